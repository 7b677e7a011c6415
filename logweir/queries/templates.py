"""Template mining and template quality (C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators import template_quality as Q
from logweir.operators import templates as T
from logweir.operators.ids import dense_by_number
from logweir.queries.base import events, lines, query, r6, table, tevents, wide_table, with_
from logweir.queries.mined_sql import mined
from logweir.session import materialize, work_dir
from logweir.sources import stores
from logweir.sources.lines import explode_text


def _parsed(spark, sf):
    """Parsed events with their signature, stored once."""
    return materialize(T.with_signature(events(spark, sf)), "parsed")


_TPL = "select template_id, template, size, first_line from "


def _recursive(body: str, **ctes: str) -> str:
    return with_("sev", body, **ctes).replace("with ", "with recursive ", 1)


@query("mine_templates", _recursive(_TPL + "mt", **mined("sev", "mt")))
def mine_templates(spark, sf):
    return T.mine_templates(_parsed(spark, sf)).select("template_id", "template", "size", "first_line")


@query("mine_document_templates")
def mine_document_templates(spark, sf):
    """Mining on messy text: every line of every document."""
    docs = explode_text(wide_table(spark, sf, "documents"), "text", "doc_id")
    ev = docs.select(F.col("raw").alias("content"), (F.col("doc_id") * 1_000_000 + F.col("line_id")).alias("line_id"))
    # not stored: both passes over the lines read the documents again
    return T.mine_templates(ev).select("template_id", "template", "size", "first_line")


# templates to match against: signatures, plus a broader and a literal variant
_CATALOG = r"""
  select template_id, template from tpl
  union all select template_id + 100, replace(template, 'block', '<*>') from tpl where contains(template, 'block')
  union all select min(line_id) + 1000, regexp_replace(trim(content), '\s+', ' ', 'g') from ev
    where regexp_matches(content, '^PacketResponder') group by content"""


def _catalog(spark, sf):
    ev = _parsed(spark, sf)
    tpl = T.number_templates(T.with_signature(ev)).select("template_id", "template")
    broad = tpl.where(F.contains("template", F.lit("block"))).select(
        F.col("template_id") + 100, F.replace("template", F.lit("block"), F.lit("<*>"))
    )
    literal = ev.where(F.col("content").rlike("^PacketResponder")).groupBy("content").agg(
        (F.min("line_id") + 1000).alias("template_id")
    ).select("template_id", F.array_join(X.tokens(F.col("content")), " "))
    out = tpl.union(broad).union(literal)
    return ev, materialize(out.withColumn("tokens", F.split("template", " ")), "catalog")


@query("assign_templates", with_("tpl", r"""
  select line_id, coalesce(template_id, -1) as template_id, coalesce(template, content) as template from (
    select e.line_id, e.content, c.template_id, c.template,
      row_number() over (partition by e.line_id order by len(list_filter(string_split(c.template, ' '), lambda x: x = '<*>')) desc, c.template_id) as rn
    from (select line_id, content, string_split_regex(trim(content), '\s+') as t from ev) e
    left join (select *, string_split(template, ' ') as ct from cat) c
      on len(e.t) = len(c.ct) and len(list_filter(list_zip(e.t, c.ct), lambda p: p[2] <> '<*>' and p[1] <> p[2])) = 0) x
  where rn = 1""", cat=_CATALOG))
def assign_templates(spark, sf):
    return T.assign_templates(*_catalog(spark, sf)).select("line_id", "template_id", "template")


@query("signature_template", with_("sev", "select line_id, template as signature from sev"))
def signature_template(spark, sf):
    return events(spark, sf).select("line_id", X.signature(F.col("content")).alias("signature"))


@query("template_numbering", with_("tpl", "select template_id, template, size, first_line from tpl"))
def template_numbering(spark, sf):
    return T.number_templates(T.with_signature(events(spark, sf)))


@query("template_count", with_("sev", "select count(distinct template) as template_count from sev"))
def template_count(spark, sf):
    return T.template_count(T.with_signature(events(spark, sf)), "signature")


_HALVES = {
    "early": "select * from sev where line_id <= (select max(line_id) // 2 from ev)",
    "late": "select * from sev where line_id > (select max(line_id) // 2 from ev)",
}


@query("mine_incremental", _recursive(_TPL + "m2", **_HALVES, **mined("early", "m1"), **mined("late", "m2", "m1")))
def mine_incremental(spark, sf):
    """First half, then the whole log on top of the stored templates."""
    ev = _parsed(spark, sf)
    half = ev.agg(F.max("line_id")).first()[0] // 2
    first = T.mine_templates(ev.where(F.col("line_id") <= half))
    path = f"{work_dir(spark)}/templates-{uuid.uuid4().hex}"
    stores.save_templates(first, path)
    seed = stores.load_templates(spark, path)
    return T.mine_templates(ev.where(F.col("line_id") > half), seed=seed).select("template_id", "template", "size", "first_line")


@query("template_store", _recursive(_TPL + "mt", **mined("sev", "mt")))
def template_store(spark, sf):
    path = f"{work_dir(spark)}/templates-{uuid.uuid4().hex}"
    stores.save_templates(T.mine_templates(_parsed(spark, sf)), path)
    return stores.load_templates(spark, path).select("template_id", "template", "size", "first_line")


@query("sweep_templates")
def sweep_templates(spark, sf):
    return r6(Q.rank_combos(Q.sweep_templates(spark, lines(spark, sf))))


def _partly(spark, sf):
    """Assigned ids with every 7th template-less: id -1."""
    ids = F.when(F.col("line_id") % 7 == 0, -1).otherwise(F.col("template_id"))
    return tevents(spark, sf).select("line_id", ids.cast("long").alias("template_id"), "block_id", "level")


_PARTLY = "select line_id, case when line_id % 7 = 0 then -1 else template_id end as template_id from tev"


@query("coverage_rate", with_("tev", """
  select round(avg(case when template_id >= 0 then 1.0 else 0.0 end), 6) as coverage_rate from p""", p=_PARTLY))
def coverage_rate(spark, sf):
    return r6(Q.coverage(_partly(spark, sf)))


@query("wildcard_density", with_("tpl", """
  select round(avg(len(list_filter(t, lambda x: x = '<*>')) / len(t)), 6) as wildcard_density
  from (select string_split(template, ' ') as t from tpl) x"""))
def wildcard_density(spark, sf):
    tpl = T.number_templates(T.with_signature(events(spark, sf)))
    return r6(Q.wildcard_density(tpl.withColumn("tokens", F.split("template", " "))))


@query("template_entropy", with_("tev", """
  select round(coalesce(-sum(n / t * log2(n / t)), 0.0), 6) as template_entropy from (
    select cast(count(*) as double) as n, sum(count(*)) over () as t from p where template_id >= 0 group by template_id) x""", p=_PARTLY))
def template_entropy(spark, sf):
    return r6(Q.template_entropy(_partly(spark, sf)))



@query("convergence", with_("tev", """
  select round(1.0 - count(*) filter (where f <= (select count(*) // 2 from ev)) / count(*), 6) as convergence
  from (select block_id, min(line_id) as f from tev group by block_id) x"""))
def convergence(spark, sf):
    """With blocks as labels, which keep appearing through the log."""
    ev = tevents(spark, sf)
    first = ev.groupBy("block_id").agg(F.min("line_id").alias("first_line"))
    ids = dense_by_number(first, "first_line", "template_id").select("block_id", "template_id")
    return r6(Q.convergence(ev.drop("template_id").join(ids, "block_id")))


_GT = r"""select template_id - 1 as idx, concat('(?i)', replace(regexp_replace(replace(template, '<*>', '[*]'),
   '([.^$*+?{}\[\]\\|()\-&~#\s])', '\\\1', 'g'), '\[\*\]', '.*')) as regex from tpl where template_id % 3 <> 0"""


@query("assign_ground_truth", with_("tpl", """
  select line_id, coalesce(min(idx), -1) as gt_id from ev left join gt on regexp_matches(content, regex) group by line_id""", gt=_GT))
def assign_ground_truth(spark, sf):
    """Against a catalog that misses every third template."""
    from logweir.sources.lines import catalog_regex

    ev = events(spark, sf)
    tpl = T.number_templates(T.with_signature(ev)).where("template_id % 3 <> 0")
    catalog = tpl.select(
        (F.col("template_id") - 1).alias("idx"),
        catalog_regex(F.replace("template", F.lit("<*>"), F.lit("[*]"))).alias("regex"),
    )
    return T.assign_catalog(ev, catalog).select("line_id", "gt_id")


def _ari_sql(src: str, a: str, b: str) -> str:
    return f"""
  with c as (select {a} as a, {b} as b, cast(count(*) as double) as n from {src} group by 1, 2),
  s as (select sum(n * (n - 1) / 2) as s, sum(n) as n from c),
  l as (select sum(n * (n - 1) / 2) as s from (select a, sum(n) as n from c group by a) x),
  r as (select sum(n * (n - 1) / 2) as s from (select b, sum(n) as n from c group by b) x)
  select '{src}' as src, round((s.s - l.s * r.s / (s.n * (s.n - 1) / 2)) / ((l.s + r.s) / 2 - l.s * r.s / (s.n * (s.n - 1) / 2)), 6) as ari
  from s, l, r"""


@query("adjusted_rand", f"select * from ({_ari_sql('lineitem', 'l_returnflag', 'l_linestatus')}) x "
       f"union all select * from ({_ari_sql('orders', 'o_orderpriority', 'o_orderstatus')}) y")
def adjusted_rand(spark, sf):
    a = Q.adjusted_rand(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    b = Q.adjusted_rand(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return r6(a.withColumn("src", F.lit("lineitem")).unionByName(b.withColumn("src", F.lit("orders"))))


_METRICS = """
  select user_id as sim_th, event_type as depth, avg(value) / 500 as coverage_rate, min(value) / 100 as convergence,
    stddev_pop(value) / 20 as template_entropy, count(*) / 1000 as wildcard_density from events group by 1, 2"""


def _metrics(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("sim_th"), F.col("event_type").alias("depth")).agg(
        (F.avg("value") / 500).alias("coverage_rate"), (F.min("value") / 100).alias("convergence"),
        (F.stddev_pop("value") / 20).alias("template_entropy"), (F.count("*") / 1000).alias("wildcard_density"),
    )


_SCORE = "0.35e0 * coverage_rate + 0.30e0 * convergence + 0.20e0 * least(template_entropy / 6, 1) - 0.15e0 * wildcard_density"


@query("tuning_score", f"select sim_th, depth, round({_SCORE}, 6) as composite from ({_METRICS}) m")
def tuning_score(spark, sf):
    return r6(Q.composite(_metrics(spark, sf)).select("sim_th", "depth", "composite"))


@query("rank_combos", f"""
  select sim_th, depth, composite, rank, rank = 1 as is_best, row_number() over (order by ari desc, rank) = 1 as is_best_ari from (
    select sim_th, depth, composite, ari, row_number() over (order by composite desc, sim_th, depth) as rank from (
      select sim_th, depth, round({_SCORE}, 6) as composite, round(wildcard_density, 6) as ari from ({_METRICS}) m) x) y""")
def rank_combos(spark, sf):
    m = Q.composite(_metrics(spark, sf)).select(
        "sim_th", "depth", F.round("composite", 6).alias("composite"), F.round("wildcard_density", 6).alias("ari")
    )
    return Q.rank_combos(m).select(
        "sim_th", "depth", "composite", F.col("rank").cast("long").alias("rank"), "is_best", "is_best_ari"
    )
