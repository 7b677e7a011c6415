"""Block features (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import features as D
from logweir.queries.base import query, r6, table, tevents, with_

# template ids with a hole: every 11th line has no template
_HOLES = "select line_id, block_id, level, case when line_id % 11 = 0 then -1 else template_id end as template_id from tev"


def _ev(spark, sf):
    ids = F.when(F.col("line_id") % 11 == 0, -1).otherwise(F.col("template_id")).cast("long")
    return tevents(spark, sf).withColumn("template_id", ids)


@query("group_blocks", with_("ev", "select block_id, count(*) as event_count from ev where block_id <> '' group by block_id"))
def group_blocks(spark, sf):
    return D.block_sizes(tevents(spark, sf))


@query("template_vocab", with_("tev", """
  select template_id, row_number() over (order by template_id) - 1 as col from (select distinct template_id from h where template_id >= 0) x""", h=_HOLES))
def template_vocab(spark, sf):
    return D.template_vocab(_ev(spark, sf))


@query("template_freq", with_("tev", """
  select block_id, template_id, count(*) as n from h where template_id >= 0 group by 1, 2""", h=_HOLES))
def template_freq(spark, sf):
    ev = _ev(spark, sf)
    return D.template_freq(ev, D.template_vocab(ev))


def _stat(name: str, expr: str):
    @query(name, with_("tev", f"select block_id, {expr} as {name} from h group by block_id", h=_HOLES))
    def run(spark, sf):
        return D.block_stats(_ev(spark, sf)).select("block_id", name)


_stat("event_count", "count(*)")
_stat("unique_templates", "count(distinct case when template_id >= 0 then template_id end)")
_stat("event_span", "max(line_id) - min(line_id)")
_stat("error_count", "count(*) filter (where level in ('ERROR','FATAL'))")
_stat("warn_count", "count(*) filter (where level = 'WARN')")

_ENTROPY = """
  select b.block_id, round(coalesce(-sum(n / t * log2(n / t)), 0.0), 6) + 0.0 as sequence_entropy
  from (select distinct block_id from h) b left join (
    select block_id, cast(count(*) as double) as n, sum(count(*)) over (partition by block_id) as t
    from h where template_id >= 0 group by block_id, template_id) x using (block_id) group by b.block_id"""
_PAIRS = """select block_id, template_id as cur, lag(template_id) over (partition by block_id order by line_id) as prev
  from h where template_id >= 0"""


@query("sequence_entropy", with_("tev", f"select block_id, abs(sequence_entropy) as sequence_entropy from ({_ENTROPY}) e", h=_HOLES))
def sequence_entropy(spark, sf):
    out = D.sequence_entropy(_ev(spark, sf))
    return out.select("block_id", F.abs(F.round("sequence_entropy", 6)).alias("sequence_entropy"))


_RATIO = "round(coalesce(avg(case when prev is null then null when prev = cur then 1.0 else 0.0 end), 0.0), 6)"


@query("repeat_ratio", with_("tev", f"""
  select b.block_id, {_RATIO} as repeat_ratio from (select distinct block_id from h) b left join p using (block_id)
  group by b.block_id""", h=_HOLES, p=_PAIRS))
def repeat_ratio(spark, sf):
    return r6(D.repeat_ratio(_ev(spark, sf)))


@query("unique_bigrams", with_("tev", """
  select b.block_id, count(distinct case when prev is not null then prev * 1000000 + cur end) as unique_bigrams
  from (select distinct block_id from h) b left join p using (block_id) group by b.block_id""", h=_HOLES, p=_PAIRS))
def unique_bigrams(spark, sf):
    return D.unique_bigrams(_ev(spark, sf))


_FV = f"""
  , v as (select template_id, row_number() over (order by template_id) - 1 as col from (select distinct template_id from h where template_id >= 0) x),
  w as (select count(*) as w from v), b as (select distinct block_id from h),
  freq as (select b.block_id, v.col as pos, cast(coalesce(n, 0) as double) as x from b cross join v
    left join (select block_id, template_id, count(*) as n from h group by 1, 2) c using (block_id, template_id)),
  st as (select block_id, cast(count(*) as double) as x0, cast(count(distinct case when template_id >= 0 then template_id end) as double) as x1,
    cast(max(line_id) - min(line_id) as double) as x2, cast(count(*) filter (where level in ('ERROR','FATAL')) as double) as x6,
    cast(count(*) filter (where level = 'WARN') as double) as x7 from h group by block_id),
  en as ({_ENTROPY}),
  pr as (select b.block_id, {_RATIO} as x4, cast(count(distinct case when prev is not null then prev * 1000000 + cur end) as double) as x5
    from b left join p using (block_id) group by b.block_id),
  ex as (select block_id, unnest([x0, x1, x2, abs(sequence_entropy), x4, x5, x6, x7]) as x, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as o
    from st join en using (block_id) join pr using (block_id))
"""


def _full(body: str) -> str:
    head = with_("tev", "", h=_HOLES, p=_PAIRS).rstrip()
    return head + _FV + body


_LONG = "select block_id, cast(pos as bigint) as pos, x from freq union all select block_id, cast(w + o as bigint), x from ex, w"


@query("feature_vector", _full(_LONG))
def feature_vector(spark, sf):
    out = D.feature_vector(_ev(spark, sf), "full").select("block_id", F.posexplode("features").alias("pos", "x"))
    return out.select("block_id", F.col("pos").cast("long").alias("pos"), F.abs(F.round("x", 6)).alias("x"))


@query("feature_vector_freq_only", _full("select block_id, cast(pos as bigint) as pos, x from freq"))
def feature_vector_freq_only(spark, sf):
    out = D.feature_vector(_ev(spark, sf), "freq_only").select("block_id", F.posexplode("features").alias("pos", "x"))
    return out.select("block_id", F.col("pos").cast("long").alias("pos"), "x")


@query("block_templates", with_("tev", """
  select block_id, string_agg(template_id, ',' order by template_id) as template_ids
  from (select distinct block_id, template_id from h) x group by block_id""", h=_HOLES))
def block_templates(spark, sf):
    return D.block_stats(_ev(spark, sf)).select(
        "block_id", F.array_join(F.transform("template_ids", lambda t: t.cast("string")), ",").alias("template_ids")
    )


@query("standardize", """
  with x as (select vec_id, unnest(embedding) as e, unnest(generate_series(0, 63)) as pos from embeddings),
  s as (select pos, avg(cast(e as double)) as m, stddev_pop(cast(e as double)) as sd from x group by pos)
  select vec_id, pos, round((cast(e as double) - m) / case when sd > 0 then sd else 1 end, 4) as x from x join s using (pos)""")
def standardize(spark, sf):
    emb = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("features")
    )
    out = D.standardize(emb).select("vec_id", F.posexplode("features").alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("x"))
