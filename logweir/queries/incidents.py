"""Clustering and incidents (F)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweir.operators import incidents as I
from logweir.operators.dbscan import dbscan as run_dbscan
from logweir.operators.dbscan import number_clusters
from logweir.operators.metrics import detect_totals as detect_totals_of
from logweir.operators.neighbors import epsilon_neighbors as eps_counts
from logweir.plans import flows
from logweir.queries.base import lines, query, r6, table, tevents, with_
from logweir.queries.models import _FLAGGED, _SCORED, _flagged
from logweir.session import materialize, work_dir
from logweir.sources import stores
from logweir.sources.lines import scan_incidents as read_incidents


@query("anomalies_only", with_("ev", "select block_id, round(anomaly_score, 9) as anomaly_score from f where is_anomaly", s=_SCORED, f=_FLAGGED))
def anomalies_only(spark, sf):
    return I.anomalies_only(_flagged(spark, sf)).select("block_id", F.round("anomaly_score", 9).alias("anomaly_score"))


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("features")
    )


_NEAR = """select a.vec_id as a, b.vec_id as b from e a join e b on sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= 0.9"""


@query("dbscan", f"""
  with recursive e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
  near as materialized ({_NEAR}),
  core as (select a from near group by a having count(*) >= 4),
  link as materialized (select a, b from near where a in (from core) and b in (from core)),
  reach(a, root) as (select a, a from core union select l.b, r.root from reach r join link l on l.a = r.a and r.root < l.b),
  comp as (select a, min(root) as root from reach group by a),
  own as (select vec_id, coalesce(c.root, (select min(k.root) from near n join comp k on k.a = n.b where n.a = vec_id)) as root from e left join comp c on c.a = vec_id),
  first as (select root, min(vec_id) as low from own where root is not null group by root)
  select vec_id, case when root is null then -1 else dense_rank() over (order by low nulls last) - 1 end as label from own left join first using (root)""")
def dbscan(spark, sf):
    out = number_clusters(materialize(run_dbscan(_embeddings(spark, sf), 0.9, 4, "vec_id"), "clustered"))
    return out.select("vec_id", "label")


@query("epsilon_neighbors", """
  with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
  select a.vec_id, count(*) as n_neighbors from e a join e b
    on sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= 0.9
  group by a.vec_id""")
def epsilon_neighbors(spark, sf):
    return eps_counts(_embeddings(spark, sf), 0.9, "vec_id")


# a clustering SQL can do: blocks of one user's digit sum; every 4th block is noise
_MEMB = """select block_id, anomaly_score, case when cast(substr(block_id, 5) as bigint) % 4 = 0 then null else
    min(block_id) filter (where cast(substr(block_id, 5) as bigint) % 4 <> 0) over (partition by cast(substr(block_id, 5) as bigint) % 10) end as cluster
  from f where is_anomaly"""
_KEYED = "select block_id, anomaly_score, case when cluster is null then 0 else 1 end as kind, coalesce(cluster, block_id) as first_block from m"
_NUMBERED = "select block_id, anomaly_score, dense_rank() over (order by kind, first_block) - 1 as incident_id from k"
_INC = {"s": _SCORED, "f": _FLAGGED, "m": _MEMB, "k": _KEYED, "n": _NUMBERED}


def _clustered(spark, sf):
    hot = I.anomalies_only(_flagged(spark, sf)).select("block_id", "anomaly_score")
    num = F.substring("block_id", 5, 20).cast("long")
    hot = hot.withColumn("g", num % 10).withColumn("noise", num % 4 == 0)
    first = hot.where("not noise").groupBy("g").agg(F.min("block_id").alias("first"))
    return hot.join(first, "g", "left").select(
        "block_id", "anomaly_score", F.when(~F.col("noise"), F.col("first")).alias("cluster")
    )


def _members(spark, sf):
    return materialize(I.number_incidents(I.noise_as_singletons(_clustered(spark, sf))), "members").drop("cluster")


@query("noise_as_singletons", with_("ev", "select block_id, kind, first_block from k", **{k: _INC[k] for k in "sfmk"}))
def noise_as_singletons(spark, sf):
    return I.noise_as_singletons(_clustered(spark, sf)).select("block_id", "incident_key.kind", "incident_key.first_block")


@query("incident_numbering", with_("ev", "select block_id, incident_id from n", **_INC))
def incident_numbering(spark, sf):
    return _members(spark, sf).select("block_id", "incident_id")


@query("incident_severity", with_("ev", """
  select incident_id, round(greatest(0.0, least(1.0, -avg(anomaly_score) * 5)), 6) as severity from n group by incident_id""", **_INC))
def incident_severity(spark, sf):
    five = _members(spark, sf).withColumn("anomaly_score", F.col("anomaly_score") * 5)
    return r6(I.incident_rows(five).select("incident_id", "severity"))


_LINES = """select n.incident_id, row_number() over (partition by n.incident_id order by e.block_id, e.line_id) as line_no,
  e.block_id, e.line_id, e.timestamp, e.content, e.template from n join sev e using (block_id)"""


def _inc_lines(spark, sf):
    return I.incident_lines(_members(spark, sf), tevents(spark, sf))


@query("incident_enrich", with_("sev", "select incident_id, line_no, block_id, line_id, content, template from il", **_INC, il=_LINES))
def incident_enrich(spark, sf):
    """The whole lines of every incident in order."""
    return _inc_lines(spark, sf).select("incident_id", "line_no", "block_id", "line_id", "content", "template")


@query("incident_templates", with_("sev", "select distinct incident_id, template from il where template <> ''", **_INC, il=_LINES))
def incident_templates(spark, sf):
    return I.incident_templates(_inc_lines(spark, sf))


@query("incident_preview", with_("sev", """
  select incident_id, line_count, template_count, array_to_string(lines[1:50], '|') as log_lines, time_from, time_to from (
    select incident_id, count(*) as line_count, count(distinct template) as template_count,
      list(content order by line_no) as lines, min(timestamp) as time_from, max(timestamp) as time_to from il group by incident_id) x""", **_INC, il=_LINES))
def incident_preview(spark, sf):
    """One row per incident as the prompts see it: counts, range, first 50 lines."""
    members = _members(spark, sf)
    inc = I.enrich(members, materialize(I.incident_lines(members, tevents(spark, sf)), "incident_lines"))
    return inc.select(
        "incident_id", "line_count", "template_count", F.array_join("log_lines", "|").alias("log_lines"),
        F.col("time_range.start").alias("time_from"), F.col("time_range.end").alias("time_to"),
    )


@query("incident_time_range", with_("sev", """
  select incident_id, min(timestamp) as "start", max(timestamp) as "end" from il where timestamp <> '' group by incident_id""", **_INC, il=_LINES))
def incident_time_range(spark, sf):
    ev = tevents(spark, sf)
    return I.incident_time_range(I.incident_events(_members(spark, sf), ev))


_ROWS = """select incident_id, count(*) as size, round(avg(anomaly_score), 4) as mean_anomaly_score,
  round(greatest(0.0, least(1.0, -avg(anomaly_score))), 4) as severity from n group by incident_id"""


@query("incident_rollup", with_("ev", _ROWS, **_INC))
def incident_rollup(spark, sf):
    return I.rounded(I.incident_rows(_members(spark, sf)))


@query("severity_band", with_("ev", """
  select incident_id, case when s5 > 0.5 then 'red' when s5 > 0.2 then 'yellow' else 'green' end as band from (
    select incident_id, greatest(0.0, least(1.0, -avg(anomaly_score) * 8)) as s5 from n group by incident_id) x""", **_INC))
def severity_band(spark, sf):
    scaled = _members(spark, sf).withColumn("anomaly_score", F.col("anomaly_score") * 8)
    return I.severity_band(I.incident_rows(scaled)).select("incident_id", "band")


@query("incident_digest", with_("sev", """
  select incident_id, array_to_string(b[1:3], ', ') || case when len(b) > 3 then ' (+' || (len(b) - 3) || ' more)' else '' end as blocks,
    array_to_string(l[1:5], chr(10)) as head
  from (select incident_id, list(block_id order by block_id) as b from n group by incident_id) x
  join (select incident_id, list(content order by line_no) as l from il group by incident_id) y using (incident_id)""", **_INC, il=_LINES))
def incident_digest(spark, sf):
    members = _members(spark, sf)
    return I.digest(members, materialize(I.incident_lines(members, tevents(spark, sf)), "incident_lines"))


def _decided(spark, sf):
    ev = tevents(spark, sf)
    _, _, blk = flows.detect(ev)
    return ev, blk


@query("cluster")
def cluster(spark, sf):
    ev, blk = _decided(spark, sf)
    _, _, inc = I.cluster(blk, ev)
    return r6(inc.select("incident_id", "size", "severity", "line_count", "template_count"))


def detection(spark, sf):
    return flows.run_detect(materialize(lines(spark, sf), "lines"))


def _result_files(spark, sf) -> str:
    """The tables of one detection with incidents that SQL can state, written out."""
    decided, members = materialize(_flagged(spark, sf), "decided"), _members(spark, sf)
    ev = tevents(spark, sf)
    lines_ = materialize(I.incident_lines(members, ev), "incident_lines")
    incidents = I.enrich(members, lines_)
    path = f"{work_dir(spark)}/detection-{uuid.uuid4().hex}"
    stores.write_detection(path, detect_totals_of(ev, ev, decided, incidents), incidents, members, lines_, decided)
    return path


@query("write_detection", with_("sev", """
  select 'anomaly' as kind, block_id as id, 1 as n, round(anomaly_score, 6) as value from f where is_anomaly
  union all select 'block', block_id, 1, round(anomaly_score, 6) from n
  union all select 'incident', cast(incident_id as varchar), count(*), cast(count(distinct template) as double) from il group by incident_id""", **_INC, il=_LINES))
def write_detection(spark, sf):
    path = _result_files(spark, sf)
    one = F.lit(1).cast("long").alias("n")
    rows = spark.read.parquet(f"{path}/anomalies").select(F.lit("anomaly").alias("kind"), F.col("block_id").alias("id"), one, F.round("anomaly_score", 6).alias("value"))
    blocks = spark.read.parquet(f"{path}/incident_blocks").select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), one, F.round("anomaly_score", 6).alias("value"))
    docs = read_incidents(spark, f"{path}/incidents").select(
        F.lit("incident").alias("kind"), F.col("incident_id").cast("string").alias("id"), F.size("log_lines").cast("long").alias("n"), F.size("templates").cast("double").alias("value"))
    return rows.unionByName(blocks).unionByName(docs)


@query("scan_incidents_json", with_("sev", f"""
  select r.incident_id, blocks, severity, time_from, lines, md5(text) as lines_md5 from (
    select incident_id, count(*) as blocks, round(greatest(0.0, least(1.0, -avg(anomaly_score))), 6) as severity from n group by incident_id) r
  join (select incident_id, min(timestamp) as time_from, count(*) as lines, string_agg(content, chr(10) order by line_no) as text from il group by incident_id) l using (incident_id)""", **_INC, il=_LINES))
def scan_incidents_json(spark, sf):
    """Written incidents read back from their documents, all lines in order."""
    return read_incidents(spark, f"{_result_files(spark, sf)}/incidents").select(
        "incident_id", F.size("block_ids").cast("long").alias("blocks"), F.round("severity", 6).alias("severity"),
        F.col("time_range.start").alias("time_from"), F.size("log_lines").cast("long").alias("lines"),
        F.md5(F.array_join("log_lines", "\n").cast("binary")).alias("lines_md5"),
    )


@query("detect_totals")
def detect_totals(spark, sf):
    return detection(spark, sf).totals()


@query("detect_end_to_end")
def detect_end_to_end(spark, sf):
    return r6(detection(spark, sf).incidents.select(
        "incident_id", "size", "mean_anomaly_score", "severity", "line_count", "template_count"
    ))
