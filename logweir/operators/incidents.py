"""Anomalous blocks -> incidents, their lines, templates and time range.

Whole results are long tables (one row per incident block or line).  An incident
row is a document: it names all its blocks and templates, and shows its first lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.dbscan import dbscan
from logweir.operators.features import dense, standardize
from logweir.operators.ids import dense_by_order
from logweir.session import materialize

# Digest and preview sizes, severity bands
DIGEST_BLOCKS, DIGEST_LINES = 3, 5
PREVIEW_LINES = 50
RED, YELLOW = 0.5, 0.2


def anomalies_only(blk: DataFrame) -> DataFrame:
    return blk.where("is_anomaly")


def noise_as_singletons(clustered: DataFrame) -> DataFrame:
    """Adds ``incident_key``: noise points (null cluster) stand alone, before
    all clusters in the key's order."""
    noise = F.col("cluster").isNull()
    key = F.struct(
        F.when(noise, 0).otherwise(1).alias("kind"), F.coalesce("cluster", "block_id").alias("first_block")
    )
    return clustered.withColumn("incident_key", key)


def number_incidents(keyed: DataFrame) -> DataFrame:
    """Adds incident_id 0..k: noise in block order, then clusters by first block."""
    keys = keyed.select("incident_key").distinct().select("incident_key", "incident_key.*")
    ids = dense_by_order(keys, ["kind", "first_block"], "incident_id", 0).select("incident_key", "incident_id")
    return keyed.join(ids, "incident_key").drop("incident_key")


def severity(mean_score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), -mean_score))


def incident_rows(members: DataFrame) -> DataFrame:
    """(incident_id, size, mean_anomaly_score, severity), unrounded."""
    return members.groupBy("incident_id").agg(
        F.count("*").alias("size"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        severity(F.avg("anomaly_score")).alias("severity"),
    )


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean_anomaly_score", F.round("mean_anomaly_score", 4)).withColumn(
        "severity", F.round("severity", 4)
    )


def incident_events(members: DataFrame, ev: DataFrame) -> DataFrame:
    """Events of the incidents' blocks."""
    return ev.join(members.select("incident_id", "block_id"), "block_id")


def incident_lines(members: DataFrame, ev: DataFrame) -> DataFrame:
    """(incident_id, line_no, block_id, line_id, timestamp, content, template):
    lines in (block, line) order, numbered from 1 per incident."""
    rows = incident_events(members, ev).select(
        "incident_id", "block_id", "line_id", "timestamp", "content", "template"
    )
    ranked = dense_by_order(rows, ["incident_id", "block_id", "line_id"], "_g")
    start = ranked.groupBy("incident_id").agg(F.min("_g").alias("_g0"))
    return ranked.join(start, "incident_id").withColumn(
        "line_no", F.col("_g") - F.col("_g0") + 1
    ).drop("_g", "_g0")


def incident_templates(lines: DataFrame) -> DataFrame:
    """Distinct non-empty templates per incident."""
    return lines.where("template <> ''").select("incident_id", "template").distinct()


def incident_time_range(lines: DataFrame) -> DataFrame:
    """Smallest and largest non-empty timestamp text."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    return lines.groupBy("incident_id").agg(
        F.coalesce(F.min(ts), F.lit("")).alias("start"), F.coalesce(F.max(ts), F.lit("")).alias("end")
    )


def first_k(df: DataFrame, order: str, value: str, k: int, name: str) -> DataFrame:
    """(incident_id, array of the first ``k`` values); at most k rows per
    incident leave any task."""
    w = Window.partitionBy("incident_id").orderBy(order)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_r", F.col(value).alias("v"))))
    return top.groupBy("incident_id").agg(F.transform(listed, lambda s: s["v"]).alias(name))


def all_of(df: DataFrame, value: str, name: str) -> DataFrame:
    """(incident_id, sorted array of all values)."""
    return df.groupBy("incident_id").agg(F.sort_array(F.collect_list(value)).alias(name))


def enrich(members: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per incident with counts, time range, all block ids and templates,
    and its first lines."""
    none = F.array().cast("array<string>")
    counts = lines.groupBy("incident_id").agg(F.count("*").alias("line_count"))
    tpl = incident_templates(lines)
    n_tpl = tpl.groupBy("incident_id").agg(F.count("*").alias("template_count"))
    head = lines.where(F.col("line_no") <= PREVIEW_LINES)
    out = (
        incident_rows(members)
        .join(all_of(members, "block_id", "block_ids"), "incident_id")
        .join(counts, "incident_id", "left")
        .join(n_tpl, "incident_id", "left")
        .join(incident_time_range(lines), "incident_id", "left")
        .join(first_k(head, "line_no", "content", PREVIEW_LINES, "log_lines"), "incident_id", "left")
        .join(all_of(tpl, "template", "templates"), "incident_id", "left")
    )
    return out.select(
        "incident_id", "size", "mean_anomaly_score", "severity", "block_ids",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("template_count", F.lit(0)).alias("template_count"),
        F.coalesce("log_lines", none).alias("log_lines"),
        F.coalesce("templates", none).alias("templates"),
        F.struct(F.coalesce("start", F.lit("")).alias("start"), F.coalesce("end", F.lit("")).alias("end")).alias("time_range"),
    )


def severity_band(rows: DataFrame) -> DataFrame:
    s = F.col("severity")
    band = F.when(s > RED, "red").when(s > YELLOW, "yellow").otherwise("green")
    return rows.withColumn("band", band)


def listed(values: Column, total: Column, k: int, sep: str = ", ") -> Column:
    """First k values and '(+n more)' when there are more."""
    text = F.array_join(F.slice(values, 1, k), sep)
    return F.when(total > k, F.concat(text, F.format_string(" (+%d more)", total - k))).otherwise(text)


def digest(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(incident_id, blocks, head): the first three block ids as text and the
    first five lines."""
    blocks = first_k(members, "block_id", "block_id", DIGEST_BLOCKS, "_b").join(
        members.groupBy("incident_id").agg(F.count("*").alias("_n")), "incident_id"
    )
    head = first_k(lines.where(F.col("line_no") <= DIGEST_LINES), "line_no", "content", DIGEST_LINES, "_h")
    return blocks.join(head, "incident_id", "left").select(
        "incident_id",
        listed(F.col("_b"), F.col("_n"), DIGEST_BLOCKS).alias("blocks"),
        F.coalesce(F.array_join("_h", "\n"), F.lit("")).alias("head"),
    )


def cluster_blocks(blk: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """(incident_id, block_id, anomaly_score) of the anomalous blocks; vectors
    (``features``, or sparse ``idx`` and ``val``) are scaled over the anomalies
    only, so only the anomalies are ever made dense."""
    hot = anomalies_only(blk)
    if "features" in blk.columns:
        hot = materialize(hot.select("block_id", "anomaly_score", "features"), "anomalies")
    else:
        hot = materialize(hot.select("block_id", "anomaly_score", "idx", "val"), "anomalies")
        last = hot.agg(F.max(F.array_max("idx"))).first()[0]
        hot = hot.withColumn("features", dense((last if last is not None else -1) + 1)).drop("idx", "val")
    clustered = dbscan(standardize(hot), eps, min_samples).drop("features")
    keyed = materialize(noise_as_singletons(clustered), "clustered")
    return number_incidents(keyed).select("incident_id", "block_id", "anomaly_score")


def cluster(blk: DataFrame, ev: DataFrame, eps: float = 0.5, min_samples: int = 2):
    """(members, lines, incidents) of decided blocks."""
    members = materialize(cluster_blocks(blk, eps, min_samples), "members")
    lines = materialize(incident_lines(members, ev), "incident_lines")
    return members, lines, enrich(members, lines)
