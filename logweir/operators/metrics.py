"""Counters, gauges and histograms over a table of request records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds in seconds
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(req: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    return req.groupBy("name", *labels).agg(F.sum(value).alias("total"))


def histogram(req: DataFrame, labels: list[str], value: str = "value", buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(name, labels, le, cumulative, sum, count): observations up to each
    bound, in one aggregate; ``le`` is text and ends with 'Inf'."""
    v = F.col(value)
    agg = req.groupBy("name", *labels).agg(
        *[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
        F.count("*").alias("count"), F.sum(v).alias("sum"),
    )
    bounds = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    bounds.append(F.struct(F.lit("Inf").alias("le"), F.col("count").alias("cumulative")))
    return agg.select("name", *labels, "sum", "count", F.inline(F.array(*bounds)))


def gauges(req: DataFrame, labels: list[str], value: str = "value", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Latest value per name and label set; ``tie`` orders equal times."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return req.groupBy("name", *labels).agg(F.max_by(value, order).alias("value"))


def detect_totals(lines: DataFrame, ev: DataFrame, blk: DataFrame, inc: DataFrame) -> DataFrame:
    """One row: lines, events, parse errors, blocks, anomalies, incidents, templates."""
    one = F.lit(1).alias("_k")
    parts = [
        lines.agg(F.count("*").alias("total_lines")),
        ev.agg(F.count("*").alias("total_events"), F.count_distinct("template").alias("templates")),
        blk.agg(F.count("*").alias("total_blocks"), F.count_if("is_anomaly").alias("anomalies")),
        inc.agg(F.count("*").alias("incidents")),
    ]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "_k")
    return out.withColumn("parse_errors", F.col("total_lines") - F.col("total_events")).drop("_k")
