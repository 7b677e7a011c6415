"""Exact quantiles and the anomaly decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_ROWS = 5_000_000
ACCURACY = 10_000


def exact_quantile(df: DataFrame, col: str, q: float, exact_rows: int = EXACT_ROWS) -> float | None:
    """Linear-interpolated quantile of a column, exact at any size.

    Big inputs are bracketed with an approximate quantile; the rank is then
    resolved exactly among the rows inside the bracket.
    """
    vals = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    n = vals.count()
    return _quantile(vals, n, float(q) * (n - 1), exact_rows) if n else None


def _quantile(vals: DataFrame, n: int, rank: float, exact_rows: int) -> float:
    """Value at a fractional 0-based rank of the sorted column."""
    if n <= exact_rows or n <= 2:
        at = rank / (n - 1) if n > 1 else 0.0
        return float(vals.agg(F.percentile("v", F.lit(float(min(max(at, 0.0), 1.0))))).first()[0])
    at = rank / (n - 1)
    slack = 4.0 / ACCURACY
    while True:
        probes = [max(at - slack, 0.0), min(at + slack, 1.0)]
        lo, hi = vals.agg(F.percentile_approx("v", probes, ACCURACY)).first()[0]
        cut = vals.agg(
            F.count_if(F.col("v") < lo).alias("below"), F.count_if(F.col("v").between(lo, hi)).alias("inside")
        ).first()
        below, inside = cut["below"], cut["inside"]
        if lo == hi and below <= rank and rank + 1 < below + inside:
            return float(lo)
        if below <= rank and (rank + 1 < below + inside or probes[1] == 1.0) and inside < n:
            return _quantile(vals.where(F.col("v").between(lo, hi)), inside, rank - below, exact_rows)
        if inside >= n:  # one value or no progress left: nothing more to cut off
            return float(vals.agg(F.percentile("v", F.lit(at))).first()[0])
        slack *= 4


def contamination_offset(scores: DataFrame, contamination: float, col: str = "score") -> float | None:
    """Score below which the ``contamination`` share of the training rows lies."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    return exact_quantile(scores, col, contamination)


def flag_anomalies(scores: DataFrame, offset: float, col: str = "score") -> DataFrame:
    """Adds anomaly_score = score - offset and is_anomaly = anomaly_score < 0."""
    return scores.withColumn("anomaly_score", F.col(col) - F.lit(offset)).withColumn(
        "is_anomaly", F.col("anomaly_score") < 0
    )


def run_stats(blk: DataFrame, vocab_size: int) -> DataFrame:
    return blk.agg(
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.round(F.count_if("is_anomaly") / F.greatest(F.count("*"), F.lit(1)), 4).alias("anomaly_rate"),
        F.round(F.avg("anomaly_score"), 4).alias("mean_anomaly_score"),
        F.round(F.min("anomaly_score"), 4).alias("min_anomaly_score"),
        F.count("*").alias("total_blocks"),
        F.lit(vocab_size).cast("long").alias("vocab_size"),
    )
