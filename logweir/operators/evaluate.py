"""Scores against labels, leaderboards and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_labels(blk: DataFrame, labels: DataFrame) -> DataFrame:
    """(block_id, predicted, actual) of the blocks known to both sides."""
    return blk.select("block_id", F.col("is_anomaly").alias("predicted")).join(
        labels.select("block_id", F.col("is_anomaly").alias("actual")), "block_id"
    )


def confusion(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    p, a = F.col("predicted"), F.col("actual")
    return df.groupBy(*by).agg(
        F.count_if(p & a).alias("true_positives"),
        F.count_if(p & ~a).alias("false_positives"),
        F.count_if(~p & a).alias("false_negatives"),
        F.count_if(~p & ~a).alias("true_negatives"),
        F.count("*").alias("total_blocks"),
    )


def prf(conf: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; 0 where a denominator is 0."""
    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    tp = F.col("true_positives")
    out = conf.withColumn("precision", ratio(tp, tp + F.col("false_positives"))).withColumn(
        "recall", ratio(tp, tp + F.col("false_negatives"))
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def evaluate(blk: DataFrame, labels: DataFrame) -> DataFrame:
    return prf(confusion(join_labels(blk, labels)))


def leaderboard(rows: DataFrame) -> DataFrame:
    """Runs by falling f1, earlier runs first among equals; ``is_best`` marks
    the first strictly best one."""
    top = rows.orderBy(F.desc("f1"), "seq").limit(1).select(F.col("seq").alias("_best"))
    return (
        rows.join(F.broadcast(top), F.col("seq") == F.col("_best"), "left")  # one row
        .withColumn("is_best", F.col("_best").isNotNull()).drop("_best")
        .orderBy(F.desc("f1"), "seq")
    )


def compare_runs(runs: DataFrame, columns: list[str], order: str = "start_time", n: int = 5) -> DataFrame:
    """The n most recent runs with the chosen columns as text, '-' when absent."""
    shown = [
        (F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in runs.columns else F.lit("-")).alias(c)
        for c in columns
    ]
    recent = runs.orderBy(F.desc(order), F.desc("run_id")).limit(n)
    return recent.select(F.substring(F.col("run_id").cast("string"), 1, 8).alias("run_id"), *shown)


def answer_eval(quality: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: means of the judged scores and totals of all model calls."""
    q = quality.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("relevance", "specificity", "actionability")]
    )
    q = q.withColumn(
        "mean_quality", (F.col("mean_relevance") + F.col("mean_specificity") + F.col("mean_actionability")) / 3.0
    )
    ms = F.col("latency_ms")
    u = usage.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.avg(F.when(ms > 0, ms)), F.lit(0.0)).alias("mean_latency_ms"),
    )
    one = F.lit(1).alias("_k")
    return q.select("*", one).join(u.select("*", one), "_k").drop("_k")
