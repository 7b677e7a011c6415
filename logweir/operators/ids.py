"""Dense numbering without a single-partition sort of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import materialize

BUCKET = 1 << 20


def dense_by_number(
    df: DataFrame, order: str, name: str, start: int = 1, bucket: int = BUCKET, tie: str | None = None
) -> DataFrame:
    """Number rows densely by an integer column (``tie`` orders equal values).

    Rows are cut into fixed value ranges; each range is ranked on its own (at
    most ``bucket`` rows) and shifted by the running count of the ranges before.
    """
    b = F.floor(F.col(order) / bucket).cast("long")
    cut = df.withColumn("_b", b)
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*[c for c in (order, tie) if c]))
    return (
        cut.withColumn("_r", rank)
        .join(offsets, "_b")
        .withColumn(name, (F.col("_off") + F.col("_r") + (start - 1)).cast("long"))
        .drop("_b", "_r", "_off")
    )


def dense_by_order(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Number rows densely by any sortable columns or expressions (unique together).

    A range-partitioned, sorted copy is written first, so the row positions the
    offsets are computed from cannot change between the two uses.
    """
    staged = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_p", F.shiftright("_m", 33))
    sizes = staged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_p", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        staged.join(F.broadcast(offsets), "_p")  # one row per range partition
        .withColumn(name, (F.col("_off") + F.col("_m") - F.col("_m0") + start).cast("long"))
        .drop("_p", "_m", "_m0", "_off")
    )


def running_sum(
    df: DataFrame, pos: str, sums: dict[str, str], keys: tuple[str, ...] = (), bucket: int = 1 << 16
) -> DataFrame:
    """Inclusive running sums along an integer position.

    ``sums`` maps output names to input columns.  Positions are cut into ranges:
    totals of the ranges are accumulated first, then each range on its own.
    """
    k = list(keys)
    cut = df.withColumn("_b", F.floor(F.col(pos) / bucket).cast("long"))
    totals = cut.groupBy(*k, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *k, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*k, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, [*k, "_b"])
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"_o_{n}"))
    return out.drop("_b", *[f"_o_{n}" for n in sums])
