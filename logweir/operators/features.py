"""Per-block features of events (block_id, line_id, level, template_id).

Counts go through one (block, template) aggregate, so a block that holds a
large share of all lines is reduced map-side before any shuffle.  Adjacent
pairs are found inside (block, line range) pieces and stitched at the seams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.ids import dense_by_number
from logweir.session import materialize

# Fixed value: order of the eight columns after the template counts
EXTRA = (
    "event_count",
    "unique_templates",
    "event_span",
    "sequence_entropy",
    "repeat_ratio",
    "unique_bigrams",
    "error_count",
    "warn_count",
)
FEATURE_SETS = ("full", "freq_only")
LINE_RANGE = 1 << 20  # lines per adjacency piece


def group_blocks(ev: DataFrame) -> DataFrame:
    return ev.where("block_id <> ''")


def block_sizes(ev: DataFrame) -> DataFrame:
    return group_blocks(ev).groupBy("block_id").agg(F.count("*").alias("event_count"))


def template_vocab(ev: DataFrame) -> DataFrame:
    """(template_id, col): sorted distinct ids >= 0 of all events, col from 0."""
    ids = ev.where("template_id >= 0").select("template_id").distinct()
    return dense_by_number(ids, "template_id", "col", start=0).select("template_id", "col")


def _by_template(ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return group_blocks(ev).groupBy(*keys, "block_id", "template_id").agg(
        F.count("*").alias("n"),
        F.min("line_id").alias("lo"),
        F.max("line_id").alias("hi"),
        F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"),
        F.count_if(F.col("level") == "WARN").alias("warns"),
    )


def template_freq(ev: DataFrame, vocab: DataFrame) -> DataFrame:
    """(block_id, template_id, n) for templates in the vocabulary."""
    n = group_blocks(ev).groupBy("block_id", "template_id").agg(F.count("*").alias("n"))
    return n.join(vocab.select("template_id"), "template_id", "left_semi")


def _stats(per: DataFrame, keys: tuple[str, ...] = (), extra: tuple[Column, ...] = ()) -> DataFrame:
    n = F.col("n")
    known = F.col("template_id") >= 0
    seq = F.coalesce(F.sum(F.when(known, n)), F.lit(0))
    weighted = F.coalesce(F.sum(F.when(known, n * F.log2(n.cast("double")))), F.lit(0.0))
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N; exactly 0 for one template
    entropy = F.when(
        F.count_if(known) > 1, F.log2(seq.cast("double")) - weighted / seq
    ).otherwise(F.lit(0.0))
    return per.groupBy(*keys, "block_id").agg(
        *extra,
        F.sum("n").alias("event_count"),
        F.count_if(known).alias("unique_templates"),
        (F.max("hi") - F.min("lo")).alias("event_span"),
        entropy.alias("sequence_entropy"),
        F.sum("errors").alias("error_count"),
        F.sum("warns").alias("warn_count"),
        F.sort_array(F.collect_list("template_id")).alias("template_ids"),
    )


def block_stats(ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """event_count, unique_templates, event_span, sequence_entropy, error_count,
    warn_count and the sorted template_ids of every block."""
    return _stats(_by_template(ev, keys), keys)


def sequence_entropy(ev: DataFrame) -> DataFrame:
    return block_stats(ev).select("block_id", "sequence_entropy")


def adjacent_pairs(ev: DataFrame, keys: tuple[str, ...] = (), line_range: int = LINE_RANGE) -> DataFrame:
    """(block_id, prev, cur, n): counts of neighbouring template pairs."""
    k = [*keys, "block_id"]
    seq = group_blocks(ev).where("template_id >= 0").select(*k, "line_id", "template_id")
    last = ev.agg(F.max("line_id")).first()[0] or 0
    cur = F.col("template_id").alias("cur")
    if last < line_range:  # one piece: everything below stays partitioned by block
        prev = F.lag("template_id").over(Window.partitionBy(*k).orderBy("line_id")).alias("prev")
        both = seq.select(*k, prev, cur)
    else:
        seq = seq.withColumn("piece", F.floor(F.col("line_id") / line_range).cast("long"))
        inside = Window.partitionBy(*k, "piece").orderBy("line_id")
        pairs = seq.select(*k, F.lag("template_id").over(inside).alias("prev"), cur)
        ends = seq.groupBy(*k, "piece").agg(
            F.min_by("template_id", "line_id").alias("cur"), F.max_by("template_id", "line_id").alias("last")
        )
        across = Window.partitionBy(*k).orderBy("piece")
        both = pairs.unionByName(ends.select(*k, F.lag("last").over(across).alias("prev"), "cur"))
    return both.where("prev is not null").groupBy(*k, "prev", "cur").agg(F.count("*").alias("n"))


def _pair_stats(ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    same = F.sum(F.when(F.col("prev") == F.col("cur"), F.col("n")).otherwise(0))
    return adjacent_pairs(ev, keys).groupBy(*keys, "block_id").agg(
        (same / F.sum("n")).alias("repeat_ratio"), F.count("*").alias("unique_bigrams")
    )


def repeat_ratio(ev: DataFrame) -> DataFrame:
    """Share of adjacent equal template pairs; 0 for a block of one event."""
    return _with_pairs(block_sizes(ev), ev).select("block_id", "repeat_ratio")


def unique_bigrams(ev: DataFrame) -> DataFrame:
    return _with_pairs(block_sizes(ev), ev).select("block_id", "unique_bigrams")


def _with_pairs(blocks: DataFrame, ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return (
        blocks.join(_pair_stats(ev, keys), [*keys, "block_id"], "left")
        .withColumn("repeat_ratio", F.coalesce("repeat_ratio", F.lit(0.0)))
        .withColumn("unique_bigrams", F.coalesce("unique_bigrams", F.lit(0)).cast("long"))
    )


def extra_features(ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """block_stats with the two adjacency columns."""
    return _with_pairs(block_stats(ev, keys), ev, keys)


@dataclass(frozen=True)
class FeatureSpace:
    """Which columns a feature vector has: the vocabulary and the feature set."""

    vocab: DataFrame
    size: int
    feature_set: str = "full"

    @property
    def width(self) -> int:
        return self.size + (len(EXTRA) if self.feature_set == "full" else 0)


def feature_space(ev_or_vocab: DataFrame, feature_set: str = "full") -> FeatureSpace:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}, got {feature_set!r}")
    is_vocab = "col" in ev_or_vocab.columns
    vocab = ev_or_vocab if is_vocab else materialize(template_vocab(ev_or_vocab), "vocab")
    return FeatureSpace(vocab, vocab.count(), feature_set)


def sparse_features(ev: DataFrame, space: FeatureSpace, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per block (of each key): block_id, idx, val (non-zero features by
    position), event_count and template_ids.

    The vector stays sparse: its size follows the templates a block really has,
    not the vocabulary.
    """
    none = F.array().cast("array<struct<i:int,v:double>>")
    cell = F.struct(F.col("col").cast("int").alias("i"), F.col("n").cast("double").alias("v"))
    freq = F.sort_array(F.collect_list(F.when(F.col("col").isNotNull(), cell))).alias("_f")
    out = _stats(_by_template(ev, keys).join(space.vocab, "template_id", "left"), keys, (freq,))
    tail = none
    if space.feature_set == "full":
        out = _with_pairs(out, ev, keys)
        tail = F.filter(
            F.array(*[
                F.struct(F.lit(space.size + j).alias("i"), F.col(c).cast("double").alias("v"))
                for j, c in enumerate(EXTRA)
            ]),
            lambda s: s["v"] != 0.0,
        )
    return out.withColumn("_all", F.concat("_f", tail)).select(
        *keys,
        "block_id",
        F.col("_all.i").alias("idx"),
        F.col("_all.v").alias("val"),
        "event_count",
        "template_ids",
    )


def dense(width: int, idx: Column | str = "idx", val: Column | str = "val") -> Column:
    """Dense array<double> of a sparse vector."""
    m = F.map_from_arrays(idx, val)
    cells = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    return F.transform(cells, lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def feature_vector(ev: DataFrame, feature_set: str = "full", vocab: DataFrame | None = None) -> DataFrame:
    """(block_id, features): template counts in vocabulary order, then EXTRA."""
    space = feature_space(ev if vocab is None else vocab, feature_set)
    rows = sparse_features(ev, space)
    return rows.select("block_id", dense(space.width).alias("features"))


def scaler(blk: DataFrame, col: str = "features") -> tuple[list[float], list[float]]:
    """Mean and population sd per position (two lists as long as a vector)."""
    rows = (
        blk.select(F.posexplode(col).alias("pos", "x")).groupBy("pos")
        .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    )
    return [r["m"] for r in rows], [r["s"] if r["s"] and r["s"] > 0 else 1.0 for r in rows]


def standardize(blk: DataFrame, col: str = "features") -> DataFrame:
    """(x - mean) / population sd per position; a zero sd divides by 1."""
    mean, sd = scaler(blk, col)
    if not mean:
        return blk
    out = F.zip_with(F.col(col), F.lit(mean), lambda x, m: x - m)
    return blk.withColumn(col, F.zip_with(out, F.lit(sd), lambda x, s: x / s))
