"""Mixing sources to target weights by temperature.

The share p of a source's words is raised to an exponent between 0 (all sources
alike) and 1 (as they come).  The exponent is the largest whose weights reach the
target entropy, or the smallest that keeps every source within the repetition limit
if that is larger; both are bisected, many cuts a pass, by sums over the sources.
A weight is realised as blocks: whole permutations of the source, then as much of
one more as the budget still allows, so no document is read twice before every
other document of its source was read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import fresh, stored, words

ENTROPY = 0.97  # of the weights, as a share of the largest possible
REPEATS = 4.0  # times that a source may be read
CUTS, PASSES = 64, 6  # exponents a pass, passes: the exponent is exact to 65^-6
BUCKETS = 1 << 12  # of a permutation: what its running totals are added up by


def _key(block: Column) -> Column:
    """Place of a document in the permutation of a block (0 to 2^62 - 1)."""
    return _place(F.xxhash64(F.coalesce("text", F.lit(""))), block)


def _place(hashed: Column, block: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", hashed, block), F.lit(1 << 62))


def exponent(sources: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for (source, words) rows; 1.0 where there is nothing to mix."""
    p = sources.where("words > 0")
    total, n, least = p.agg(F.sum("words"), F.count("*"), F.min("words")).first()
    if not n or n < 2:
        return 1.0
    need, factor = entropy * math.log(n), (budget or total) / total
    low_p = least / total
    low, high = [0.0, 0.0], [1.0, 1.0]  # brackets: entropy, repetition
    answer = [0.0, 1.0]  # if no exponent will do: the flattest; the source as it comes
    for _ in range(PASSES):
        cuts = sorted({lo + (hi - lo) * k / (CUTS + 1) for lo, hi in zip(low, high) for k in range(CUTS + 2)})
        share = F.col("words") / F.lit(float(total))
        at = p.select(share.alias("p"), F.explode(F.array(*[F.lit(c) for c in cuts])).alias("a"))
        sums = {r["a"]: (r["z"], r["s"]) for r in at.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s")).collect()}
        flat = [a for a in cuts if math.log(sums[a][0]) - a * sums[a][1] / sums[a][0] >= need - 1e-12]
        mild = [a for a in cuts if factor * low_p ** (a - 1) / sums[a][0] <= repeats + 1e-12]
        if flat:
            answer[0] = flat[-1]
            low[0], high[0] = flat[-1], next((a for a in cuts if a > flat[-1]), flat[-1])
        if mild:
            answer[1] = mild[0]
            low[1], high[1] = next((a for a in reversed(cuts) if a < mild[0]), mild[0]), mild[0]
    return max(answer)


def mixed(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """``docs`` with n_words, weight (of its source) and copies, the number of times
    the mixture reads the document; ``budget`` is in words (default: all words).

    A null source is a source of its own.  Null and empty texts have no words, cost
    nothing and are read whenever their turn comes.  A source without words has
    weight 0.  Equal rows stand at one place, so they are read equally often.  An
    empty table gives none.  Columns of these names in ``docs`` are replaced.
    """
    new = ["n_words", "weight", "copies"]
    docs = docs.drop(*new)
    (p,) = fresh(docs, "_plan")
    counted = F.size(words(F.coalesce("text", F.lit("")))).cast("long")
    slim = stored(docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), counted.alias("n")), "mixture-rows")
    sources = stored(slim.groupBy("source").agg(F.sum("n").alias("words")), "sources")
    total = sources.agg(F.sum("words")).first()[0] or 0
    budget = float(total if budget is None else budget)
    a = exponent(sources, budget, entropy, repeats)
    raised = F.when(F.col("words") > 0, F.pow(F.col("words") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(raised)).first()[0] or 1.0
    blocks = F.when(F.col("words") > 0, F.col("weight") * budget / F.col("words")).otherwise(0.0)  # with the broken one
    plan = (sources.withColumn("weight", raised / z).withColumn("whole", F.floor(blocks + 1e-9).cast("long"))
            .withColumn("rest", F.col("weight") * budget - F.col("whole") * F.col("words"))
            .withColumn("rest", F.when(F.col("rest") > 1e-9 * F.col("words"), F.col("rest")).otherwise(0.0)))  # not what rounding leaves
    plan = stored(plan.select(F.col("source").alias("s"), "weight", "whole", "rest"), "mixture")

    # Where the broken block ends: words by bucket of the permutation find the bucket,
    # and only the rows of that one bucket are put in order.
    u = slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).where("rest > 0").withColumn("u", _place(F.col("h"), F.col("whole")))
    u = u.select("s", "rest", "n", "u", F.shiftright("u", 62 - 12).cast("int").alias("b"))
    sums = u.groupBy("s", "rest", "b").agg(F.sum("n").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (sums.withColumn("start", start).where("start < rest").groupBy("s").agg(F.max_by(F.struct("b", "start"), "b").alias("at"))
            .select(F.col("s").alias("s2"), F.col("at.b").alias("b2"), F.col("at.start").alias("start")))
    rows = u.join(edge, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("u").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (rows.withColumn("before", F.col("start") + before).where("before < rest").groupBy("s").agg(F.max("u").alias("cut"))
           .withColumnRenamed("s", "s2"))
    plan = plan.join(cut, F.col("s").eqNullSafe(F.col("s2")), "left").select(
        F.struct("s", "weight", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")).alias(p))
    out = docs.join(stored(plan, "mixture-cuts"), F.col("source").eqNullSafe(F.col(f"{p}.s")))
    copies = F.col(f"{p}.whole") + (_key(F.col(f"{p}.whole")) <= F.col(f"{p}.cut")).cast("long")
    return out.select(*docs.columns, counted.alias("n_words"), F.col(f"{p}.weight").alias("weight"), copies.alias("copies"))


def schedule(mixture: DataFrame) -> DataFrame:
    """A row for each time a document is read: with its block (0, 1, ...) and its
    place in the block's permutation; documents that are never read go."""
    turns = mixture.where("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return turns.withColumn("place", _key(F.col("block")))
