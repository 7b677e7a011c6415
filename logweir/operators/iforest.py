"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) trained and applied on Spark.

Subsamples are drawn on the executors by hashing, so they do not depend on how
the rows are partitioned.  Trees are grown from at most 256 rows each and kept
as complete binary heaps: node ``i`` has children ``2i+1`` and ``2i+2``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.operators.threshold import contamination_offset, flag_anomalies
from logweir.session import fan_out, materialize, spread

SUBSAMPLE = 256
TREES_PER_TASK = 8
CELLS = 4_000_000  # dense cells scored at a time


def mean_path(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_trees(x: np.ndarray, depth: int, rng: np.random.Generator, copies: np.ndarray | None = None):
    """Grow one tree per sample of ``x`` (trees, rows, features), level by level.
    ``copies`` says how often each row stands in every sample.

    Returns (feature, split, path) heaps; feature is -1 at a leaf, and path
    holds the leaf's depth plus c(rows that ended there).
    """
    t, n, d = x.shape
    cells = 2 ** (depth + 1) - 1
    feature = np.full((t, cells), -1, dtype=np.int64)
    split = np.zeros((t, cells))
    path = np.zeros((t, cells))
    node = np.zeros((t, n), dtype=np.int64)
    flat = x.reshape(t * n, d)
    tree = np.repeat(np.arange(t), n)
    live = np.ones(t * n, dtype=bool)
    for level in range(depth + 1):
        rows = np.flatnonzero(live)
        if not len(rows):
            break
        key = tree[rows] * cells + node.reshape(-1)[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
        size = np.diff(np.r_[starts, len(key)]) if copies is None else np.add.reduceat(copies[rows % n], starts)
        lo = np.minimum.reduceat(flat[rows], starts, axis=0)
        hi = np.maximum.reduceat(flat[rows], starts, axis=0)
        weight = np.where(hi > lo, rng.random(lo.shape), -1.0)
        pick = weight.argmax(axis=1)
        g = np.arange(len(starts))
        can = (weight[g, pick] >= 0) & (level < depth)
        at = key[starts]
        cut = lo[g, pick] + rng.random(len(g)) * (hi[g, pick] - lo[g, pick])
        # a draw that rounds up to the maximum would leave one side empty
        cut = np.where(cut >= hi[g, pick], lo[g, pick], cut)
        feature.reshape(-1)[at[can]] = pick[can]
        split.reshape(-1)[at[can]] = cut[can]
        path.reshape(-1)[at[~can]] = level + mean_path(size[~can])
        go = can[group]
        live[rows[~go]] = False
        moving, mg = rows[go], group[go]
        right = flat[moving, pick[mg]] > cut[mg]
        cur = node.reshape(-1)[moving]
        node.reshape(-1)[moving] = 2 * cur + 1 + right
    return feature, split, path


def path_lengths(x: np.ndarray, feature: np.ndarray, split: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Mean leaf path of every row of ``x`` over all trees."""
    t, cells = feature.shape
    depth = int(math.log2(cells + 1)) - 1
    base = np.arange(t) * cells
    f, s, p = feature.reshape(-1), split.reshape(-1), path.reshape(-1)
    node = np.zeros((len(x), t), dtype=np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        at = node + base
        col = f[at]
        right = x[rows, np.maximum(col, 0)] > s[at]
        node = np.where(col < 0, node, 2 * node + 1 + right)
    return p[node + base].mean(axis=1)


def densify(offsets, idx, val, start: int, stop: int, lookup: np.ndarray, width: int) -> np.ndarray:
    """Dense rows [start, stop) of sparse vectors over the looked-up columns."""
    a, b = offsets[start], offsets[stop]
    row = np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))
    i = idx[a:b]
    col = np.where(i < len(lookup), lookup[np.minimum(i, len(lookup) - 1)], -1)
    out = np.zeros((stop - start, width))
    keep = col >= 0
    out[row[keep], col[keep]] = val[a:b][keep]
    return out


@dataclass
class Forest:
    """A grown forest: three (trees, heap) arrays over original column numbers."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    psi: int
    contamination: float
    offset: float | None = None

    @property
    def n_trees(self) -> int:
        return len(self.feature)

    def score(self, blk: DataFrame) -> DataFrame:
        """Adds score = -2^(-mean path / c(psi)) to sparse block vectors."""
        used = np.unique(self.feature[self.feature >= 0])
        lookup = np.full(int(used.max()) + 1 if len(used) else 1, -1, dtype=np.int64)
        lookup[used] = np.arange(len(used))
        local = np.where(self.feature >= 0, lookup[np.maximum(self.feature, 0)], -1) if len(used) else self.feature
        norm = float(mean_path([self.psi])[0]) or 1.0
        width = max(len(used), 1)
        # at most n_trees * 511 nodes whatever the data size
        shared = blk.sparkSession.sparkContext.broadcast((local, self.split, self.path, lookup))
        step = max(1, CELLS // max(width, self.n_trees))

        @F.arrow_udf("double")
        def run(i: pa.Array, v: pa.Array) -> pa.Array:
            f, s, p, look = shared.value
            offsets = i.offsets.to_numpy() - i.offsets[0].as_py()
            idx = i.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            val = v.flatten().to_numpy(zero_copy_only=False)
            out = np.empty(len(i))
            for a in range(0, len(i), step):
                b = min(a + step, len(i))
                x = densify(offsets, idx, val, a, b, look, width)
                out[a:b] = -np.power(2.0, -path_lengths(x, f, s, p) / norm)
            return pa.array(out)

        return blk.withColumn("score", run("idx", "val"))

    def decide(self, blk: DataFrame) -> DataFrame:
        return flag_anomalies(self.score(blk), self.offset)

    # -- persistence ---------------------------------------------------------

    def nodes(self, spark: SparkSession) -> DataFrame:
        t, c = self.feature.shape
        used = (self.feature >= 0) | (self.path > 0)
        used[:, 0] = True
        tree, node = np.nonzero(used)
        pdf = pd.DataFrame(
            {"tree": tree, "node": node, "feature": self.feature[used],
             "split": self.split[used], "path": self.path[used]}
        )
        return spark.createDataFrame(
            pdf, "tree long, node long, feature long, split double, path double"
        )

    @classmethod
    def from_nodes(cls, nodes: DataFrame, n_trees: int, depth: int, psi: int,
                   contamination: float, offset: float | None) -> "Forest":
        shape = (n_trees, 2 ** (depth + 1) - 1)
        out = cls(np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape), psi, contamination, offset)
        pdf = nodes.toPandas()  # at most n_trees * 511 rows
        at = (pdf["tree"].to_numpy(), pdf["node"].to_numpy())
        out.feature[at], out.split[at], out.path[at] = pdf["feature"], pdf["split"], pdf["path"]
        return out


def draw_samples(blk: DataFrame, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, idx, val, _h, _r): ``psi`` rows per tree, chosen by hashes of the
    block id.

    Trees are split into ``m`` groups and a row is dealt to one tree of each
    group, with m just big enough that about two subsamples reach every tree.
    With many rows m is 1 and a first hash thins them out, so the shuffle is
    2 * trees * psi rows however large the input is.
    """
    space = 1 << 31
    m = max(1, min(n_trees, -(-2 * n_trees * psi // n)))
    if 2 * n_trees * psi < n:
        keep = F.pmod(F.xxhash64(F.lit(seed), "block_id"), F.lit(space))
        blk = blk.where(keep < int(space * 2 * n_trees * psi / n))
    first = [g * n_trees // m for g in range(m + 1)]
    group = F.inline(F.array(*[
        F.struct(F.lit(a).alias("_a"), F.lit(b - a).alias("_w")) for a, b in zip(first, first[1:])
    ]))
    dealt = (
        blk.select("block_id", "idx", "val", group)
        .withColumn("_h", F.xxhash64(F.lit(seed + 1), "_a", "block_id"))
        .withColumn("tree", (F.col("_a") + F.pmod("_h", F.col("_w"))).cast("int"))
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "_h"), "block_id"))
    return dealt.select("block_id", "tree", "idx", "val", "_h").withColumn("_r", rank).where(F.col("_r") <= psi)


@dataclass(frozen=True)
class IForest:
    """Estimator; ``fit`` takes sparse block vectors (block_id, idx, val)."""

    n_trees: int = 200
    contamination: float = 0.03
    seed: int = 42

    def fit(self, blk: DataFrame, rows: int | None = None) -> Forest:
        n = blk.count() if rows is None else rows
        if n == 0:
            raise ValueError("no blocks to fit on")
        psi = min(SUBSAMPLE, n)
        depth = int(math.ceil(math.log2(max(psi, 2))))
        seed = self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tree", "_r"], ignore_index=True)
            idx = np.concatenate([np.asarray(i, np.int64) for i in pdf["idx"]] or [[]]).astype(np.int64)
            val = np.concatenate([np.asarray(v, float) for v in pdf["val"]] or [[]])
            cols, pos = np.unique(idx, return_inverse=True)
            x = np.zeros((len(pdf), max(len(cols), 1)))
            x[np.repeat(np.arange(len(pdf)), pdf["idx"].map(len)), pos] = val
            real = np.r_[cols, -1] if len(cols) else np.array([-1, -1])
            out = []
            # trees with equally many rows grow together; a seed per tree group
            for rows, part in pdf.groupby(pdf.groupby("tree")["_r"].transform("size")):
                ids = part["tree"].unique()
                rng = np.random.default_rng([seed, int(ids[0]), int(rows)])
                f, s, p = grow_trees(x[part.index].reshape(len(ids), int(rows), -1), depth, rng)
                used = (f >= 0) | (p > 0)
                used[:, 0] = True
                t, node = np.nonzero(used)
                out.append(pd.DataFrame({
                    "tree": ids[t], "node": node, "feature": real[f[used]], "split": s[used], "path": p[used],
                }))
            return pd.concat(out)

        # a task grows TREES_PER_TASK trees: at most that many times psi rows
        drawn = draw_samples(blk, n, self.n_trees, psi, seed).withColumn("grove", F.floor(F.col("tree") / TREES_PER_TASK))
        nodes = fan_out(drawn, "grove", groups=-(-self.n_trees // TREES_PER_TASK)).groupBy("grove").applyInPandas(
            grow, "tree long, node long, feature long, split double, path double"
        )
        return Forest.from_nodes(nodes, self.n_trees, depth, psi, self.contamination, None)

    def fit_decide(self, blk: DataFrame) -> tuple[Forest, DataFrame]:
        """Fit, set the contamination offset from the training scores, decide."""
        n = blk.count()
        if n == 0:  # nothing to learn from: an empty table comes back decided
            model = Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1)), 1, self.contamination, 0.0)
            return model, model.decide(blk)
        blk = spread(blk, n, 4_000)
        model = self.fit(blk, n)
        scored = materialize(model.score(blk), "scored")
        model.offset = contamination_offset(scored, self.contamination)
        return model, flag_anomalies(scored, model.offset)
