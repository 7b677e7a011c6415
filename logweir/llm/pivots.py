"""Exact top-k inner products by a pivot table with elimination.

Vectors become whole numbers (floor(256 c)).  Every row is stored with its squared length and its distances
to ``PIVOTS`` pivots.  For a query q and a row x the triangle inequality gives d(q, x) >= max over the pivots
of |d(q, p) - d(x, p)|, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so each pair has an upper bound of its score
without its vector being read.  Rows are evaluated in the order of their bounds until the next bound is below
the k-th best score so far; that score starts from the query's k-th best in a sample of the rows, which can
only be too low, never too high.

Queries are taken in chunks of at most ``CHUNK`` rows, broadcast with their pivot distances (a few MB whatever
the input) and held against all rows, block by block; a task keeps k rows a query, tasks' lists meet in a
window per query.  Rows are never shuffled.  Copies of a vector within a batch are folded to their k + 1
smallest ids, as no more of them can be in a list.

The pivots are fitted on a documented sample: of the ``SAMPLE`` rows least by hash, each next pivot is the row
furthest from those before.  The pivots change what is skipped, never the result.

Defined results: vectors null or with null or non-finite entries take no part, nor do rows without id; shorter
vectors count as filled with zeros; rows that repeat an id are each a candidate, never for a query of that id,
and each such query row is answered on its own; other columns are ignored; no rows, no result.  Scores beyond a
long count as its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored

PIVOTS = 32
SAMPLE = 4096
CHUNK = 4096
SCALE = 256
FIRST = 64  # rows a query evaluates before it asks its bounds again
PIECE = 1 << 19  # pairs whose bounds are held at a time

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _whole(c: np.ndarray) -> np.ndarray:
    """floor(256 c) as doubles where that is exact, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE)
    if not c.size or np.abs(x).max() < _EXACT:
        return x
    return np.array([[int(v) * SCALE if abs(v) >= 1 << 50 else int(np.floor(v * SCALE)) for v in row] for row in c.tolist()], object)


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of one width, filled with zeros."""
    flat, starts = np.asarray(column.flatten(), float), np.asarray(column.offsets)
    size = np.diff(starts)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], size)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b', exact: as doubles if no sum can reach 2^53, else as whole numbers held to a long."""
    if a.dtype != object and b.dtype != object:
        top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
        if top < _EXACT:
            return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a.tolist()], [[int(v) for v in row] for row in b.tolist()]
    dots = [[max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(r, s)))) for s in whole[1]] for r in whole[0]]
    return np.array(dots, np.int64).reshape(len(a), len(b))


def _measures(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and distances to the pivots, as doubles."""
    x, p = x.astype(float), pivots.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        n = (x * x).sum(1)
        return n, np.sqrt(np.maximum(n[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))


def _bounds(qn: np.ndarray, qd: np.ndarray, xn: np.ndarray, xd: np.ndarray) -> np.ndarray:
    """For each query and row a score that the pair cannot exceed."""
    low = np.zeros((len(qn), len(xn)))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, b in zip(qd.T, xd.T):
            np.maximum(low, np.abs(a[:, None] - b), out=low)
        both = qn[:, None] + xn
        slack = np.sqrt(both) * 1e-6 + 1e-6  # a distance loses up to half its digits where it is near zero
        top = (both - np.maximum(low - slack, 0) ** 2) / 2 + both * 1e-12 + 1
    return np.where(np.isnan(top), np.inf, np.maximum(top, -_LONG - 1))  # scores are held to a long as well


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _least_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, without copies of a vector beyond its k + 1 smallest ids."""
    if x.dtype == object or not x.shape[1]:
        return np.arange(len(ids))
    _, which = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    group = which[order]
    first = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return np.sort(order[place <= k])


class _Lists:
    """The k best rows of each query of a chunk, as far as a task has looked."""

    def __init__(self, queries: dict[str, np.ndarray], k: int):
        self.q, self.k = queries, k
        self.ids = [np.zeros(0, np.int64)] * len(queries["id"])
        self.scores = [np.zeros(0, np.int64)] * len(queries["id"])
        self.least = queries["least"].copy()  # no lower score can be in the list

    def take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.least[i]) & (ids != self.q["id"][i])
        if keep.any():
            self.ids[i], self.scores[i] = _best(np.r_[self.ids[i], ids[keep]], np.r_[self.scores[i], scores[keep]], self.k)
            if len(self.ids[i]) == self.k:
                self.least[i] = max(self.least[i], self.scores[i][-1])

    def look(self, ids: np.ndarray, x: np.ndarray, xn: np.ndarray, xd: np.ndarray) -> None:
        """Hold a block of rows against all queries."""
        step = max(1, PIECE // max(len(ids), 1))
        for at in range(0, len(self.ids), step):
            some = np.arange(at, min(at + step, len(self.ids)))
            top = _bounds(self.q["n"][some], self.q["d"][some], xn, xd)
            order = np.argsort(-top, axis=1)
            for r, i in enumerate(some):
                self._first(i, ids, x, order[r, :FIRST], top[r])
            left = [(r, i, order[r, FIRST : np.searchsorted(-top[r, order[r]], -float(self.least[i]), "right")]) for r, i in enumerate(some)]
            left = [y for y in left if len(y[2])]
            if sum(len(y[2]) for y in left) > len(left) * len(ids) // 8:  # most of the block: one product serves all
                for (_, i, rows), dots in zip(left, _products(self.q["x"][[y[1] for y in left]], x)):
                    self.take(i, ids[rows], dots[rows])
            else:
                for r, i, rows in left:
                    for lo in range(0, len(rows), 4 * FIRST):
                        if top[r, rows[lo]] < self.least[i]:
                            break
                        self._first(i, ids, x, rows[lo : lo + 4 * FIRST], top[r])

    def _first(self, i: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, top: np.ndarray) -> None:
        rows = rows[top[rows] >= self.least[i]]
        if len(rows):
            self.take(i, ids[rows], _products(self.q["x"][i : i + 1], x[rows])[0])


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, c) of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    rows = df.where(F.col(vector).isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    return rows.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def fit_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample, each the furthest from those before; fewer if the rest repeat them."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    chosen, near = [], np.full(len(x), np.inf)
    at = int((x * x).sum(1).argmax())
    while len(chosen) < pivots:
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        at = int(near.argmax())
        if not near[at] > 0:
            break
    return sample[chosen]


_TABLE = "vec_id long, c array<double>, n double, d array<double>"


def pivot_table(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """Every row with its squared length and its distances to the pivots."""
    told = rows.sparkSession.sparkContext.broadcast(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d = _measures(_whole(_rows(b.column("c"), width)), told.value)
            offsets = np.arange(0, d.size + 1, max(d.shape[1], 1), dtype=np.int32)[: len(n) + 1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("c"), pa.array(n), pa.ListArray.from_arrays(offsets, d.ravel())], ["vec_id", "c", "n", "d"])

    return stored(rows.mapInArrow(measured, _TABLE), "pivot-table")


def _seeded(batches: Iterator[pa.RecordBatch], sample: tuple[np.ndarray, np.ndarray], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries with their k-th best score in the sample, which none of their lists can end below."""
    ids, rows = sample
    for b in batches:
        x, own = _whole(_rows(b.column("c"), width)), np.asarray(b.column("vec_id"))
        least = np.full(len(x), -_LONG - 1, np.int64)
        for at in range(0, len(x), 256):
            for i, dots in enumerate(_products(x[at : at + 256], rows), at):
                dots = dots[ids != own[i]]
                if len(dots) >= k:
                    least[i] = np.partition(dots, len(dots) - k)[len(dots) - k]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], [*b.schema.names, "least"])


def top_k(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k other rows of highest inner
    product, ties to the smaller id."""
    spark, out = df.sparkSession, "query_row long, query_id long, vec_id long, score long"
    rows = usable(df, vector)
    width = rows.agg(F.max(F.size("c"))).first()[0] or 0
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "c").limit(SAMPLE).toPandas()
    sample = _whole(np.array([np.pad(c, (0, width - len(c))) for c in head["c"]], float).reshape(len(head), width))
    chosen = fit_pivots(sample, pivots)
    table = pivot_table(rows, chosen, width)

    known = spark.sparkContext.broadcast((head["vec_id"].to_numpy(), sample))
    seeded = table.where(is_query).mapInArrow(lambda batches: _seeded(batches, known.value, width, k), f"{_TABLE}, least long")
    asked = stored(seeded.withColumn("row", F.monotonically_increasing_id()), "pivot-queries")
    parts = []
    for lot in _lots(asked):
        q = asked.where(lot).toPandas()
        x = _whole(np.array([np.pad(c, (0, width - len(c))) for c in q["c"]], float).reshape(len(q), width))
        told = spark.sparkContext.broadcast(
            {"row": q["row"].to_numpy(), "id": q["vec_id"].to_numpy(), "x": x, "n": q["n"].to_numpy(), "d": np.array(q["d"].tolist(), float).reshape(len(q), len(chosen)), "least": q["least"].to_numpy()})

        def found(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            lists = _Lists(told.value, k)
            for b in batches:
                ids, x = np.asarray(b.column("vec_id")), _whole(_rows(b.column("c"), width))
                keep = _least_copies(ids, x, k)
                lists.look(ids[keep], x[keep], np.asarray(b.column("n"))[keep], _rows(b.column("d"), told.value["d"].shape[1])[keep])
            sizes = [len(i) for i in lists.ids]
            if sum(sizes):
                cols = np.repeat(told.value["row"], sizes), np.repeat(told.value["id"], sizes), np.concatenate(lists.ids), np.concatenate(lists.scores)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_row", "query_id", "vec_id", "score"])

        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        merged = table.mapInArrow(found, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(stored(merged.select("query_id", "rank", "vec_id", "score"), "pivot-lists"))
        told.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, parts)


def _lots(asked: DataFrame) -> list[Column]:
    """Conditions that cut the queries into chunks of at most ``CHUNK`` rows: runs of row numbers inside a
    partition of the stored table, small partitions together."""
    part = F.shiftright("row", 33)
    counts = asked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high")).sort("part").collect()
    out, start, held = [], None, 0
    for _, n, low, high in counts:
        if held and held + n > CHUNK:
            out.append((start, low - 1))
            held = 0
        if not held:
            start = low
        held += n
        while held > CHUNK:  # only where the partition stands alone: its rows are numbered without gaps
            out.append((start, start + CHUNK - 1))
            start, held = start + CHUNK, held - CHUNK
        last = high
    if held:
        out.append((start, last))
    return [F.col("row").between(a, b) for a, b in out]
