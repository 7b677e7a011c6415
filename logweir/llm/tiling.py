"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed (``least`` equal words in a row) are
candidates.  For each such pair, running Karp-Rabin matching finds the longest common
runs of words that are not yet marked, marks them and repeats with shorter ones down
to ``least`` words (Wise, "Running Karp-Rabin matching and greedy string tiling",
1993).  Tiles need not be in order, so reordered passages count.  A document is
contaminated if the tiles cover ``share`` of the words of some item.

Items are the query set: they go to the tasks in blocks of at most BLOCK words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import fresh, stored, texts

LEAST, SHARE = 5, 0.8
TILES = "array<struct<item:int,doc:int,words:int>>"
BLOCK = 1_000_000  # words of items that are sent to the tasks at a time


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n numbers."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return h


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, words) of the tiles of two arrays
    of word numbers.  Ties: the first place in the item, then in the document."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    hash_i, hash_d = _hashes(item, least), _hashes(doc, least)
    near = np.flatnonzero(np.isin(hash_d, hash_i))
    at: dict[int, list[int]] = {}
    for j in near.tolist():
        at.setdefault(int(hash_d[j]), []).append(j)
    out: list[tuple[int, int, int]] = []
    a, b = item.tolist(), doc.tolist()
    while True:
        best, found = least, []
        for i in range(len(hash_i)):
            for j in at.get(int(hash_i[i]), ()):
                if i and j and a[i - 1] == b[j - 1] and free_i[i - 1] and free_d[j - 1]:
                    continue  # inside a run that is met at its start
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        for i, j in found:
            if free_i[i : i + best].all() and free_d[j : j + best].all():
                free_i[i : i + best] = free_d[j : j + best] = False
                out.append((i, j, best))
        if not found:
            return out


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items as words, in blocks."""
    block, n = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        w = (r["text"] or "").encode("utf-8", "surrogatepass").lower().split()
        if block and n + len(w) > size:
            yield block
            block, n = [], 0
        block.append((r["item_id"], w))
        n += len(w)
    if block:
        yield block


def _covered(docs: DataFrame, block: list[tuple[int, list[bytes]]], least: int, share: float) -> DataFrame:
    words: dict[bytes, int] = {}
    coded = [np.array([words.setdefault(x, len(words)) for x in w], np.int64) for _, w in block]
    seeds = [_hashes(c, min(least, len(c))) if len(c) else np.zeros(0, np.uint64) for c in coded]
    whole = np.array([0 < len(c) < least for c in coded], bool)  # too short for a tile: found whole or not at all
    flat, owner = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    order = np.argsort(flat, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((words, coded, flat[order], owner[order], whole, [i for i, _ in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, coded, flat, owner, whole, names = held.value
        short = sorted({len(coded[k]) for k in np.flatnonzero(whole)})
        for b in batches:
            out = []
            for id_, text in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist()):
                ids = np.array([words.get(w, -1) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.int64)
                known = np.flatnonzero(ids >= 0)
                cand: set[int] = set()
                for n in [least, *short]:
                    if len(known) < n:
                        continue
                    ok = np.convolve(ids >= 0, np.ones(n, np.int64), "valid") == n
                    h = np.unique(_hashes(ids, n)[ok])
                    lo, hi = np.searchsorted(flat, h), np.searchsorted(flat, h, side="right")
                    for x, y in zip(lo[hi > lo], hi[hi > lo]):
                        cand.update(k for k in owner[x:y].tolist() if (len(coded[k]) if whole[k] else least) == n)
                for k in sorted(cand):
                    t = tiles(coded[k], ids, min(least, len(coded[k])))
                    cover = sum(x[2] for x in t) / len(coded[k])
                    if cover >= share:
                        out.append((*id_, names[k], cover, [{"item": i, "doc": j, "words": n} for i, j, n in t]))
            if out:
                kind = pa.list_(pa.struct([("item", pa.int32()), ("doc", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.float64(), kind])], names=["doc_id", "h", "item_id", "coverage", "tiles"])

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, item_id long, coverage double, tiles " + TILES)


def _found(docs: DataFrame, items: DataFrame, least: int, share: float, block: int) -> DataFrame:
    out = None
    for words in _blocks(items, block):
        part = stored(_covered(docs, words, least, share), "tiles")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id long, h long, item_id long, coverage double, tiles {TILES}")
    return out


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, coverage, tiles): each document with each item of which its
    tiles cover at least ``share`` of the words.

    Words are compared in ASCII lower case.  Null and empty texts, of documents or
    items, match nothing; an item shorter than ``least`` words counts when it stands
    whole.  Repeated documents or items give repeated rows; without items or
    documents the result is empty.
    """
    return _found(docs, items, least, share, block).drop("h")


def without_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` finds."""
    key, i, h = fresh(docs, "_k", "_id", "_h")
    bad = stored(_found(docs, items, least, share, block).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct(), "contaminated")
    named = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = named.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h)), "left_anti")
    return kept.select(*docs.columns)
