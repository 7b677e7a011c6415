"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: two blocks of the perfect binary
Golay code [23, 12], 2^24 anchors on 46 of the 64 bits.  A block lies within
distance 3 of exactly one codeword, its home.  A fingerprint goes to every
anchor that up to ``max_bits`` changed bits could make the home of a neighbour,
so of two linked fingerprints each meets the other at the other's home.  Only
distinct fingerprints are copied (22 anchors a block, 68 in all for 2 bits), and
an anchor returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import fresh, joined_components, stored, texts
from logweir.operators.components import connected_components

N, GENERATOR, RADIUS = 23, 0xC75, 3  # the Golay code: length, generator polynomial, covering radius
SMALL = 4_096  # pairs of one anchor that are compared together with those of others


# -- fingerprints -----------------------------------------------------------------

def fingerprint(text: str, size: int = 3) -> int:
    """Unsigned SimHash of the word shingles of one text (ASCII lower case)."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[k:] for k in range(size)))) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), 65_536):
        part = h[s : s + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(h)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, h, fp): the fingerprint of each document as a signed long; h tells
    texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    return texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


# -- the covering code --------------------------------------------------------------

Code = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def golay() -> Code:
    """Syndromes of the low 12 and the high 11 bits of a block, and for each
    syndrome the error vectors of weight up to 3, of 4 and of 5 (-1: none)."""
    unit, x = [], 1
    for _ in range(N):
        unit.append(x)
        x <<= 1
        if x >> 11 & 1:
            x ^= GENERATOR
    of = lambda bits, base: np.bitwise_xor.reduce([np.where(bits >> k & 1, unit[base + k], 0) for k in range(12) if base + k < N])
    low, high = of(np.arange(1 << 12), 0), of(np.arange(1 << 11), 12)
    found: list[dict[int, list[int]]] = [{}, {}, {}]
    for weight in range(RADIUS + 3):
        for at in combinations(range(N), weight):
            s = 0
            for k in at:
                s ^= unit[k]
            found[max(0, weight - RADIUS)].setdefault(s, []).append(sum(1 << k for k in at))
    tables = []
    for f in found:
        t = np.full((1 << 11, max(map(len, f.values()))), -1, dtype=np.int64)
        for s, v in f.items():
            t[s, : len(v)] = v
        tables.append(t)
    return low, high, tables


def anchors(fp: np.ndarray, code: Code, max_bits: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, row, is the home): all anchors of each fingerprint."""
    low, high, tables = code
    u, mask = fp.view(np.uint64), np.uint64((1 << N) - 1)
    blocks = [(u & mask).astype(np.int64), (u >> np.uint64(N) & mask).astype(np.int64)]
    syndromes = [low[b & 0xFFF] ^ high[b >> 12] for b in blocks]
    for left in range(max_bits + 1):
        for right in range(max_bits + 1 - left):
            a, b = tables[left][syndromes[0]], tables[right][syndromes[1]]
            for i in range(a.shape[1]):
                for j in range(b.shape[1]):
                    row = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0))
                    if len(row):
                        yield (blocks[0][row] ^ a[row, i]) << N | blocks[1][row] ^ b[row, j], row, left + right == 0


# -- links inside an anchor ------------------------------------------------------------

def _masks(max_bits: int) -> np.ndarray:
    return np.array([sum(1 << k for k in c) for n in range(max_bits + 1) for c in combinations(range(64), n)], dtype=np.uint64)


def _dense(fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large anchor, as a forest.  The work is linear in the number
    of fingerprints: each is compared with all homes, or looked up among them
    with every change of up to max_bits bits, whichever is less."""
    lab, at = np.arange(len(fp)), np.flatnonzero(home)
    masks = _masks(max_bits)
    if len(at) <= len(masks):
        steps = ((h, np.flatnonzero(np.bitwise_count(fp ^ fp[h]) <= max_bits)) for h in at)
        links = ((np.full(len(j), h), j) for h, j in steps)
    else:
        at = at[np.argsort(fp[at])]
        known = fp[at]
        where = lambda m: np.minimum(np.searchsorted(known, fp ^ m), len(known) - 1)
        links = ((at[k[ok]], np.flatnonzero(ok)) for m in masks for k in [where(m)] for ok in [known[k] == fp ^ m])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for i, j in links:
        held.append((i, j))
        if (size := size + len(i)) > 1_000_000:
            lab = _merge(lab, held)
            held, size = [], 0
    lab = _merge(lab, held)
    return np.arange(len(fp)), lab


def _merge(lab: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    i = np.concatenate([lab[x] for x, _ in held] or [np.zeros(0, np.int64)])
    j = np.concatenate([lab[y] for _, y in held] or [np.zeros(0, np.int64)])
    return joined_components(len(lab), i, j)[lab]


def anchor_links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (u, v) of rows sorted by anchor, whole anchors only."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    homes = np.add.reduceat(home.astype(np.int64), start)
    u, v = [], []
    big = np.flatnonzero(homes * size > SMALL)
    for k in big:
        s = slice(start[k], start[k] + size[k])
        i, j = _dense(fp[s], home[s], max_bits)
        u.append(fp[s][i[i != j]])
        v.append(fp[s][j[i != j]])
    run = np.repeat(np.arange(len(start)), size)
    of_small = home & ((homes * size <= SMALL) & (size > 1))[run]
    at = np.flatnonzero(of_small)
    for part in np.array_split(at, max(1, int(size[run[at]].sum()) // 4_000_000 + 1)):
        if not len(part):
            continue
        reps = size[run[part]]
        i = np.repeat(part, reps)
        j = np.repeat(start[run[part]], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        near &= i != j
        i, j = i[near], j[near]
        rows = np.unique(np.r_[i, j])
        lab = joined_components(len(rows), np.searchsorted(rows, i), np.searchsorted(rows, j))
        away = lab != np.arange(len(rows))
        u.append(fp[rows[away]])
        v.append(fp[rows[lab[away]]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([*u, none]), np.concatenate([*v, none])


def near_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v): links that span the graph of fingerprints (column fp, distinct)
    differing in at most ``max_bits`` bits."""

    code = golay()

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for a, row, home in anchors(fp, code, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(fp[row]), pa.array(np.full(len(a), home))], names=["anchor", "fp", "home"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(cols[0]):
                u, v = anchor_links(cols[0], cols[1].view(np.uint64), cols[2], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        parts: list[list[np.ndarray]] = [rest]
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last anchor may go on in the next batch
            if cut:
                yield from out([np.concatenate([p[k] for p in parts] + [cols[k][:cut]]) for k in range(3)])
                parts = []
            elif parts and len(parts[-1][0]) and parts[-1][0][-1] != cols[0][0]:
                yield from out([np.concatenate([p[k] for p in parts]) for k in range(3)])
                parts = []
            parts.append([c[cut:] for c in cols])
        if parts:
            yield from out([np.concatenate([p[k] for p in parts]) for k in range(3)])

    spread = distinct.select("fp").mapInArrow(copies, "anchor long, fp long, home boolean")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(link, "u long, v long")


def _components(docs: DataFrame, size: int, max_bits: int) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of each row."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("lead")), "fingerprint-groups")
    linked = connected_components(near_links(groups, max_bits))
    roots = stored(
        groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "lead", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    leads = stored(roots.groupBy("root").agg(F.min("lead").alias("component_id")), "fingerprint-leads")
    of = stored(roots.join(leads, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return fps.join(of, "fp")


def simhash_components(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null texts are empty; a text without words has fingerprint zero and links
    like any other.  Repeated rows stay, each with the same result.  A null
    doc_id is never a component_id unless its whole component has none.  An
    empty table gives an empty result.  Other columns are not looked at.
    """
    return _components(docs, size, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest doc_id (null:
    last), then of smallest text hash; of rows alike in both, any one."""
    return first_of_each(docs, _components(docs, size, max_bits))


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``docs`` with one row of each root, by the (doc_id, h, root) of its rows, as ``one_of_each`` says."""
    rows = stored(rooted.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")), "fingerprint-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    first = stored(first.select("root", F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h")), "fingerprint-firsts")
    key, i, h = fresh(docs, "_k", "_id", "_h")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h))
    keys = lambda x, name: stored(x.select(F.col("doc_id").alias(i), F.col("h").alias(h)), name)
    of = rows.join(first, "root").withColumn("first", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    # what goes is the smaller side, so the texts need not be shuffled while that is small
    gone = keys(of.where("not first"), "near-copies")
    again = keys(of.where("first and n > 1"), "repeated-rows")
    named = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = named.join(gone, same, "left_anti")
    once = kept.join(again, same, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return once
    return once.unionByName(kept.join(again, same).dropDuplicates([i, h]).select(*docs.columns))
