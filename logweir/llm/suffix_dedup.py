"""Exact removal of repeated byte strings, by threshold-bounded interval
expansion on Burrows-Wheeler transforms.

1. Anchors.  Every window of ``length`` bytes picks the k-gram of smallest hash
   in it, so equal windows pick equal anchors (Schleimer et al., "Winnowing",
   SIGMOD 2003).  An anchor carries the hash of its context: all bytes of all
   windows that can have picked it.
2. Equal contexts.  An anchor whose context also stands earlier is covered whole.
   Copies inside one batch are settled before the shuffle, so a hot context
   sends one row a batch.
3. Unequal contexts of one k-gram.  Only the first of each is compared byte by
   byte.  The contexts of a k-gram, aligned at it, are the rows of a positional
   Burrows-Wheeler transform.  All intervals of rows with equal bytes are extended
   backwards, breadth first, by one byte a level, once over the bytes before the
   k-gram and once over the reversed bytes after it, so common prefixes come by
   increasing length (Beller et al., "Computing the longest common prefix array based
   on the Burrows-Wheeler transform", JDA 2013).  Extension stops at ``length``, and
   single rows leave early.  Rows in one interval of that length hold the same
   string; the earliest stays.  A k-gram with more than HOT different contexts is
   settled by grouping the windows themselves, which Spark can spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import stored, texts

K = 32  # bytes of an anchor's k-gram
HOT = 20_000  # contexts of one k-gram that one group holds
LAST = 2**63 - 1  # where a document without an id stands in the order
ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


# -- anchors ---------------------------------------------------------------------------

def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(max(0, n - 1), base, U))])


class Rolling:
    """Hashes of any substring of one byte array, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, pw: np.ndarray, inv: np.ndarray) -> None:
        v = mixed(data.astype(U) + U(1))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(v * pw[: len(v)], dtype=U)])
        self.inv = inv

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U))


def anchors_of(data: np.ndarray, length: int, roll: Rolling) -> np.ndarray:
    """Positions of the k-grams that the windows of one text pick."""
    n, w = len(data), length - K + 1
    at = np.arange(n - K + 1)
    key = (roll(at, at + K) & ~U(0xFFFFFFFF)) | at.astype(U)  # ties: the first
    span, low = 1, key
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(key) - w + 1], low[w - span :])
    low = low[np.r_[True, low[1:] != low[:-1]]] & U(0xFFFFFFFF)
    return low.astype(np.int64)


def in_order(*cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns sorted by the first, the second, ..., without repeated rows;
    and whether each row is the first of its first two columns."""
    o = np.lexsort(cols[::-1])
    cols = [c[o] for c in cols]
    same = lambda n: np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:n]])
    if not len(o):
        return cols, np.zeros(0, bool)
    keep = np.r_[True, ~same(len(cols))]
    return [c[keep] for c in cols], np.r_[True, ~same(2)][keep]


def place(sub: int, pos: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """One number for a place in a text: what tells texts of one id apart (24
    bits), position (32) and the bytes of context after it (7)."""
    return (np.int64(sub) << 39) | pos << 7 | reach


def joined_spans(ord_: np.ndarray, sub: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The spans of each text, sorted, with those that meet made one."""
    o = np.lexsort((lo, sub, ord_))
    ord_, sub, lo, hi = ord_[o], sub[o], lo[o], hi[o]
    if not len(o):
        return [ord_, sub, lo, hi]
    text = np.cumsum(np.r_[False, (ord_[1:] != ord_[:-1]) | (sub[1:] != sub[:-1])])
    far = np.maximum.accumulate(hi + (text << 33)) - (text << 33)  # the furthest end so far, in its text
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (lo[1:] > far[:-1])])
    return [ord_[new], sub[new], lo[new], far[np.r_[new[1:] - 1, len(o) - 1]]]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(kind, h, c, ord, at): anchors (kind 0) with the hashes of their k-gram and
    context; and spans (kind 1; c: the end) that earlier texts of a batch cover."""
    left = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = inv = np.zeros(0, U)
        for b in batches:
            raw = [x.as_buffer() for x in b.column(2)]
            longest = max([1, *(x.size for x in raw)])
            if longest + 1 > len(pw):
                pw, inv = powers(longest + 1, ODD), powers(longest + 1, U(pow(int(ODD), -1, 2**64)))
            ords, subs = b.column(0).to_pylist(), b.column(1).to_pylist()
            found: list[tuple[np.ndarray, ...]] = []
            for i, x in enumerate(raw):
                if x.size < length:
                    continue
                data = np.frombuffer(x, np.uint8)
                roll = Rolling(data, pw, inv)
                p = anchors_of(data, length, roll)
                before, reach = np.minimum(p, left), np.minimum(len(data) - p, length)
                c = mixed(roll(p - before, p + reach) + before.astype(U))
                found.append((roll(p, p + K), c, np.full(len(p), ords[i]), place(subs[i], p, reach)))
            if not found:
                continue
            (h, c, ord_, at), first = in_order(*map(np.concatenate, zip(*found)))
            spans = _whole(ord_[~first], at[~first], length)
            yield _rows(0, h[first], c[first], ord_[first], at[first])
            where = spans[1] << 39 | spans[2] << 7
            yield _rows(1, mixed((spans[0] ^ where).astype(U)), spans[3].astype(U), spans[0], where)

    return docs.mapInArrow(run, "kind byte, h long, c long, ord long, at long")


def _rows(kind: int, h: np.ndarray, c: np.ndarray, ord_: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(h), kind, np.int8)), *(pa.array(x.view(np.int64)) for x in (h, c, ord_, at))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "h", "c", "ord", "at"])


def _whole(ord_: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The spans of whole contexts; those too short for a window go."""
    sub, pos, reach = at >> 39, at >> 7 & 0xFFFFFFFF, at & 127
    lo, hi = pos - np.minimum(pos, length - K), pos + reach
    ok = hi - lo >= length
    return joined_spans(ord_[ok], sub[ok], lo[ok], hi[ok])


def _settled(anchors: DataFrame, length: int) -> DataFrame:
    """(h, ord, at, lo, hi): spans whose context stands earlier (h null), and the
    first place of each context where a k-gram has several (lo null)."""

    def out(h, ord_, at, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, ord_, at, lo, hi)], names=["h", "ord", "at", "lo", "hi"])

    def spans(s: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(s[0]), pa.int64())
        return out(none, s[0], s[1], s[2], s[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, held = None, 0, None  # the last row, contexts of its k-gram so far, its first place if not yet given out
        for b in batches:
            kind, h, c, ord_, at = (x.to_numpy() for x in b.columns)
            ready = kind == 1
            if ready.any():
                yield spans([ord_[ready], at[ready] >> 39, at[ready] >> 7 & 0xFFFFFFFF, c[ready]])
            h, c, ord_, at = (x[~ready] for x in (h, c, ord_, at))
            if not len(h):
                continue
            row = (h[0], c[0], ord_[0], at[0])
            same = lambda k: last is not None and last[:k] == row[:k]
            new_h, new_c, new = (np.r_[not same(k), np.logical_or.reduce([x[1:] != x[:-1] for x in (h, c, ord_, at)[:k]])] for k in (1, 2, 4))
            later = new & ~new_c
            # a repeated row of the first place is the first place
            s = _whole(ord_[later], at[later], length)
            if len(s[0]):
                yield spans(s)
            run_of = np.cumsum(new_h) - new_h[0]
            count = np.bincount(run_of, weights=new_c).astype(np.int64)
            if not new_h[0]:
                if n == 1 and count[0] and held:
                    yield out([held[0]], [held[1]], [held[2]], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()))
                    held = None
                count[0] += n
            give = new_c & (count > 1)[run_of]
            if give.any():
                none = pa.nulls(int(give.sum()), pa.int64())
                yield out(h[give], ord_[give], at[give], none, none)
            n, last = int(count[-1]), (h[-1], c[-1], ord_[-1], at[-1])
            if n == 1:
                first = np.flatnonzero(new_c)
                if len(first) and run_of[first[-1]] == run_of[-1]:
                    held = (h[first[-1]], ord_[first[-1]], at[first[-1]])
            else:
                held = None

    order = ("kind", "h", "c", "ord", "at")
    return anchors.repartition("kind", "h").sortWithinPartitions(*order).mapInArrow(run, "h long, ord long, at long, lo long, hi long")


# -- interval expansion ------------------------------------------------------------------

def extended(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Interval of each row by number of bytes (0 ... columns): rows share it if
    they share the group and the bytes.  -1: alone, or past the text's end (256)."""
    rows, depth = sides.shape
    out = np.full((rows, depth + 1), -1, np.int64)
    live, cur = np.arange(rows), np.unique(group, return_inverse=True)[1]
    out[:, 0] = cur
    for level in range(depth):
        sym = sides[live, level].astype(np.int64)
        inside = sym < 256
        live, key = live[inside], (cur * 257 + sym)[inside]
        if not len(live):
            break
        o = np.argsort(key, kind="stable")
        starts = np.r_[True, key[o][1:] != key[o][:-1]]
        ids = np.cumsum(starts) - 1
        shared = np.bincount(ids)[ids] > 1
        live, cur = live[o][shared], ids[shared]
        out[live, level + 1] = cur
        if not len(live):
            break
    return out


def repeated_spans(group: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes before, bytes from the anchor on) that windows also in an
    earlier row of the group cover; rows are in order of place."""
    left, right = extended(group, before), extended(group, after)
    rows, slack = len(group), length - K
    back, ahead = np.full(rows, -1), np.full(rows, -1)
    for e in range(slack + 1):
        a, b = left[:, slack - e], right[:, e]
        live = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(live):
            continue
        key = a[live] * (rows + 1) + b[live]
        o = np.argsort(key, kind="stable")
        again = live[o][np.r_[False, key[o][1:] == key[o][:-1]]]
        back[again] = np.maximum(back[again], slack - e)
        ahead[again] = np.maximum(ahead[again], e)
    hit = np.flatnonzero(back >= 0)
    return hit, back[hit], K + ahead[hit]


def _contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(h, ord, at, before, after): the bytes round each place, nearest first."""
    by_text = places.groupBy("ord", F.shiftright("at", 39).alias("sub")).agg(F.collect_list(F.struct("h", "at")).alias("places"))
    left = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ord_, data, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = data.as_py()
                for p in places:
                    pos = p["at"] >> 7 & 0xFFFFFFFF
                    rows.append((p["h"], ord_, p["at"], data[max(0, pos - left) : pos][::-1], data[pos + K : pos + length]))
            for s in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows[s : s + 50_000]), [pa.int64()] * 3 + [pa.binary()] * 2)], names=["h", "ord", "at", "before", "after"])

    return docs.join(by_text, ["ord", "sub"]).select("ord", "data", "places").mapInArrow(run, "h long, ord long, at long, before binary, after binary")


def _symbols(col: pa.Array, width: int) -> np.ndarray:
    out = np.full((len(col), width), 256, np.int16)
    for i, x in enumerate(col):
        d = np.frombuffer(x.as_buffer(), np.uint8)
        out[i, : len(d)] = d
    return out


def _expanded(contexts: DataFrame, length: int) -> DataFrame:
    """(ord, at, lo, hi): what interval expansion finds in the groups of one k-gram."""
    width = length - K

    def found(t: pa.Table) -> pa.RecordBatch:
        h, ord_, at = (t.column(k).to_numpy() for k in range(3))
        new = np.r_[True, (h[1:] != h[:-1]) | (ord_[1:] != ord_[:-1]) | (at[1:] != at[:-1])]  # a repeated row counts once
        t = t.filter(pa.array(new))
        h, ord_, at = h[new], ord_[new], at[new]
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
        row, back, ahead = repeated_spans(group, *(_symbols(t.column(k).combine_chunks(), width) for k in (3, 4)), length)
        pos = at[row] >> 7 & 0xFFFFFFFF
        s = joined_spans(ord_[row], at[row] >> 39, pos - back, pos + ahead)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in s], names=["ord", "sub", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            h = t.column(0).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])  # the last k-gram may go on
            if cut == 0 and held and held[-1].column(0)[-1].as_py() == h[0]:
                held.append(t)
                continue
            held.append(t.slice(0, cut))
            if sum(x.num_rows for x in held):
                yield found(pa.concat_tables(held).combine_chunks())
            held = [t.slice(cut)]
        if held and sum(x.num_rows for x in held):
            yield found(pa.concat_tables(held).combine_chunks())

    return contexts.repartition("h").sortWithinPartitions("h", "ord", "at").mapInArrow(run, "ord long, sub long, lo long, hi long")


def _by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(ord, sub, lo, hi): the same by grouping each window, for hot k-grams."""
    width = length - K
    b, a = F.length("before"), F.length("after")
    rows = contexts.select(
        "h", "ord", "at", "before", "after",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(width)), lambda e: (e <= a) & (width - e <= b))).alias("e"))
    bytes_ = F.concat(F.expr(f"substring(before, 1, {width} - e)"), F.expr("substring(after, 1, e)"))
    keyed = rows.select("ord", "at", "e", F.struct("h", "e", F.sha2(bytes_, 256).alias("s")).alias("w"))
    first = stored(keyed.groupBy("w").agg(F.min(F.struct("ord", "at")).alias("first")), "first-windows")
    pos = F.shiftright("at", 7).bitwiseAND(F.lit(0xFFFFFFFF))
    return (keyed.join(first, "w").where(F.struct("ord", "at") != F.col("first"))
            .select("ord", F.shiftright("at", 39).alias("sub"), (pos - (width - F.col("e"))).alias("lo"), (pos + K + F.col("e")).alias("hi")))


# -- the operator ------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    t = texts(docs)
    return t.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.pmod(F.xxhash64("text"), F.lit(1 << 24)).alias("sub"),
        F.col("text").cast("binary").alias("data"), "doc_id")


def repeated_bytes(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(ord, sub, lo, hi): spans of bytes inside strings of ``length`` bytes that
    also start earlier; they may overlap."""
    keyed = _keyed(docs)
    settled = stored(_settled(_anchors(keyed.select("ord", "sub", "data"), length), length), "settled-anchors")
    spans = settled.where("lo is not null").select("ord", F.col("at").alias("sub"), "lo", "hi")
    places = settled.where("lo is null").select("h", "ord", "at")
    many = stored(places.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot-anchors")
    contexts = stored(_contexts(keyed.select("ord", "sub", "data"), places, length), "contexts")
    out = spans.unionByName(_expanded(contexts.join(many, "h", "left_anti"), length))
    if not many.isEmpty():
        out = out.unionByName(_by_windows(contexts.join(many, "h", "left_semi"), length))
    return stored(out, "spans")


def remove_repeated(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text, as UTF-8 bytes,
    without the bytes of strings of ``length`` bytes that start earlier.

    Null texts are empty.  A null doc_id stands after all others.  Rows that
    repeat a doc_id and its text count once, and each gets the result; different
    texts of one doc_id are ordered by their hash.  An empty table gives none.
    """
    spans = repeated_bytes(docs, length, hot)
    by_text = stored(spans.groupBy("ord", "sub").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "text-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, data, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = data.as_py()
                kept, end, n = [], 0, 0
                for s in spans or ():
                    if s["lo"] > end or not n:
                        kept.append(data[end : s["lo"]])
                        n += 1
                    end = max(end, s["hi"])
                kept.append(data[end:])
                kept = b"".join(kept)
                rows.append((id_, len(data), len(data) - len(kept), n, kept))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _keyed(docs).join(by_text, ["ord", "sub"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
