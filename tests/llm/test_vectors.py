"""Conversation repair, top-k search and whitening, against plain Python, through the registered queries."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logweir.llm import conversations, pivots, whitening

SF = "/root/testdata/sf0.001"
CLASHES = ("at", "c", "x", "z", "d", "n", "row", "part", "block", "kind", "score", "rank", "component", "index", "vector", "fault", "edit", "tie")


def written(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clashing(df):
    return df.select("*", *[F.lit(1).alias(n) for n in CLASHES])


# -- conversation repair ----------------------------------------------------------------------

BLANK = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(h, text)
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's damaged rows: best
    whole audits per row and state, compared as strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for r in rows:
        t = r[3].rstrip(BLANK)
        faults.append("blank" if not t else "duplicate" if r[2:] in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add(r[2:])
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for s in best:
                c, audit, text = best[new[s]]
                best[s] = min(best[s], (c + 2, "I" + audit, (f"{names[new[s]]}:", *text)))
        return best

    none = (math.inf, "", ())
    best = inserted({"": (0, "", ()), "s": none, "u": none, "a": (0, "", ())})
    for r, f, i in list(zip(rows, faults, initials))[::-1]:
        now = {}
        for s in best:
            c, audit, text = best[s]
            ways = [(c + 3, "D" + audit, text)]
            if f not in ("blank", "duplicate"):
                if (s, i) in step:
                    c, audit, text = best[step[s, i]]
                    ways.append((c + (f is not None), "K" + audit, (f"{r[2]}:{r[3]}", *text)))
                c, audit, text = best[new[s]]
                ways.append((c + 2 + (f is not None), "R" + audit, (f"{names[new[s]]}:{r[3]}", *text)))
            now[s] = min(ways)
        best = inserted(now)
    cost, audit, text = best[""]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
    )


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def held_to_plain(df, got):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    hurt = plain_damage(rows)
    want = {c: plain_repair([r for r in hurt if r[0] == c]) for c in {r[0] for r in rows}}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert got == want


def test_repair_of_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    held_to_plain(df, entry.queries()["op11_conversation_repair"](spark, SF))


def test_repair_of_long_conversations_crosses_many_blocks(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv, n in [(1, 700), (2, 1), (3, 120), (4, 3), (None, 260), (9, 40)]:
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((conv, t + (t > 50) * 3, rng.choice([role, role, role, "system", "tool"]), rng.choice(["a.", "b!", "cut", " ", f"text {t}.", f"open {t}"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    held_to_plain(df, entry.queries()["op11_conversation_repair"](spark, written(df, tmp_path, "conversations")))


def test_repair_of_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None), (1, None, "user", "x."), (1, 0, "", "é😀?"), (1, 0, "user", "x."), (1, 0, "user", "x."), (2, None, None, None), (3, 5, "assistant", "w " * 200_000),
        (3, 5, "assistant", "w " * 200_000 + "."), (None, None, "system", "s."), (None, 3, "user", "\n\x0b."), (5, 1, "system", "only."), (6, 2, "system", "a."), (6, 3, "system", "b."), (7, 9, "user", "u.\n "),
    ] + [(c, 0, "user", "x.") for c in range(100, 140)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    held_to_plain(df, entry.queries()["op11_conversation_repair"](spark, written(df, tmp_path, "conversations")))


def test_repair_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert entry.queries()["op11_conversation_repair"](spark, written(df, tmp_path, "conversations")).count() == 0


def test_repair_gives_texts(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (1, 2, "user", "So")]
    out = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("at", "step").collect()
    assert [(r.edit, r.was, r.fault, r.role, r.text) for r in out] == [
        ("I", None, None, "user", ""), ("K", "assistant", None, "assistant", "Hi."), ("K", "user", None, "user", "Well?"), ("R", "user", "truncated", "assistant", "So")]


# -- top-k search ---------------------------------------------------------------------------------

def plain_top(rows, k=5):
    width = max((len(v) for _, v in rows), default=0)
    x = [(i, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for i, v in rows]
    return sorted((q, *r) for q, a in x if q % 50 == 0 for r in [
        (n, i, -s) for n, (s, i) in enumerate(sorted((-sum(p * r for p, r in zip(a, b)), i) for i, b in x if i != q)[:k], 1)])


def top_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert top_rows(entry.queries()["op12_top_k"](spark, SF)) == plain_top(rows)


def test_top_k_with_copies_and_ties(spark, tmp_path, monkeypatch):
    """A third of the rows are one vector; small chunks, samples and pieces."""
    rng = random.Random(5)
    monkeypatch.setattr(pivots, "CHUNK", 7)
    monkeypatch.setattr(pivots, "SAMPLE", 20)
    monkeypatch.setattr(pivots, "FIRST", 3)
    monkeypatch.setattr(pivots, "PIECE", 500)
    rows = [(i, [0.5, -0.25, 1.0, 0.0] if i % 3 == 0 else [rng.choice([-1.0, -0.3, 0.0, 0.2, 0.7]) for _ in range(4)]) for i in range(0, 1800, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    assert top_rows(entry.queries()["op12_top_k"](spark, written(df, tmp_path, "embeddings"))) == plain_top(plain)


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e30])
def test_top_k_of_odd_rows(spark, tmp_path, scale):
    """Null, non-finite and empty vectors, shorter ones, sums that no double holds."""
    rows = [(0, [scale, 1.0]), (50, [-scale]), (1, []), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [scale, 1.0]), (7, [-0.0, scale / 3]), (100, []), (None, [1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = top_rows(entry.queries()["op12_top_k"](spark, written(df, tmp_path, "embeddings")))
    low, high = -(1 << 63), (1 << 63) - 1
    fit = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if scale < 1e20:
        want = plain_top(fit)
        if scale > 1:
            want = [(q, s) for q, _, _, s in want]
            assert [(q, s) for q, _, _, s in got] == [(q, max(low, min(high, s))) for q, s in want]
        else:
            assert got == want
    else:
        assert {(q, v): s for q, _, v, s in got}[0, 6] == high and len(got) == 15


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    query = F.col("vec_id") % 50 == 0
    assert pivots.top_k(spark.createDataFrame([], schema), query).count() == 0
    assert pivots.top_k(spark.createDataFrame([(0, [1.0])], schema), query).count() == 0
    assert top_rows(pivots.top_k(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0])], schema), query)) == [(0, 1, 1, 65536), (0, 1, 1, 131072)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(300, 16)))
    x[10:20] = x[5]
    p = pivots.fit_pivots(x, 32)
    n, d = pivots._measures(x, p)
    assert (pivots._bounds(n, d, n, d) >= x @ x.T).all() and len(p) == 32
    assert len(pivots.fit_pivots(np.ones((9, 3)), 32)) == 1


# -- whitening ----------------------------------------------------------------------------------------

def held_to_numpy(rows, out):
    """Up to the signs of components, for distinct eigenvalues."""
    width = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in rows])
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    e, v = np.linalg.eigh(np.cov((once - s / n).T, bias=True).reshape(width, width))
    e, v = e[::-1], v[:, ::-1]
    k = min(16, width)
    z = (x - s / n) @ v[:, :k] / np.sqrt(e[:k])
    want = sorted((i, c + 1, int(((n * r - s) ** 2).sum()), abs(z[at, c])) for at, ((i, _), r) in enumerate(zip(rows, x)) for c in range(k))
    got = sorted((r.vec_id, r.component, r.deviation, abs(r.whitened)) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-6
    assert {r.n for r in out} == {n} and all(r.identity_error < 1e-4 for r in out)
    assert all(abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-6 for r in out)
    for c in range(1, k + 1):  # one sign for all rows
        signs = {np.sign(r.whitened * z[[i for i, _ in rows].index(r.vec_id), c - 1]) for r in out if r.component == c and abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_whitening_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_to_numpy(rows, entry.queries()["op13_whitening"](spark, SF).collect())


def test_whitening_with_copies_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [5.0, -3.0, 0.0, 1.0] if i % 3 == 0 else [float(c) for c in rng.normal(size=4) * (9, 5, 3, 1)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    held_to_numpy(rows, entry.queries()["op13_whitening"](spark, written(df, tmp_path, "embeddings")).collect())


def test_whitening_of_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [9.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [3.0, -4.0]), (7, [2.5, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = entry.queries()["op13_whitening"](spark, written(df, tmp_path, "embeddings")).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["0"] * 4 + ["1"] * 2 + ["7"] * 2 + ["None"] * 2)
    assert {r.n for r in out} == {4} and all(r.identity_error < 1e-4 for r in out)
    assert len({(r.component, r.whitened, r.deviation) for r in out if r.vec_id == 0}) == 2


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whitening.whitened(spark.createDataFrame([(1, [0.0, 3.0]), (2, [2.0, 3.0]), (3, [1e300, 3.0])], schema)).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3
