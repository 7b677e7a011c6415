"""The other text operators, the queries and the pipeline, against plain Python."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import chaining, language, mixing, simhash, suffix_dedup, tiling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty values, a long text, repeated rows, one id twice, a null id, clashing columns."""
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n", "en", "s", 2), (3, "7 + 7", "en", None, 5), (4, "wort " * 30_000, "de", "t", 1)]
    rows += [(5, "the word", "en", "s", 8)] * 2 + [(5, "another word", "en", "s", 12), (None, "no id", None, "s", 5)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(n) for n in ("h", "fp", "_k", "_id", "spans", "copies", "data", "ord", "row")])


# -- SimHash -----------------------------------------------------------------------------

def plain_fingerprint(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(g))


def least_reachable(nodes, linked):
    root = dict(zip(nodes, nodes))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in nodes}


def test_fingerprints(spark):
    texts = [None, "", "A b", "Ä b C d \x0b e\tf", "a  b\nc a b c"] + [" ".join(random.Random(i).choices("ab cd ef gh".split(), k=i)) for i in range(40)]
    out = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.fp % 2**64 == plain_fingerprint(texts[r.doc_id]) for r in out)


@pytest.mark.parametrize("small", [4_096, 0])
def test_links_span_all_near_pairs(small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(6)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    fps = np.array(sorted(fps), dtype=np.uint64)
    rows = [(a, fps[row], np.full(len(a), home)) for a, row, home in simhash.anchors(fps, simhash.golay())]
    a, f, home = (np.concatenate(x) for x in zip(*rows))
    assert len(a) <= 68 * len(fps)
    o = np.argsort(a, kind="stable")
    u, v = simhash.anchor_links(a[o], f[o], home[o], 2)
    links = set(zip(u.tolist(), v.tolist())) | set(zip(v.tolist(), u.tolist()))
    assert all((x ^ y).bit_count() <= 64 for x, y in links)
    nodes = fps.tolist()
    assert least_reachable(nodes, lambda x, y: (x, y) in links) == least_reachable(nodes, lambda x, y: (x ^ y).bit_count() <= 2)


def test_mask_lookup_equals_comparison(monkeypatch):
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 6)).astype(np.uint64)))
    home = np.ones(len(fp), bool)
    near = simhash._dense(fp, home, 2)[1]
    monkeypatch.setattr(simhash, "_masks", lambda n, f=simhash._masks: f(n))
    big = np.concatenate([fp, rng.integers(0, 2**63, 3_000).astype(np.uint64)])
    assert np.array_equal(near, simhash._dense(big, np.ones(len(big), bool), 2)[1][: len(fp)])


def test_simhash_on_tables(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = least_reachable(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in fp}
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(want.values()))
    assert simhash.simhash_components(odd).count() == odd.count() and simhash.simhash_components(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()].count(5) == 2 and simhash.one_of_each(empty).count() == 0


# -- repeated strings ------------------------------------------------------------------------

def kept_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_strings(spark, hot):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([0, 50, 99, 100, 101, 150, 400]))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(0, 40) :][: rng.randrange(60, 300)] for _ in range(rng.randrange(0, 5)))) for i in range(120)]
    rows += [(1_000 + i, "ab" * rng.randrange(40, 200)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated(docs, hot=hot).collect()}
    assert got == kept_bytes(rows)


def test_repeated_strings_odd_rows(spark, odd, empty):
    out = suffix_dedup.remove_repeated(odd).collect()
    assert len(out) == odd.count() and suffix_dedup.remove_repeated(empty).count() == 0
    assert {r.n_removed for r in out if r.doc_id == 5} == {0}
    same = spark.createDataFrame([(1, "x" * 80 + "y" * 80)] * 2 + [(2, "x" * 80 + "y" * 80)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeated(same).collect()) == [(1, 0), (1, 0), (2, 160)]


# -- language ------------------------------------------------------------------------------------

def test_best_paths_are_best():
    rng = np.random.default_rng(0)
    scores, first, size = rng.normal(size=(30, 3)) * 3, np.array([0, 6, 7, 15]), np.array([6, 1, 8, 7])
    got = language.best_paths(scores, first, size, 2.0)
    for f, n in zip(first, size):
        value = lambda q: sum(scores[f + i, x] for i, x in enumerate(q)) - 2.0 * sum(a != b for a, b in zip(q, q[1:]))  # noqa: E731, B023
        assert tuple(got[f : f + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)


def test_long_paths_are_best():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 57, 400):
        scores = rng.normal(size=(n, 4)) * 3
        assert (language.long_path(scores, 2.0) == language.best_paths(scores, np.array([0]), np.array([n]), 2.0)).all()


def test_texts_in_parts_are_labelled_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    rng, texts = random.Random(3), [r.text or "" for r in docs.collect()]
    mixed = ["\n".join(rng.choice(texts)[:300] for _ in range(8)) + "x" * 500 for _ in range(20)]
    whole = [language._labelled([t], model, language.SWITCH)[0] for t in mixed]
    monkeypatch.setattr(language, "CHARS", 150)
    assert [language._labelled([t], model, language.SWITCH)[0] for t in mixed] == whole
    assert all("".join(x for _, x in language._slices(t)) == t for t in mixed)


def test_very_long_text(spark):
    import time
    import tracemalloc

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    text = " ".join(r.text or "" for r in docs.collect())
    text = (text * (1 + 5_000_000 // len(text)))[:5_000_000]
    tracemalloc.start()
    began = time.monotonic()
    lang, score, spans = language._labelled([text], model, language.SWITCH)[0]
    assert time.monotonic() - began < 30 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert 0 < score < 1 and len(spans) > 1_000


def test_language_spans(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.where(language.may_learn(F.col("doc_id"))))
    rows = language.label_spans(docs, model, "doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    one = {r.lang: r.text for r in docs.where("n_chars > 800").collect()}
    text = one["de"][:400] + "\n" + one["es"][:400]
    mixed = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = language.label_spans(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "es"] and abs(spans[1].start - 401) < 30
    out = {r.doc_id: r for r in language.label_spans(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 3)) and None in out
    assert language.label_spans(empty, model).count() == 0
    none = language.learn(empty)
    assert {r.lang_pred for r in language.label_spans(odd, none).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, k, None, 0) for i in range(0, 60) for k, t in (("ru", "это слово"), ("en", "that word"))]
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    x = spark.createDataFrame([(1, "слон that word слово")], "doc_id long, text string")
    words = language.read_words(["слон thатх"], model.abc)
    assert model.word_scores(words)[0][model.langs.index("en")] <= -4 * language.FOREIGN
    assert language.label_spans(x, model, switch=1.0).first().spans[1].lang == "en"


# -- tiling -------------------------------------------------------------------------------------------

def test_tiles_of_reordered_passage():
    item, doc = np.arange(1, 13), np.array([99, 7, 8, 9, 10, 11, 12, 50, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5])
    assert tiling.tiles(item, doc) == [(0, 8, 6), (6, 1, 6)]
    assert tiling.tiles(np.arange(4), np.arange(4)) == []


def plain_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), 0
    while True:
        best, runs = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, runs = n, []
                if n == best:
                    runs.append((i, j))
        for i, j in runs:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best], free_b[j : j + best] = [False] * best, [False] * best
                out += best
        if not runs:
            return out


@pytest.mark.parametrize("block", [10**6, 30])
def test_contaminated(spark, odd, empty, block):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices("a b c d e f g".split(), k=rng.choice([0, 3, 12, 20])))) for i in range(12)] + [(99, None)]
    docs = []
    for i in range(60):
        w = rng.choices("a b c d e f g h".split(), k=rng.randrange(30))
        if i % 2:
            p = items[i % 12][1].upper().split()
            w += p[len(p) // 2 :] + ["h"] + p[: len(p) // 2]
        docs.append((i, " ".join(w)))
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = (x or "").split(), t.lower().split()
            if a and plain_tiles(a, b, min(5, len(a))) >= 0.8 * len(a):
                want.add((d, i))
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in tiling.contaminated(frame, table, block=block).collect()} == want and len(want) > 10
    assert {r.doc_id for r in tiling.without_contaminated(frame, table).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    none = table.where("item_id < 0")
    assert tiling.contaminated(odd, none).count() == tiling.contaminated(empty, table).count() == 0
    assert tiling.without_contaminated(odd, none).count() == odd.count()


# -- passages ---------------------------------------------------------------------------------------

def test_chains_are_collinear_and_best():
    rng = random.Random(9)
    for _ in range(40):
        pairs = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(7)})
        b, a = [x for x, _ in pairs], [y for _, y in pairs]
        cost = lambda q: chaining.SEED * len(q) - chaining.COST * sum(b[y] - b[x] + a[y] - a[x] for x, y in zip(q, q[1:]))  # noqa: E731, B023
        ordered = [q for n in range(1, 8) for q in itertools.combinations(range(len(b)), n) if all(b[x] < b[y] and a[x] < a[y] for x, y in zip(q, q[1:]))]
        got = chaining.chains(b, a)
        assert cost(got[0]) == pytest.approx(max(map(cost, ordered))) and sorted(x for q in got for x in q) == list(range(len(b)))


def test_common_words():
    rng = random.Random(3)
    for _ in range(300):
        x, y = (np.array([rng.randrange(4) for _ in range(rng.randrange(31))], np.uint32) for _ in range(2))
        row = [0] * (len(y) + 1)
        for v in x:
            diag = 0
            for j, w in enumerate(y):
                diag, row[j + 1] = row[j + 1], diag + 1 if v == w else max(row[j + 1], row[j])
        assert chaining.common_words(x, y) == row[-1]


def test_room_bounds_what_a_pair_can_be_drawn_out():
    rng = np.random.default_rng(5)
    for _ in range(100):
        x, y = (rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64) << np.uint64(40) for _ in range(2))
        i, j = rng.integers(0, len(x) - chaining.SEED + 1, 20), rng.integers(0, len(y) - chaining.SEED + 1, 20)
        got = chaining.room(chaining.around(x, i), chaining.around(y, j))
        for a, b, g in zip(i, j, got):
            left = next((k for k in range(chaining.MARGIN) if a - k < 1 or b - k < 1 or x[a - k - 1] != y[b - k - 1]), chaining.MARGIN)
            ends = [v[c + chaining.SEED :] for v, c in ((x, a), (y, b))]
            right = next((k for k, (v, w) in enumerate(zip(*ends)) if v != w), min(map(len, ends)))
            assert g >> 8 >= min(left, chaining.MARGIN) and g & 255 >= min(right, chaining.MARGIN)


def test_pairs_of_no_passage_go():
    rng = random.Random(6)
    for _ in range(60):
        least = rng.choice([12, 30])
        rows = sorted({(rng.randrange(2), 0, rng.randrange(3), 0, rng.randrange(150), rng.randrange(9)) for _ in range(rng.randrange(1, 40))})
        o, s, so, ss, p, _ = (np.array(c) for c in zip(*rows))
        wide = np.array([rng.randrange(5) * 256 + rng.randrange(5) for _ in rows])
        covered = set()  # words that a chain may hold, with the places between them
        for k, r in enumerate(rows):
            end = r[4] + chaining.SEED + wide[k] % 256
            for q in rows:
                if q[:4] == r[:4] and r[4] < q[4] <= r[4] + chaining.GAP + chaining.SEED:
                    end = max(end, q[4])
            covered |= {(r[0], 2 * w + h) for w in range(max(0, r[4] - wide[k] // 256), end + 1) for h in (0, 1) if w < end or not h}
        for k, ok in enumerate(chaining.may_repeat(o, s, so, ss, p, wide, least)):
            lo = hi = 2 * rows[k][4]
            while (rows[k][0], lo - 1) in covered:
                lo -= 1
            while (rows[k][0], hi + 1) in covered:
                hi += 1
            assert ok == (hi - lo >= 2 * least)


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3_000)]
    passages = [rng.choices(words, k=60) for _ in range(5)]
    rows, holds = [], {}
    for i in range(160):
        t = rng.choices(words, k=rng.randrange(200))
        if i % 4 == 1:
            p = list(passages[i % 5])
            if i % 8 == 5:
                p[20] = "edit"
                p.insert(40, "new")
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
            holds[i] = i % 5
        rows.append((i, " ".join(t)))
    first = {min(i for i, k in holds.items() if k == x) for x in range(5)}
    got = {r.doc_id: r for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(holds) - first and all(55 <= r.n_repeated <= 66 for r in got.values())
    assert all(holds[s] == holds[i] for i, r in got.items() for s in r.sources)
    assert chaining.repeated_passages(odd).count() == 0 and chaining.repeated_passages(empty).count() == 0


def test_passages_whose_seeds_stand_elsewhere(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(20_000)]
    p = rng.choices(words, k=60)
    scraps = [rng.choices(words, k=30) + p[k : k + 12] + rng.choices(words, k=30) for k in range(0, 60, 7)]
    whole = [rng.choices(words, k=80) + p + rng.choices(words, k=80) for _ in range(2)]
    texts = [*scraps, whole[0], *scraps[::-1], whole[1]]  # scraps are first and last before the second
    texts[len(scraps) + 1 : -1] = [rng.choices(words, k=9) + t[30:42] for t in texts[len(scraps) + 1 : -1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    last = got[len(rows) - 1]
    assert len(scraps) in last.sources and 60 <= last.n_repeated <= 62 and set(got) <= {len(scraps), len(rows) - 1}


def test_edited_passages(spark):
    rng = random.Random(22)
    words = [f"w{i}" for i in range(20_000)]
    rows = []
    for n, share in ((60, 0.05), (60, 0.1), (100, 0.1), (100, 0.15)):  # every tenth word, or as many at random
        for k in range(10):
            p = rng.choices(words, k=n)
            q, inner = list(p), range(4, n - 4)
            for at in range(9, n - 4, 10) if share == 0.1 and k < 5 else rng.sample(inner, round(share * n)):
                q[at] = "edit"
            for x in (p, q):
                rows.append((len(rows), " ".join(rng.choices(words, k=50) + x + rng.choices(words, k=50))))
    got = {r.doc_id for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got <= set(range(1, len(rows), 2)) and len(got) >= 0.95 * len(rows) / 2


def _all_pairs(rows):
    """The passages by chains of every document with every earlier one, on all seeds they share."""
    out, seen = {}, []
    for doc, text in rows:
        w, first = chaining.Reader().words([text.encode()])
        seeds = {}
        for h, at in zip(*map(np.concatenate, zip(chaining.seeds_of(w, first), chaining.long_seeds(w, first)))):
            seeds.setdefault(h, []).append(int(at))
        spans, w = [], (w >> np.uint64(32)).astype(np.uint32)
        for v, others in seen:
            pairs = sorted({(x, y) for h in seeds.keys() & others.keys() for x in seeds[h] for y in others[h]})
            b, a = [x for x, _ in pairs], [y for _, y in pairs]
            for part in (c for chain in chaining.chains(b, a) for c in chaining._cut(b, a, chain)):
                lo, hi, s_lo, s_hi, n = chaining.aligned(w, v, [x for x, _ in part], [y for _, y in part])
                if n >= chaining.SAME * max(hi - lo, s_hi - s_lo):
                    spans.append((lo, hi))
        seen.append((w, seeds))
        merged = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        if merged := [(lo, hi) for lo, hi in merged if hi - lo >= chaining.LEAST]:
            out[doc] = merged
    return out


def test_passages_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(0)
    words, few = [f"w{i}" for i in range(3_000)], [f"v{i}" for i in range(6)]
    passages, line = [rng.choices(words, k=rng.randrange(30, 90)) for _ in range(6)], rng.choices(words, k=12)
    rows = []
    for i in range(120):
        t = rng.choices(words, k=rng.randrange(10, 60))
        for _ in range(rng.randrange(4)):
            r = rng.random()
            if r < 0.5:  # a piece of a passage, edited
                p = list(rng.choice(passages))
                x = rng.randrange(len(p) // 2 + 1)
                p = p[x : rng.randrange(x + 8, len(p) + 9)]
                for _ in range(rng.randrange(7)):
                    p[rng.randrange(len(p))] = rng.choice(words)
            else:
                p = line if r < 0.8 else [rng.choice(few)] * rng.randrange(3, 120) if r < 0.9 else rng.choices(few, k=rng.randrange(8, 40))
            t += p + rng.choices(words, k=rng.randrange(12))
        rows.append((i, " ".join(t)))
    rows += [(120 + i, rows[7 * i][1]) for i in range(9)]
    want, docs = _all_pairs(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(want) > 15
    for part, meet in ((chaining.PART, chaining.MEET), (200, 50)):  # any number of tasks gives the same
        monkeypatch.setattr(chaining, "PART", part)
        monkeypatch.setattr(chaining, "MEET", meet)
        assert {r.doc_id: [tuple(p) for p in r.passages] for r in chaining.repeated_passages(docs).collect()} == want


def test_copies_and_a_common_line_leave_nothing_open(spark, monkeypatch):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(50_000)]
    whole, line = rng.choices(words, k=100), rng.choices(words, k=12)
    rows = [(i, " ".join(whole if i % 2 else rng.choices(words, k=20) + line + rng.choices(words, k=20))) for i in range(120)]
    sizes, keep = [], chaining.stored

    def counted(df, name):
        out = keep(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(chaining, "stored", counted)
    got = {r.doc_id: [tuple(p) for p in r.passages] for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: [(0, 100)] for i in range(3, 120, 2)}
    # copies have no seeds among the others, and a short line alone is met by nothing
    known = [name for name, _ in sizes].index("known-passages")
    assert all(n <= 6 * 60 for _, n in sizes) and all(n == 0 for name, n in sizes[known + 1 :] if name != "passages")


# -- mixing ----------------------------------------------------------------------------------------------

def test_mixture_meets_its_targets(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 40), None, "big" if i % 3 else f"s{i % 4}" if i % 5 else None, 0) for i in range(1_500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs, entropy=0.9).collect()
    size, got, weight = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r.n_words
        got[r.source] += r.n_words * r.copies
        weight[r.source] = r.weight
    total = sum(size.values())
    a = math.log(weight["big"] / weight["s0"]) / math.log(size["big"] / size["s0"])
    assert all(w == pytest.approx(size[s] ** a / sum(v**a for v in size.values())) for s, w in weight.items())
    assert -sum(w * math.log(w) for w in weight.values()) / math.log(len(weight)) == pytest.approx(0.9, abs=1e-6)
    assert all(abs(got[s] - weight[s] * total) <= 40 for s in size)
    copies = {}
    for r in out:
        copies.setdefault(r.source, set()).add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in copies.values())
    again = {s: w for s, w in {r.source: r.weight for r in mixing.mixed(docs, entropy=1.0, repeats=1.5).collect()}.items()}
    assert max(w * total / size[s] for s, w in again.items()) == pytest.approx(1.5, abs=1e-4)
    turns = mixing.schedule(mixing.mixed(docs, entropy=0.9))
    assert turns.count() == sum(r.copies for r in out) and turns.select("doc_id", "block").distinct().count() == turns.count()
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(empty).count() == 0


# -- near copies ----------------------------------------------------------------------------

def plain_shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# -- pipeline -----------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in left.collect()}
        left = spark.createDataFrame(stage(spark, left, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in left.collect()}
        assert left.columns == columns and set(after) <= set(before)
        if name == "near_dedup":
            fp = {i: plain_fingerprint(t) for i, t in before.items()}
            assert set(after) == set(least_reachable(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2).values())
        if name == "decontamination":
            items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, t in before.items() if any(plain_tiles(x, t.lower().split(), 5) >= 0.8 * len(x) for x in items if set(x) & set(t.lower().split()) and len(set(x) - set(t.lower().split())) <= 0.3 * len(x))}
            assert set(after) == set(before) - bad
    last = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in left.collect()}
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.block) for r in out.collect()) == sorted((r.doc_id, r.block) for r in last.collect())
    for _, stage in corpus_pipeline.STAGES:
        most = 4 * odd.count() if stage is corpus_pipeline.mixture else odd.count()
        assert stage(spark, odd, SF).count() <= most and stage(spark, empty, SF).count() == 0


def test_digests(spark):
    from logweir.llm.queries import QUERIES

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in kept_bytes(docs).items()}
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()} == want
    assert len(QUERIES) == 13
