"""The operators that use DataFrame functions only, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.llm import licenses, line_dedup, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "x", "a a a a a a", "é😀 ß", "word " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty values, a long text, repeated rows, a null id, a clashing column."""
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (None, "x y", "en", "s", 3)]
    names = ["kind", "word", "n", "t", "w", "_k", "spans", "copies", "lines"]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(t):
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[name]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_search(spark):
    rng = random.Random(1)
    texts = [
        None, "", "a@b.c_d@e.f", "x@y@z.com 1.2.3.4.5.6.7.8.9 256.1.1.1 01.002.0003.4", "+1 (743) 555-3824 +1 (743) 555-3824x+1+2",
        "4111 1111 1111 1111 4111-1111-1111-1111-4", "é😀 me@x.org 4111111111111111", "a.b@@c.d@e..f a@b.c.", "1.1.1.1@2.2.2.2", "9" * 3_000, "a." * 3_000 + "@b.c",
    ] + ["".join(rng.choice("a1.2 @+-(5é") for _ in range(rng.randrange(5, 80))) for _ in range(300)]
    got = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        base = [(x.s, x.kind, x.e) for x in r.base]
        assert base == base_spans(texts[r.doc_id]), texts[r.doc_id]
        spans = [(x.s, x.kind, x.e) for x in r.spans]
        assert set(base) <= set(spans) and spans == sorted(spans)


def test_texts_of_very_many_addresses(spark):
    """Every tenth address is none; what is near a match is known in every chunk."""
    import time

    text = " ".join(f"mail user{i}@host{i}.example" if i % 10 else f"ip 10.0.{i % 256}.7 x" for i in range(20_000))
    few = spark.createDataFrame([(1, text[:3_000])], "doc_id long, text string")
    many = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.pii_spans(few).collect()
    began = time.monotonic()
    pii.pii_spans(few).collect()
    middle = time.monotonic()
    row = pii.pii_spans(many).first()
    assert [(s.s, s.kind, s.e) for s in row.base] == base_spans(text) and len(row.base) == 20_000
    assert time.monotonic() - middle < 30 + (middle - began)


def test_boosted_candidates_follow_confirmed_form(spark):
    # cards of sixteen digits pass their checksum; a seventeenth form never does
    cards = [c for c in (f"45{i:014d}" for i in range(3_000)) if luhn(c)]
    rows = [(i, f"card {c} end") for i, c in enumerate(cards)] + [(10_000 + i, f"no. {i:012d}0 end") for i in range(200)]
    rows += [(20_000, "card 4500000000000001 end"), (20_001, "no. 0000000000990 end")]
    out = {r.doc_id: r for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 20000").collect()}
    assert not out[20_000].base and [(x.s, x.e) for x in out[20_000].spans] == [(5, 21)]
    assert not out[20_001].spans


def test_pii_odd_rows(odd, empty):
    assert pii.pii_spans(odd).count() == odd.count()
    assert pii.pii_spans(empty).count() == 0


# -- quality rules ----------------------------------------------------------------------

def counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    at, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            covered.update(x for i in v for x in (i, i + 1, i + 2))
    for x in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))


def test_quality_counts(spark, odd):
    rng = random.Random(2)
    texts = [*ODD, " a b  a b a b \n\n a\n a ", "a\tb\x0bc\x0ca b\rc"] + ["".join(rng.choice("ab \n#|") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for r in quality.measured(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


def test_cutoffs_hold_their_promise(spark):
    from math import comb

    # 2,000 good documents, of which 2 have many symbols: 0.1 % against 1 % a rule
    good = [("en", 100, 500, 90 if i < 2 else 1, 10, 0, 0) for i in range(2_000)] + [("de", 100, 500, 90, 10, 0, 0)] * 50
    m = spark.createDataFrame(good, "stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(m).collect()}
    assert got["en", "symbols"] == 0.1 and not any(s == "de" for s, _ in got)
    n, k, p = 400, 3, 0.02
    tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    x = spark.sql(f"select exp({quality.log_binomial_tail('n', 'k', p)}) as t from (select {n}L as n, {k}L as k)").first().t
    assert x == pytest.approx(tail)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(odd, labels)
    assert out.count() == odd.count() and out.where("kept and base_failed").count() == 0
    assert quality.quality_rules(empty, labels).count() == 0


# -- licences ------------------------------------------------------------------------------

def best_notices(t):
    sets = sorted((n, sorted(licenses.bigrams(licenses.normal_words(x)))) for n, x in licenses.TEMPLATES)
    units = [("line", i, x) for i, x in enumerate((t or "").split("\n"))]
    units += [("paragraph", i, x) for i, x in enumerate(re.split(r"\n[ \t\r#*/;%-]*\n", t or "")) if "\n" in x.strip("\n")]
    out = []
    for u, i, x in units:
        g = licenses.bigrams(licenses.normal_words(x))
        if g:
            d, _, n = max((2 * len(g & set(s)) / (len(g) + len(s)), -k, n) for k, (n, s) in enumerate(sets))
            if d >= 0.8 - 1e-12:
                out.append((u, i, n, d))
    return out


def test_license_notices(spark, odd, empty):
    rng = random.Random(3)
    texts = [*ODD, "Released under the MIT license", "x\nLicensed under the  APACHE License, version 2.0\ny", "released\nunder the\nMIT License"]
    for _, t in licenses.TEMPLATES:
        w = t.split()
        for _ in range(6):
            v = [x for x in w if rng.random() > 0.08]
            v.insert(rng.randrange(len(v) + 1), "word")
            texts.append(" ".join(v) + rng.choice(["", "\nmore", "\n\nend"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.number, r.license, r.dice) for r in licenses.license_notices(docs).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in best_notices(t)) and len(got) > 60
    assert licenses.license_notices(odd).count() == 0 and licenses.license_notices(empty).count() == 0


def test_notice_in_a_comment_block(spark):
    """A header in comment marks, whose blank lines hold a mark alone."""
    notice = next(t for n, t in licenses.TEMPLATES if t.startswith("This program is free software"))
    words = notice.split()
    lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
    text = "\n".join(["# A program for something else", "#", *[f"# {x}" for x in lines], "#", "# You should have received a copy of it", "x = 1"])
    got = licenses.license_notices(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.unit, r.license, round(r.dice, 3)) for r in got if r.unit == "paragraph"] == [("paragraph", "GPL-3.0", 1.0)]


# -- lines -----------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def changed(rng, line, most):
    b = list(line)
    for _ in range(rng.randrange(most + 1)):
        k, o = rng.randrange(len(b) + 1), rng.random()
        if o < 0.4 and k < len(b):
            b[k] = rng.choice("xyz")
        elif o < 0.7:
            b.insert(k, rng.choice("xyz"))
        elif k < len(b):
            del b[k]
    return "".join(b)


def test_banded_distance(spark):
    rng, pairs = random.Random(4), []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(3, 30)))
        a, b = sorted((a, changed(rng, a, 3) or "x"), key=len, reverse=True)
        pairs.append((a, b))
    x = spark.createDataFrame(pairs, "a string, b string").withColumns({"p": F.split("a", ""), "t": F.split("b", "")})
    for r in x.selectExpr("a", "b", *[f"{line_dedup.banded_distance('p', 't', k)} as d{k}" for k in (1, 2)]).collect():
        e = edits(r.a, r.b)
        for k, d in ((1, r.d1), (2, r.d2)):
            if len(r.b) >= k:
                assert d == e if e <= k else d > k


@pytest.mark.parametrize("pairs", [24, 2])
def test_repeated_lines(spark, pairs):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([3, 19, 20, 21, 25, 40]))) for _ in range(12)]
    rows = [(i, "\n".join(changed(rng, rng.choice(base), 2) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    lines = [(i, n, x) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    u = sorted({x for _, _, x in lines})
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if min(len(a), len(b)) >= 20 and edits(a, b) <= 1:
                root[find(a)] = find(b)
    seen, gone = set(), {}
    for i, n, x in lines:
        if find(x) in seen:
            gone.setdefault(i, []).append(n)
        seen.add(find(x))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.gone for r in line_dedup.repeated_lines(docs, pairs).collect()} == gone


def test_lines_odd_rows(odd, empty):
    out = line_dedup.without_repeated_lines(odd)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and rows[0].text is None and rows[0].n_lines == 0
    assert rows[4].n_removed == 0 and rows[7].text == ODD[7]
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_digest_of_no_span(spark):
    none = hashlib.sha256(b"").hexdigest()
    x = pii.pii_spans(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert x.select(F.sha2(F.expr(pii.written("base")), 256)).first()[0] == none
