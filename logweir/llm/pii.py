"""Personal data: candidates from high-recall generators, scored by boosted trees.

Base patterns give spans that always count.  Looser generators propose more, and
they may overlap.  A candidate is described by a few binned features of its form and
of the text next to it, so all candidates of a corpus fall into at most CELLS cells.
The candidates that a base span confirms (a checksum, a range, a number of digits:
none of them a feature) are the positive examples.  Gradient boosting of depth-two
trees on the counted cells learns what confirmed candidates look like, and a cutoff
for each kind is calibrated on documents that were held back.  The trees become one
SQL expression, so scoring is a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logweir.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns.  A match starts where the last one ended or not
#: inside a run of its own characters, which any leftmost match does; so long runs
#: are read once.  Quantifiers that can't give anything back are possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.:,-][0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?:(?<![0-9])00|\+|\(|(?<![0-9+(]))[0-9]{1,4}+(?:[\x20().-]{1,2}+[0-9]{2,5}+){2,4}+(?![0-9])",
}
CONTEXT = 16  # code points on each side that features look at
#: Words before a value that name its kind, and the separators told apart.
NAMED = {
    "email": "mail|contact|e-mail|write", "ip": "ip|host|addr|server|from",
    "card": "card|visa|master|credit|pay|account", "phone": "tel|phone|call|mobile|fax",
}
BINS = {"kind": 4, "size": 6, "digits": 6, "mark": 6, "left": 4, "right": 4, "named": 2, "first": 5}
CELLS = 2 * math.prod(BINS.values())  # and twice that with the held-back half: what fitting can collect at most
ROUNDS, RATE, LEAST = 24, 0.3, 20  # trees, learning rate, examples in a leaf at least
HOLD = 4  # one document in so many calibrates
KEEP = 0.99  # share of a kind's confirmed candidates that its cutoff keeps
FLOOR = 0.5  # probability below which no cutoff goes


def found(text: str, patterns: dict[str, str], docs: DataFrame, when: str) -> DataFrame:
    """``docs`` with an array per pattern: its matches with start, end (code points)
    and the text on both sides.  Only rows that ``when`` holds for are searched."""
    out = docs
    for k, p in patterns.items():
        p = F.lit(p)
        none = F.expr("cast(array() as array<string>)")
        out = out.withColumn(f"{k}_m", F.when(F.expr(when), F.regexp_extract_all(text, p, F.lit(0))).otherwise(none))
        out = out.withColumn(f"{k}_g", F.when(F.size(f"{k}_m") > 0, F.split(F.col(text), p, -1)).otherwise(none))
    # the place of a match is the length of all before it: summed up to the start of its chunk, of about as many
    # matches as there are chunks, and then from match to match
    spans = []
    for k in patterns:
        out = out.withColumn(f"{k}_n", F.expr(f"transform({k}_m, (t, i) -> length({k}_g[i]) + length(t))"))
        step = f"cast(ceil(sqrt(size({k}_m))) as int)"
        one = f"""aggregate(sequence(c * {step}, least((c + 1) * {step}, size({k}_m)) - 1),
            named_struct('pos', aggregate(slice({k}_n, 1, c * {step}), 0, (x, y) -> x + y), 'out', cast(array() as
            array<struct<t:string,s:int,e:int,l:string,r:string>>)), (a, i) -> named_struct(
            'pos', a.pos + {k}_n[i], 'out', concat(a.out, array(named_struct('t', {k}_m[i],
            's', a.pos + {k}_n[i] - length({k}_m[i]), 'e', a.pos + {k}_n[i],
            'l', right({k}_g[i], {CONTEXT}), 'r', left({k}_g[i + 1], {CONTEXT}))))), a -> a.out)"""
        none = "cast(array() as array<struct<t:string,s:int,e:int,l:string,r:string>>)"
        spans.append(F.expr(f"if(size({k}_m) = 0, {none}, flatten(transform(sequence(0, cast((size({k}_m) - 1) div {step} as int)), c -> {one})))").alias(k))
    return out.select(*docs.columns, *spans)


def _valid(kind: str, t: str) -> str:
    """SQL: whether a match of a base pattern counts."""
    digits = f"regexp_replace({t}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({t}, '[.]'), p -> p rlike '^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
        "card": f"length({digits}) between 14 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 10 and 15",
    }[kind]


def _side(x: str) -> str:
    return f"case when {x} is null or {x} = '' then 0 when {x} rlike '[0-9]' then 1 when {x} rlike '[ \\t-\\r]' then 2 else 3 end"


def _features(kind: str) -> str:
    """SQL: the binned features of a loose match x."""
    digits = "length(regexp_replace(x.t, '[^0-9]', ''))"
    return f"""named_struct('kind', {KINDS.index(kind)},
        'size', case when length(x.t) < 10 then 0 when length(x.t) < 14 then 1 when length(x.t) < 16 then 2
                     when length(x.t) < 18 then 3 when length(x.t) < 24 then 4 else 5 end,
        'digits', case when {digits} < 7 then 0 when {digits} < 10 then 1 when {digits} < 12 then 2 when {digits} < 14 then 3
                       when {digits} < 17 then 4 else 5 end,
        'mark', case when x.t rlike '^[0-9]+$' then 0 when x.t rlike '[(]' then 1 when x.t rlike '[ ]' then 2
                     when x.t rlike '[-]' then 3 when x.t rlike '[.]' then 4 else 5 end,
        'left', {_side("right(x.l, 1)")}, 'right', {_side("left(x.r, 1)")},
        'named', if(x.l rlike '(?i)({NAMED[kind]})[^0-9]*$', 1, 0),
        'first', case when x.t rlike '^[+]' then 0 when x.t rlike '^0' then 1 when x.t rlike '^[1-3]' then 2
                      when x.t rlike '^[4-9]' then 3 else 4 end)"""


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, s, e) and loose (kind, s, e, confirmed, f: features)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("hit", F.expr("contains(t, '@') or t rlike '[0-9]' or contains(t, '[at]') or contains(t, '(at)')"))
    every = {f"b_{k}": p for k, p in BASE.items()} | {f"c_{k}": p for k, p in LOOSE.items()}
    d = found("t", every, d, "hit").drop("t", "hit")
    d = d.select("doc_id", *[f"c_{k}" for k in KINDS], *[
        F.expr(f"transform(filter(b_{k}, x -> {_valid(k, 'x.t')}), x -> named_struct('kind', {i}, 's', x.s, 'e', x.e))").alias(f"b_{k}")
        for i, k in enumerate(KINDS)])
    # base spans of a kind are in order and apart, so the last one that begins before a candidate's end tells if any
    # overlaps it; it is looked for by the first spans of chunks, then in its chunk
    for k in KINDS:
        step = f"greatest(1, cast(ceil(sqrt(size(b_{k}))) as int))"
        d = d.withColumn(f"o_{k}", F.expr(f"if(size(b_{k}) = 0, cast(array() as array<array<struct<kind:int,s:int,e:int>>>), "
                                          f"transform(sequence(0, cast((size(b_{k}) - 1) div {step} as int)), c -> slice(b_{k}, c * {step} + 1, {step})))"))
        d = d.withColumn(f"f_{k}", F.expr(f"transform(o_{k}, x -> x[0].s)"))
    loose = [
        f"""transform(c_{k}, x -> named_struct('kind', {i}, 's', x.s, 'e', x.e, 'confirmed',
            if(coalesce(exists(get(o_{k}, size(filter(f_{k}, s -> s < x.e)) - 1), b -> b.s < x.e and x.s < b.e), false), 1, 0), 'f', {_features(k)}))"""
        for i, k in enumerate(KINDS)]
    return d.select("doc_id", F.concat(*[f"b_{k}" for k in KINDS]).alias("base"), F.expr(f"concat({', '.join(loose)})").alias("loose"))


# -- boosting on counted cells -------------------------------------------------------------

Split = tuple[str, int]


def _best(cells: list[Row], grads: list[tuple[float, float]], own: list[int]) -> tuple[float, Split | None]:
    """The split with most gain of some cells, by sums of gradients a bin."""
    gain, at = 1e-9, None
    total = [sum(grads[i][j] for i in own) for j in (0, 1)]
    for f, n in BINS.items():
        bins = [[0.0, 0.0, 0] for _ in range(n)]
        for i in own:
            x = bins[cells[i][f]]
            x[0] += grads[i][0]
            x[1] += grads[i][1]
            x[2] += cells[i]["n"]
        left, size, every = [0.0, 0.0], 0, sum(b[2] for b in bins)
        for cut in range(n - 1):
            left[0] += bins[cut][0]
            left[1] += bins[cut][1]
            size += bins[cut][2]
            if min(size, every - size) < LEAST:
                continue
            g, h = total[0] - left[0], total[1] - left[1]
            won = left[0] ** 2 / (left[1] + 1) + g**2 / (h + 1) - total[0] ** 2 / (total[1] + 1)
            if won > gain:
                gain, at = won, (f, cut)
    return gain, at


def fit(cells: list[Row]) -> list[str]:
    """Boosted depth-two trees on cells (features, y, n), as SQL terms to add up."""
    pos, n = (sum(c["n"] for c in cells if y is None or c["y"] == y) for y in (1, None))
    start = math.log((pos + 1) / (n - pos + 1))
    score, terms = [start] * len(cells), [repr(start) + "D"]
    for _ in range(ROUNDS if 0 < pos < n else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grads = [(c["n"] * (c["y"] - q), c["n"] * q * (1 - q)) for c, q in zip(cells, p)]
        root = _best(cells, grads, list(range(len(cells))))[1]
        if root is None:
            break

        def leaf(own: list[int]) -> str:
            v = RATE * sum(grads[i][0] for i in own) / (sum(grads[i][1] for i in own) + 1)
            for i in own:
                score[i] += v
            return repr(v) + "D"

        def below(at: Split, own: list[int], inner: bool) -> str:
            yes, no = [i for i in own if cells[i][at[0]] <= at[1]], [i for i in own if cells[i][at[0]] > at[1]]
            sides = []
            for side in (yes, no):
                nxt = _best(cells, grads, side)[1] if inner else None
                sides.append(below(nxt, side, False) if nxt else leaf(side))
            return f"if(x.f.{at[0]} <= {at[1]}, {sides[0]}, {sides[1]})"

        terms.append(below(root, list(range(len(cells))), True))
    return terms


def probability(terms: list[str]) -> str:
    return f"(1 / (1 + exp(-({' + '.join(terms)}))))"


def learned(found_: DataFrame) -> Column:
    """The loose spans to redact (column loose): a filter with the learned score."""
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(HOLD)) == 0
    x = found_.select(held.alias("held"), F.explode("loose").alias("x"))
    cells = (x.groupBy("held", *[F.col(f"x.f.{f}").alias(f) for f in BINS], F.col("x.confirmed").alias("y"))
             .agg(F.count("*").alias("n")).orderBy(*BINS, "y").collect())  # at most 2 x CELLS rows
    terms = fit([c for c in cells if not c["held"]])
    scored = found_.sparkSession.createDataFrame(
        [(c["kind"], c["n"], {f: c[f] for f in BINS}) for c in cells if c["held"] and c["y"]],
        f"kind int, n long, f struct<{','.join(f'{f}:int' for f in BINS)}>")
    rows = scored.select("kind", "n", F.expr(f"transform(array(named_struct('f', f)), x -> {probability(terms)})[0]").alias("p")).collect()
    cut = {}
    for k in range(len(KINDS)):
        own = sorted(((r["p"], r["n"]) for r in rows if r["kind"] == k), reverse=True)
        total, seen = sum(n for _, n in own), 0
        cut[k] = 1.0  # a kind that nothing confirms redacts no candidate
        for p, n in own:
            cut[k], seen = p, seen + n
            if seen >= KEEP * total:
                break
        cut[k] = max(cut[k], FLOOR)
    limits = "case x.f.kind " + " ".join(f"when {k} then {v!r}D" for k, v in cut.items()) + " end"
    return F.expr(f"filter(loose, x -> x.confirmed = 0 and {probability(terms)} >= {limits})")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, kind, e) in code points, by start, then
    kind (a number in KINDS), then end; spans are those of base and the learned ones.

    A null text is empty; texts may be of any length, and the work on one grows with its matches to the power 1.5.
    Other columns are ignored.  Each row is judged alone, so repeated rows and null ids
    stay; an empty table gives none.
    """
    c = stored(candidates(docs), "pii-candidates")
    own = "x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e)"
    both = c.select("doc_id", F.expr(f"array_sort(transform(base, {own}))").alias("base"), learned(c).alias("more"))
    return both.select("doc_id", "base", F.expr(f"array_sort(concat(base, transform(more, {own})))").alias("spans"))


def written(spans: str) -> str:
    """SQL: kind:start:end of spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')"
