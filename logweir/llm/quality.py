"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose score is above (or below) a cutoff.  The cutoffs
of a rule are tried from the mildest to the strictest on labelled documents, stratum
by stratum.  A cutoff is accepted if the exact binomial test shows that it rejects
less than ``risk / rules`` of the good documents, at level ``level / (strata x
rules)`` (Bonferroni; inside a sequence the first failure ends the search, so its
cutoffs need no further correction).  So with probability 1 - ``level`` the rules
together reject less than ``risk`` of the good documents of every stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import stored, words

RISK = 0.05  # share of good documents that may be rejected, per stratum
LEVEL = 0.05  # probability with which any of these promises may fail

#: rule: (score, from the mildest to the strictest cutoff, rejected if above).  Fixed values.
RULES: dict[str, tuple[str, list[float], bool]] = {
    "symbols": ("try_divide(n_symbols, n_words)", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1], True),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15], True),
    "repeats": ("try_divide(n_repeat_words, n_words)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1], True),
    "long_words": ("try_divide(word_chars, n_words)", [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0], True),
    "short_words": ("try_divide(word_chars, n_words)", [1.5, 2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0], False),
}


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of ``keep`` and the counts that the rules use.  A null
    text has no words; repeated rows stay."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", *keep, text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", *keep, "w", lines.alias("lines"), F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.expr("transform(if(size(w) < 3, cast(array() as array<int>), sequence(0, size(w) - 3)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))").alias("h"))
    # windows of equal hash stand next to each other once (hash, number) pairs are sorted
    d = d.withColumn("s", F.expr(
        "if(size(array_distinct(h)) = size(h), cast(array() as array<struct<x: bigint, i: int>>), sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))))"))
    same = " and ".join(["p.x = s[{0}].x", *(f"w[p.i + {k}] = w[s[{{0}}].i + {k}]" for k in range(3))])
    d = d.withColumn("r", F.expr(
        f"sort_array(filter(transform(s, (p, j) -> if(j > 0 and {same.format('greatest(j - 1, 0)')} or j + 1 < size(s) and {same.format('least(j + 1, size(s) - 1)')}, p.i, null)), p -> p is not null))"))
    return d.select(
        "doc_id", *keep, F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(r, (p, j) -> least(3, coalesce(get(r, j + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def log_binomial_tail(n: str, k: str, p: float) -> str:
    """SQL: log of P(Binomial(n, p) <= k), term by term."""
    return (f"aggregate(if({k} < 1, cast(array() as array<bigint>), sequence(1L, {k})), "
            f"named_struct('t', {n} * log1p(-{p!r}D), 's', {n} * log1p(-{p!r}D)), "
            f"(a, i) -> named_struct('t', a.t + ln(({n} - i + 1) / i) + {math.log(p / (1 - p))!r}D, "
            f"'s', a.s + log1p(exp(a.t + ln(({n} - i + 1) / i) + {math.log(p / (1 - p))!r}D - a.s))), a -> a.s)")


def cutoffs(good: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff) accepted on the measured good documents."""
    share = risk / len(RULES)
    # the number of a rule's cutoffs that reject the document
    level_of = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.expr(
            f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> coalesce({score} {'>' if above else '<'} c, false)))").alias("passed"))
        for name, (score, cuts, above) in RULES.items()])
    per = (good.where("n_words > 0").select("stratum", F.explode(level_of).alias("x"))
           .groupBy("stratum", "x.rule", "x.passed").agg(F.count("*").alias("n")))
    # cutoff number c rejects those that more than c cutoffs reject
    steps = F.explode(F.create_map(*[x for name, (_, cuts, _) in RULES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cuts]))]))
    total = good.where("n_words > 0").groupBy("stratum").agg(F.count("*").alias("n"))
    grid = (total.select("stratum", "n", steps.alias("rule", "cuts")).select("stratum", "n", "rule", F.posexplode("cuts").alias("c", "cutoff")))
    found = (grid.join(per.withColumnsRenamed({"n": "m", "stratum": "s2", "rule": "r2"}), F.expr("stratum <=> s2 and rule = r2 and passed > c"), "left")
             .groupBy("stratum", "rule", "c", "cutoff", "n").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("k")))
    n_strata = max(1, total.count())
    tail = F.when(F.expr(f"k > n * {share!r}D"), 0.0).otherwise(F.expr(log_binomial_tail("n", "k", share)))
    tested = found.withColumn("fails", tail > math.log(level / (n_strata * len(RULES))))
    ended = F.coalesce(F.min(F.when(F.col("fails"), F.col("c"))), F.lit(1 << 30))
    stop = tested.groupBy("stratum", "rule").agg(ended.alias("end"), F.collect_list(F.struct("c", "cutoff")).alias("all"))
    return (stop.select("stratum", "rule", F.expr("array_max(filter(all, x -> x.c < end))").alias("best"))
            .where("best is not null").select("stratum", "rule", "best.cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of ``docs``; strata are
    the values of lang, null one of them.

    A document counts as good if all its labels say quality 1; labels without
    doc_id or quality are left out, and so are documents without words.  A stratum
    with too few good documents gets no cutoff.  Repeated rows stay; an empty
    table gives none; without labels only the base rules decide.
    """
    m = stored(measured(docs, "lang").withColumnRenamed("lang", "stratum").withColumn("base_failed", base_failed()), "quality-counts")
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    # only documents that pass the base rules can be rejected by the others
    good = stored(m.where("not base_failed").join(marked, "doc_id", "left_semi"), "quality-good")
    accepted = stored(cutoffs(good, risk, level), "quality-cutoffs")
    by_stratum = accepted.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rejects = [F.expr(f"coalesce({score} {'>' if above else '<'} cuts['{name}'], false)") for name, (score, _, above) in RULES.items()]
    bad = rejects[0]
    for r in rejects[1:]:
        bad = bad | r
    joined = m.join(by_stratum.withColumnRenamed("stratum", "s2"), F.expr("stratum <=> s2"), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"))
