"""The registered queries of the text operators: each applies its operator, with
production parameters, to the whole table.  The operators return texts, spans and
tiles; the queries derive digests from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import (
    chaining, conversations, language, licenses, line_dedup, mixing, pii, pivots, quality, simhash, suffix_dedup, tiling, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Where there is none, SQL can't express hashes, models and alignments; tests hold the
#: query against a brute-force version instead.
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sha(x: str) -> Column:
    return F.sha2(F.col(x), 256)


@_query
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.pii_spans(_table(spark, sf, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.written("base")), 256).alias("base_sha256"), F.expr(pii.written("spans")).alias("spans"))


@_query
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf, "documents"))


@_query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = tiling.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))


@_query
def op4_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that repeat passages of earlier ones; others are not listed."""
    return chaining.repeated_passages(_table(spark, sf, "documents"))


@_query
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = language.learn(docs.where(language.may_learn(F.col("doc_id"))))
    held = F.coalesce(~language.may_learn(F.col("doc_id")), F.lit(False))
    return language.label_spans(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.remove_repeated(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha("kept").alias("kept_sha256"))


#: Windows of 100 bytes by their hexadecimal text; islands of repeated ones; what is left between these.
ORACLES["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT *, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i FROM d) x),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w) x WHERE nth > 1),
g AS (SELECT *, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) x),
s AS (SELECT doc_id, island, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, island),
p AS (SELECT d.doc_id, lo, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY d.doc_id ORDER BY lo), 0) + 1,
        2 * (lo - coalesce(lag(hi) OVER (PARTITION BY d.doc_id ORDER BY lo), 0))) AS part
      FROM d JOIN (SELECT doc_id, lo, hi FROM s UNION ALL SELECT doc_id, len(h) // 2, NULL FROM d) x USING (doc_id)),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY lo) AS h FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id) n USING (doc_id)
"""


@_query
def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_notices(_table(spark, sf, "documents"))


@_query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each time the mixture reads a document, with its place in the permutation of blocks."""
    return mixing.schedule(mixing.mixed(_table(spark, sf, "documents"))).select("doc_id", "source", "n_words", "weight", "copies", "block", "place")


@_query
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def _quality_sql() -> str:
    """Counts by words and windows as rows; exact binomial tails as sums over lgamma."""
    score = {"symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words",
             "long_words": "word_chars / n_words", "short_words": "word_chars / n_words"}
    rules = ", ".join(f"('{r}', {c}, {x!r}e0, {above})" for r, (_, cuts, above) in quality.RULES.items() for c, x in enumerate(cuts))
    scores = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {x} AS score FROM m WHERE n_words > 0" for r, x in score.items())
    share, n_rules = quality.RISK / len(quality.RULES), len(quality.RULES)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}e0) + (n - i) * ln(1 - {share!r}e0))"
    return rf"""
WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(text, '') AS t FROM documents),
v AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM w) x),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM v) x, (VALUES (0), (1), (2)) d(k) WHERE times > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(z.n, 0) AS n_repeat_words FROM w LEFT JOIN z USING (doc_id)),
m AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
s AS ({scores}),
good AS (SELECT doc_id FROM m WHERE NOT base_failed AND n_words > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
total AS (SELECT lang, count(*) AS n FROM m WHERE doc_id IN (FROM good) GROUP BY lang),
rules(rule, c, cutoff, above) AS (VALUES {rules}),
tried AS (SELECT total.lang, n, r.rule, r.c, r.cutoff, (SELECT count(*) FROM s WHERE s.rule = r.rule AND s.lang IS NOT DISTINCT FROM total.lang AND doc_id IN (FROM good)
  AND CASE WHEN above THEN score > cutoff ELSE score < cutoff END) AS k FROM total, rules r),
tails AS (SELECT *, CASE WHEN k > n * {share!r}e0 THEN 0 ELSE ln(list_sum(list_transform(range(0, k + 1), lambda i: {term}))) END > ln({quality.LEVEL!r}e0 / ((SELECT count(*) FROM total) * {n_rules})) AS fails FROM tried),
best AS (SELECT lang, rule, max_by(cutoff, c) AS cutoff FROM (SELECT *, min(CASE WHEN fails THEN c END) OVER (PARTITION BY lang, rule) AS stop FROM tails) x WHERE c < coalesce(stop, 1000) GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM s JOIN best b ON s.rule = b.rule AND s.lang IS NOT DISTINCT FROM b.lang
  WHERE CASE WHEN (SELECT any_value(above) FROM rules WHERE rules.rule = b.rule) THEN score > cutoff ELSE score < cutoff END)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (FROM bad) AS kept FROM m
"""


ORACLES["op9_quality"] = _quality_sql()


@_query
def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", _sha("text").alias("kept_sha256"))


#: Lines one edit apart agree in their first or their last eight characters.
ORACLES["op10_line_dedup"] = r"""
WITH RECURSIVE a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
l AS (SELECT * FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS id, length(line) AS n FROM (SELECT DISTINCT line FROM l) x),
c AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b, x.line AS p, y.line AS q FROM u x JOIN u y ON left(x.line, 8) = left(y.line, 8) AND x.id < y.id WHERE x.n >= 20 AND y.n >= 20 AND abs(x.n - y.n) <= 1
  UNION SELECT x.id, y.id, x.line, y.line FROM u x JOIN u y ON right(x.line, 8) = right(y.line, 8) AND x.id < y.id WHERE x.n >= 20 AND y.n >= 20 AND abs(x.n - y.n) <= 1),
e AS MATERIALIZED (SELECT a, b FROM c WHERE levenshtein(p, q) <= 1),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON w.a = r.id),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
o AS (SELECT doc_id, no, coalesce(root, u.id) AS root FROM l JOIN u USING (line) LEFT JOIN root r ON r.id = u.id),
g AS (SELECT doc_id, no FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id, no) AS nth FROM o) x WHERE nth > 1),
k AS (SELECT a.doc_id, coalesce(string_agg(a.line, chr(10) ORDER BY a.no) FILTER (WHERE g.no IS NULL), '') AS kept, count(g.no) AS n_removed
      FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.no = a.no GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) n USING (doc_id)
"""


@_query
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations")
    found = conversations.digests(conversations.repair(conversations.damaged(rows))).withColumnRenamed("conv_id", "found_id")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@_query
def op12_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op12_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@_query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf, "embeddings"))
