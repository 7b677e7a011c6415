"""Quality of a template set: coverage, density, entropy, convergence, ARI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators import templates as T
from logweir.session import materialize

# Tuning grid, sample size and score weights
SIM_THS = (0.3, 0.4, 0.5, 0.6)
DEPTHS = (3, 4, 5)


def coverage(assign: DataFrame) -> DataFrame:
    hit = (F.col("template_id") >= 0).cast("double")
    return assign.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("coverage_rate"))


def _density(tokens: Column) -> Column:
    wild = F.size(F.filter(tokens, lambda t: t == X.WILDCARD))
    return F.when(F.size(tokens) > 0, wild / F.size(tokens))


def wildcard_density(templates: DataFrame) -> DataFrame:
    return templates.agg(F.coalesce(F.avg(_density(F.col("tokens"))), F.lit(0.0)).alias("wildcard_density"))


def _entropy(n: str = "n") -> Column:
    c = F.col(n).cast("double")
    total = F.sum(c)
    return F.when(F.count("*") > 1, F.log2(total) - F.sum(c * F.log2(c)) / total).otherwise(F.lit(0.0))


def template_entropy(assign: DataFrame) -> DataFrame:
    n = assign.where("template_id >= 0").groupBy("template_id").agg(F.count("*").alias("n"))
    return n.agg(_entropy().alias("template_entropy"))


def convergence(assign: DataFrame, line: str = "line_id") -> DataFrame:
    """1 - templates seen in the first half / all templates.

    High when new templates keep appearing, despite the name.
    """
    lines = assign.agg(F.count("*").alias("total"))
    first = assign.where("template_id >= 0").groupBy("template_id").agg(F.min(line).alias("first_line"))
    one = F.lit(1).alias("_k")
    return (
        first.select("*", one).join(lines.select("*", one), "_k")
        .agg(
            F.coalesce(
                1.0 - F.count_if(F.col("first_line") <= F.floor(F.col("total") / 2)) / F.nullif(F.count("*"), F.lit(0)),
                F.lit(0.0),
            ).alias("convergence")
        )
    )


def adjusted_rand(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted Rand Index of two labelings of the same rows (``ari``)."""
    k = list(by)

    def pairs(name: str) -> Column:
        n = F.col(name).cast("double")
        return n * (n - 1) / 2

    cells = df.groupBy(*k, a, b).agg(F.count("*").alias("n"))
    left = cells.groupBy(*k, a).agg(F.sum("n").alias("n")).groupBy(*k).agg(F.sum(pairs("n")).alias("sa"))
    right = cells.groupBy(*k, b).agg(F.sum("n").alias("n")).groupBy(*k).agg(F.sum(pairs("n")).alias("sb"))
    both = cells.groupBy(*k).agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n"))
    one = F.lit(1).alias("_k")
    on = ["_k", *k]
    out = both.select("*", one).join(left.select("*", one), on).join(right.select("*", one), on)
    expected = F.col("sa") * F.col("sb") / pairs("n")
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when((pairs("n") == 0) | (top == expected), F.lit(1.0)).otherwise(
        (F.col("s") - expected) / (top - expected)
    )
    return out.select(*k, ari.alias("ari"))


def composite(metrics: DataFrame) -> DataFrame:
    score = (
        0.35 * F.col("coverage_rate")
        + 0.30 * F.col("convergence")
        + 0.20 * F.least(F.col("template_entropy") / 6.0, F.lit(1.0))
        - 0.15 * F.col("wildcard_density")
    )
    return metrics.withColumn("composite", score)


def rank_combos(metrics: DataFrame) -> DataFrame:
    """Combos by falling composite with their rank and the two winners marked."""
    w = Window.orderBy(F.desc("composite"), "sim_th", "depth")  # one row per combo
    out = metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)
    if "ari" not in metrics.columns:
        return out.orderBy("rank")
    best = Window.orderBy(F.desc_nulls_last("ari"), "rank")
    flag = (F.row_number().over(best) == 1) & F.col("ari").isNotNull()
    return out.withColumn("is_best_ari", flag).orderBy("rank")


def tuning_sample(lines: DataFrame, n: int | None = None) -> DataFrame:
    """(line_id, content): all lines, or the first n, with their prefix cut off."""
    lines = lines if n is None else lines.orderBy("line_id").limit(n)
    return lines.select("line_id", X.strip_prefix(F.col("raw")).alias("content"))


def sweep_templates(
    spark: SparkSession,
    lines: DataFrame,
    sim_ths: tuple[float, ...] = SIM_THS,
    depths: tuple[int, ...] = DEPTHS,
    sample: int | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """One metrics row per (sim_th, depth) on all lines (or the first ``sample``), all combos in one run.

    The sample is collapsed to signatures once; combos differ only in how the
    signatures are merged.
    """
    text = materialize(tuning_sample(lines, sample), "sample")
    if catalog is not None:
        text = materialize(T.assign_catalog(text, catalog), "sample_gt")
    sig = materialize(T.distinct_signatures(text), "signatures")
    combos = F.array(*[
        F.struct(F.lit(float(s)).alias("sim_th"), F.lit(int(d)).alias("depth")) for s in sim_ths for d in depths
    ])
    grid = sig.select("signature", "tokens", "size", "first_line", F.inline(combos)).withColumn(
        "seed_id", F.lit(-1).cast("long")
    )
    keys = ("sim_th_key", "depth")
    grid = grid.withColumn("sim_th_key", F.col("sim_th"))
    found = materialize(T.merge_signatures(grid, F.col("depth"), max(depths), keys), "tuned")
    found = found.withColumn("template_id", F.xxhash64("tokens")).withColumn("template", F.array_join("tokens", " "))

    # match every distinct form against the templates of each combo
    forms = sig.select("signature", F.array_join("tokens", " ").alias("form"), "size", "first_line")
    assign = _match_by_combo(forms, found, keys)
    n_lines = text.count()
    total = F.lit(float(n_lines))
    per_tpl = assign.where("template_id is not null").groupBy(*keys, "template_id").agg(
        F.sum("size").alias("n"), F.min("first_line").alias("first_line")
    )
    freq = per_tpl.groupBy(*keys).agg(
        _entropy().alias("template_entropy"),
        (F.sum("n") / total).alias("coverage_rate"),
        F.count_if(F.col("first_line") <= n_lines // 2).alias("_half"),
    )
    shape = found.groupBy(*keys).agg(
        F.count("*").alias("n_templates"), F.avg(_density(F.col("tokens"))).alias("wildcard_density")
    )
    out = shape.join(freq, list(keys)).withColumn("convergence", 1.0 - F.col("_half") / F.col("n_templates")).drop("_half")
    if catalog is not None:
        labelled = text.select(X.signature(F.col("content")).alias("signature"), "gt_id").join(
            assign.select(*keys, "signature", F.coalesce("template_id", F.lit(-1)).alias("template_id")), "signature"
        )
        out = out.join(adjusted_rand(labelled, "template_id", "gt_id", keys), list(keys))
    return composite(out.withColumnRenamed("sim_th_key", "sim_th"))


def _match_by_combo(forms: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, signature, size, first_line, template_id): best template per combo."""
    tpl = found.select(*keys, "template_id", "tokens", F.col("first_line").alias("_tf"))
    hits = T.full_matches(forms, tpl, keys)
    return hits.groupBy(*keys, "signature").agg(
        F.min_by("template_id", F.struct("literals", "_tf", "template_id")).alias("template_id"),
        F.first("size").alias("size"), F.first("first_line").alias("first_line"),
    )
