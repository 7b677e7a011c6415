"""Raw lines -> structured events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators.formats import LogFormat, detect_entity, detect_format, file_formats, get_format, registered

EVENT_COLS = ("timestamp", "level", "component", "content", "block_id")
_SEP = "\x01\x02"


@dataclass(frozen=True)
class ParsePlan:
    """How a log is going to be parsed: a registered format or the generic way."""

    fmt: LogFormat | None
    entity: str | None

    @property
    def sim_th(self) -> float:
        return self.fmt.sim_th if self.fmt else 0.4

    @property
    def depth(self) -> int:
        return self.fmt.depth if self.fmt else 4


def plan_parse(lines: DataFrame, log_format: str = "auto") -> ParsePlan:
    """Choose the parse plan; looks at the head of the log only for ``auto``."""
    if log_format == "auto":
        name = detect_format(lines)
        if name is None:
            return ParsePlan(None, detect_entity(lines))
        log_format = name
    if log_format == "generic":
        return ParsePlan(None, None)
    fmt = get_format(log_format)
    return ParsePlan(fmt, fmt.entity)


def _refs(spec: int | tuple[int, ...]) -> str:
    return " ".join(f"${g}" for g in ([spec] if isinstance(spec, int) else spec))


def matches(raw: Column, fmt: LogFormat) -> Column:
    return raw.rlike(fmt.pattern)


def _parse_named(df: DataFrame, fmt: LogFormat) -> DataFrame:
    # One regex pass rewrites the line into separated fields; content comes
    # last so that a separator inside it cannot shift the others.
    names = [c for c in ("timestamp", "level", "component") if c in fmt.groups] + ["content"]
    rewrite = _SEP.join(_refs(fmt.groups[n]) for n in names)
    fields = F.split(F.regexp_replace("raw", fmt.pattern, rewrite), _SEP, len(names))
    hit = df.where(matches(F.col("raw"), fmt)).withColumn("_f", fields)
    got = {n: F.col("_f")[i] for i, n in enumerate(names)}
    level = X.norm_level(got["level"]) if "level" in got else F.lit(X.UNKNOWN)
    out = hit.select(
        *df.columns,
        got.get("timestamp", F.lit("")).alias("timestamp"),
        level.alias("level"),
        got.get("component", F.lit("")).alias("component"),
        got["content"].alias("content"),
    )
    return out.withColumn("block_id", X.entity(F.col("content"), F.col("raw"), fmt.entity))


def generic_fields(df: DataFrame) -> DataFrame:
    """Adds timestamp, level (as written), component and content of any line."""
    rest = df.withColumn("_rest", X.after_ts(F.col("raw")))
    cut = rest.withColumn("_cut", X.after_level(F.col("_rest")))
    content = X.strip(F.col("_cut"))
    return cut.select(
        *df.columns,
        X.generic_ts(F.col("raw")).alias("timestamp"),
        X.generic_level(F.col("_rest")).alias("level"),
        X.generic_component(F.col("_cut")).alias("component"),
        F.when(content == "", F.col("raw")).otherwise(content).alias("content"),
    )


def _parse_generic(df: DataFrame, entity: str | None) -> DataFrame:
    kept = df.where(X.strip(F.col("raw")) != "")
    return (
        generic_fields(kept)
        .withColumn("level", X.norm_level(F.col("level")))
        .withColumn("block_id", X.entity_generic(F.col("raw"), entity))
    )


def parse_with(df: DataFrame, plan: ParsePlan) -> DataFrame:
    return _parse_named(df, plan.fmt) if plan.fmt else _parse_generic(df, plan.entity)


def parse_lines(df: DataFrame, log_format: str = "auto", entity: str | None = None) -> DataFrame:
    """Events of the lines that parse; ``entity`` overrides the entity pattern
    for formats without one."""
    plan = plan_parse(df, log_format)
    if entity and not plan.entity:
        plan = ParsePlan(plan.fmt, entity)
        if plan.fmt:
            return parse_with(df, plan).withColumn(
                "block_id", X.entity(F.col("content"), F.col("raw"), entity)
            )
    return parse_with(df, plan)


def parse_files(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Events of the lines of many files, each in its own format: ``formats`` has
    (path, format, entity) rows, a null format being the generic one.

    One pass with a branch per format; a line runs the patterns of its own
    branch only.  Adds ``format`` ('generic' where none is registered).
    """
    known = lines.join(formats.select("path", F.coalesce("format", F.lit("generic")).alias("format"), "entity"), "path")
    is_generic = F.col("format") == "generic"
    names = ("timestamp", "level", "component", "content")

    def rewritten(fmt: LogFormat) -> Column:
        parts = _SEP.join(_refs(fmt.groups[n]) if n in fmt.groups else "" for n in names)
        return F.split(F.regexp_replace("raw", fmt.pattern, parts), _SEP, len(names))

    def by_format(branch: Callable[[LogFormat], Column], otherwise: Column) -> Column:
        out = F.when(is_generic, otherwise)
        for fmt in registered():
            out = out.when(F.col("format") == fmt.name, branch(fmt))
        return out

    cut = known.withColumn("_rest", F.when(is_generic, X.after_ts(F.col("raw")))).withColumn("_cut", F.when(is_generic, X.after_level(F.col("_rest"))))
    content = X.strip(F.col("_cut"))
    generic = F.array(
        X.generic_ts(F.col("raw")), X.generic_level(F.col("_rest")), X.generic_component(F.col("_cut")),
        F.when(content == "", F.col("raw")).otherwise(content),
    )
    fields = by_format(
        lambda fmt: F.when(matches(F.col("raw"), fmt), rewritten(fmt)), F.when(X.strip(F.col("raw")) != "", generic)
    )
    hit = cut.withColumn("_f", fields).where(F.col("_f").isNotNull())
    got = {n: F.col("_f")[i] for i, n in enumerate(names)}
    out = hit.select(
        *lines.columns, "format", "entity",
        got["timestamp"].alias("timestamp"), X.norm_level(got["level"]).alias("level"), got["component"].alias("component"), got["content"].alias("content"),
    )
    shaped = F.lit("")
    for p in X.ENTITY_SHAPES:
        shaped = F.when(F.col("entity") == p, X.entity_generic(F.col("raw"), p)).otherwise(shaped)
    block = by_format(lambda fmt: X.entity(F.col("content"), F.col("raw"), fmt.entity), shaped)
    return out.withColumn("block_id", block).drop("entity")


def parse_each_file(lines: DataFrame, log_format: str = "auto") -> DataFrame:
    """Events of (path, line_id, raw) lines numbered per file, with ``format``:
    the given one for all files, or with ``auto`` each file's own."""
    if log_format == "auto":
        return parse_files(lines, file_formats(lines))
    return parse_lines(lines, log_format).withColumn("format", F.lit(log_format))


def parse_first_match(df: DataFrame) -> DataFrame:
    """Line-at-a-time auto mode: the first line that fits a registered format
    fixes it for all later lines; lines before it are parsed generically."""
    first = df.agg(
        *[F.min(F.when(matches(F.col("raw"), f), F.col("line_id"))).alias(f.name) for f in registered()]
    ).first()
    at = [(first[f.name], i, f) for i, f in enumerate(registered()) if first[f.name] is not None]
    if not at:
        return _parse_generic(df, None)
    start, _, fmt = min(at, key=lambda x: x[:2])
    early = _parse_generic(df.where(F.col("line_id") < start), None)
    return early.unionByName(_parse_named(df.where(F.col("line_id") >= start), fmt))


def parse_errors(df: DataFrame, fmt: LogFormat) -> DataFrame:
    """(total_lines, parsed, parse_errors) for a named format."""
    ok = matches(F.col("raw"), fmt)
    return df.agg(
        F.count("*").alias("total_lines"),
        F.count_if(ok).alias("parsed"),
        F.count_if(~ok).alias("parse_errors"),
    )


def events_for_block(ev: DataFrame, block_id: str) -> DataFrame:
    return ev.where(F.col("block_id") == block_id)


def block_ids(ev: DataFrame) -> DataFrame:
    return ev.where("block_id <> ''").select("block_id").distinct()
