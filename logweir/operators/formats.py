"""Registered line formats and their detection from the head of a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import text as X


@dataclass(frozen=True)
class LogFormat:
    """One line layout.

    ``groups`` maps event columns to regex group numbers; a tuple of numbers is
    joined with one blank (a timestamp spread over two fields).
    """

    name: str
    pattern: str
    groups: dict[str, int | tuple[int, ...]] = field(default_factory=dict)
    entity: str | None = None
    sim_th: float = 0.4
    depth: int = 4


# Line layouts, entity patterns and template-mining settings
HDFS = LogFormat(
    "hdfs",
    r"(?d)^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+(\S+):\s+(.+)$",
    {"timestamp": (1, 2), "level": 4, "component": 5, "content": 6},
    r"(blk_-?\d+)",
    0.4,
    4,
)
OPENSSH = LogFormat(
    "openssh",
    r"(?d)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.+)$",
    {"timestamp": 1, "component": 2, "content": 4},
    r"sshd\[(\d+)\]",
    0.5,
    4,
)
SYSLOG = LogFormat(
    "syslog",
    r"(?d)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s+(.+)$",
    {"timestamp": 1, "component": 3, "content": 5},
    None,
    0.5,
    3,
)
DETECT_LINES, DETECT_SHARE = 20, 0.8
ENTITY_LINES, ENTITY_SHARE = 200, 0.3

_REGISTRY: dict[str, LogFormat] = {}


def register_format(fmt: LogFormat) -> None:
    """Add a format; registration order breaks ties in detection."""
    _REGISTRY[fmt.name] = fmt


for _fmt in (HDFS, OPENSSH, SYSLOG):
    register_format(_fmt)


def registered() -> list[LogFormat]:
    return list(_REGISTRY.values())


def get_format(name: str) -> LogFormat:
    if name not in _REGISTRY:
        known = ", ".join([*_REGISTRY, "auto", "generic"])
        raise ValueError(f"unknown log format '{name}'; known: {known}")
    return _REGISTRY[name]


def _shares(head: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    """(seq, name, share) of head lines hit by each pattern, in one pass."""
    hit = [F.avg(F.col("raw").rlike(p).cast("double")).alias(f"h{i}") for i, (_, p) in enumerate(named)]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.col(f"h{i}").alias("share"))
            for i, (n, _) in enumerate(named)
        ]
    )
    return head.agg(*hit).select(F.inline(rows)).where("share is not null")


def format_scores(lines: DataFrame, n: int = DETECT_LINES) -> DataFrame:
    """Share of the first ``n`` lines that each registered format matches."""
    head = lines.orderBy("line_id").limit(n)
    return _shares(head, [(f.name, f.pattern) for f in registered()])


def best_format(lines: DataFrame, n: int = DETECT_LINES, share: float = DETECT_SHARE) -> DataFrame:
    """One row with the accepted format name; no row when none is good enough."""
    return (
        format_scores(lines, n).where(F.col("share") >= share)
        .orderBy(F.desc("share"), "seq").limit(1)
    )


def detect_format(lines: DataFrame) -> str | None:
    row = best_format(lines).first()
    return row["name"] if row else None


def entity_scores(lines: DataFrame, n: int = ENTITY_LINES) -> DataFrame:
    head = lines.orderBy("line_id").limit(n)
    return _shares(head, [(p, p) for p in X.ENTITY_SHAPES])


def best_entity(lines: DataFrame, threshold: float = ENTITY_SHARE) -> DataFrame:
    return (
        entity_scores(lines).where((F.col("share") >= threshold) & (F.col("share") > 0))
        .orderBy(F.desc("share"), "seq").limit(1)
    )


def detect_entity(lines: DataFrame, threshold: float = ENTITY_SHARE) -> str | None:
    row = best_entity(lines, threshold).first()
    return row["name"] if row else None


def _first_best(shares: list[tuple[str, Column]], least: float) -> Column:
    """The name with the highest share of at least ``least``, the first of equals."""
    found = F.array(*[F.struct(v.alias("share"), F.lit(-i).alias("seq"), F.lit(n).alias("name")) for i, (n, v) in enumerate(shares)])
    good = F.filter(found, lambda x: (x["share"] >= least) & (x["share"] > 0))
    return F.when(F.size(good) > 0, F.array_max(good)["name"])


def file_formats(lines: DataFrame) -> DataFrame:
    """(path, format, entity) of (path, line_id, raw) lines numbered per file: what
    the first lines of each file look like, in one grouped pass over them.  A
    format of null is the generic one, for which the entity pattern is looked for."""
    head = F.col("line_id") <= DETECT_LINES
    fits = [F.avg(F.when(head, F.col("raw").rlike(f.pattern).cast("double"))).alias(f"f{i}") for i, f in enumerate(registered())]
    holds = [F.avg(F.col("raw").rlike(p).cast("double")).alias(f"e{i}") for i, p in enumerate(X.ENTITY_SHAPES)]
    shares = lines.where(F.col("line_id") <= max(ENTITY_LINES, DETECT_LINES)).groupBy("path").agg(*fits, *holds)
    named = _first_best([(f.name, F.col(f"f{i}")) for i, f in enumerate(registered())], DETECT_SHARE)
    entity = _first_best([(p, F.col(f"e{i}")) for i, p in enumerate(X.ENTITY_SHAPES)], ENTITY_SHARE)
    return shares.select("path", named.alias("format"), F.when(named.isNull(), entity).alias("entity"))
