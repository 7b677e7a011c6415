"""Registry and the shared inputs of the registered queries, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.operators.parse import parse_lines
from logweir.operators.templates import signature_events, with_signature
from logweir.session import materialize
from logweir.sources.render import lines_sql, rendered_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, given one partition per core when it is a single
    small file (a no-op for tables with many splits)."""
    df, cores = table(spark, sf, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places."""
    return df.select(*[
        F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# -- Spark inputs --------------------------------------------------------------

def lines(spark: SparkSession, sf: str, shape: str = "hdfs") -> DataFrame:
    return rendered_lines(spark, sf, shape)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(lines(spark, sf), "hdfs")


def tevents(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed events with stateless templates and ids by first appearance,
    stored once: most queries read them several times."""
    parsed = materialize(with_signature(events(spark, sf)), "parsed")
    return materialize(signature_events(parsed), "events")


# -- the same inputs as DuckDB CTEs ----------------------------------------------

HDFS = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+(\S+):\s+(.+)$"
LEVELS = "('DEBUG','INFO','WARN','ERROR','FATAL')"
BL = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CTE = {
    "lines": lines_sql("hdfs"),
    "ev": f"""
      select line_id, raw, concat(regexp_extract(raw, '{HDFS}', 1), ' ', regexp_extract(raw, '{HDFS}', 2)) as timestamp,
        case when upper(regexp_extract(raw, '{HDFS}', 4)) in {LEVELS} then upper(regexp_extract(raw, '{HDFS}', 4)) else 'UNKNOWN' end as level,
        regexp_extract(raw, '{HDFS}', 5) as component, regexp_extract(raw, '{HDFS}', 6) as content,
        coalesce(nullif(regexp_extract(regexp_extract(raw, '{HDFS}', 6), '(blk_-?\\d+)', 1), ''), regexp_extract(raw, '(blk_-?\\d+)', 1)) as block_id
      from lines where regexp_matches(raw, '{HDFS}')""",
    "sev": r"""
      select *, regexp_replace(regexp_replace(trim(content), '\s+', ' ', 'g'), '\S*[0-9]\S*', '<*>', 'g') as template from ev""",
    "tpl": """
      select template, row_number() over (order by min(line_id)) as template_id, count(*) as size,
        min(line_id) as first_line from sev group by template""",
    "tev": "select sev.*, tpl.template_id from sev join tpl using (template)",
}
NEEDS = {"ev": ["lines"], "sev": ["lines", "ev"], "tpl": ["lines", "ev", "sev"], "tev": ["lines", "ev", "sev", "tpl"]}


def with_(name: str, body: str, **more: str) -> str:
    """SQL text: the chain of CTEs up to ``name``, extra CTEs, then ``body``."""
    chain = [*NEEDS.get(name, []), name]
    ctes = [f"{n} as ({CTE[n]})" for n in chain] + [f"{n} as ({sql})" for n, sql in more.items()]
    return "with " + ", ".join(ctes) + " " + body
