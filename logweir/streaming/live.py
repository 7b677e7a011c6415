"""Window detection on an unbounded stream of log lines.

Line numbers and windows go on over the files of a source, and a window that is not
full waits for the next batch.  What has to be remembered (how many lines a source
has had, the lines of its open window, the templates) is a small table for each
batch, written aside and published by a rename when the batch's results are there.
A batch reads the state of the batch before it and never its own, so one that is run
again, before or after that rename, leaves everything as it is.

A batch is numbered by per-split counts like a stored log, so a source with most of
the lines is still read by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.operators.parse import parse_lines
from logweir.operators.templates import assign_templates, mine_templates
from logweir.session import materialize
from logweir.sources.lines import number_rows
from logweir.sources.stores import child_names, exists, publish
from logweir.streaming.windows import WINDOW, window_detect, window_results

LINES = "source string, line_id long, raw string"


@dataclass(frozen=True)
class Settings:
    """How the windows of a stream are cut, parsed and decided."""

    n: int = WINDOW
    log_format: str = "hdfs"
    sim_th: float = 0.4
    depth: int = 4
    contamination: float = 0.03
    n_trees: int = 200


def state_before(spark: SparkSession, store: str, batch_id: int) -> str | None:
    """The folder of the last batch before ``batch_id`` that was published."""
    ids = [int(n.removeprefix("batch=")) for n in child_names(spark, f"{store}/state") if n.startswith("batch=")]
    ids = [i for i in ids if i < batch_id]
    return f"{store}/state/batch={max(ids)}" if ids else None


def _known(spark: SparkSession, state: str | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(lines so far of each source, open lines, templates)."""
    if state is None:
        return spark.createDataFrame([], "source string, lines long"), spark.createDataFrame([], LINES), None
    templates = spark.read.parquet(f"{state}/templates")
    return spark.read.parquet(f"{state}/counts"), spark.read.schema(LINES).parquet(f"{state}/open"), None if templates.isEmpty() else templates


def _windows(lines: DataFrame, templates: DataFrame | None, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window results, decided blocks, templates) of whole windows."""
    parsed = parse_lines(lines, s.log_format)
    templates = materialize(mine_templates(parsed, s.sim_th, s.depth, templates), "templates")
    ev = materialize(assign_templates(parsed, templates), "events")
    found = materialize(window_detect(ev, s.n, s.contamination, s.n_trees, keys=("source",)), "found")
    return window_results(lines, ev, found, s.n, keys=("source",)), found, templates


def process_batch(batch: DataFrame, batch_id: int, store: str, out: str, s: Settings) -> None:
    """Results of the windows that a micro-batch of (source, path, begin, raw) fills, and the state after it."""
    spark, state = batch.sparkSession, f"{store}/state/batch={batch_id}"
    if exists(spark, state):  # published: the results are there
        return
    counts, open_lines, templates = _known(spark, state_before(spark, store, batch_id))
    # the splits of a source in the order of its files
    fresh = batch.select(F.col("source").alias("path"), F.struct("path", "begin").alias("_start"), "raw")
    fresh = number_rows(fresh, "line_id").select(F.col("path").alias("source"), "line_id", "raw")
    before = F.coalesce("lines", F.lit(0))
    fresh = fresh.join(counts, "source", "left").select("source", (F.col("line_id") + before).cast("long").alias("line_id"), "raw")
    lines = materialize(fresh.unionByName(open_lines), "batch")
    seen = lines.groupBy("source").agg(F.max("line_id").alias("lines"))
    counts = materialize(counts.join(seen.select("source"), "source", "left_anti").unionByName(seen), "counts")
    ends = counts.select("source", (F.floor(F.col("lines") / s.n) * s.n).alias("end"))
    cut = lines.join(ends, "source")
    full = materialize(cut.where("line_id <= end").drop("end"), "full-windows")
    if not full.isEmpty():
        result, found, templates = _windows(full, templates, s)
        result.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/windows/batch={batch_id}")
        found.write.mode("overwrite").parquet(f"{out}/blocks/batch={batch_id}")
    if templates is None:
        templates = spark.createDataFrame([], "template_id long, tokens array<string>, template string, size long, first_line long")
    aside = f"{store}/_aside/batch={batch_id}"
    for name, df in (("counts", counts), ("open", cut.where("line_id > end").drop("end")), ("templates", templates)):
        df.write.mode("overwrite").parquet(f"{aside}/{name}")
    publish(spark, aside, state)


def trailing_windows(spark: SparkSession, store: str, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(window results, decided blocks) of the windows still open after the last batch, as if the stream had ended."""
    _, open_lines, templates = _known(spark, state_before(spark, store, 1 << 62))
    result, found, _ = _windows(materialize(open_lines, "open"), templates, s)
    return result, found


def stream_windows(sdf: DataFrame, store: str, out: str, checkpoint: str, s: Settings = Settings()) -> DataStreamWriter:
    """Writer for a stream of (source, path, begin, raw) as given by ``tail_log``."""
    return sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, store, out, s))
