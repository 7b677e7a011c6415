"""Tables that outlive a run: parsed events, templates, models, runs, results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from logweir.operators.features import FeatureSpace
from logweir.operators.iforest import Forest
from logweir.operators.parse import parse_each_file
from logweir.session import materialize
from logweir.sources.lines import scan_log


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return [f.getPath().getName() for f in found]


def publish(spark: SparkSession, aside: str, path: str) -> None:
    """Make a finished folder visible under its name, in one step."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise RuntimeError(f"{path} could not be published")


# -- parsed events -------------------------------------------------------------

EVENT_STORE = (
    "path string, line_id long, raw string, format string, timestamp string, level string, component string, "
    "content string, block_id string, version string"
)
MANIFEST = "path string, modified timestamp, size long, version string"


def listed_files(spark: SparkSession, src: str) -> DataFrame:
    """(path, modified, size) of the files under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    )


def _new_version() -> str:
    return f"{datetime.now(timezone.utc).strftime('%Y%m%d%H%M%S%f')}-{uuid.uuid4().hex[:8]}"


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    """The files of the last published refresh, with the version that holds each one's events."""
    found = child_names(spark, f"{store}/manifests")
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{max(found)}")


def refresh_events(
    spark: SparkSession, src: str, store: str, log_format: str = "auto", force: bool = False
) -> DataFrame:
    """Events of all files under ``src``, each parsed in its own format with
    ``auto``; only files that are new or changed since the last refresh are parsed.

    Events of a refresh go to a folder of their own.  What counts is its manifest,
    the list of all files with the version of their events, which is written aside
    and published by a rename: a refresh that fails anywhere before shows nothing,
    and the next one parses its files again.  Files that are gone are not listed.
    """
    now, before = listed_files(spark, src), _manifest(spark, store)
    if force:
        before = before.where("false")
    version, same = _new_version(), ["path", "modified", "size"]
    state = materialize(now.join(before, same, "left").select(*same, F.coalesce("version", F.lit(version)).alias("version")), "files")
    todo = [r["path"] for r in state.where(F.col("version") == version).select("path").collect()]  # one name a changed file
    if todo:
        parsed = parse_each_file(scan_log(spark, todo), log_format)
        names = [c.split()[0] for c in EVENT_STORE.split(", ")]
        parsed.withColumn("version", F.lit(version)).select(*names).write.mode("append").partitionBy("version").parquet(f"{store}/events")
    elif not force and state.count() == before.count():
        return read_events(spark, store)
    aside = f"{store}/_aside/{version}"
    state.write.parquet(aside)
    publish(spark, aside, f"{store}/manifests/{version}")
    return read_events(spark, store)


def read_events(spark: SparkSession, store: str) -> DataFrame:
    """The events of the last published refresh."""
    if not exists(spark, f"{store}/events"):
        return spark.createDataFrame([], EVENT_STORE).drop("version")
    ev = spark.read.schema(EVENT_STORE).parquet(f"{store}/events")
    return ev.join(_manifest(spark, store).select("path", "version"), ["path", "version"], "left_semi").drop("version")


# -- templates -----------------------------------------------------------------

def save_templates(templates: DataFrame, path: str) -> None:
    """Store a template set as a new version; older versions are kept."""
    version = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
    templates.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    last = df.agg(F.max("version")).first()[0]
    out = df.where(F.col("version") == last).drop("version")
    return None if last is None or out.isEmpty() else out


def clear_templates(spark: SparkSession, path: str) -> None:
    """Start over: the next load finds an empty set."""
    old = load_templates(spark, path)
    if old is not None:
        empty = spark.createDataFrame([(datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f"),)], "version string")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields]
        empty.select(*missing, "version").write.mode("append").parquet(path)


# -- models --------------------------------------------------------------------

def save_model(model: Forest, space: FeatureSpace, templates: DataFrame, path: str, name: str = "forest", run_id: str = "") -> None:
    """Nodes, vocabulary, the templates the vocabulary refers to and one row of
    metadata, stored together."""
    spark = space.vocab.sparkSession
    model.nodes(spark).write.parquet(f"{path}/nodes")
    space.vocab.write.parquet(f"{path}/vocab")
    templates.write.parquet(f"{path}/templates")
    depth = model.feature.shape[1].bit_length() - 1  # a heap of depth d has 2^(d+1) - 1 cells
    meta = [(name, run_id, type(model).__name__, space.feature_set, space.size, model.n_trees, depth,
             model.psi, model.contamination, model.offset)]
    spark.createDataFrame(
        meta,
        "model_name string, run_id string, model_type string, feature_set string, vocab_size long, "
        "n_trees long, depth long, psi long, contamination double, offset double",
    ).write.parquet(f"{path}/meta")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, run, feature set, vocabulary size and type."""
    return spark.read.parquet(f"{path}/meta").select("model_name", "run_id", "feature_set", "vocab_size", "model_type")


def load_model(spark: SparkSession, path: str) -> tuple[Forest, FeatureSpace, DataFrame]:
    meta = spark.read.parquet(f"{path}/meta").first()
    model = Forest.from_nodes(
        spark.read.parquet(f"{path}/nodes"), meta["n_trees"], meta["depth"], meta["psi"],
        meta["contamination"], meta["offset"],
    )
    vocab = spark.read.parquet(f"{path}/vocab")
    return model, FeatureSpace(vocab, meta["vocab_size"], meta["feature_set"]), spark.read.parquet(f"{path}/templates")


def load_vocab_json(spark: SparkSession, path: str) -> FeatureSpace:
    """Vocabulary documents: an object with template_vocab and feature_set, or the
    older bare list of ids (then the full feature set)."""
    text = spark.read.text(path, wholetext=True)
    obj = F.from_json("value", "template_vocab array<long>, feature_set string")
    bare = F.from_json("value", "array<long>")
    is_list = F.ltrim("value").startswith("[")
    got = text.select(
        F.when(is_list, bare).otherwise(obj["template_vocab"]).alias("ids"),
        F.when(is_list, F.lit("full")).otherwise(F.coalesce(obj["feature_set"], F.lit("full"))).alias("fs"),
    )
    row = got.select(F.size("ids").alias("n"), "fs").first()
    vocab = got.select(F.posexplode("ids").alias("col", "template_id")).select("template_id", F.col("col").cast("long"))
    return FeatureSpace(vocab, max(row["n"], 0), row["fs"])


# -- runs and results ------------------------------------------------------------

def fingerprint(df: DataFrame) -> dict[str, str]:
    """Schema, rows and an order-free hash of a table, as parameters of a run."""
    h = F.xxhash64(*[F.to_json(F.col(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields])
    row = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s")).first()
    return {"input_schema": df.schema.simpleString(), "input_rows": str(row["n"]), "input_hash": f"{(row['x'] or 0) & (1 << 64) - 1:016x}{(row['s'] or 0) & (1 << 64) - 1:016x}"}


def append_run(
    spark: SparkSession, path: str, kind: str, params: dict[str, Any], metrics: dict[str, float], run_id: str, data: DataFrame | None = None
) -> None:
    """Add one run to the runs table; parameters and metrics are maps.  ``data`` is the
    input of the run, whose fingerprint is stored with the parameters."""
    params = {**params, **(fingerprint(data) if data is not None else {})}
    row = [(run_id, kind, datetime.now(timezone.utc), {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items()})]
    schema = "run_id string, kind string, start_time timestamp, params map<string,string>, metrics map<string,double>"
    spark.createDataFrame(row, schema).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, params: list[str], metrics: list[str]) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.select(
        "run_id", "kind", "start_time",
        *[F.col("params")[p].alias(p) for p in params], *[F.col("metrics")[m].alias(m) for m in metrics],
    )


# the parts of an incident's document, in order
_HEAD, _BLOCKS, _TEMPLATES, _LINES = range(4)
_LISTS = {_BLOCKS: "block_ids", _TEMPLATES: "templates", _LINES: "log_lines"}


def write_incident_documents(path: str, incidents: DataFrame, members: DataFrame, lines: DataFrame) -> None:
    """Detection documents (JSON, one a file) that hold every block, template and line of their incidents.

    A row here is one element of one list.  Rows are dealt to files by incident and
    sorted, and the text is written as they pass, so neither a row nor a task ever holds
    an incident, whatever its number of lines.
    """
    span = F.array("time_range.start", "time_range.end")
    head = incidents.select("incident_id", F.lit(_HEAD).alias("part"), F.lit(0).cast("long").alias("no"), F.to_json(F.struct(
        "incident_id", "severity", "mean_anomaly_score", span.alias("time_range"))).alias("value"))

    def listed(df: DataFrame, part: int, no: Column, value: str) -> DataFrame:
        return df.select("incident_id", F.lit(part).alias("part"), no.cast("long").alias("no"), F.col(value).alias("value"))

    zero = F.lit(0)
    templates = lines.where("template <> ''").select("incident_id", "template").distinct()
    rows = head.unionByName(listed(members, _BLOCKS, zero, "block_id")).unionByName(listed(templates, _TEMPLATES, zero, "template"))
    rows = rows.unionByName(listed(lines, _LINES, F.col("line_no"), "content"))
    dealt = rows.repartitionByRange("incident_id").sortWithinPartitions("incident_id", "part", "no", "value")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (incident, part)
        for b in batches:
            out = []
            for incident, part, value in zip(*[b.column(c).to_pylist() for c in ("incident_id", "part", "value")]):
                if last is None or last[0] != incident:
                    out.append('{"incidents": [' if last is None else ("}," if last[1] == _HEAD else "]},"))
                    out.append(value[:-1] if part == _HEAD else "{")
                    last = (incident, _HEAD)
                if part != _HEAD:
                    new = last[1] != part
                    if new:
                        out.append(f'{"" if last[1] == _HEAD else "]"}, "{_LISTS[part]}": [')
                    out.append(("" if new else ",") + json.dumps(value, ensure_ascii=False))
                last = (incident, part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["}]}" if last[1] == _HEAD else "]}]}"])], ["value"])

    dealt.mapInArrow(written, "value string").write.text(path)


def write_detection(
    path: str, totals: DataFrame, incidents: DataFrame, members: DataFrame, lines: DataFrame, blk: DataFrame,
    evaluation: DataFrame | None = None,
) -> None:
    """Summary, whole incident documents, their blocks and lines, and the anomalies as tables."""
    totals.write.json(f"{path}/summary")
    write_incident_documents(f"{path}/incidents", incidents, members, lines)
    members.write.parquet(f"{path}/incident_blocks")
    lines.write.parquet(f"{path}/incident_lines")
    blk.where("is_anomaly").write.parquet(f"{path}/anomalies")
    if evaluation is not None:
        evaluation.write.json(f"{path}/evaluation")


def write_summaries(path: str, summaries: DataFrame, evaluation: DataFrame | None = None) -> None:
    summaries.write.json(f"{path}/summaries")
    if evaluation is not None:
        evaluation.write.json(f"{path}/evaluation")
