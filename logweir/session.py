"""Session helpers: a default session and durable intermediate tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "logweir", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made in this block go when it ends, also after an error:
    what is wanted of its results has to be read or written inside."""
    folder = f"{work_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` stored and nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        _delete(table.sparkSession, folder)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``, or the
    folder of the ``scratch`` block in it).

    There is no default: a machine-local folder would not be readable by other
    executors.
    """
    if _SCRATCH.get():
        return _SCRATCH.get()
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage, survives executor loss, keeps columnar pruning for the
    readers, and gives the optimizer real sizes to choose join strategies by.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no plan needs any more: it does so only when the driver's garbage is collected, which
    spares the last job's until there is a newer one."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_files(path: str):
    """(file system, path in it) of a folder for code that runs inside tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def spread(df: DataFrame, rows: int, per_task: int = 8_000) -> DataFrame:
    """Give a compute-heavy stage enough tasks; a no-op for data that already
    has them (small tables are otherwise read back as one partition)."""
    want = min(-(-rows // per_task), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def fan_out(df: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """Partition by the keys of a compute-heavy grouped stage.  A fixed number of
    partitions keeps small but expensive groups on all cores, where the size-based
    coalescing of shuffles would put them into one task; ``groups`` is the number
    of groups where it is known, as more partitions would stay empty."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n if groups is None else max(1, min(n, groups)), *keys)
