"""Embedding whitening on Spark MLlib's distributed block matrices.

1. Entries become whole numbers, so that equal vectors are equal keys and sums are exact.  The fit list
   is each distinct vector once.
2. Rows get dense numbers from their place in a stored table (counts per partition, no sort), and the
   centred rows become a BlockMatrix of ``BLOCK`` rows a block.
3. Transposed times itself gives the scatter matrix.  MLlib deals the products of one result block to one
   task unless told otherwise, so the middle dimension is split into as many parts as there are blocks.
4. The eigenvectors of that dims x dims matrix are found on the driver; the rows never get there.
5. The centred rows times the whitening matrix are the whitened rows, joined to their ids by number.

Defined results: null vectors and those holding null or non-finite entries go; shorter vectors count as
filled with zeros; entries beyond ``LARGEST`` count as that; repeated rows and null ids keep their rows;
other columns are ignored; an empty table gives no rows.  Equal eigenvalues leave the choice of their
eigenvectors open.  A component without variance (at most ``NONE`` of the whole) has null as its whitened
value and is left out of ``identity_error``.  ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import stored

BLOCK = 1024  # rows a block; a block of 64 columns holds 512 KB
COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
NONE = 1e-12


@dataclass
class Whitening:
    """A fitted whitening; ``components`` has one unit eigenvector a column, by falling ``variances``."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float = 0.0

    def matrix(self) -> np.ndarray:
        """dims x components; a component without variance is a zero column."""
        live = self.variances > NONE * self.total
        return self.components * np.where(live, 1 / np.sqrt(np.where(live, self.variances, 1)), 0)


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a usable vector, as whole numbers, filled to one length."""
    c = F.col(vector).cast("array<double>")
    usable = df.where(F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    usable = usable.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    held = F.transform("c", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * SCALE))) + SHIFT)
    width = usable.agg(F.max(F.size("c"))).first()[0] or 0
    return usable.select("vec_id", F.concat(held, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("c"))).alias("x"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with a dense number ``at``: the place in a partition plus the rows of the partitions before."""
    kept = stored(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("low")).sort("part").collect()
    starts, before = [], 0  # one entry a partition of the stored table
    for p, rows, low in counts:
        starts.append((p, before - low))
        before += rows
    shifts = df.sparkSession.createDataFrame(starts, "part long, shift long")
    return kept.withColumn("part", part).join(F.broadcast(shifts), "part").withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _centred(n: int, sums: list[int]) -> Column:
    s = F.array(*[F.lit(v).cast("long") for v in sums])
    return F.transform("x", lambda v, i: (v * n - F.get(s, i)).cast("double") / n)


def blocks(rows: DataFrame, values: Column, dims: int) -> BlockMatrix:
    """The block matrix of (at, values) rows; JVM side only."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("at").alias("index"), array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(BLOCK, dims)


def scatter(a: BlockMatrix, n: int) -> np.ndarray:
    """a' a, summed over as many parts of the rows as there are blocks."""
    parts = max(1, -(-n // BLOCK))
    left = a.transpose()._java_matrix_wrapper
    both = left.call("multiply", a._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(both, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def times(a: BlockMatrix, w: np.ndarray, df: DataFrame) -> BlockMatrix:
    """a w, for a small matrix w of one block."""
    small = df.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(w)], "at long, v array<double>")
    right = MLUtils.convertVectorColumnsFromML(small.select(F.col("at").alias("index"), array_to_vector("v").alias("vector")), "vector")
    return a.multiply(IndexedRowMatrix(right).toBlockMatrix(w.shape[0], w.shape[1]))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (vec_id, x) rows, each distinct x once; None without rows."""
    once = numbered(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    per = once.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).sort("i").collect()
    n, sums = once.count(), [int(r.s) for r in per]  # one sum a dimension
    if not sums:
        return None
    a = blocks(once, _centred(n, sums), len(sums))
    e, v = np.linalg.eigh(scatter(a, n) / n)
    e, v = np.maximum(e[::-1], 0), v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(e))] < 0, -1, 1)
    k = min(components, len(e))
    w = Whitening(n, sums, e[:k], v[:, :k], float(e.sum()))
    live = int((w.variances > NONE * w.total).sum())
    if live:  # measured on the whitened rows themselves
        white = scatter(times(a, w.matrix()[:, :live], rows), n) / n
        w.identity_error = float(np.abs(white - np.eye(live)).max())
    return w


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and
    component, of a whitening fitted to the rows themselves."""
    rows = numbered(whole_vectors(df, vector), "whitening-rows")
    w = fit(rows, components)
    if w is None:
        return df.sparkSession.createDataFrame([], T.StructType([
            T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]))
    white = times(blocks(rows, _centred(w.n, w.sums), len(w.sums)), w.matrix(), df).toIndexedRowMatrix()
    z = callMLlibFunc("getIndexedRows", white._java_matrix_wrapper._java_model)
    z = z.select(F.col("index").alias("at"), vector_to_array("vector").alias("z"))
    s = F.array(*[F.lit(v).cast("long") for v in w.sums])
    off = F.transform("x", lambda v, i: F.try_subtract(F.try_multiply(v, F.lit(w.n).cast("long")), F.get(s, i)))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda t, d: F.try_add(t, F.try_multiply(d, d)))
    parts = [F.struct(F.lit(i + 1).alias("component"), (F.get("z", F.lit(i)) if e > NONE * w.total else F.lit(None).cast("double")).alias("whitened"),
                      F.lit(float(e / w.total) if w.total else None).cast("double").alias("explained")) for i, e in enumerate(w.variances)]
    out = rows.select("at", "vec_id", deviation.alias("deviation")).join(z, "at").select("vec_id", "deviation", F.explode(F.array(*parts)).alias("p"))
    return out.select("vec_id", "p.component", F.lit(w.n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(w.identity_error).alias("identity_error"))
