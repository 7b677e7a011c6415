"""What the text operators share: the work columns of a document table and
stored intermediate tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.session import materialize

#: A word is a run of characters outside this set (ASCII blanks).
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text, as an array.  Plain replacement and a split at one
    character are several times as fast as a regular expression."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; what its shuffles left on disk
    goes as soon as the table is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def joined_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, for n rows and links i-j."""
    lab = np.arange(n)
    while True:
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            return lab
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(lab, nxt := lab[lab]):
            lab = nxt
