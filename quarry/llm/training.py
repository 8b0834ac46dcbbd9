"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc32_text

#: Fold of a document: crc32(id as text) mod 4; this one is held out.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id"):
    """Whether a document belongs to the held-out fold; null ids don't."""
    return F.coalesce(F.pmod(crc32_text(id_col), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text (t) and label (y, 0 or 1) of at most about max_rows labelled documents outside the held-out fold.

    The sample is the max_rows smallest xxhash64(id), so it depends neither on order nor on partitions.  A document with
    several labels takes the mean, rounded up from one half; null ids and labels other than 0 and 1 are ignored.
    """
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(~held_out("k")).groupBy("k").agg(F.avg("y").alias("y"))
    rows = known.select("k", F.when(F.col("y") >= 0.5, 1).otherwise(0).alias("y"), F.xxhash64("k").alias("h")).orderBy("h", "k").limit(max_rows).select("k", "y").collect()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in rows], "k long, y int")
    # at most max_rows pairs of ints: bounded, whatever the tables hold
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "k").select("t", "y")
