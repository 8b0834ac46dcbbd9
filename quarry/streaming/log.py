"""The write-ahead log as a table: checksums, the valid prefix, the split at a snapshot, gaps.

A log is ordered by seq, dense from its first record.  What is valid ends before the first torn record (its checksum
fails) and before the first gap, even if later records are fine.  All of it is aggregates and joins on seq; no window
runs over the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.types import VectorError

LOG = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ext_id", T.LongType()), T.StructField("level", T.IntegerType()),
    T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("metadata", T.BinaryType()), T.StructField("snapshot_seq", T.LongType()), T.StructField("crc", T.LongType()),
])
OPS = ("insert", "delete", "checkpoint")
MAX_LEVEL = 32


def checksum() -> Column:
    """crc32 of a record's content; null and empty fields differ."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    vec = F.coalesce(F.array_join(F.transform("vec", lambda x: F.coalesce(x.cast("string"), F.lit("~"))), ","), F.lit("~"))
    return F.crc32(F.concat_ws("|", text(F.col("seq")), text(F.col("op")), text(F.col("ext_id")), text(F.col("level")), vec, F.coalesce(F.hex("metadata"), F.lit("~")), text(F.col("snapshot_seq"))).cast("binary"))


def torn() -> Column:
    return F.col("crc").isNull() | (F.col("crc") != checksum())


def first_bad(log: DataFrame, bad: Column | None = None) -> DataFrame:
    """One row: first_seq, torn_seq, gap_seq (the first record after a gap) and end_seq (null: all is valid)."""
    rows = log.select("seq", (torn() if bad is None else bad).alias("bad"))
    first = rows.agg(F.min("seq").alias("first_seq"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("torn_seq"))
    after = rows.join(rows.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti")  # records without predecessor
    gap = after.join(F.broadcast(first.select("first_seq"))).where("seq > first_seq").agg(F.min("seq").alias("gap_seq"))  # one row
    return first.join(gap).select("first_seq", "torn_seq", "gap_seq", F.least("torn_seq", "gap_seq").alias("end_seq"))


def valid_prefix(log: DataFrame, bad: Column | None = None) -> DataFrame:
    end = F.broadcast(first_bad(log, bad).select("end_seq"))  # one row
    return log.join(end).where("end_seq is null or seq < end_seq").drop("end_seq")


def replay_split(log: DataFrame, snapshot_seq: int, bad: Column | None = None) -> DataFrame:
    """One row: skipped (at or before the snapshot), replayed, replayed_inserts and next_seq of the valid prefix."""
    rows = valid_prefix(log, bad)
    new = F.col("seq") > snapshot_seq
    return rows.agg(
        F.count_if(~new).alias("skipped"), F.count_if(new).alias("replayed"), F.count_if(new & (F.col("op") == "insert")).alias("replayed_inserts"),
        (F.greatest(F.coalesce(F.max("seq"), F.lit(snapshot_seq)), F.lit(snapshot_seq)) + 1).alias("next_seq"),
    )


def require_intact(log: DataFrame, snapshot_seq: int) -> DataFrame:
    """The valid prefix, or an error: records missing after the snapshot, an unknown operation, a malformed insert.

    These are records whose checksum holds, so they aren't damage that recovery may cut off."""
    rows = valid_prefix(log)
    wrong = ~F.col("op").isin(*OPS) | ((F.col("op") == "insert") & (F.col("vec").isNull() | F.col("ext_id").isNull() | F.col("level").isNull() | (F.col("level") < 0) | (F.col("level") > MAX_LEVEL)))
    r = rows.agg(F.min("seq").alias("first"), F.min(F.when(wrong, F.col("seq"))).alias("wrong")).first()
    if r["first"] is not None and r["first"] > snapshot_seq + 1:
        raise VectorError(f"records {snapshot_seq + 1} to {r['first'] - 1} are missing")
    if r["wrong"] is not None:
        raise VectorError(f"record {r['wrong']} is intact but not understood")
    return rows


def applied(snapshot: DataFrame, log: DataFrame, snapshot_seq: int) -> DataFrame:
    """(ext_id, level, vec, metadata) of the snapshot with the later inserts and without what later deletes name."""
    later = log.where(F.col("seq") > snapshot_seq)
    meta = lambda df: (F.col("metadata") if "metadata" in df.columns else F.lit(None)).cast("binary").alias("metadata")
    added = later.where("op = 'insert'").select("seq", "ext_id", "level", "vec", meta(later))
    both = snapshot.select(F.lit(0).cast("long").alias("seq"), "ext_id", "level", "vec", meta(snapshot)).unionByName(added)
    gone = later.where("op = 'delete'").groupBy("ext_id").agg(F.max("seq").alias("gone"))
    return both.join(gone, "ext_id", "left").where("gone is null or seq > gone").select("ext_id", "level", "vec", "metadata")
