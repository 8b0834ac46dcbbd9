"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, all other
speakers as named users and system turns as they are; loss masks cover what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import table

#: Turns of one block of the two-level prefix sum: no window holds more than a block, or one row a block.
BLOCK = 1024


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """One row for each perspective and turn, in the order conv, perspective, turn, speaker, body.

    conv_id, perspective (the participant who is the assistant), turn, speaker, tag, segment (the rendered turn),
    char_start and char_end (its place in that perspective's rendering), loss (whether the assistant says it), loss_start
    and loss_end (what is trained on: the body and its end mark; null without loss).  Concatenated segments are the
    rendering, so that no conversation is ever gathered in one row.

    Null speakers are "unknown", null texts empty, null conversation ids one conversation; turns that are null come first,
    and rows with equal turns follow speaker and text; repeated rows stay.  A conversation of system turns only has no
    participant and gives no row.  Other columns are ignored.
    """
    base = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    voices = base.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = base.join(voices, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own: Column = F.col("speaker") == F.col("perspective")
    tag = F.when(own, F.lit("<|assistant|>")).when(F.col("speaker") == system, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>")))
    rows = rows.select(
        "conv_id", "perspective", "turn", "speaker", "body", tag.alias("tag"),
        F.concat(tag, F.lit("\n"), "body", F.lit("<|end|>\n")).alias("segment"), own.alias("loss"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).cast("long").alias("block"),
    )
    key = ["conv_id", "perspective", "block"]
    sums = rows.groupBy(*key).agg(F.sum(F.length("segment")).cast("long").alias("chars"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"))
    # what a rendering consists of orders its rows: equal rows are interchangeable
    inside = W.partitionBy(*key).orderBy("turn", "speaker", "body").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.length("segment")).over(inside))
    rows = rows.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("base") + F.col("upto")
    start = end - F.length("segment")
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", "tag", "segment",
        start.cast("long").alias("char_start"), end.cast("long").alias("char_end"), "loss",
        F.when(F.col("loss"), start + F.length("tag") + 1).cast("long").alias("loss_start"),
        F.when(F.col("loss"), end - 1).cast("long").alias("loss_end"),
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op6_perspective_rotation": op6_perspective_rotation}
ORACLES = {
    "op6_perspective_rotation": """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), voices AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'
), made AS (
  SELECT b.conv_id, v.perspective, b.turn, b.speaker, b.body, b.speaker = v.perspective AS loss,
         CASE WHEN b.speaker = v.perspective THEN '<|assistant|>' WHEN b.speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || b.speaker || '|>' END AS tag
  FROM base b JOIN voices v ON b.conv_id IS NOT DISTINCT FROM v.conv_id
), rendered AS (
  SELECT *, tag || chr(10) || body || '<|end|>' || chr(10) AS segment FROM made
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                                            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM rendered
)
SELECT conv_id, perspective, turn, speaker, tag, segment, CAST(char_end - length(segment) AS BIGINT) AS char_start, char_end, loss,
       CASE WHEN loss THEN CAST(char_end - length(segment) + length(tag) + 1 AS BIGINT) END AS loss_start,
       CASE WHEN loss THEN CAST(char_end - 1 AS BIGINT) END AS loss_end
FROM placed
"""
}
