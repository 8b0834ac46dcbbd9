"""A training-corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bwt_dedup import WORD_GRAM, WORD_SPAN, remove_repeats
from quarry.llm.common import discard, materialize, table
from quarry.llm.gam_quality import fit_quality, keep_good
from quarry.llm.jaccard_join import keep_one
from quarry.llm.string_tiling import decontaminate
from quarry.llm.trie_bpe import encode_documents

#: Stages of this kind can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, rejects go.

    Labelled rows come from the documents at hand, so the stage stands on its own input.  Null texts are scored as empty;
    repeated rows are judged alike; where nothing could be learned, all stay."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard 0.8 on five-word shingles, the document with the smallest id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (A-Z in lower case, whatever stands between them) that stand elsewhere too go; the documents
    stay, and n_chars follows the text.  By words, since such a passage often has fewer than 400 bytes.  Null and short
    texts stay as they are; repeated rows count as copies of one another."""
    out = remove_repeats(docs, WORD_SPAN, WORD_GRAM, words=True)
    if "n_chars" in docs.columns:
        same = F.col("__n_removed") == 0
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that tile a benchmark item go.  Null and empty texts tile nothing and stay; repeated rows are judged alike."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and decoded text of what is left."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # what a stage wrote goes when the next one has read it
    return docs
