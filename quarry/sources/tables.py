"""Tables as vector collections: a registry, in-memory rows, neighbour lists in both shapes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.validate import check_shape
from quarry.types import VECTORS, VectorError, check_dim


@dataclass(frozen=True)
class DatasetSpec:
    """A registered collection: place below the root, columns, expected shape (0: any), metric and recall target."""

    name: str
    path: str
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    count: int = 0
    dim: int = 64
    metric: str = "l2"
    target: float = 0.95


REGISTRY = {"embeddings": DatasetSpec("embeddings", "embeddings.parquet")}


def resolve_root(root: str | None = None, variable: str = "QUARRY_DATASETS", default: str = "~/datasets") -> str:
    """An argument goes before the environment, which goes before the default."""
    return os.path.expanduser(root or os.environ.get(variable) or default)


def load(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """(id, vec) of a registered dataset; its shape is checked where the registry states one."""
    if name not in REGISTRY:
        raise VectorError(f"unknown dataset {name}; known: {', '.join(sorted(REGISTRY))}")
    spec = REGISTRY[name]
    rows = vectors(spark.read.parquet(f"{resolve_root(root)}/{spec.path}"), spec.id_col, spec.vec_col)
    if spec.count:
        check_shape(rows, spec.count, spec.dim)
    return rows


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def from_flat(spark: SparkSession, dim: int, values: list[float]) -> DataFrame:
    """Rows of a flat buffer, ids by position."""
    check_dim(dim)
    if len(values) % dim:
        raise VectorError(f"{len(values)} values are not whole vectors of dimension {dim}")
    return spark.createDataFrame([(k, [float(x) for x in values[k * dim : (k + 1) * dim]]) for k in range(len(values) // dim)], VECTORS)


def first_n(df: DataFrame, n: int) -> DataFrame:
    """Vectors with ids below n; an error if the ids don't reach it."""
    top = df.agg(F.max("id")).first()[0]
    if n < 0 or top is None or n > top + 1:
        raise VectorError(f"first {n} of ids up to {top}")
    return df.where(F.col("id") < n)


def split_tail(df: DataFrame, warmup: int) -> tuple[DataFrame, DataFrame]:
    """(measured, warm-up): the last ids warm up, at most half of all."""
    last = df.agg(F.max("id")).first()[0]
    n = 0 if last is None else last + 1
    w = min(warmup, n // 2)
    return df.where(F.col("id") < n - w), df.where(F.col("id") >= n - w)


def to_lists(neighbours: DataFrame) -> DataFrame:
    """(id, vec): neighbour ids of each query by rank, as the integer file format has them; ids must fit 32 bits."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: F.when(s["id"] > 2**31 - 1, F.raise_error(F.lit("id above 32 bits")).cast("long")).otherwise(s["id"]).cast("int"))
    return neighbours.groupBy(F.col("qid").alias("id")).agg(ids.alias("vec"))


def from_lists(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("id").alias("qid"), F.posexplode("vec").alias("rank", "id")).select("qid", "rank", F.col("id").cast("long").alias("id"))
