"""Schemas, metrics and errors of the vector engine."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

#: Bounds of a collection.
MAX_DIM = 4096

VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
NEIGHBOURS = T.StructType([T.StructField("qid", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("dist", T.FloatType())])
NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("level", T.IntegerType())])
EDGES = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("dst", T.LongType())])


class VectorError(ValueError):
    """Bad input from outside: named, never skipped."""


class MetricKind(Enum):
    """Distances, smaller is closer: squared Euclidean, 1 - cosine on unit vectors, negated inner product."""

    L2 = 0
    COSINE = 1
    DOT = 2

    @staticmethod
    def parse(name: str | MetricKind) -> MetricKind:
        names = {"l2": MetricKind.L2, "l2squared": MetricKind.L2, "cosine": MetricKind.COSINE, "angular": MetricKind.COSINE, "dot": MetricKind.DOT, "ip": MetricKind.DOT}
        if isinstance(name, MetricKind):
            return name
        if name.lower() not in names:
            raise VectorError(f"unknown metric: {name}")
        return names[name.lower()]


def check_dim(dim: int) -> int:
    if not 1 <= dim <= MAX_DIM:
        raise VectorError(f"dimension must be in 1..{MAX_DIM}, not {dim}")
    return dim
