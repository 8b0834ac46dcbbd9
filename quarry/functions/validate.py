"""Checks of vectors that come from outside: a table of violations, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.types import VectorError, check_dim


def violations(vectors: DataFrame, dim: int, zero: bool = False) -> DataFrame:
    """kind, id, component, value of every bad row: null_vector, bad_dimension (value: its size), non_finite (the first bad
    component; null components count), zero_vector (if asked).  A row shows its first kind only."""
    check_dim(dim)
    bad = F.posexplode_outer("vec")
    sized = vectors.select("id", "vec", F.when(F.col("vec").isNull(), "null_vector").when(F.size("vec") != dim, "bad_dimension").alias("kind"))
    shape = sized.where("kind is not null").select("kind", "id", F.lit(None).cast("int").alias("component"), F.when(F.col("vec").isNotNull(), F.size("vec").cast("double")).alias("value"))
    parts = sized.where("kind is null").select("id", "vec", bad.alias("component", "x"))
    wrong = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    first = parts.where(wrong).groupBy("id").agg(F.min(F.struct("component", F.col("x").cast("double").alias("value"))).alias("f"))
    out = shape.unionByName(first.select(F.lit("non_finite").alias("kind"), "id", "f.component", "f.value"))
    if zero:
        none = sized.where("kind is null and not exists(vec, x -> x is null or x <> 0)")
        out = out.unionByName(none.select(F.lit("zero_vector").alias("kind"), "id", F.lit(None).cast("int").alias("component"), F.lit(0.0).alias("value")))
    return out


def require_valid(vectors: DataFrame, dim: int, zero: bool = False) -> DataFrame:
    """The vectors, or an error that names the first violation by id."""
    found = violations(vectors, dim, zero).orderBy("id").limit(1).collect()
    if found:
        r = found[0]
        raise VectorError(f"{r['kind']}: vector {r['id']}, component {r['component']}, value {r['value']}")
    return vectors


def check_shape(vectors: DataFrame, count: int, dim: int) -> None:
    """An error unless there are count vectors, all of dimension dim."""
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if r["n"] != count or (count and (r["a"] != dim or r["b"] != dim)):
        raise VectorError(f"expected {count} x {dim}, found {r['n']} x {r['a']}..{r['b']}")
