"""Comparison of neighbour lists: agreement by id, equivalence by distance, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kernels import relative_gap
from quarry.operators.knn import distances_to


def share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """part / whole; nothing of nothing is ``empty``."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def rows_of(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(qid, positions, same, identical_row, same_set, first_difference) of lists joined by query and rank."""
    both = ours.select("qid", "rank", F.col("id").alias("a")).join(reference.select("qid", "rank", F.col("id").alias("b")), ["qid", "rank"])
    per = both.groupBy("qid").agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if(F.col("a") == F.col("b")).alias("same"),
        (F.array_sort(F.collect_list("a")) == F.array_sort(F.collect_list("b"))).alias("same_set"),  # k entries
        F.min(F.when(F.col("a") != F.col("b"), F.col("rank"))).alias("first_difference"),
    )
    return per.select("qid", "positions", "same", (F.col("same") == F.col("positions")).alias("identical_row"), "same_set", "first_difference")


def compare(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: rows, positions, identical_positions, identical_rows, same_set_rows, their shares (1 of nothing) and exact."""
    r = rows_of(ours, reference).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"), F.coalesce(F.sum("same"), F.lit(0)).alias("identical_positions"),
        F.count_if("identical_row").alias("identical_rows"), F.count_if("same_set").alias("same_set_rows"),
    )
    return r.select(
        "*", share(F.col("identical_rows"), F.col("rows")).alias("row_ratio"), share(F.col("same_set_rows"), F.col("rows")).alias("same_set_ratio"),
        share(F.col("identical_positions"), F.col("positions")).alias("position_ratio"), (F.col("identical_positions") == F.col("positions")).alias("is_exact"),
    )


def examples(ours: DataFrame, reference: DataFrame, n: int = 5) -> DataFrame:
    """The first n differing queries: qid, first_difference."""
    return rows_of(ours, reference).where("not identical_row").orderBy("qid").limit(n).select("qid", "first_difference")


def distance_equivalence(base: DataFrame, queries: DataFrame, ours: DataFrame, reference: DataFrame, metric: str = "l2", rtol: float = 1e-6) -> DataFrame:
    """One row: differing positions, how many are as far within rtol, the largest relative gap, is_equivalent."""
    both = ours.select("qid", "rank", F.col("id").alias("a")).join(reference.select("qid", "rank", F.col("id").alias("b")), ["qid", "rank"]).where("a <> b")
    asked = both.join(queries.select("qid", "vec"), "qid")
    ids = asked.select("qid", "vec", F.col("a").alias("id")).unionByName(asked.select("qid", "vec", F.col("b").alias("id"))).dropDuplicates(["qid", "id"])
    dist = distances_to(base, ids, metric)
    pairs = both.join(dist.select("qid", F.col("id").alias("a"), F.col("dist").alias("da")), ["qid", "a"]).join(dist.select("qid", F.col("id").alias("b"), F.col("dist").alias("db")), ["qid", "b"])
    gap = relative_gap(F.col("da").cast("double"), F.col("db").cast("double"))
    r = pairs.agg(F.count(F.lit(1)).alias("differing"), F.count_if(gap <= rtol).alias("equivalent"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_relative_gap"))
    return r.select("*", (F.col("differing") == F.col("equivalent")).alias("is_equivalent"))


def recall(ours: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits, expected (queries times k), recall by id membership in the first k of truth."""
    best = truth.where(F.col("rank") < k)
    hits = ours.where(F.col("rank") < k).join(best.select("qid", "id"), ["qid", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    n = best.select("qid").distinct().agg((F.count(F.lit(1)) * k).alias("expected"))
    return hits.crossJoin(n).select("hits", "expected", share(F.col("hits"), F.col("expected")).alias("recall"))  # one row each


def distance_recall(ours: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """As recall, but a result as near as the k-th true one counts, so that ties don't cost."""
    last = truth.where(F.col("rank") < k).groupBy("qid").agg(F.max("dist").alias("limit"))
    hits = ours.where(F.col("rank") < k).join(last, "qid").agg(F.count_if(F.col("dist") <= F.col("limit")).alias("hits"))
    n = last.agg((F.count(F.lit(1)) * k).alias("expected"))
    return hits.crossJoin(n).select("hits", "expected", share(F.col("hits"), F.col("expected")).alias("recall"))  # one row each


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99; nothing gives 0."""
    of = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {column})").cast("double"), F.lit(0.0))
    return values.agg(of(0.5).alias("p50"), of(0.95).alias("p95"), of(0.99).alias("p99"))


def median_row(repeats: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the upper median (index n // 2 of the ascending values) and the spread (max - min) / median."""
    r = repeats.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"))  # repeats of one setting: few
    median = F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int"))
    return r.select(key, median.alias("median"), share(F.array_max("v") - F.array_min("v"), median, 0.0).alias("spread"))


def meets_target(sweep: DataFrame, target: float) -> DataFrame:
    """One row: the best recall of a sweep and whether it reaches the target."""
    return sweep.agg(F.max("recall").alias("best")).select("best", (F.col("best") + 1e-9 >= target).alias("met"))
