"""Neighbour selection as a column expression: an ordered fold, so it needs neither a UDF nor a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kernels import distance
from quarry.types import MetricKind


def candidate_lists(neighbours: DataFrame, base: DataFrame) -> DataFrame:
    """qid and its candidates, an array of (dist, id, vec) by (dist, id).  Lists hold at most k entries a query."""
    rows = neighbours.join(base.select("id", "vec"), "id")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist", "id", "vec"))).alias("candidates"))


def select_neighbors(candidates: Column, m: int, metric: str | MetricKind = "l2", heuristic: bool = True, keep_pruned: bool = True) -> Column:
    """Ids of at most m candidates.  In order of (dist, id), one is chosen if no chosen one is strictly closer to it than
    the query is; with keep_pruned the nearest of the others fill what is free, after the chosen."""
    ids = F.transform(candidates, lambda c: c["id"])
    if not heuristic:
        return F.slice(ids, 1, m)
    none = F.slice(candidates, 1, 0)

    def step(chosen: Column, c: Column) -> Column:
        crowded = F.exists(chosen, lambda s: distance(c["vec"], s["vec"], metric) < c["dist"])
        return F.when((F.size(chosen) >= m) | crowded, chosen).otherwise(F.concat(chosen, F.array(c)))

    chosen = F.transform(F.aggregate(candidates, none, step), lambda c: c["id"])
    return F.slice(F.concat(chosen, F.array_except(ids, chosen)), 1, m) if keep_pruned else chosen
