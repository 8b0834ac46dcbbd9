"""The commands: ground truth, recall sweep, round trip of a graph."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import truth
from quarry.operators.graph_index import GraphParams
from quarry.operators.hnsw import build, load, save, search_built, sweep
from quarry.operators.knn import knn
from quarry.sources.tables import first_n

EF = (10, 20, 40, 80, 160, 320, 512, 800)


def ground_truth(base: DataFrame, queries: DataFrame, k: int = 100, metric: str = "l2", limit: int | None = None) -> DataFrame:
    """Exact neighbours; k must be in 1..rows of the base."""
    rows = base.count()
    if not 1 <= k <= rows:
        raise ValueError(f"k must be in 1..{rows}, not {k}")
    if limit is not None:
        queries = first_n(queries.withColumnRenamed("qid", "id"), limit).withColumnRenamed("id", "qid")
    return knn(base, queries, k, metric)


def recall_sweep(base: DataFrame, queries: DataFrame, k: int = 10, efs: tuple[int, ...] = EF, metric: str = "l2", params: GraphParams | None = None, shards: int = 1) -> DataFrame:
    """(ef, recall, distance_recall, computed per query) over beams on the same graphs, against exact neighbours."""
    exact = knn(base, queries, k, metric).checkpoint()
    found = sweep(base, queries, k, list(efs), params, metric, shards).checkpoint()
    out = None
    for ef in efs:  # a few settings
        ours = found.where(F.col("ef") == ef)
        work = ours.groupBy("qid").agg(F.max("computed").alias("c")).agg(F.avg("c").alias("computed"))
        row = truth.recall(ours, exact, k).select("recall").join(truth.distance_recall(ours, exact, k).select(F.col("recall").alias("distance_recall"))).join(work)
        row = row.select(F.lit(ef).alias("ef"), "recall", "distance_recall", "computed")
        out = row if out is None else out.unionByName(row)
    return out


def bench(base: DataFrame, queries: DataFrame, k: int = 10, efs: tuple[int, ...] = EF, metric: str = "l2", params: GraphParams | None = None, shards: int = 1, repeats: int = 3, warmup: int = 10) -> DataFrame:
    """One row a beam: ef, recall, computed (distances a query), qps, p50, p95, p99 (seconds a query, nearest rank), of the
    repeat with the upper median qps; spread of the repeats' qps; same_recall, whether all repeats found the same.

    Queries a second are those of one searcher: queries over the sum of their seconds.  Warm-up queries don't count."""
    exact = knn(base, queries, k, metric).checkpoint()
    found = sweep(base, queries, k, list(efs), params, metric, shards, repeats, warmup).checkpoint()
    hits = found.join(exact.where(F.col("rank") < k).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").groupBy("ef", "repeat", "qid")
    per = hits.agg(F.max("seconds").alias("seconds"), F.sum("computed").alias("c"), F.count("rank").alias("n"), F.count("hit").alias("hits"))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by seconds)")  # noqa: E731  of the queries of a run
    runs = per.groupBy("ef", "repeat").agg(
        (F.sum("hits") / (F.count(F.lit(1)) * k)).alias("recall"), F.avg(F.col("c") / F.col("n")).alias("computed"), (F.count(F.lit(1)) / F.sum("seconds")).alias("qps"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )
    listed = runs.groupBy("ef").agg(F.array_sort(F.collect_list(F.struct("qps", "recall", "computed", "p50", "p95", "p99"))).alias("r"), F.count_distinct("recall").alias("kinds"))  # a few repeats
    median = F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int"))
    spread = (F.element_at("r", -1)["qps"] - F.element_at("r", 1)["qps"]) / median["qps"]
    return listed.select("ef", median.alias("m"), spread.alias("spread"), (F.col("kinds") == 1).alias("same_recall")).select("ef", "m.recall", "m.computed", "m.qps", "m.p50", "m.p95", "m.p99", "spread", "same_recall")


def timed(run, repeats: int = 1) -> list[float]:
    """Seconds of each repeat of an action."""
    out = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return out


def round_trip(base: DataFrame, queries: DataFrame, path: str, k: int = 10, ef: int = 80, metric: str = "l2", params: GraphParams | None = None, shards: int = 1) -> DataFrame:
    """Rows by which the answers of graphs before and after a write and read differ: none, if the trip is exact."""
    built = build(base, params, metric, shards)
    before = search_built(base, built, queries, k, ef)
    save(built, path)
    after = search_built(base, load(base.sparkSession, path), queries, k, ef)
    return before.exceptAll(after).unionByName(after.exceptAll(before))
