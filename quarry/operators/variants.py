"""Search with filters, tombstones and quantized vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.graph_index import GraphParams
from quarry.operators.hnsw import filtered_search
from quarry.operators.knn import distances_to, knn, top
from quarry.types import VectorError


def filtered_knn(base: DataFrame, queries: DataFrame, k: int, predicate: Column | str, metric: str = "l2") -> DataFrame:
    """Exact neighbours among the rows that pass: the filter stands below the scan, so it is pushed down."""
    return knn(base.where(predicate).select("id", "vec"), queries, k, metric)


def strategy(passing: float) -> str:
    """How an approximate search should treat a filter that this share of the rows passes."""
    if not 0 <= passing <= 1:
        raise VectorError("a share must be in 0..1")
    return "brute_force" if passing < 0.01 else "in_filter" if passing < 0.6 else "post_filter"


def widened_beam(ef: int, tombstoned: float) -> int:
    """Beam that keeps ef live results where this share of the rows is dead."""
    if not 0 <= tombstoned < 1:
        raise VectorError("a share must be in 0..1")
    whole = ef / (1 - tombstoned)
    return int(whole) + (whole > int(whole))


#: Share of dead rows past which graphs are built anew without them.
REBUILD_SHARE = 0.2


def approximate_filtered(base: DataFrame, queries: DataFrame, k: int, ef: int, predicate: Column | str, tombstones: DataFrame | None = None, metric: str = "l2", params: GraphParams | None = None, shards: int | None = None) -> DataFrame:
    """(qid, rank, id, dist) among the live rows of base (id, vec, ...) that pass, by the strategy for the share that passes.

    Tombstones (id) of up to REBUILD_SHARE of the rows stay in the graphs, as nodes to walk over that are no results, under
    a beam widened for them; of more, the graphs are built without them."""
    rows = base
    dead = 0.0
    if tombstones is not None:
        rows = base.join(tombstones.select("id", F.lit(True).alias("__dead")).distinct(), "id", "left")
        n = rows.agg(F.avg(F.col("__dead").isNotNull().cast("double")).alias("dead")).first()["dead"] or 0.0
        if n > REBUILD_SHARE:
            rows = rows.where("__dead is null")
        else:
            dead = n
    condition = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))
    passing = condition & F.col("__dead").isNull() if tombstones is not None else condition
    share = rows.agg(F.avg(passing.cast("double")).alias("s")).first()["s"] or 0.0
    mode = strategy(share)
    if mode == "brute_force":
        return filtered_knn(rows, queries, k, passing, metric)
    return filtered_search(rows, queries, k, widened_beam(max(ef, k), dead), passing, mode, params, metric, shards).drop("computed")


def live(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    return base.join(tombstones.select("id"), "id", "left_anti")


def clip_bounds(base: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """pos, lo, hi: nearest-rank quantiles of every dimension."""
    parts = base.select(F.posexplode("vec").alias("pos", "x"))
    of = lambda p: F.expr(f"percentile_disc({p}) within group (order by x)").cast("double")
    return parts.groupBy("pos").agg(of(low).alias("lo"), of(high).alias("hi"))


def quantizer(base: DataFrame, low: float = 0.01, high: float = 0.99) -> tuple[list[float], list[float], float]:
    """Clip bounds of every dimension and the global scale, the widest range over 255 (at least one step)."""
    rows = sorted(clip_bounds(base, low, high).collect())  # one row a dimension: at most 4096
    scale = max((r["hi"] - r["lo"] for r in rows), default=0.0) / 255.0
    return [r["lo"] for r in rows], [r["hi"] for r in rows], scale or 1.0


def quantize(vec: Column, lows: list[float], highs: list[float], scale: float) -> Column:
    """Steps of the scale above each dimension's lower bound, clipped to it, 0 to 255."""
    lo, hi = F.array(*map(F.lit, lows)), F.array(*map(F.lit, highs))
    clipped = F.zip_with(F.zip_with(vec, lo, lambda x, a: F.greatest(x.cast("double"), a)), hi, lambda x, b: F.least(x, b))
    return F.zip_with(clipped, lo, lambda x, a: F.floor((x - a) / F.lit(scale) + 0.5).cast("int"))


def quantized_knn(base: DataFrame, queries: DataFrame, k: int, low: float = 0.01, high: float = 0.99, rescore: int = 0) -> DataFrame:
    """(qid, rank, id, dist) by integer squared distance of quantized vectors, times scale squared; with rescore, the
    k * rescore best are ranked anew by the exact distance."""
    lows, highs, scale = quantizer(base, low, high)
    b = base.select("id", quantize(F.col("vec"), lows, highs, scale).alias("b"))
    q = queries.select("qid", quantize(F.col("vec"), lows, highs, scale).alias("q"))
    n = k * max(rescore, 1)
    steps = F.aggregate(F.zip_with("q", "b", lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = b.crossJoin(F.broadcast(q)).select("qid", "id", steps.alias("steps"))  # a stated set of queries
    order = W.partitionBy("qid").orderBy("steps", "id")
    best = top(pairs, order, n)
    if not rescore:
        return best.select("qid", "rank", "id", (F.col("steps").cast("double") * F.lit(scale * scale)).cast("float").alias("dist"))
    exact = distances_to(base, best.select("qid", "id").join(queries.select("qid", "vec"), "qid"))
    again = W.partitionBy("qid").orderBy("dist", "id")
    return top(exact, again, k).select("qid", "rank", "id", "dist")
