"""Exact nearest neighbours.

The base table is scanned once for each block of queries.  A partition keeps the k best of every query: matrix products
find who can be among them, with a margin for rounding, and the reference kernel decides on those few.  So a shuffle moves
at most k rows a query and partition, and results equal those of the column kernels bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.kernels import distance, distances_np, normalize_np, unit
from quarry.types import MetricKind, VectorError

#: Bytes of queries in one broadcast block; more queries mean more blocks.
QUERY_BYTES = 64 << 20
SCHEMA = "qid long, id long, dist float"


def top(rows: DataFrame, order: W, k: int) -> DataFrame:
    """The first k rows of every window, with their rank from 0.  The bare comparison with a literal lets Spark limit each
    group before the shuffle too."""
    numbered = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return numbered.withColumn("rank", (F.col("__n") - 1).cast("int")).drop("__n")


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy("dist", "id")
    return top(pairs, order, k).select("qid", "rank", "id", "dist")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a float array column; an error if one is null or of another size."""
    sizes = np.diff(np.asarray(column.offsets))
    if column.null_count or (sizes != dim).any():
        raise VectorError(f"vectors must have dimension {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dim)


def best_of(qx: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, kind: MetricKind) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of the k best rows of x for every query."""
    q64, x64 = qx.astype(np.float64), x.astype(np.float64)
    dots = q64 @ x64.T
    if kind is MetricKind.L2:
        near = (q64 * q64).sum(1)[:, None] + (x64 * x64).sum(1)[None, :] - 2 * dots
        scale = (q64 * q64).sum(1)[:, None] + (x64 * x64).sum(1)[None, :]
    else:
        near = -dots
        scale = np.abs(q64) @ np.abs(x64).T + 1
    n = x.shape[0]
    for q in range(len(qx)):
        if n > k:
            cut = np.partition(near[q], k - 1)[k - 1]
            some = np.flatnonzero(near[q] <= cut + 4e-7 * scale[q].max())  # float steps and the product's rounding
        else:
            some = np.arange(n)
        dist = distances_np(x[some], qx[q], kind)
        order = np.lexsort((ids[some], dist))[:k]
        yield q, ids[some][order], dist[order]


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str | MetricKind = "l2", impl: str = "blocks", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, dist) of the k nearest of base (id, vec) for every query (qid, vec), by (dist, id), rank from 0.

    k = 0 or an empty side gives no row; fewer than k base rows give fewer.  ``impl``: "blocks", or "hof" and "unrolled"
    for a broadcast cross join with column kernels.  ``exclude_self`` leaves out rows whose id is the query's.
    """
    kind = MetricKind.parse(metric)
    spark = base.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "qid long, rank int, id long, dist float")
    if impl != "blocks":
        dim = queries.select(F.max(F.size("vec"))).first()[0] or 0
        q = F.broadcast(queries.select("qid", unit(F.col("vec"), kind).alias("qv")))  # for comparison, on few queries
        pairs = base.select("id", unit(F.col("vec"), kind).alias("bv")).crossJoin(q)
        if exclude_self:
            pairs = pairs.where("id <> qid")
        return _rank(pairs.select("qid", "id", distance(F.col("qv"), F.col("bv"), kind, impl, dim).alias("dist")), k)
    wide = k + 1 if exclude_self else k
    found = None
    for qids, qx in query_blocks(queries):
        if kind is MetricKind.COSINE:
            qx = _unit_np(qx)
        part = base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(_scan(spark.sparkContext.broadcast((qids, qx)), wide, kind), SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "qid long, rank int, id long, dist float")
    if exclude_self:
        found = found.where("id <> qid")
    return _rank(found, k)


def query_blocks(queries: DataFrame, limit: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in blocks of at most about limit bytes, one on the driver at a time."""
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if not shape["n"]:
        return
    if shape["a"] != shape["b"] or shape["a"] < 1:
        raise VectorError("queries must have one dimension")
    blocks = -(-shape["n"] * (4 * shape["b"] + 8) // limit)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = part.select(F.col("qid").cast("long").alias("qid"), "vec").toArrow().sort_by("qid").combine_chunks()
        if rows.num_rows:
            column = rows.column(1).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            yield rows.column(0).to_numpy(), matrix(column, shape["b"])


def _unit_np(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all() or not (x != 0).any(axis=1).all():
        raise VectorError("zero or non-finite vector")
    return normalize_np(x)


def _scan(held, k: int, kind: MetricKind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qx = held.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(qids)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), qx.shape[1])
                if kind is MetricKind.COSINE:
                    x = _unit_np(x)
                for lot in range(0, len(qids), 1024):
                    for q, i, d in best_of(qx[lot : lot + 1024], ids, x, k, kind):
                        oi, od = best[lot + q]
                        i, d = np.concatenate([oi, i]), np.concatenate([od, d])
                        order = np.lexsort((i, d))[:k]
                        best[lot + q] = (i[order], d[order])
        for lot in range(0, len(qids), 4096):
            some = best[lot : lot + 4096]
            if any(len(i) for i, _ in some):
                yield pa.RecordBatch.from_pydict({"qid": pa.array(np.repeat(qids[lot : lot + 4096], [len(i) for i, _ in some])), "id": pa.array(np.concatenate([i for i, _ in some])), "dist": pa.array(np.concatenate([d for _, d in some]), pa.float32())})

    return run


def nearest(base: DataFrame, query: list[float], k: int, metric: str | MetricKind = "l2") -> DataFrame:
    """(rank, id, dist) for one query, by top-k without a shuffle of the base."""
    kind = MetricKind.parse(metric)
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = base.select("id", distance(unit(q, kind), unit(F.col("vec"), kind), kind).alias("dist"))
    best = scored.orderBy("dist", "id").limit(max(k, 0))
    return best.select((F.row_number().over(W.orderBy("dist", "id")) - 1).cast("int").alias("rank"), "id", "dist")


def distances_to(base: DataFrame, wanted: DataFrame, metric: str | MetricKind = "l2") -> DataFrame:
    """wanted (qid, vec, id) with the distance to base's id; an id that base lacks is an error."""
    kind = MetricKind.parse(metric)
    asked = wanted.select("qid", F.col("vec").alias("qv"), "id")
    joined = asked.join(base.select("id", F.col("vec").alias("bv")), "id", "left")
    known = F.when(F.col("bv").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col("id").cast("string"))).cast("array<float>")).otherwise(F.col("bv"))
    return joined.select("qid", "id", distance(unit(F.col("qv"), kind), unit(known, kind), kind).alias("dist"))
