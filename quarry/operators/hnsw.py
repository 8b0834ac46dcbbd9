"""Approximate search: a small-world graph for each shard of the base, built and searched by the shard's task."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.kernels import distances_np, normalize_np
from quarry.operators.graph_index import Graph, GraphParams
from quarry.operators.knn import best_of, matrix, query_blocks, top
from quarry.types import MetricKind, VectorError

#: Vectors of one shard: what one task builds a graph of, at most; and at least, where there are more cores than shards.
SHARD_ROWS, LEAST_ROWS = 4_096, 256


def shard_count(base: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
    n = base.count()
    return max(1, -(-n // shard_rows), min(base.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))


def bounded(base: DataFrame, shards: int | None) -> int:
    """The shards asked for, or more where a graph would have over SHARD_ROWS vectors."""
    return max(shards, -(-base.count() // SHARD_ROWS)) if shards else shard_count(base)


def _sharded(base: DataFrame, shards: int, *more: Column) -> DataFrame:
    """Rows by shard and id, a partition a shard."""
    rows = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long").alias("shard"), F.col("id").cast("long").alias("id"), "vec", *more)
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "id")


def _shards(batches: Iterator[pa.RecordBatch], kind: MetricKind) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ids, vectors) of a partition sorted by shard and id."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def whole(shard: int) -> tuple[int, np.ndarray, np.ndarray]:
        rows = held.pop(shard)
        dim = len(rows[0].column(2)[0])
        x = np.concatenate([matrix(r.column(2), dim) for r in rows])
        if not np.isfinite(x).all() or (kind is MetricKind.COSINE and not (x != 0).any(axis=1).all()):
            raise VectorError("zero or non-finite vector")
        return shard, np.concatenate([r.column(1).to_numpy() for r in rows]), normalize_np(x) if kind is MetricKind.COSINE else x

    for batch in batches:
        for shard in dict.fromkeys(batch.column(0).to_pylist()):
            for old in [s for s in held if s != shard]:
                yield whole(old)
            held.setdefault(shard, []).append(batch.filter(pa.array(batch.column(0).to_numpy() == shard)))
    for old in list(held):
        yield whole(old)


def _graph(ids: np.ndarray, x: np.ndarray, params: GraphParams, kind: MetricKind) -> Graph:
    return Graph(x.astype(np.float64), params, kind.name.lower()).build(ids.tolist())


def build(base: DataFrame, params: GraphParams | None = None, metric: str | MetricKind = "l2", shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta): graphs as tables with ids of the base.  One shard gives the sequential graph by ascending id.

    nodes: shard, id, level; edges: shard, layer, src, pos, dst; meta: shard, entry, count, params (JSON with the metric).
    """
    params, kind = params or GraphParams(), MetricKind.parse(metric)
    shards = shards or shard_count(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, x in _shards(batches, kind):
            g = _graph(ids, x, params, kind)
            n, edges = len(ids), g.edges()
            tag = lambda kind_, m, **c: pa.RecordBatch.from_pydict({"kind": pa.array([kind_] * m, pa.int32()), "shard": pa.array([shard] * m, pa.int64())} | {k: c.get(k, pa.nulls(m, t)) for k, t in _CELLS.items()})
            yield tag(0, n, a=pa.array(ids), layer=pa.array(g.levels, pa.int32()))
            yield tag(1, len(edges), layer=pa.array([e[0] for e in edges], pa.int32()), a=pa.array(ids[[e[1] for e in edges]] if edges else np.zeros(0, np.int64)), pos=pa.array([e[2] for e in edges], pa.int32()), b=pa.array(ids[[e[3] for e in edges]] if edges else np.zeros(0, np.int64)))
            yield tag(2, 1, a=pa.array([ids[g.entry]]), b=pa.array([n], pa.int64()))

    rows = _sharded(base, shards).mapInArrow(run, "kind int, shard long, a long, layer int, pos int, b long").checkpoint()
    text = json.dumps({"m": params.m, "max_degree0": params.max_degree0, "ef_construction": params.ef_construction, "seed": params.seed, "heuristic": params.heuristic, "keep_pruned": params.keep_pruned, "metric": kind.name.lower(), "shards": shards})
    nodes = rows.where("kind = 0").select("shard", F.col("a").alias("id"), F.col("layer").alias("level"))
    edges = rows.where("kind = 1").select("shard", "layer", F.col("a").alias("src"), "pos", F.col("b").alias("dst"))
    meta = rows.where("kind = 2").select("shard", F.col("a").alias("entry"), F.col("b").alias("count"), F.lit(text).alias("params"))
    return nodes, edges, meta


#: What a shard finds: seconds and distances computed for the query in this shard, and the repeat.
FOUND = "ef int, qid long, id long, dist float, computed long, seconds double, repeat int"
_CELLS = {"a": pa.int64(), "layer": pa.int32(), "pos": pa.int32(), "b": pa.int64()}


def save(built: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Write the tables of build() below a folder; meta goes last, so that a folder with it is whole."""
    for name, df in zip(("nodes", "edges", "meta"), built):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "meta"))


def search_built(base: DataFrame, built: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, k: int, ef: int) -> DataFrame:
    """As search, on graphs that are there: (qid, rank, id, dist, computed).  Metric and parameters are the graphs' own.

    A graph whose parts don't belong together, or whose vectors are missing from the base, is an error."""
    nodes, edges, meta = built
    spark = base.sparkSession
    shards = meta.collect()  # one row a shard
    if not shards:
        return spark.createDataFrame([], "qid long, rank int, id long, dist float, computed long")
    spec = json.loads(shards[0]["params"])
    kind = MetricKind.parse(spec.pop("metric"))
    count = spec.pop("shards")
    params = GraphParams(**spec)
    known = {r["shard"]: (r["entry"], r["count"]) for r in shards}
    none = F.lit(None)
    parts = nodes.join(base.select(F.col("id").cast("long").alias("id"), "vec"), "id").select("shard", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("level").cast("long").alias("b"), none.cast("int").alias("layer"), none.cast("int").alias("pos"), "vec")
    parts = parts.unionByName(edges.select("shard", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "layer", "pos", none.cast("array<float>").alias("vec")))
    parts = parts.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind", "a", "layer", "pos")
    found = None
    for qids, qx in query_blocks(queries):
        held = spark.sparkContext.broadcast((qids, normalize_np(qx) if kind is MetricKind.COSINE else qx))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, qx = held.value
            rows: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                for shard in dict.fromkeys(batch.column(0).to_pylist()):
                    rows.setdefault(shard, []).append(batch.filter(pa.array(batch.column(0).to_numpy() == shard)))
            for shard, some in rows.items():
                whole = pa.Table.from_batches(some).combine_chunks()
                mine = whole.filter(pa.array(whole.column(1).to_numpy() == 0))
                ids = mine.column(2).to_numpy()
                entry, n = known[shard]
                if len(ids) != n:
                    raise VectorError(f"shard {shard} has {len(ids)} of {n} vectors")
                vec = mine.column(6).combine_chunks()
                vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
                x = matrix(vec, qx.shape[1])
                x = normalize_np(x) if kind is MetricKind.COSINE else x
                other = whole.filter(pa.array(whole.column(1).to_numpy() == 1))
                place = {int(v): p for p, v in enumerate(ids)}
                links = [(la, place.get(a, -1), p, place.get(b, -1)) for a, b, la, p in zip(*(other.column(c).to_pylist() for c in (2, 3, 4, 5)))]
                g = Graph.from_parts(x.astype(np.float64), params, kind.name.lower(), mine.column(3).to_pylist(), links, place.get(entry))
                yield _Shard.of(g, ids, x, k, kind).answers(qids, qx, ef)

        part = parts.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("qid").orderBy("dist", "id")
    return top(found, order, k).select("qid", "rank", "id", "dist", "computed")


def _members(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cuts): the rows of each distinct vector, in order of its first row; cuts[c] : cuts[c + 1] are those of c."""
    held = np.ascontiguousarray(x + np.float32(0))  # -0.0 is 0.0
    _, first, which = np.unique(held.view(np.dtype((np.void, held.dtype.itemsize * held.shape[1]))).ravel(), return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    which = place[which]
    rows = np.argsort(which, kind="stable")
    return rows, np.searchsorted(which[rows], np.arange(len(first) + 1))


class _Shard:
    """A shard and its graph.  Equal vectors are one node, with the first one's id: among many copies a beam, and the links
    of a node, would hold nothing else."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, kind: MetricKind, params: GraphParams, passing: np.ndarray | None = None):
        rows, cuts = _members(x)
        self._set(_graph(ids[rows[cuts[:-1]]], x[rows[cuts[:-1]]], params, kind), ids, x, k, kind, rows, cuts, passing)

    @classmethod
    def of(cls, g: Graph, ids: np.ndarray, x: np.ndarray, k: int, kind: MetricKind) -> _Shard:
        """With a graph that is there, whose nodes are the rows."""
        shard = cls.__new__(cls)
        shard._set(g, ids, x, k, kind, np.arange(len(x)), np.arange(len(x) + 1), None)
        return shard

    def _set(self, g: Graph, ids: np.ndarray, x: np.ndarray, k: int, kind: MetricKind, rows: np.ndarray, cuts: np.ndarray, passing: np.ndarray | None) -> None:
        self.g, self.ids, self.x, self.k, self.kind = g, ids, x, k, kind
        of = lambda c: rows[cuts[c] : cuts[c + 1]] if passing is None else (r := rows[cuts[c] : cuts[c + 1]])[passing[r]]
        self.rows = [of(c)[:k].tolist() for c in range(len(cuts) - 1)]  # of equal vectors, the smallest ids come first
        self.passing = None if passing is None else np.array([len(r) > 0 for r in self.rows], bool)
        self.scale = float((x.astype(np.float64) ** 2).sum(1).max(initial=0))

    def slack(self, q: np.ndarray) -> float:
        """By how much distances can differ that are equal once narrowed."""
        own = float((q.astype(np.float64) ** 2).sum())
        return 4e-7 * (own + self.scale if self.kind is MetricKind.L2 else np.sqrt(own * self.scale) + 1)

    def ranked(self, q: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows of some nodes, by the reference kernel's distance and id."""
        rows = [r for c in nodes for r in self.rows[c]]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        dist, ids = distances_np(self.x[rows], q, self.kind), self.ids[rows]
        order = np.lexsort((ids, dist))[: self.k]
        return ids[order], dist[order]

    def answers(self, qids: np.ndarray, qx: np.ndarray, ef: int, repeat: int = 0, complete: bool = False) -> pa.RecordBatch:
        """What a beam finds for each query; with complete, one that is widened while rows are missing from its answer."""
        out: list[tuple] = []
        for at in range(0, len(qids), 1024):
            lot = qx[at : at + 1024]
            exact = best_of(lot, self.ids, self.x, self.k, self.kind) if complete and self.k > 0 else None
            for qid, q in zip(qids[at : at + 1024].tolist(), lot):
                before, began, beam, q64 = self.g.computed, time.perf_counter(), ef, q.astype(np.float64)
                want = next(exact)[1] if exact else None
                while True:
                    ids, dist = self.ranked(q, [c for _, c in self.g.search(q64, self.k, beam, self.passing, self.slack(q))])
                    if want is None or beam >= len(self.rows) or np.array_equal(ids, want):
                        break
                    beam = min(len(self.rows), 2 * max(beam, self.k))
                out += [(ef, qid, i, d, self.g.computed - before, time.perf_counter() - began, repeat) for i, d in zip(ids.tolist(), dist.tolist())]
        return _found(out)

    def widened(self, qids: np.ndarray, qx: np.ndarray, ef: int) -> pa.RecordBatch:
        """What is left of a beam without a filter once rows that don't pass go, widened while fewer than k are."""
        out: list[tuple] = []
        n = len(self.rows)
        for qid, q in zip(qids.tolist(), qx):
            before, beam = self.g.computed, min(n, int(max(ef, self.k) / max(self.passing.mean(), 1 / n)) + 1)
            while True:
                whole = beam >= n  # then the filter may cut before the sort
                near = [c for _, c in self.g.search(q.astype(np.float64), self.k if whole else beam, beam, self.passing if whole else None, self.slack(q)) if self.passing[c]]
                ids, dist = self.ranked(q, near)
                if len(ids) == self.k or whole:
                    break
                beam = min(n, 2 * beam)
            out += [(ef, qid, i, d, self.g.computed - before, 0.0, 0) for i, d in zip(ids.tolist(), dist.tolist())]
        return _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"ef": pa.int32(), "qid": pa.int64(), "id": pa.int64(), "dist": pa.float32(), "computed": pa.int64(), "seconds": pa.float64(), "repeat": pa.int32()}
    return pa.RecordBatch.from_pydict({n: pa.array([r[c] for r in rows], t) for c, (n, t) in enumerate(kinds.items())})


def search(base: DataFrame, queries: DataFrame, k: int, ef: int, params: GraphParams | None = None, metric: str | MetricKind = "l2", shards: int | None = None, complete: bool = False) -> DataFrame:
    """(qid, rank, id, dist, computed): k nearest that beams of max(ef, k) find in all shards, with the reference kernel's
    distances; computed counts the distances computed for the query.

    A graph has at most SHARD_ROWS vectors, so large bases have more shards than asked for.  A beam as wide as its graph is
    exact.  Narrower ones miss some neighbours; with ``complete`` an exact check of each query in each shard (matrix
    products; not counted in computed) says which of them do, and those are doubled until they miss none."""
    return sweep(base, queries, k, [ef], params, metric, shards, complete=complete).select("qid", "rank", "id", "dist", "computed")


def sweep(base: DataFrame, queries: DataFrame, k: int, efs: list[int], params: GraphParams | None = None, metric: str | MetricKind = "l2", shards: int | None = None, repeats: int = 1, warmup: int = 0, complete: bool = False) -> DataFrame:
    """As search for several beams on the same graphs, with the beam as column ef; and repeat, and seconds: what the query
    took in the slowest shard.  Each beam first answers the first ``warmup`` queries without a record of them."""
    params, kind, spark = params or GraphParams(), MetricKind.parse(metric), base.sparkSession
    shards, found = bounded(base, shards), None
    for qids, qx in query_blocks(queries):
        if kind is MetricKind.COSINE:
            qx = normalize_np(qx)
        held = spark.sparkContext.broadcast((qids, qx))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, qx = held.value
            for _, ids, x in _shards(batches, kind):
                shard = _Shard(ids, x, k, kind, params)
                for ef in efs:
                    for q in qx[:warmup]:
                        shard.g.search(q.astype(np.float64), k, ef)
                    for r in range(repeats):
                        yield shard.answers(qids, qx, ef, r, complete)

        part = _sharded(base, shards).mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "ef int, qid long, rank int, id long, dist float, computed long, repeat int, seconds double")
    one = W.partitionBy("ef", "repeat", "qid")  # at most k rows of each shard
    return top(found.withColumn("seconds", F.max("seconds").over(one)), one.orderBy("dist", "id"), k).select("ef", "qid", "rank", "id", "dist", "computed", "repeat", "seconds")


def filtered_search(base: DataFrame, queries: DataFrame, k: int, ef: int, passing: Column | str, mode: str = "in_filter", params: GraphParams | None = None, metric: str | MetricKind = "l2", shards: int | None = None) -> DataFrame:
    """(qid, rank, id, dist, computed): as search, among the rows of base (id, vec, and whatever the filter names) that pass.

    in_filter: beams walk over all nodes and collect those that pass.  post_filter: a beam widened by the share that passes
    in the shard finds neighbours of any kind, and those that don't pass go; widened again, up to the whole shard, where
    fewer than k are left."""
    if mode not in ("in_filter", "post_filter"):
        raise VectorError(f"mode must be in_filter or post_filter, not {mode!r}")
    params, kind, spark = params or GraphParams(), MetricKind.parse(metric), base.sparkSession
    shards = bounded(base, shards)
    condition = F.expr(passing) if isinstance(passing, str) else passing
    rows = _sharded(base, shards, F.coalesce(condition, F.lit(False)).alias("ok"))
    found = None
    for qids, qx in query_blocks(queries):
        held = spark.sparkContext.broadcast((qids, normalize_np(qx) if kind is MetricKind.COSINE else qx))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, qx = held.value
            flags: dict[int, bool] = {}

            def seen() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    flags.update(zip(b.column(1).to_pylist(), b.column(3).to_pylist()))
                    yield b.select([0, 1, 2])

            for _, ids, x in _shards(seen(), kind):
                shard = _Shard(ids, x, k, kind, params, np.array([flags.pop(i) for i in ids.tolist()], bool))
                yield shard.answers(qids, qx, ef) if mode == "in_filter" else shard.widened(qids, qx, ef)

        part = rows.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "qid long, rank int, id long, dist float, computed long")
    order = W.partitionBy("qid").orderBy("dist", "id")
    return top(found, order, k).select("qid", "rank", "id", "dist", "computed")
