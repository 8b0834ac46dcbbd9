"""Embedding near-dedup: a small-world graph for every shard, queried by every vector of the same label.

Equal vectors of a label are one node with a count, so a hot vector costs as much as any other.  Shards split the nodes of
each label by a hash.  The task of a shard builds its graph, audits it against brute force on a spread sample of its own and
other shards' nodes and widens the beam until the audit passes (past the shard's size it scans); what it built is written.
Then the nodes of the label, in lots, are answered by tasks of one lot and one graph each, so a hot label is many tasks; a
beam whose worst result is still similar enough is widened until it isn't.  Cosines are verified in double precision from
the vectors as given.  What a task finds leaves it as counts and one forest, never as pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Forest, components, discard, map_batches, materialize, table
from quarry.operators.graph_index import Graph, GraphParams

THRESHOLD = 0.93
#: Nodes of one shard, of one block of queries, and blocks that one task answers.
SHARD_ROWS, QUERY_ROWS, LOT_BLOCKS = 4096, 512, 8
PARAMS = GraphParams(m=12, ef_construction=48)
FIRST_BEAM, AUDIT_ROWS, AUDIT_RECALL = 24, 48, 0.99
#: Vectors of each block of another shard that the audit asks.
AUDIT_OTHERS = 2


def cosines(x: np.ndarray, norm: np.ndarray, rows: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    return (x[rows] * q).sum(1) / (norm[rows] * q_norm)


class Shard:
    """The graph of one shard, with a beam that passed its audit.  Equal vectors are one node, named by the first id, with
    the count of what they stand for.  ``others`` are vectors of other shards that the audit asks too."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, threshold: float, others: np.ndarray | None = None, counts: np.ndarray | None = None):
        _, first, inverse = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.count = np.bincount(place[inverse.reshape(-1)], counts, len(first)).astype(np.int64)
        ids, x = ids[first[order]], x[first[order]]
        self.ids, self.x, self.threshold = ids, x, threshold
        self.norm = np.sqrt((x * x).sum(1))
        self.graph = Graph(x / self.norm[:, None], PARAMS, "cosine").build(ids.tolist())
        self.beam, self.recall = FIRST_BEAM, 0.0
        self.scan = False
        self.audit(x[:0] if others is None else others)

    def exact(self, q: np.ndarray, q_norm: float) -> np.ndarray:
        return np.flatnonzero((self.x * q).sum(1) / (self.norm * q_norm) >= self.threshold)

    def audit(self, others: np.ndarray) -> None:
        """Widen the first beam until the links of each sampled vector are found, or scan.  recall is that of the worst."""
        sample = self.x[np.unique(np.linspace(0, len(self.ids) - 1, AUDIT_ROWS).astype(int))]
        sample = np.concatenate([sample, others]) if len(others) else sample
        norm = np.sqrt((sample * sample).sum(1))
        wanted = [self.exact(q, qn) for q, qn in zip(sample, norm)]
        while True:
            self.recall = 1.0
            for q, qn, want in zip(sample, norm, wanted):
                if len(want):
                    self.recall = min(self.recall, len(np.intersect1d(want, self.find(q, qn))) / len(want))
                if self.recall < AUDIT_RECALL:
                    break
            if self.recall >= AUDIT_RECALL or self.scan:
                return
            self.beam *= 2
            self.scan = self.beam >= len(self.ids)

    def find(self, q: np.ndarray, q_norm: float) -> np.ndarray:
        """Nodes that link with q."""
        if self.scan:
            return self.exact(q, q_norm)
        beam, unit = self.beam, q / q_norm
        while True:
            got = self.graph.search(unit, beam, beam)
            if len(got) < beam or 1 - got[-1][0] < self.threshold - 1e-9:
                break  # beyond its links the beam saw what isn't one
            if beam >= len(self.ids):
                break
            beam *= 4
        rows = np.array([c for d, c in got if 1 - d >= self.threshold - 1e-9], np.int64)
        return rows[cosines(self.x, self.norm, rows, q, q_norm) >= self.threshold] if len(rows) else rows


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"], np.float32).reshape(len(ids), -1).astype(np.float64), np.frombuffer(row["n"], np.int64)


def _build(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind: blocks of the shard itself (kind 0), some vectors of each block of its family for the
    audit (kind 1).  Gives one row a shard with its graph."""
    key, own, others = None, [], []

    def whole() -> pa.RecordBatch:
        ids, x, n = (np.concatenate([v[c] for v in own]) for c in range(3))
        order = np.argsort(ids, kind="stable")
        shard = Shard(ids[order], x[order], threshold, np.concatenate(others) if others else None, n[order])
        return pa.RecordBatch.from_pydict({"shard": pa.array([key]), "graph": pa.array([pickle.dumps(shard)], pa.binary()), "beam": pa.array([len(ids) if shard.scan else shard.beam], pa.int32()), "recall": pa.array([shard.recall])})

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != key:
                if own:
                    yield whole()
                key, own, others = row["shard"], [], []
            if row["kind"] == 0:
                own.append(_vectors(row))
            else:
                others.append(_vectors(row)[1])
    if own:
        yield whole()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by job and kind: the graph of the job's shard (kind 0), then blocks of queries (kind 1).  Gives the links
    of each query, counted in rows, and the edges of a spanning forest of each job."""
    job, shard, nodes = None, None, {}
    forest, edges = Forest(0), []
    for batch in batches:
        for row in batch.to_pylist():
            if row["job"] != job:
                if edges:
                    yield _edges(edges)
                job, shard, edges = row["job"], pickle.loads(row["x"]), []
                nodes = {v: k for k, v in enumerate(shard.ids.tolist())}
                forest = Forest(len(nodes))
                names = shard.ids.tolist()
                continue
            ids, x, _ = _vectors(row)
            links = []
            for v, q, qn in zip(ids.tolist(), x, np.sqrt((x * x).sum(1))):
                hits = shard.find(q, qn)
                at = nodes.get(v)
                if at is not None and at < len(names) and at not in hits and cosines(shard.x, shard.norm, np.array([at]), q, qn)[0] >= shard.threshold:
                    hits = np.append(hits, at)
                links.append(int(shard.count[hits].sum()))
                for h in hits.tolist():
                    if at is None:  # of another shard: a node of the forest once it has a link
                        at = nodes[v] = len(forest.up)
                        forest.up.append(at)
                    if forest.join(at, h):
                        edges.append((v, names[h]))
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[some]), "links": pa.array(np.array(links)[some], pa.int64()), "b": pa.nulls(len(some), pa.int64())})
    if edges:
        yield _edges(edges)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in pairs], pa.int64()), "links": pa.array([0] * len(pairs), pa.int64()), "b": pa.array([e[1] for e in pairs], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept, and beam and recall of the shard that holds it (recall of the worst vector that
    its audit asked), of every row: links are pairs of one label, and of one dimension, with cosine >= threshold.

    Vectors with a null id or label, and those that are null, empty, zero or hold null or non-finite components, link with
    nothing.  Rows that repeat an id are one vector, the least by components, and share its result.  Other columns are
    ignored; an empty table gives no row.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    fine = rows.where("id is not null and label is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(v, x -> x <> 0)")
    fine = fine.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v", F.size("r.v").alias("dim"))
    fine = materialize(fine)
    nodes = materialize(fine.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")))
    counts = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards"))
    placed = nodes.join(counts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("shards")))
    # blocks of rows, so that a vector isn't a row in each shuffle
    tagged = placed.select(F.xxhash64("label", "dim").alias("family"), "shards", "own", "id", "v", "n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list, list]] = {}

        def block(key: tuple, got: tuple[list, list, list]) -> dict:
            return {"family": key[0], "shards": key[1], "own": key[2], "ids": np.array(got[0], np.int64).tobytes(), "x": np.concatenate(got[1]).tobytes(), "n": np.array(got[2], np.int64).tobytes()}

        schema = pa.schema([("family", pa.int64()), ("shards", pa.int64()), ("own", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            values = batch.column(4)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            off = np.asarray(values.offsets) - np.asarray(values.offsets)[0]
            full = []
            for k, (f, s, o, i, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)))):
                got = held.setdefault((f, s, o), ([], [], []))
                got[0].append(i)
                got[2].append(n)
                got[1].append(flat[off[k] : off[k + 1]])
                if len(got[0]) >= QUERY_ROWS:
                    full.append(block((f, s, o), held.pop((f, s, o))))
            if full:
                yield pa.RecordBatch.from_pylist(full, schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(k, g) for k, g in held.items()], schema)

    blocks = materialize(map_batches(tagged, pack, "family long, shards long, own long, ids binary, x binary, n binary"))
    name = lambda part: F.concat_ws("/", "family", part)
    asked = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("part")).withColumn("shard", name(F.col("part")))
    base = blocks.select(name(F.col("own")).alias("shard"), F.lit(0).alias("kind"), "ids", "x", "n")
    few = F.expr(f"substring(ids, 1, {8 * AUDIT_OTHERS})"), F.expr(f"substring(x, 1, cast({AUDIT_OTHERS} * (8 * length(x) div length(ids)) as int))"), F.expr(f"substring(n, 1, {8 * AUDIT_OTHERS})")
    some = asked.where("part <> own").select("shard", F.lit(1).alias("kind"), few[0].alias("ids"), few[1].alias("x"), few[2].alias("n"))
    spread = base.unionByName(some).repartition("shard").sortWithinPartitions("shard", "kind")
    graphs = materialize(map_batches(spread, lambda b: _build(b, threshold), "shard string, graph binary, beam int, recall double"))
    # a job: the graph of one shard and a lot of the blocks of its family
    lots = blocks.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / LOT_BLOCKS).cast("int").alias("lots"))
    job = F.concat_ws("#", "shard", "lot").alias("job")
    none = F.lit(None).cast("binary")
    held = graphs.withColumn("family", F.substring_index("shard", "/", 1).cast("long")).join(lots, "family").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    queries = asked.join(lots, "family").withColumn("lot", F.pmod(F.xxhash64("ids"), F.col("lots")).cast("int"))
    jobs = held.select(job, F.lit(0).alias("kind"), none.alias("ids"), F.col("graph").alias("x"), none.alias("n")).unionByName(queries.select(job, F.lit(1).alias("kind"), "ids", "x", "n"))
    jobs = jobs.repartition("job").sortWithinPartitions("job", "kind")
    found = materialize(map_batches(jobs, _search, "a long, links long, b long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("n"))
    whole = components(found.where("b is not null").select("a", "b"))
    seen = tagged.select("id", name(F.col("own")).alias("shard")).join(F.broadcast(graphs.select("shard", "beam", "recall")), "shard").drop("shard")  # one row a shard
    result = nodes.select("id", F.col("n").alias("copies")).join(links.withColumnRenamed("a", "id"), "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left").join(seen, "id")
    # a node links with itself; the root of a node is the least of its component, and its id the least of its rows
    result = materialize(result.select("id", (F.coalesce("n", "copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"), "beam", "recall"))
    twins = nodes.where("n > 1").select("label", "v", F.col("id").alias("rep"))
    members = fine.join(twins, ["label", "v"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    answers = members.join(result.withColumnRenamed("id", "rep"), "rep").select("id", "n", "root", "beam", "recall")
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(answers, "id", "left")
    component = F.coalesce("root", "id")
    out = materialize(out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "beam", "recall"))
    discard(fine, nodes, blocks, graphs, found, result)
    return out


def op4_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_graph_dedup": op4_graph_dedup}
ORACLES: dict[str, str] = {}
