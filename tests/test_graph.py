import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, truth
from quarry.operators.graph_index import Graph, GraphParams, select_neighbors
from quarry.operators.hnsw import build, search
from quarry.operators.knn import knn
from quarry.operators.selection import select_neighbors as select_column
from quarry.types import EDGES, NODES, VECTORS

POINTS = np.array([[1, 0], [1.05, 0], [1.1, 0], [0, 1.2]])


def near(points, query):
    return [(float(((p - query) ** 2).sum()), k) for k, p in enumerate(points)]


def between(points):
    return lambda c, chosen: ((points[chosen] - points[c]) ** 2).sum(1)


@pytest.mark.parametrize(
    "m, heuristic, keep, want",
    [(2, True, True, [0, 3]), (2, False, True, [0, 1]), (3, True, True, [0, 3, 1]), (3, True, False, [0, 3])],
)
def test_selection_by_hand(spark, m, heuristic, keep, want):
    assert select_neighbors(near(POINTS, np.zeros(2)), m, between(POINTS), heuristic, keep) == want
    rows = [(d, k, [float(x) for x in POINTS[k]]) for d, k in sorted(near(POINTS, np.zeros(2)))]
    df = spark.createDataFrame([(rows,)], "c array<struct<dist: float, id: long, vec: array<float>>>")
    assert df.select(select_column(F.col("c"), m, "l2", heuristic, keep)).first()[0] == want


def test_selection_of_equal_points():
    same = np.zeros((3, 2))
    query = np.ones(2)
    assert select_neighbors(near(same, query), 3, between(same), True, False) == [0]
    assert select_neighbors(near(same, query), 3, between(same)) == [0, 1, 2]


def path_graph(n):
    g = Graph(np.arange(n, dtype=float)[:, None])
    g.layers = [{k: [x for x in (k - 1, k + 1) if 0 <= x < n] for k in range(n)}]
    g.entry = 0
    return g


def test_beam_on_a_path():
    g = path_graph(12)
    got = g.search_layer(np.array([5.0]), [(25.0, 0)], 3, 0)
    assert got == [(0.0, 5), (1.0, 4), (1.0, 6)]


def test_beam_stays_in_its_component():
    g = Graph(np.array([[0.0], [1.0], [100.0], [101.0]]))
    g.layers, g.entry = [{0: [1], 1: [0], 2: [3], 3: [2]}], 0
    assert [c for _, c in g.search_layer(np.array([100.0]), [(10000.0, 0)], 4, 0)] == [1, 0]


def test_parameters():
    assert GraphParams().max_degree(0) == 32 and GraphParams().max_degree(1) == 16
    for bad in ({"m": 0}, {"m": 513}, {"m": 8, "max_degree0": 4}, {"ef_construction": 0}):
        with pytest.raises(ValueError):
            GraphParams(**bad)
    assert GraphParams(m=1).level_of(3) == 0
    assert Graph(np.zeros((0, 2))).search(np.zeros(2), 3, 10) == []


def data(n=1500, dim=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def test_recall_grows_with_the_beam_and_the_graph_is_sound():
    x = data().astype(float)
    queries = data(40, seed=2).astype(float)
    exact = [set(np.lexsort((np.arange(len(x)), ((x - q) ** 2).sum(1)))[:10]) for q in queries]
    g = Graph(x, GraphParams(m=12, ef_construction=60)).build()
    again = Graph(x, GraphParams(m=12, ef_construction=60)).build()
    assert g.edges() == again.edges()
    recalls = []
    for ef in (10, 30, 100):
        recalls.append(np.mean([len({c for _, c in g.search(q, 10, ef)} & e) / 10 for q, e in zip(queries, exact)]))
    assert recalls == sorted(recalls) and recalls[-1] >= 0.95
    for layer, links in enumerate(g.layers):
        for s, row in links.items():
            assert len(row) <= g.params.max_degree(layer) and s not in row and len(set(row)) == len(row)
            assert all(g.levels[t] >= layer for t in row)
    assert g.computed > 0


def test_clusters_need_the_heuristic():
    rng = np.random.default_rng(9)
    x = np.concatenate([np.full(8, c * 200.0) + rng.random((60, 8)) for c in range(12)])
    queries = np.array([np.full(8, c * 200 + 0.5) for c in range(12)])
    found = {}
    for heuristic in (True, False):
        g = Graph(x, GraphParams(m=6, ef_construction=40, heuristic=heuristic)).build()
        exact = [set(np.argsort(((x - q) ** 2).sum(1), kind="stable")[:5]) for q in queries]
        found[heuristic] = np.mean([len({c for _, c in g.search(q, 5, 60)} & e) / 5 for q, e in zip(queries, exact)])
    assert found[False] <= found[True]


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], VECTORS)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_sharded_search(spark, metric):
    x = data(400)
    b = frame(spark, x)
    q = b.where("id % 40 = 0").withColumnRenamed("id", "qid")
    exact = knn(b, q, 5, metric)
    for shards in (1, 3):
        got = search(b, q, 5, 100, GraphParams(m=12, ef_construction=80), metric, shards)
        assert truth.recall(got, exact, 5).first()["recall"] >= (0.9 if metric != "dot" else 0.6)
    wide = search(b, q, 5, 400, GraphParams(m=16, ef_construction=120), "l2", 1).drop("computed")
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, knn(b, q, 5).collect()))
    assert search(b.where("id < 0"), q, 5, 10, shards=1).count() == 0


def test_built_tables_have_no_violation(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes, edges, meta = build(frame(spark, data(300)), GraphParams(m=4, ef_construction=30), shards=1)
    entry = meta.first()["entry"]
    assert graph.violations(nodes, edges, entry, m=4).count() == 0
    assert graph.unreached(nodes, edges, entry).count() == 0
    stats = graph.layer_stats(nodes, edges, m=4).orderBy("layer").collect()
    assert stats[0]["nodes"] == 300 and stats[0]["max_degree"] <= 8 and stats[0]["bytes"] == 300 * 9 * 4
    assert graph.total_stats(graph.layer_stats(nodes, edges, m=4)).first()["nodes"] == 300


def test_saved_graphs_answer_alike(spark, tmp_path):
    from quarry.operators.hnsw import load, save, search_built
    from quarry.plans.sweep import recall_sweep, round_trip

    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    b = frame(spark, data(300))
    q = b.where("id % 30 = 0").withColumnRenamed("id", "qid")
    params = GraphParams(m=8, ef_construction=40)
    assert round_trip(b, q, f"file://{tmp_path}/g", 5, 50, params=params, shards=2).count() == 0
    built = load(spark, f"file://{tmp_path}/g")
    fresh = search(b, q, 5, 50, params, "l2", 2)
    assert sorted(map(tuple, search_built(b, built, q, 5, 50).collect())) == sorted(map(tuple, fresh.collect()))
    with pytest.raises(Exception, match="vectors"):
        search_built(b.where("id > 5"), built, q, 5, 50).collect()
    nodes, edges, meta = built
    save((nodes, edges.withColumn("dst", F.col("dst") + 1000), meta), f"file://{tmp_path}/h")
    with pytest.raises(Exception, match="leaves layer"):
        search_built(b, load(spark, f"file://{tmp_path}/h"), q, 5, 50).collect()
    sweep = recall_sweep(b, q, 5, (5, 100), params=params).orderBy("ef").collect()
    assert sweep[0]["recall"] <= sweep[1]["recall"] and sweep[1]["distance_recall"] >= sweep[1]["recall"]


@pytest.mark.parametrize(
    "levels, edges, entry, what",
    [([0], [], 0, "levels"), ([0, 0], [], None, "entry"), ([0, 1], [], 0, "top"), ([0, 0], [(0, 0, 0, 5)], 0, "leaves"), ([0, 0], [(0, 0, 1, 1)], 0, "place"), ([0, 99], [], 1, "level")],
)
def test_parts_must_fit(levels, edges, entry, what):
    with pytest.raises(ValueError, match=what):
        Graph.from_parts(np.zeros((2, 2)), GraphParams(), "l2", levels, edges, entry)


def test_each_violation(spark):
    nodes = spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 0)], NODES)
    edges = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 0, 1), (0, 1, 1, 9), (1, 0, 0, 1), (1, 1, 0, 0), (0, 2, 0, 0), (0, 2, 1, 1), (0, 2, 2, 3)], EDGES)
    kinds = {r["kind"] for r in graph.violations(nodes, edges, 1, m=1).collect()}
    assert kinds == {"DegreeAboveCap", "DuplicateNeighbor", "SelfLoop", "NeighborOutOfRange", "NeighborNotOnLayer", "LevelMismatch", "IsolatedOnLayerZero", "EntryPointBelowTop"}
    kinds = {r["kind"] for r in graph.violations(nodes, edges, None, m=1).collect()}
    assert "MissingEntryPoint" in kinds
    none = spark.createDataFrame([], NODES)
    assert graph.violations(none, edges.where("src < 0"), None).count() == 0
    assert graph.total_stats(graph.layer_stats(none, edges.where("src < 0"))).first()["asymmetry_ratio"] == 0.0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with embeddings that graphs find hard: no clusters, and one vector with 300 copies."""
    x = data(3000, 64, seed=5)
    x[700:1000] = x[700]
    path = str(tmp_path_factory.mktemp("many"))
    frame(spark, x).selectExpr("id AS vec_id", "vec AS embedding", "CAST(id % 10 AS INT) AS label").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_recall_floor_holds_for_each_query(spark, many):
    from quarry import queries

    assert sorted(map(tuple, queries.QUERIES["hnsw_recall_floor"](spark, many).collect())) == [(q, True) for q in range(0, 3000, 50)]


def test_complete_search_has_every_neighbour(spark):
    x = data(500, 16)
    x[200:300] = x[200]
    b = frame(spark, x)
    q = b.where("id % 25 = 0").withColumnRenamed("id", "qid")
    for metric in ("l2", "cosine", "dot"):
        got = search(b, q, 5, 1, GraphParams(m=2, ef_construction=4), metric, 2, complete=True).drop("computed")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn(b, q, 5, metric).collect()))


def test_search_query_finds_most_of_each_querys_neighbours(spark, many):
    from quarry import queries

    assert sorted(map(tuple, queries.QUERIES["hnsw_search_recall"](spark, many).collect())) == [(q, True) for q in range(0, 3000, 50)]


def test_a_beam_as_wide_as_the_graph_holds_every_node():
    g = Graph(np.array([[0.0], [1.0], [100.0], [101.0]]))
    g.levels, g.layers, g.entry = [0] * 4, [{0: [1], 1: [0], 2: [3], 3: [2]}], 0
    assert [c for _, c in g.search(np.array([100.0]), 3, 4)] == [2, 3, 1]
    assert [c for _, c in g.search(np.array([100.0]), 3, 4, np.array([True, True, False, True]))] == [3, 1, 0]


def test_a_wide_beam_equals_the_beam_by_heap():
    x = data(600).astype(float)
    g = Graph(x, GraphParams(m=8, ef_construction=40)).build()
    for q in data(10, seed=3).astype(float):
        before = g.computed
        wide = g.search(q, 20, 600)
        between, start = g.computed, [(float(g.distances(q, [g.entry])[0]), g.entry)]
        for layer in range(len(g.layers) - 1, 0, -1):
            start = g.search_layer(q, start, 1, layer)
        assert wide == g.search_layer(q, start, 600, 0)[:20] and between - before == g.computed - between


def test_graphs_are_bounded_whatever_shards_are_asked_for(spark, monkeypatch):
    from quarry.operators import hnsw

    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    x = data(350)
    b = frame(spark, x)
    q = b.where("id % 50 = 0").withColumnRenamed("id", "qid")
    got = search(b, q, 5, 350, GraphParams(m=8, ef_construction=40), shards=1)
    assert hnsw.bounded(b, 1) == 4 and hnsw.bounded(b, 9) == 9
    assert sorted(map(tuple, got.drop("computed").collect())) == sorted(map(tuple, knn(b, q, 5).collect()))


@pytest.mark.parametrize("mode", ["in_filter", "post_filter"])
def test_filtered_whole_beams_are_exact_on_bounded_graphs(spark, monkeypatch, mode):
    from quarry.operators import hnsw

    asked, sharded = [], hnsw._sharded
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    monkeypatch.setattr(hnsw, "_sharded", lambda base, shards, *more: asked.append(shards) or sharded(base, shards, *more))
    x = data(350)
    x[100:180] = x[100]
    b = frame(spark, x)
    q = b.where("id % 50 = 0").withColumnRenamed("id", "qid")
    got = hnsw.filtered_search(b, q, 5, 350, "id % 3 = 1", mode, GraphParams(m=8, ef_construction=40), shards=2)
    assert sorted(map(tuple, got.drop("computed").collect())) == sorted(map(tuple, knn(b.where("id % 3 = 1"), q, 5).collect()))
    assert asked == [4]
