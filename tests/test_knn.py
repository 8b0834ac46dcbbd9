import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import kernels, scalars
from quarry.functions.validate import check_shape, require_valid, violations
from quarry.operators import truth, variants
from quarry.operators.knn import distances_to, knn, nearest
from quarry.sources import tables
from quarry.types import VECTORS, MetricKind, VectorError, check_dim


def base(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], VECTORS)


def asked(spark, rows):
    return base(spark, rows).withColumnRenamed("id", "qid")


def ids(df):
    return [r["id"] for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("impl", ["blocks", "hof", "unrolled"])
@pytest.mark.parametrize(
    "metric, rows, query, k, want, dist",
    [
        ("l2", [[1], [2], [3], [4]], [0], 3, [0, 1, 2], [1, 4, 9]),
        ("l2", [[1], [-1], [1], [-1], [1], [-1]], [0], 4, [0, 1, 2, 3], [1, 1, 1, 1]),
        ("dot", [[1, 0], [5, 0], [2, 0]], [1, 0], 3, [1, 2, 0], [-5, -2, -1]),
        ("cosine", [[1, 0], [100, 0], [0, 3]], [7, 0], 3, [0, 1, 2], [0, 0, 1]),
    ],
)
def test_hand_cases(spark, impl, metric, rows, query, k, want, dist):
    got = knn(base(spark, rows), asked(spark, [query]), k, metric, impl).orderBy("rank").collect()
    assert [r["id"] for r in got] == want
    assert [r["dist"] for r in got] == pytest.approx(dist, abs=1e-6)
    assert [r["rank"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_kernels_agree_bit_for_bit(spark, metric):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 33)).astype(np.float32)
    b, q = base(spark, rows).repartition(3), asked(spark, rows[:7])
    got = [sorted(map(tuple, knn(b, q, 9, metric, impl).collect())) for impl in ("blocks", "hof", "unrolled")]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 63


def test_edges_of_k_and_empty_sides(spark):
    b, none = base(spark, [[1, 2]]), base(spark, [])
    assert knn(b, asked(spark, [[1, 1]]), 0).count() == 0
    assert knn(b, asked(spark, []), 3).count() == 0
    assert knn(none, asked(spark, [[1, 1]]), 3).count() == 0
    assert knn(b, asked(spark, [[1, 1]]), 3).count() == 1
    with pytest.raises(Exception, match="dimension"):
        knn(b, asked(spark, [[1, 1, 1]]), 1).collect()
    with pytest.raises(Exception, match="zero or non-finite"):
        knn(base(spark, [[0, 0]]), asked(spark, [[1, 1]]), 1, "cosine").collect()


def test_single_query_and_lookup(spark):
    b = base(spark, [[1], [2], [3], [4]])
    assert [r["id"] for r in nearest(b, [0.0], 2).orderBy("rank").collect()] == [0, 1]
    w = spark.createDataFrame([(0, [0.0], 3), (0, [0.0], 0)], "qid long, vec array<float>, id long")
    assert {r["id"]: r["dist"] for r in distances_to(b, w).collect()} == {3: 16.0, 0: 1.0}
    with pytest.raises(Exception, match="unknown id 9"):
        distances_to(b, w.withColumn("id", F.lit(9).cast("long"))).collect()


def lists(spark, rows):
    return spark.createDataFrame([(q, r, i) for q, row in enumerate(rows) for r, i in enumerate(row)], "qid long, rank int, id long")


def test_agreement(spark):
    r = truth.compare(lists(spark, [[1, 3, 2]]), lists(spark, [[1, 2, 3]])).first()
    assert (r["identical_rows"], r["same_set_rows"], r["identical_positions"], r["is_exact"]) == (0, 1, 1, False)
    assert truth.examples(lists(spark, [[1, 3, 2]]), lists(spark, [[1, 2, 3]])).first()["first_difference"] == 1
    empty = truth.compare(lists(spark, []), lists(spark, [])).first()
    assert empty["row_ratio"] == empty["position_ratio"] == 1.0


def test_equivalence_by_distance(spark):
    q = asked(spark, [[0]])
    swap = truth.distance_equivalence(base(spark, [[-1], [1], [5]]), q, lists(spark, [[1]]), lists(spark, [[0]])).first()
    assert swap["is_equivalent"] and swap["max_relative_gap"] == 0
    real = truth.distance_equivalence(base(spark, [[1], [100]]), q, lists(spark, [[1]]), lists(spark, [[0]])).first()
    assert not real["is_equivalent"] and real["max_relative_gap"] > 0.99


def test_recall_and_ties(spark):
    exact = knn(base(spark, [[1], [-1], [3]]), asked(spark, [[0]]), 2)
    ours = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 9.0)], "qid long, rank int, id long, dist float")
    assert truth.recall(ours, exact, 2).first()["recall"] == 0.5
    assert truth.distance_recall(ours, exact, 1).first()["recall"] == 1.0
    assert truth.meets_target(truth.recall(ours, exact, 2), 0.5).first()["met"]


def test_percentiles_and_median(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert truth.percentiles(v, "x").first().asDict() == {"p50": 5.0, "p95": 10.0, "p99": 10.0}
    assert truth.percentiles(v.where("x < 0"), "x").first()["p50"] == 0.0
    r = truth.median_row(spark.createDataFrame([(1, 4.0), (1, 2.0)], "k int, x double"), "k", "x").first()
    assert (r["median"], r["spread"]) == (4.0, 0.5)


def test_violations(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    found = {(r["kind"], r["id"], r["component"]) for r in violations(df, 2, zero=True).collect()}
    assert found == {("non_finite", 1, 1), ("bad_dimension", 2, None), ("null_vector", 3, None), ("zero_vector", 4, None), ("non_finite", 5, 0)}
    with pytest.raises(VectorError, match="vector 1"):
        require_valid(df, 2)
    assert require_valid(df.where("id = 0"), 2).count() == 1
    with pytest.raises(VectorError):
        check_shape(df, 6, 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4), st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4))
def test_kernel_properties(a, b):
    x, y = np.array([a], np.float32), np.array(b, np.float32)
    d = kernels.distances_np(x, y, MetricKind.L2)[0]
    assert d == kernels.distances_np(y[None], x[0], MetricKind.L2)[0]
    assert kernels.distances_np(x, x[0], MetricKind.L2)[0] == 0
    if np.abs(x).max() > 1e-3:
        assert np.linalg.norm(kernels.normalize_np(x).astype(float)) == pytest.approx(1, abs=1e-6)


def test_levels(spark):
    got = spark.range(40_000).select(kernels.level_of(F.col("id")).alias("l")).groupBy("l").count().collect()
    n = {r["l"]: r["count"] for r in got}
    for level in (1, 2):
        share = sum(c for k, c in n.items() if k >= level) / 40_000
        assert share == pytest.approx(16.0**-level, rel=0.25, abs=3 * (16.0**-level / 40_000) ** 0.5)
    assert spark.range(1).select(kernels.level_of(F.col("id"), 1)).first()[0] == 0


def test_scalars():
    assert scalars.human_bytes(1536) == "1.5 KiB" and scalars.human_bytes(10) == "10 B"
    assert scalars.parse_kb_field("VmRSS:\t  12 kB\n", "VmRSS") == 12288
    assert scalars.parse_kb_field("VmRSS: x", "VmRSS") is None
    assert scalars.align(9) == 16 and scalars.align(16) == 16
    assert scalars.SyncPolicy.parse("every:5").every == 5
    for bad in ("every:0", "sometimes"):
        with pytest.raises(ValueError):
            scalars.SyncPolicy.parse(bad)
    assert MetricKind.parse("angular") is MetricKind.COSINE
    with pytest.raises(VectorError):
        MetricKind.parse("x")
    with pytest.raises(VectorError):
        check_dim(0)


def test_relative_gap(spark):
    r = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "a double, b double").select(kernels.relative_gap(F.col("a"), F.col("b")).alias("g")).collect()
    assert [x["g"] for x in r] == [0.0, 0.5]


def test_filters_tombstones_quantization(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(200, 8)).astype(np.float32)
    b, q = base(spark, rows), asked(spark, rows[:5])
    assert all(r["id"] % 2 == 0 for r in variants.filtered_knn(b, q, 5, "id % 2 = 0").collect())
    assert all(r["id"] >= 100 for r in knn(variants.live(b, b.where("id < 100")), q, 5).collect())
    lows, highs, scale = variants.quantizer(b)
    codes = b.select(variants.quantize(F.col("vec"), lows, highs, scale).alias("c")).collect()
    assert all(0 <= x <= 255 for r in codes for x in r["c"])
    exact, rescored = knn(b, q, 5), variants.quantized_knn(b, q, 5, rescore=8)
    assert truth.recall(rescored, exact, 5).first()["recall"] >= 0.9
    assert (variants.strategy(0.005), variants.strategy(0.3), variants.strategy(0.6)) == ("brute_force", "in_filter", "post_filter")
    assert variants.widened_beam(80, 0.2) == 100


def test_collections_of_rows(spark):
    flat = tables.from_flat(spark, 2, [1, 2, 3, 4])
    assert [tuple(r["vec"]) for r in flat.orderBy("id").collect()] == [(1, 2), (3, 4)]
    with pytest.raises(VectorError):
        tables.from_flat(spark, 2, [1])
    assert tables.first_n(flat, 1).count() == 1
    with pytest.raises(VectorError):
        tables.first_n(flat, 3)
    measured, warm = tables.split_tail(flat, 5)
    assert (measured.count(), warm.count()) == (1, 1)
    n = lists(spark, [[4, 2], [7, 1]])
    assert sorted(map(tuple, tables.from_lists(tables.to_lists(n)).collect())) == sorted(map(tuple, n.collect()))
    with pytest.raises(VectorError):
        tables.load(spark, "nothing")
