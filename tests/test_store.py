import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources.vecs import record_shape, register, write_vecs
from quarry.streaming import log as wal
from quarry.streaming.collection import Collection
from quarry.types import VectorError


def rows(spark, ids, dim=4):
    return spark.createDataFrame([(i, [float(i * 3 + k) for k in range(dim)]) for i in ids], "ext_id long, vec array<float>")


def log(spark, seqs):
    df = spark.createDataFrame([(s, "insert", s * 10, 0, [float(s)], None, None) for s in seqs], "seq long, op string, ext_id long, level int, vec array<float>, metadata binary, snapshot_seq long")
    return df.withColumn("crc", wal.checksum())


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_any_damaged_record_ends_the_prefix(spark):
    whole = log(spark, range(1, 11)).cache()
    assert seqs(wal.valid_prefix(whole)) == list(range(1, 11))
    for bad in range(1, 11):
        hurt = whole.withColumn("crc", F.when(F.col("seq") == bad, F.col("crc") + 1).otherwise(F.col("crc")))
        assert seqs(wal.valid_prefix(hurt)) == list(range(1, bad))
        end = wal.first_bad(whole.where(F.col("seq") != bad)).first()["end_seq"]
        assert end == (None if bad in (1, 10) else bad + 1)


def test_gap_missing_and_split(spark):
    r = wal.first_bad(log(spark, [1, 2, 3, 5, 6])).first()
    assert (r["first_seq"], r["gap_seq"], r["torn_seq"]) == (1, 5, None)
    s = wal.replay_split(log(spark, range(1, 9)), 5).first()
    assert (s["skipped"], s["replayed"], s["next_seq"]) == (5, 3, 9)
    with pytest.raises(VectorError, match="5 to 9"):
        wal.require_intact(log(spark, range(10, 12)), 4)
    unknown = log(spark, [1, 2]).withColumn("op", F.lit("rename")).drop("crc").withColumn("crc", wal.checksum())
    with pytest.raises(VectorError, match="not understood"):
        wal.require_intact(unknown, 0)
    empty = wal.replay_split(log(spark, []), 7).first()
    assert (empty["replayed"], empty["next_seq"]) == (0, 8)


def test_collection_life(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection.create(spark, root, 4)
    with pytest.raises(VectorError, match="exists"):
        Collection.create(spark, root, 4)
    assert c.insert(rows(spark, range(5)), "a") == 5
    assert c.insert(rows(spark, range(5)), "a") == 0
    before = sorted(map(str, c.vectors().collect()))
    c.checkpoint()
    c = Collection(spark, root)
    assert sorted(map(str, c.vectors().collect())) == before
    assert c.recovery()["next_seq"] == 6
    c.insert(rows(spark, range(5, 8)), "b")
    assert c.delete(spark.createDataFrame([(0,), (6,)], "ext_id long")) == 2
    assert sorted(r["ext_id"] for r in Collection(spark, root).vectors().collect()) == [1, 2, 3, 4, 5, 7]
    assert Collection(spark, root).recovery()["replayed"] == 5


@pytest.mark.parametrize("bad", [[(9, [1.0, 2.0])], [(9, [1.0, 2.0, 3.0, float("inf")])], [(9, None)], [(None, [1.0, 2.0, 3.0, 4.0])], [(9, [1.0] * 4), (9, [2.0] * 4)], [(1, [1.0] * 4)]])
def test_nothing_bad_is_logged(spark, tmp_path, bad):
    c = Collection.create(spark, f"file://{tmp_path}/c", 4)
    c.insert(rows(spark, [1]))
    with pytest.raises(VectorError):
        c.insert(spark.createDataFrame(bad, "ext_id long, vec array<float>"))
    assert Collection(spark, f"file://{tmp_path}/c").vectors().count() == 1


def test_unfinished_and_torn_batches(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection.create(spark, root, 4)
    c.insert(rows(spark, range(3)), "a")
    (tmp_path / "c/log/v=0/batch=00000001-dead").mkdir()  # a writer was killed
    c = Collection(spark, root)
    assert c.vectors().count() == 3
    torn = c.log().withColumn("seq", F.col("seq") + 3).withColumn("ext_id", F.col("ext_id") + 3)
    torn.write.mode("overwrite").parquet(f"{root}/log/v=0/batch=00000002-torn")  # its checksums don't hold
    assert Collection(spark, root, repair=False).vectors().count() == 3
    assert Collection(spark, root, repair=False).repair() == 3
    c = Collection(spark, root)
    assert c.dropped == 0
    c.insert(rows(spark, range(3, 6)), "b")
    assert sorted(r["ext_id"] for r in c.vectors().collect()) == list(range(6))


def test_open_repairs_a_torn_log_before_writing(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection.create(spark, root, 4)
    c.insert(rows(spark, range(4)), "a")
    half = c.log().withColumn("crc", F.when(F.col("seq") >= 3, F.col("crc") + 1).otherwise(F.col("crc"))).collect()
    log_of = f"{root}/log/v=0/batch=00000000-a"
    spark.createDataFrame(half, wal.LOG).coalesce(1).write.mode("overwrite").parquet(log_of)
    c = Collection(spark, root)
    assert c.dropped == 2 and c.vectors().count() == 2
    assert c.insert(rows(spark, range(10, 13)), "b") == 3
    assert c.insert(rows(spark, range(4)), "a") == 2 and c.insert(rows(spark, range(4)), "a") == 0  # what was cut off
    assert sorted(r["ext_id"] for r in Collection(spark, root).vectors().collect()) == [0, 1, 2, 3, 10, 11, 12]


def test_a_truncated_file_ends_the_log(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection.create(spark, root, 4, sync="every:2")
    c.insert(rows(spark, range(3)), "a")
    c.insert(rows(spark, range(3, 6)), "b")
    for file in (tmp_path / "c/log/v=0/batch=00000001-b").glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:40])
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    c = Collection(spark, root)
    assert c.dropped == 1 and c.vectors().count() == 3
    assert c.insert(rows(spark, range(3, 6)), "b") == 3 and Collection(spark, root).vectors().count() == 6


def test_batches_stay_known_and_snapshots_are_verified(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection.create(spark, root, 4, sync="never")
    c.insert(rows(spark, range(5)).withColumn("metadata", F.lit(b"m")), "a")
    assert c.delete(spark.createDataFrame([(0,)], "ext_id long"), "d") == 1
    c.checkpoint()
    c = Collection(spark, root)
    assert c.insert(rows(spark, range(5)), "a") == 0 == c.delete(spark.createDataFrame([(1,)], "ext_id long"), "d")
    assert c.verify() == 4 and {bytes(r["metadata"]) for r in c.vectors().collect()} == {b"m"}
    c.snapshot().withColumn("level", F.lit(7)).collect()
    hurt = spark.createDataFrame(c.snapshot().withColumn("level", F.lit(7)).collect(), c.snapshot().schema)
    hurt.write.mode("overwrite").parquet(f"{root}/snapshot/v=1")
    with pytest.raises(VectorError, match="checksum"):
        Collection(spark, root).verify()


def test_split_of_one_row(spark):
    from quarry.sources.tables import split_tail

    one = spark.createDataFrame([(0, [1.0])], "id long, vec array<float>")
    measured, warm = split_tail(one, 5)
    assert (measured.count(), warm.count()) == (1, 0)
    assert [x.count() for x in split_tail(one.where("id < 0"), 5)] == [0, 0]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quarry.sources.shared import shared_root

    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    with pytest.raises(ValueError, match="share"):
        shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_stream_is_idempotent(spark, tmp_path):
    rows(spark, range(6)).write.parquet(f"{tmp_path}/in")
    c = Collection.create(spark, f"file://{tmp_path}/c", 4)
    stream = spark.readStream.schema("ext_id long, vec array<float>").parquet(f"{tmp_path}/in")
    for place in ("one", "two"):  # a lost checkpoint offers the same batch again
        c.ingest(stream, f"{tmp_path}/{place}").awaitTermination(120)
    assert c.vectors().count() == 6


def test_vector_files(spark, tmp_path):
    register(spark)
    path = f"{tmp_path}/x.fvecs"
    df = spark.createDataFrame([(k, [float(k), float(-k)]) for k in range(50)], "id long, vec array<float>")
    write_vecs(df, path)
    assert record_shape(path) == (50, 2)
    assert sorted(map(str, spark.read.format("fvecs").load(path).collect())) == sorted(map(str, df.collect()))
    ints = spark.createDataFrame([(0, [1, 2, 3])], "id long, vec array<int>")
    write_vecs(ints, f"{tmp_path}/x.ivecs", "ivecs")
    assert spark.read.format("ivecs").load(f"{tmp_path}/x.ivecs").first()["vec"] == [1, 2, 3]


def record(*values, dim=None):
    return np.uint32(len(values) if dim is None else dim).tobytes() + np.array(values, "<f4").tobytes()


@pytest.mark.parametrize("raw", [b"\x01", record(1, 2)[:-1], record(1, 2) + record(1, dim=1) + b"\0" * 4, record(1, float("nan")), record(dim=0), record(1, 2) + record(1, 2, dim=3)])
def test_malformed_files(spark, tmp_path, raw):
    register(spark)
    (tmp_path / "bad.fvecs").write_bytes(raw)
    with pytest.raises(Exception):
        spark.read.format("fvecs").load(f"{tmp_path}/bad.fvecs").collect()
    with pytest.raises(VectorError):
        record_shape(f"{tmp_path}/none.fvecs")
