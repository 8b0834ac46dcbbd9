"""Helpers shared by the corpus operators: shared storage, Arrow streaming, hashing, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import new_path

#: Rows in one Arrow batch handed to Python.  Bounds a worker's memory when texts are long.
ARROW_ROWS = 1000

#: Seeds of the multiplicative hashes.
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return new_path(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, and have Spark delete shuffle files that nothing refers to."""
    for df in frames:
        path = getattr(df, "_quarry_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    if frames:
        tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark's cleaner deletes shuffle files once the driver's collector finds that nothing refers to them; a long job of
    many steps would else keep those of every step."""
    gc.collect()
    spark._jvm.System.gc()


def _release() -> None:
    """Give back what a worker that lives on has freed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def one_thread() -> None:
    """Have numpy's matrix products use one thread in this process: a task owns a core, and threads that wait for one
    another on it spin (686 against 436 CPU seconds a GB for bounds of string kernels, alone on the machine)."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:  # no such file on this system: the library keeps its own setting
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        yield from fn(batches)
        _release()

    return df.mapInArrow(run, schema)


def crc32_text(ids: DataFrame | object) -> object:
    """crc32 of a column written as decimal text."""
    return F.crc32(F.col(ids).cast("string").cast("binary")) if isinstance(ids, str) else F.crc32(ids.cast("string").cast("binary"))


def crc32_of(value: int) -> int:
    return zlib.crc32(str(value).encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with good avalanche, on uint64 with wrap-around."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd base of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x100000001B3
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts.

    Returns their start, end (byte positions), 64-bit hash of the lower-cased word, and the number of the first word of
    each text (n + 1 entries).  Words never cross texts.
    """
    if not len(raw):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    low = LOWER[raw].astype(np.uint64) + np.uint64(1)
    return starts, ends, hash_spans(low, starts, ends), np.searchsorted(starts, offsets)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span (starts ascending, spans not overlapping).

    Sum of value * BASE**(position in span), then mixed with the length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    n = int(lengths.max())
    if n <= 64:
        order = np.argsort(-lengths, kind="stable")
        s, ls = starts[order], lengths[order]
        acc, pw = np.zeros(len(starts), np.uint64), powers(BASE, n)
        live = len(starts)
        for k in range(n):
            live = int(np.searchsorted(-ls, -k, side="left"))
            acc[:live] += values[s[:live] + k] * pw[k]
        out[order] = acc
    else:
        short = lengths <= 64
        out[short] = hash_spans_raw(values, starts[short], ends[short])
        pw = powers(BASE, n)
        for i in np.flatnonzero(~short):
            out[i] = (values[starts[i] : ends[i]] * pw[: lengths[i]]).sum(dtype=np.uint64)
    return mix64(out + lengths.astype(np.uint64) * MULT)


def hash_spans_raw(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    s, ls = starts[order], lengths[order]
    n = int(ls[0]) if len(ls) else 0
    acc, pw = np.zeros(len(starts), np.uint64), powers(BASE, n)
    for k in range(n):
        live = int(np.searchsorted(-ls, -k, side="left"))
        acc[:live] += values[s[:live] + k] * pw[k]
    out = np.zeros(len(starts), np.uint64)
    out[order] = acc
    return out


def ngram_hashes(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of each text; a shorter, non-empty text is one shingle.  Returns hashes, offsets."""
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    owner = np.repeat(np.arange(len(counts)), grams)
    start = first[:-1][owner] + (np.arange(offsets[-1]) - offsets[:-1][owner])
    width = np.minimum(counts, n)[owner]
    out = np.zeros(len(start), np.uint64)
    pw = powers(0xD6E8FEB86659FD93, n)
    for k in range(n):
        use = width > k
        if use.all():
            out += word_hash[start + k] * pw[k]
        else:
            out[use] += word_hash[start[use] + k] * pw[k]
    return mix64(out + width.astype(np.uint64) * MULT), offsets


class Forest:
    """Union-find on dense ints with path halving; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def unite(forest: Forest, i: np.ndarray, j: np.ndarray, test: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Join the pairs (i[k], j[k]) that pass the test, and give those that brought two trees together.

    Pairs within a tree are left out in bulk, again after every lot, so a group of near copies costs few tests."""
    if not len(i):
        return
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    while len(a):
        root = np.fromiter(map(forest.find, nodes.tolist()), np.int64, len(nodes))
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        for x, y in zip(nodes[a[:256]].tolist(), nodes[b[:256]].tolist()):
            if forest.find(x) != forest.find(y) and (test is None or test(x, y)):
                forest.join(x, y)
                yield x, y
        a, b = a[256:], b[256:]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def likely_split(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among wanted's, rows whose key is not): by a hashed bitmap, so that the second needn't be joined.

    The broadcast bitmap has at most ``bits`` bits (4 MB), however many keys there are; when it fills, more rows are in the
    first.  Null keys are in the second."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    part, pos = F.floor(place / 32768).cast("int"), F.pmod(place, F.lit(32768)).cast("int")
    maps = wanted.where(F.col(key).isNotNull()).select(part.alias("__part"), pos.cast("long").alias("__pos")).groupBy("__part").agg(F.bitmap_construct_agg("__pos").alias("__map"))
    byte = F.conv(F.hex(F.expr("substring(__map, __pos div 8 + 1, 1)")), 16, 10).cast("int")
    marked = rows.withColumn("__part", part).withColumn("__pos", pos).join(F.broadcast(maps), "__part", "left")
    likely = F.coalesce((byte.bitwiseAND(F.expr("shiftleft(1, __pos % 8)")) != 0) & F.col(key).isNotNull(), F.lit(False))
    return marked.where(likely).select(*rows.columns), marked.where(~likely).select(*rows.columns)


def likely_in(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows whose key may be among wanted's (same column name): a semi-join by a hashed bitmap, before a real join."""
    return likely_split(rows, key, wanted, bits)[0]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: columns a, b (long, not null).  Returns node, root: every node that has an edge, and the smallest node it
    can reach.  Minima are partial aggregates, so that a hub is not gathered in one task; each round is written to the
    shared folder.  Raises if it has not settled after ``limit`` rounds (it needs about log2 of the longest path).
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(limit):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: every u points to smaller ones; link them all to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(new)
        same = new.join(cur, ["u", "v"], "left_anti").isEmpty() and cur.join(new, ["u", "v"], "left_anti").isEmpty()
        discard(large, cur)
        cur = new
        if same:
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError("components did not settle")
