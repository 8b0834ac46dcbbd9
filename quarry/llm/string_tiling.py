"""Benchmark decontamination by greedy string tiling with running Karp-Rabin fingerprints.

Rolling fingerprints of min_tile words of the benchmark are the seeds; a document's rolling fingerprints are looked up in
them.  Seeds side by side on a diagonal (same shift between document and item) make the maximal matches.  Greedily the
longest match is marked in both, what overlaps it is cut back, and so on while min_tile words are left.  Tiles may stand
in any order in the document, so that reordered passages count; an item is leaked where its tiles cover the threshold.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import map_batches, ngram_hashes, table, utf8, words_of

MIN_TILE, COVERAGE = 5, 0.8
#: Bytes of benchmark text that one pass over the documents looks for.  More items mean more passes, never fewer items.
BLOCK_BYTES = 32 << 20
#: Pairs of equal seeds of a text and an item that are listed; with more, each longest match is looked for anew.
MAX_PAIRS = 50_000
#: Base of the running fingerprints: odd, so that it has an inverse.
BASE = 0xD6E8FEB86659FD93


@dataclass
class Items:
    """A block of benchmark items, indexed by their seeds."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    seed_item: np.ndarray
    seed_place: np.ndarray
    lengths: list[int]  # seed lengths in use: min_tile, and those of shorter items

    @staticmethod
    def build(rows: list[tuple[int, str]], min_tile: int) -> Items:
        rows = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        raw, offsets = utf8(pa.array([r[1] for r in rows], pa.string()))
        _, _, hashes, first = words_of(raw, offsets)
        words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        grams, at = ngram_hashes(hashes, first, min_tile)
        item = np.repeat(np.arange(len(rows)), np.diff(at))
        place = np.arange(len(grams)) - at[:-1][item]
        order = np.argsort(grams, kind="stable")
        lengths = sorted({min(len(w), min_tile) for w in words if len(w)})
        return Items([r[0] for r in rows], words, grams[order], item[order], place[order], lengths)


def tiles_of(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """(length, item start, document start) of the greedy tiles; seeds: (item place, document place) of equal windows."""
    heap: list[tuple[int, int, int]] = []
    diagonal: dict[int, list[int]] = defaultdict(list)
    for i, d in seeds:
        if np.array_equal(item[i : i + width], doc[d : d + width]):
            diagonal[d - i].append(i)
    for shift, places in diagonal.items():
        places = sorted(set(places))
        begin = last = places[0]
        for i in [*places[1:], None]:
            if i is None or i != last + 1:
                heap.append((-(last - begin + width), begin, begin + shift))
                begin = i
            last = i
    heapq.heapify(heap)
    in_item, in_doc, out = set(), set(), []
    while heap:
        length, i, d = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if i + k not in in_item and d + k not in in_doc]
        if len(free) == length:
            in_item.update(range(i, i + length))
            in_doc.update(range(d, d + length))
            out.append((length, i, d))
            continue
        begin = 0
        while begin < len(free):  # what is left of it goes back, if long enough
            end = begin
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - begin + 1 >= width:
                heapq.heappush(heap, (-(end - begin + 1), i + free[begin], d + free[begin]))
            begin = end + 1
    return out


def tiles_by_search(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """tiles_of() without a list of seeds, for texts that repeat themselves: the longest free match is found by bisection
    of its length, with the running fingerprints of all free windows of that length, until width words match no more.

    Takes memory in proportion to the words, and time in proportion to them for each tile and step."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    up, down = (np.cumprod(np.full(max(len(item), len(doc)) + 1, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    running = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])]) for words in (item, doc)]

    def windows(sums: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the windows of n free words, and where they begin."""
        if len(free) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return (sums[at + n] - sums[at]) * down[at], at

    def match(n: int) -> tuple[int, int] | None:
        """The first place in the item, and its first in the document, of n words that match."""
        (a, i), (b, d) = windows(running[0], free_item, n), windows(running[1], free_doc, n)
        common = np.flatnonzero(np.isin(a, b))
        for k in common.tolist():
            for at in d[b == a[k]].tolist():
                if np.array_equal(item[i[k] : i[k] + n], doc[at : at + n]):
                    return int(i[k]), at
        return None

    while best := match(width):
        low, high = width, min(len(item), len(doc))  # words of the longest match: at least, at most
        while low < high:
            middle = (low + high + 1) // 2
            if found := match(middle):
                low, best = middle, found
            else:
                high = middle - 1
        i, d = best
        free_item[i : i + low] = free_doc[d : d + low] = False
        out.append((low, i, d))
    return out


def leaks(items: Items, column: pa.Array, min_tile: int, coverage: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
    """(row, item number, words covered, words, tiles) of every leaked item of a batch of texts; tiles hold byte spans."""
    raw, offsets = utf8(column)
    starts, ends, hashes, first = words_of(raw, offsets)
    found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)  # item place, document places of a seed
    for n in items.lengths:
        if len(hashes) < n:
            continue
        counts = np.diff(first)
        grams, at = ngram_hashes(hashes, first, n)
        low = np.searchsorted(items.seeds, grams, side="left")
        hit = np.flatnonzero(items.seeds[np.minimum(low, len(items.seeds) - 1)] == grams)
        rows = np.searchsorted(at, hit, side="right") - 1
        use = counts[rows] >= n
        hit, rows = hit[use], rows[use]
        order = np.lexsort((hit, low[hit], rows))  # equal windows of a text together
        hit, rows = hit[order], rows[order]
        cuts = np.flatnonzero((rows[1:] != rows[:-1]) | (low[hit[1:]] != low[hit[:-1]])) + 1
        for group in np.split(hit, cuts) if len(hit) else ():
            row, k = int(np.searchsorted(at, group[0], side="right") - 1), int(low[group[0]])
            gram, places = grams[group[0]], group - at[row]
            while k < len(items.seeds) and items.seeds[k] == gram:
                number = int(items.seed_item[k])
                if min(len(items.words[number]), min_tile) == n:
                    found[(row, number)].append((int(items.seed_place[k]), places))
                k += 1
    for (row, number), seeds in sorted(found.items()):
        item = items.words[number]
        width = min(len(item), min_tile)
        possible = np.zeros(len(item) + 1, np.int64)  # no tile covers more than the seeds do
        for i in {i for i, _ in seeds}:
            possible[i] += 1
            possible[i + width] -= 1
        if (np.cumsum(possible)[:-1] > 0).sum() < coverage * len(item):
            continue
        doc = hashes[first[row] : first[row + 1]]
        if sum(len(p) for _, p in seeds) <= MAX_PAIRS:
            tiles = tiles_of(item, doc, [(i, d) for i, p in seeds for d in p.tolist()], width)
        else:
            tiles = tiles_by_search(item, doc, width)
        covered = sum(t[0] for t in tiles)
        if covered >= coverage * len(item):
            a = int(first[row])
            spans = [(i, int(starts[a + d] - offsets[row]), int(ends[a + d + n - 1] - offsets[row])) for n, i, d in sorted(tiles, key=lambda t: t[2])]
            yield row, number, covered, len(item), spans


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, min_tile: int) -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK_BYTES; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Items.build([(r["i"], r["t"]) for r in part.collect()], min_tile)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, item_col, n_words, n_covered, n_tiles, spans (item word, first and end byte in the document) of all leaks.

    Items of fewer than min_tile words need all their words side by side; items without words match nothing.  Null texts
    are empty; repeated documents and items each give their rows; either table may be empty.  Whole numbers of items are
    longs, other types stay.
    """
    out = None
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    span = T.StructType([T.StructField("item_word", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    item_type = benchmark.schema[item_col].dataType
    item_type = T.LongType() if isinstance(item_type, T.IntegralType) else item_type
    schema = T.StructType([rows.schema[0], T.StructField(item_col, item_type), T.StructField("n_words", T.LongType()), T.StructField("n_covered", T.LongType()), T.StructField("n_tiles", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    for items in _blocks(benchmark, item_col, text_col, min_tile):
        held = docs.sparkSession.sparkContext.broadcast(items)  # one block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                got = list(leaks(items, batch.column(1), min_tile, coverage)) if len(items.seeds) else []
                if got:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([g[0] for g in got])), pa.array([items.ids[g[1]] for g in got], to_arrow_type(item_type)),
                        pa.array([g[3] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([len(g[4]) for g in got], pa.int64()),
                        pa.array([[{"item_word": i, "start": a, "end": b} for i, a, b in g[4]] for g in got], pa.list_(pa.struct([("item_word", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ], names=schema.names)

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    place = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, text_col, min_tile):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                bad = {g[0] for g in leaks(items, batch.column(place).cast(pa.string()), min_tile, coverage)} if len(items.seeds) else set()
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = map_batches(docs, run, docs.schema)
    return docs


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaked = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaked.select("doc_id", "item_id", "n_words", "n_covered", "n_tiles")


QUERIES = {"op8_string_tiling": op8_string_tiling}
ORACLES: dict[str, str] = {}
