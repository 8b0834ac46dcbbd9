"""Exact Jaccard join on word shingles by size-banded tiles of bitmap signatures.

1. Every text becomes its set of 64-bit shingle hashes.  Equal sets are one node (its key: a hash of the set).  A node has
   a bitmap of about as many bits as shingles; each shingle flips the bit it hashes to.  Bits that differ between two
   bitmaps bound the symmetric difference from below, hence the overlap from above.
2. Two sets with Jaccard >= t share a token among the first n - ceil(t n) + 1 of each, in any common order.  The order is
   by hash, with tokens that turned out frequent last, so that what many texts share doesn't bring them together.
3. Nodes that share such a token form a group.  Within it, tiles of nodes of compatible sizes are compared by bit counts;
   what may be similar is united, so a group gives a forest and not its pairs.
4. Components of these forests hold all links.  Each gets its sets once, and exact intersections of sorted arrays decide,
   again in size-banded tiles after the bit counts; pairs already connected need no test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Forest, components, discard, likely_in, likely_split, map_batches, materialize, mix64, ngram_hashes, partitions, table, tidy, unite, utf8, words_of

SHINGLE, NUM, DEN = 5, 80, 100
#: Frequent tokens that come last in the order: at most so many, the most frequent ones.  Any order gives all links.
HOT_TOKENS = 65_536
HOT_COUNT = 32
#: Postings of one bucket, at which buckets are aimed.
BUCKET = 400_000
TILE = 512
#: Nodes of one task's tile.  Larger groups are cut into tiles, none is left out.
GROUP_ROWS = 16_384
#: Rows (of three short fields) up to which a side is broadcast; beyond, a bitmap thins the other side before the join.
BROADCAST_ROWS = 250_000
#: Parts into which rows of large groups are dealt where there are more large groups than that.
SALTS = 32


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = utf8(column)
    _, _, words, first = words_of(raw, offsets)
    grams, at = ngram_hashes(words, first, n)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    keep = np.ones(len(g), bool)
    if len(g):
        keep[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[keep], o[keep]
    ends = np.searchsorted(o, np.arange(len(at), dtype=np.uint64))
    for a, b in zip(ends[:-1], ends[1:]):
        yield g[a:b]


def set_key(x: np.ndarray) -> int:
    """64-bit key of a set, as a signed integer; None for the empty set."""
    return int(np.int64(np.uint64(mix64(np.array([mix64(x + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64))[0]).astype(np.int64)))


def bitmap_bits(n: int) -> int:
    return 64 << max(0, int(n - 1).bit_length() - 6)


def bitmap(x: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles that hash to each bit, as uint64 words."""
    flips = np.bincount((mix64(x ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of fewer bits, of the same set: halves folded by exclusive or."""
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_reach(differ: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether Jaccard >= num/den is possible: intersection <= (a + b - differ) / 2."""
    inter = (a + b - differ) // 2
    return (den + num) * inter >= num * (a + b)


def similar_tiles(size: np.ndarray, maps: list[np.ndarray], num: int, den: int, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j in order of size) that sizes and bit counts leave possible.  size is ascending.

    Tiles run over nodes sorted by size; a tile meets only tiles whose sizes are within the ratio.  With a forest, pairs
    that it holds in one tree already are left out: of two tiles, only nodes outside the tree that most of them are in
    meet the others, so near copies cost in proportion to their number."""

    def block(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(i) or not len(j):
            return
        bits = 64 * min(len(maps[i[0]]), len(maps[j[0]]))
        left, right = (np.stack([folded(maps[k], bits) for k in some]) for some in (i, j))
        differ = np.zeros((len(i), len(j)), np.int64)
        for w in range(left.shape[1]):
            differ += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
        sa, sb = size[i][:, None], size[j][None, :]
        ok = may_reach(differ, sa, sb, num, den) & (np.minimum(sa, sb) * den >= np.maximum(sa, sb) * num) & (i[:, None] < j[None, :])
        x, y = np.nonzero(ok)
        yield i[x], j[y]

    # a tile holds bitmaps of one length: folding the large to a much smaller one would leave nothing to tell by
    width = np.array([len(m) for m in maps])
    cuts = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(size)]
    tiles = [(a, min(a + TILE, end)) for begin, end in zip(cuts[:-1], cuts[1:]) for a in range(begin, end, TILE)]
    for k, (a, a2) in enumerate(tiles):
        for b, b2 in tiles[k:]:
            if size[b] * num > den * size[a2 - 1]:
                break
            rows, columns = np.arange(a, a2), np.arange(b, b2)
            if forest is None:
                yield from block(rows, columns)
                continue
            roots = np.fromiter(map(forest.find, [*rows.tolist(), *columns.tolist()]), np.int64, len(rows) + len(columns))
            kinds, counts = np.unique(roots, return_counts=True)
            apart = roots != kinds[np.argmax(counts)]
            alone, others = apart[: len(rows)], apart[len(rows) :]
            yield from block(rows[alone], columns)
            yield from block(rows[~alone], columns[others])


def _nodes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Tagged rows of one scan: documents (id, key, size, bitmap) and tokens frequent within a batch (key, size = count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sizes, maps, sets = batch.column(0), [], [], [], []
            seen: set[int] = set()
            for x in sets_of(batch.column(1), n):
                sizes.append(len(x))
                if not len(x):
                    keys.append(None)
                    maps.append(None)
                    continue
                key = set_key(x)
                keys.append(key)
                if key in seen:
                    maps.append(None)
                    continue
                seen.add(key)
                sets.append(x)
                maps.append(bitmap(x, bitmap_bits(len(x))).tobytes())
            yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(ids), pa.int32()), "id": ids, "key": pa.array(keys, pa.int64()), "size": pa.array(sizes, pa.int64()), "bits": pa.array(maps, pa.binary())})
            if sets:
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                some = counts >= 3
                tokens, counts = tokens[some].astype(np.int64), counts[some]
                k = len(tokens)
                yield pa.RecordBatch.from_pydict({"kind": pa.array([1] * k, pa.int32()), "id": pa.nulls(k, pa.int64()), "key": pa.array(tokens), "size": pa.array(counts, pa.int64()), "bits": pa.nulls(k, pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, "kind int, id long, key long, size long, bits binary")


def _postings(docs: DataFrame, text_col: str, n: int, num: int, den: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, tokens, keys, sizes) of prefix tokens, packed into one row for each bucket and batch."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_TOKENS integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        seen: set[int] = set()
        for batch in batches:
            tok, key, size = [], [], []
            for x in sets_of(batch.column(0), n):
                if not len(x) or (k := set_key(x)) in seen:
                    continue
                seen.add(k)
                length = len(x) - -(-num * len(x) // den) + 1
                if len(last):
                    at = np.minimum(np.searchsorted(last["token"], x), len(last) - 1)
                    rank = np.where(last["token"][at] == x, last["rank"][at], 0)
                    if rank.any():
                        x = x[np.lexsort((x, rank))]
                tok.append(x[:length])
                key.append(k)
                size.append(len(x))
            if len(seen) > 200_000:
                seen.clear()
            if not tok:
                continue
            counts = [len(t) for t in tok]
            t = np.concatenate(tok)
            k, s = np.repeat(np.array(key, np.int64), counts), np.repeat(np.array(size, np.uint32), counts)
            b = (mix64(t) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            t, k, s, b = t[order], k[order], s[order], b[order]
            cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(b[i]) for i, _ in spans], pa.int64()),
                "tokens": pa.array([t[i:j].tobytes() for i, j in spans], pa.binary()),
                "keys": pa.array([k[i:j].tobytes() for i, j in spans], pa.binary()),
                "sizes": pa.array([s[i:j].tobytes() for i, j in spans], pa.binary()),
            })

    return map_batches(docs.select(F.col(text_col).cast("string").alias("t")), run, "bucket long, tokens binary, keys binary, sizes binary")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows with the same first column, from a partition sorted by it."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and column[a] != key:
                yield key, held
                held = []
            key = column[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _groups(postings: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(group, key, size) of tokens that several nodes of compatible sizes share; a group's id is its token.

    A group falls apart where the next larger size is out of the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_group(batches):
            join = lambda c, d: np.concatenate([np.frombuffer(v, d) for h in held for v in h.column(c).to_pylist()])
            t, k, s = join(1, np.uint64), join(2, np.int64), join(3, np.uint32).astype(np.int64)
            order = np.lexsort((k, s, t))
            t, k, s = t[order], k[order], s[order]
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k, s = t[keep], k[keep], s[keep]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (s[1:] * num > s[:-1] * den)
            run_id = np.cumsum(fresh) - 1
            several = np.bincount(run_id)[run_id] > 1
            # groups of the same members come once
            first = np.flatnonzero(fresh)
            member = np.add.reduceat(mix64(k.astype(np.uint64)), first) if len(k) else np.zeros(0, np.uint64)
            _, once = np.unique(member, return_index=True)
            chosen = np.zeros(len(first), bool)
            chosen[once] = True
            use = several & chosen[run_id]
            ids = member[run_id[use]].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"g": pa.array(ids), "key": pa.array(k[use]), "size": pa.array(s[use])})

    spread = postings.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return map_batches(spread, run, "g long, key long, size long")


def tiled(rows: DataFrame, group: str, num: int, den: int, limit: int | None = None) -> DataFrame:
    """rows with a column tile, such that all rows of a group whose sizes are within the ratio meet in some tile.

    A group of at most limit rows is one tile.  A larger one is cut by size bands (each as wide as the ratio, so that only
    equal and neighbouring bands meet) and by a hash into parts of about limit rows; a row goes to the tiles of its part
    with every part of the bands it meets.  So no task holds a group, however large."""
    limit = limit or GROUP_ROWS
    large = materialize(rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("__parts")).where("__parts > 1"))
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num))).cast("long")
    mixed = F.xxhash64("size", *[c for c in ("key", "id") if c in rows.columns])
    if large.count() <= BROADCAST_ROWS:  # rows stay where they are: no task gets a group
        marked = rows.join(F.broadcast(large), group, "left")
    else:
        salted = large.select(group, "__parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        marked = rows.withColumn("__salt", F.pmod(mixed, F.lit(SALTS)).cast("int")).join(salted, [group, "__salt"], "left")
    marked = marked.withColumn("__parts", F.coalesce("__parts", F.lit(1))).withColumn("__band", band).withColumn("__own", F.pmod(mixed, F.col("__parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("__parts") - 1)
    name = lambda low, high, a, b: F.concat_ws("/", group, low, high, a, b)
    same = F.transform(others, lambda q: name(F.col("__band"), F.col("__band"), F.least("__own", q), F.greatest("__own", q)))
    below = F.transform(others, lambda q: name(F.col("__band") - 1, F.col("__band"), q, F.col("__own")))
    above = F.transform(others, lambda q: name(F.col("__band"), F.col("__band") + 1, F.col("__own"), q))
    tiles = F.when(F.col("__parts") == 1, F.array(F.col(group).cast("string"))).otherwise(F.concat(same, below, above))
    return marked.select(F.explode(tiles).alias("tile"), *rows.columns)


def _unite(groups: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """Forest edges (a, b) of what bit counts leave possible within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for _, held in by_group(batches):
            keys = np.concatenate([h.column(1).to_numpy() for h in held])
            size = np.concatenate([h.column(2).to_numpy() for h in held])
            bits = [np.frombuffer(v, np.uint64) for h in held for v in h.column(3).to_pylist()]
            order = np.lexsort((keys, size))
            keys, size, bits = keys[order], size[order], [bits[i] for i in order]
            forest = Forest(len(keys))
            for i, j in similar_tiles(size, bits, num, den, forest):
                out.update((int(keys[a]), int(keys[b])) for a, b in unite(forest, i, j))
            if len(out) > 100_000:
                yield _edges(out)
                out = set()
        if out:
            yield _edges(out)

    rows = tiled(groups, "g", num, den).join(maps, "key").select("tile", "key", "size", "bits")
    return map_batches(rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile"), run, "a long, b long")


def _edges(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _verify(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Forest edges (a, b) of exact links; members: tile, id, t (text), key, the id standing for the node
    of that key; of texts that share an id, the one with the key is meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_group(batches):
            ids = np.concatenate([h.column(1).to_numpy() for h in held])
            keys = np.concatenate([h.column(3).to_numpy() for h in held])
            sets = [x for h in held for x in sets_of(h.column(2), n)]
            mine = np.array([bool(len(x)) and set_key(x) == k for x, k in zip(sets, keys.tolist())])
            _, once = np.unique(np.where(mine, keys, 0), return_index=True)
            use = once[mine[once]]
            ids, sets = ids[use], [sets[i] for i in use]
            size = np.array([len(x) for x in sets], np.int64)
            order = np.lexsort((ids, size))
            ids, size, sets = ids[order], size[order], [sets[i] for i in order]
            maps = [bitmap(x, bitmap_bits(len(x))) for x in sets]
            forest, out = Forest(len(ids)), []

            def linked(a: int, b: int, sets: list[np.ndarray] = sets) -> bool:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                return den * both >= num * (len(sets[a]) + len(sets[b]) - both)

            for i, j in similar_tiles(size, maps, num, den, forest):
                out += [(int(ids[a]), int(ids[b])) for a, b in unite(forest, i, j, linked)]
            if out:
                yield _edges(out)

    return map_batches(members.repartition(partitions(members.sparkSession), "tile").sortWithinPartitions("tile"), run, "a long, b long")


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable by links of Jaccard >= num/den) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer than n words are one shingle.  Null, empty and blank texts have
    no shingle and link with nothing.  Rows with equal ids are one node; rows with a null id keep a null component and
    link nothing.  An empty table gives no row.
    """
    spark = docs.sparkSession
    tagged = materialize(_nodes(docs, id_col, text_col, n))
    nodes = tagged.where("kind = 0").select("id", "key", "size", "bits")
    shape = nodes.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).first()
    expected = int((shape["s"] or 0) * (den - num) / den) + (shape["n"] or 0)
    buckets = max(1, -(-expected // BUCKET))
    frequent = tagged.where("kind = 1").groupBy("key").agg(F.sum("size").alias("c")).where(F.col("c") >= HOT_COUNT)
    top = frequent.orderBy(F.desc("c"), "key").limit(HOT_TOKENS).collect()
    hot = np.zeros(len(top), [("token", np.uint64), ("rank", np.int64)])
    if top:
        hot["token"] = np.array([r["key"] for r in top], np.int64).astype(np.uint64)
        hot["rank"] = [r["c"] for r in top]
        hot.sort(order="token")

    # one representative id for each set
    named = nodes.where("key is not null and id is not null")
    reps = materialize(named.groupBy("key").agg(F.min("id").alias("rep"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies")))
    maps = named.where("bits is not null").groupBy("key").agg(F.max("bits").alias("bits"))
    spread = _postings(docs.where(F.col(id_col).isNotNull()), text_col, n, num, den, hot, buckets)
    groups = materialize(_groups(spread, buckets, num, den).distinct())
    likely = materialize(_unite(groups, maps, num, den))
    tidy(spark)
    roots = components(likely)
    placed = materialize(roots.join(reps.select(F.col("key").alias("node"), "rep", "size"), "node").select("root", F.col("rep").alias("id"), "size", F.col("node").alias("key")))
    wanted = materialize(tiled(placed, "root", num, den).select("tile", "id", "key"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    members = likely_in(rows, "id", wanted).join(wanted, "id").select("tile", "id", "t", "key")
    links = materialize(_verify(members, n, num, den))
    # copies of a set, and what the links unite; ids that repeat bring their sets together
    same = named.join(reps.where("copies > 1").select("key", "rep"), "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    tidy(spark)
    whole = components(links.unionByName(same))
    sizes = nodes.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"))
    out = sizes.join(whole.select(F.col("node").alias(id_col), "root"), id_col, "left")
    found = materialize(out.select(id_col, "n_shingles", F.coalesce("root", id_col).alias("component_id")))
    discard(tagged, reps, groups, likely, placed, wanted, links)
    return found


def _repeats(nodes: DataFrame) -> bool:
    """Whether some id stands on several rows."""
    return not nodes.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, num: int = NUM, den: int = DEN, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those that another document of their component stands for: the
    smallest id stays.  Of rows that repeat an id the one with the smallest hash of all its columns stays; rows with a null
    id or without a word all stay."""
    found = jaccard_components(docs, num, den, n, id_col, text_col)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    some, others = likely_split(docs, id_col, gone)  # most texts stay: they aren't shuffled
    kept = some.join(gone, id_col, "left_anti").select(*docs.columns).unionByName(others)
    if _repeats(found.select(F.col(id_col).alias("id"))):
        whole = F.struct(*docs.columns)
        one = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("__row"))
        kept = one.select("__row.*").unionByName(kept.where(F.col(id_col).isNull()))
    return kept


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES: dict[str, str] = {}
