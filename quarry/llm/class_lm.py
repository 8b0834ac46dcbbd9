"""LM scoring with Brown class-based bigrams.

Symbols are the most frequent words, one each, and for all other words a type by their last two bytes; a text's end is a
symbol too.  Bigrams of symbols are counted over all training texts.  Exchange clustering moves symbols between classes
while the likelihood of the class bigram grows.  Then every other training word, however rare, is moved from its type's
class to the one that its own contexts gain most by, where they outweigh PRIOR: the classes before and after all its
occurrences are summed by word in hashed buckets.  Words not seen in training keep their type's class.  Transitions are
counted anew over all training texts with the classes so found.  Then

    P(w | previous) = LAMBDA * P(class of w | class of previous) * P(w | class of w) + (1 - LAMBDA) * P_base(w)

where a class keeps the share of its words that occur once for unseen words (taken as one event a class), and P_base is
the smoothed word count that the base score uses (its one unseen event shared out evenly among classes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, crc32_text, map_batches, materialize, mix64, table, tidy, utf8, words_of
from quarry.llm.jaccard_join import by_group

FOLDS, HELD_OUT = 5, 1
#: Words with a symbol of their own, types of the others, classes, sweeps of the exchange, weight of the class model.
WORDS, TYPES, CLASSES, SWEEPS, LAMBDA = 1200, 400, 40, 6, 0.95
#: What the contexts of a word without a symbol must gain, in nats, to take it out of its type's class.
PRIOR = 3.0
#: Hash that stands for a text's end.
END = np.uint64(0x656E64)
#: Bytes of text of one block, whose words are looked up together, and entries of one bucket of the dictionary.
BLOCK_BYTES, BUCKET = 24 << 20, 2_000_000


def held_out(id_col: str):
    return F.coalesce(F.pmod(crc32_text(id_col), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and type of every token (words, then one end) of a batch of texts, and the number of the first of each."""
    raw, offsets = utf8(column)
    starts, ends, hashes, first = words_of(raw, offsets)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    kind = np.full(len(out), TYPES, np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = hashes
    if len(hashes):
        last = LOWER[raw[ends - 1]].astype(np.int64)
        before = np.where(ends - starts > 1, LOWER[raw[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
        kind[place] = (last * 257 + before * 31) % TYPES
    return out, kind, at


def symbols_of(hashes: np.ndarray, kind: np.ndarray, core: np.ndarray) -> np.ndarray:
    """core: sorted hashes of the words with a symbol of their own."""
    if not len(core):
        return kind
    k = np.minimum(np.searchsorted(core, hashes), len(core) - 1)
    return np.where((core[k] == hashes) & (kind < TYPES), k, len(core) + kind)


def _counted(train: DataFrame) -> DataFrame:
    """Hash and count of every word of the texts: partial counts of a task, summed by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            every, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in held]), len(every)).astype(np.int64)
            return pa.RecordBatch.from_pydict({"h": pa.array(every.astype(np.int64)), "c": pa.array(counts)})

        for batch in batches:
            hashes, kind, _ = tokens_of(batch.column(0))
            held.append(np.unique(hashes[kind < TYPES], return_counts=True))
            if sum(len(h) for h, _ in held) > BUCKET:
                yield merged()
                held = []
        if held:
            yield merged()

    return map_batches(train, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(train: DataFrame) -> np.ndarray:
    """The most frequent words by their exact counts (ties: the smaller hash)."""
    rows = _counted(train).orderBy(F.desc("c"), "h").limit(WORDS).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).astype(np.uint64))


def _bigrams(docs: DataFrame, core: np.ndarray) -> np.ndarray:
    """Counts of symbol pairs over all training texts (a text's first word follows an end)."""
    size = len(core) + TYPES + 1
    stripes = 16
    width = -(-size * size // stripes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            hashes, kind, _ = tokens_of(batch.column(0))
            if len(hashes):
                s = symbols_of(hashes, kind, core)
                previous = np.concatenate([[size - 1], s[:-1]])  # what comes before a text is an end
                total += np.bincount(previous * size + s, minlength=size * size)
        cells = np.flatnonzero(total)
        parts = np.split(cells, np.searchsorted(cells, np.arange(1, stripes) * width))
        rows = [(k, p) for k, p in enumerate(parts) if len(p)]
        yield pa.RecordBatch.from_pydict({"stripe": pa.array([k for k, _ in rows], pa.int64()), "cell": pa.array([p.astype(np.int64).tobytes() for _, p in rows], pa.binary()), "n": pa.array([total[p].tobytes() for _, p in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in by_group(batches):
            total = np.zeros(width, np.int64)
            for h in held:
                for cell, n in zip(h.column(1).to_pylist(), h.column(2).to_pylist()):
                    total[np.frombuffer(cell, np.int64) - k * width] += np.frombuffer(n, np.int64)
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([int(k)], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    parts = map_batches(docs, count, "stripe long, cell binary, n binary").repartition(stripes, "stripe").sortWithinPartitions("stripe")
    out = np.zeros(stripes * width, np.int64)
    for r in map_batches(parts, add, "stripe long, n binary").collect():  # a matrix of symbols: bounded
        out[r["stripe"] * width : (r["stripe"] + 1) * width] = np.frombuffer(r["n"], np.int64)
    return out[: size * size].reshape(size, size)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, sorted, and the sum of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return cell, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(cell)).astype(np.int64)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol.  The end (last symbol) stays alone in the last class.

    Each sweep takes the symbols by falling count and moves each to the class that gains the class bigram's likelihood,
    sum f(N(g, h)) - 2 sum f(N(g)) with f(x) = x log x, the most; it ends early when none moves."""
    size = len(pairs)
    count = pairs.sum(0)
    order = np.argsort(-count[:-1], kind="stable")
    k = min(classes, size)
    cls = np.empty(size, np.int64)
    cls[order] = np.arange(size - 1) % max(1, k - 1)
    cls[-1] = k - 1
    one = np.zeros((size, k))
    one[np.arange(size), cls] = 1
    m = pairs.astype(float)
    after, before = m @ one, m.T @ one  # of each symbol, by class of what follows and precedes
    table_ = one.T @ after
    total = one.T @ count.astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not count[w]:
                continue
            a, own, n = cls[w], m[w, w], float(count[w])
            r, c = after[w].copy(), before[w].copy()
            r[a] -= own
            c[a] -= own
            table_[a] -= r
            table_[:, a] -= c
            table_[a, a] -= own
            total[a] -= n
            diagonal = np.diag(table_)
            gain = (f(table_ + r) - f(table_)).sum(1) + (f(table_ + c[:, None]) - f(table_)).sum(0)
            gain += f(diagonal + r + c + own) - f(diagonal + r) - f(diagonal + c) + f(diagonal)
            gain -= 2 * (f(total + n) - f(total))
            gain[k - 1] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table_[b] += r
            table_[:, b] += c
            table_[b, b] += own
            total[b] += n
            if b != a:
                moved += 1
                cls[w] = b
                after[:, a] -= m[:, w]
                after[:, b] += m[:, w]
                before[:, a] -= m[w]
                before[:, b] += m[w]
        if not moved:
            break
    return cls


def context_gains(pairs: np.ndarray) -> np.ndarray:
    """By (class before, then class after) and class: what one such neighbour of a word adds to the class bigram's likelihood
    when the word is in that class; the last class takes no word.  pairs: counts of class pairs."""
    m = pairs + 0.1
    mutual = np.log(m * m.sum() / (m.sum(1, keepdims=True) * m.sum(0)))
    out = np.concatenate([mutual, mutual.T])
    out[:, -1] = -1e3
    return out


def classes_by_context(kind: np.ndarray, cell: np.ndarray, n: np.ndarray, gains: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Class of each word: its type's (kind), or the best by its contexts where it has any (ties: the smaller class).
    cell: word * number of contexts + context, sorted and distinct, with its count n."""
    out = kind.copy()
    width, at = len(gains), 0
    while at < len(cell):
        begin = cell[at] // width
        end = np.searchsorted(cell, (begin + 32_768) * width)
        held = np.zeros((32_768, width))
        held.ravel()[cell[at:end] - begin * width] = n[at:end]
        some = np.unique(cell[at:end] // width)
        value = held[some - begin] @ gains
        value[np.arange(len(some)), kind[some]] += prior
        out[some] = np.argmax(value, 1)
        at = end
    return out


def _blocks_of(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n)).cast("long"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose id is not in the held-out fold.  Null and empty texts are one token, the end.  Null ids are in
    no held-out fold; repeated rows stay and each count.  Without training rows all tokens are unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), held_out(id_col).alias("held"))
    train = rows.where("not held").select("t")
    core = _frequent(train)
    pairs = _bigrams(train, core)
    cls = exchange(pairs)
    k = int(cls.max()) + 1
    one = np.zeros((len(cls), k))
    one[np.arange(len(cls)), cls] = 1
    gains = context_gains(one.T @ pairs @ one)
    width = len(gains)
    class_of = cls.astype(np.uint8)

    text_bytes = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-text_bytes // BLOCK_BYTES))
    buckets = max(1, -(-text_bytes // (12 * BUCKET)))
    placed = _blocks_of(rows, blocks).select("block", "id", "t", "held")

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return (mix64(h) % np.uint64(buckets)).astype(np.int64)

    def listed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of a block by (bucket, hash), and the bucket of each."""
        u = np.unique(np.concatenate(parts))
        b = bucket_of(u)
        order = np.argsort(b, kind="stable")
        return u[order], b[order]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held_rows in by_group(batches):
            every, learn, types, around = [], [], [], []
            for h in held_rows:
                hashes, kind, at = tokens_of(h.column(2))
                use = np.repeat(~h.column(3).to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
                u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                every.append(u)
                symbols = symbols_of(u, kind[first], core)
                types.append(class_of[symbols])
                c = types[-1][inverse].astype(np.int64)
                rare = np.flatnonzero(use & (symbols[inverse] >= len(core)) & (kind < TYPES))  # an end follows each
                before = np.where(rare > 0, c[rare - 1], k - 1)  # and an end comes before each text
                cells = inverse[rare].astype(np.int64) * width
                around.append(np.unique(np.concatenate([cells + before, cells + k + c[rare + 1]]), return_counts=True))
                learn.append(np.bincount(inverse[use], minlength=len(u)))
            keys, b = listed(every)
            order = np.argsort(keys)
            counts, kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
            for q, (u, n, t) in enumerate(zip(every, learn, types)):
                place = order[np.searchsorted(keys[order], u)]
                counts[place] += n
                kinds[place] = t
                cell, times = around[q]
                around[q] = place[cell // width] * width + cell % width, times
            cell, times = _summed(around)
            cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            spans = list(zip(cuts[:-1], cuts[1:]))
            own = np.searchsorted(cell, cuts * width)
            steps = [np.diff(cell[x:y], prepend=i * width) for i, x, y in zip(cuts[:-1], own[:-1], own[1:])]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(b[i]) for i, _ in spans], pa.int64()), "block": pa.array([int(block)] * len(spans), pa.int64()),
                "h": pa.array([keys[i:j].tobytes() for i, j in spans], pa.binary()),
                "n": pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in spans], pa.binary()),
                "c": pa.array([kinds[i:j].tobytes() for i, j in spans], pa.binary()),
                "steps": pa.array([x.astype(np.uint32).tobytes() for x in steps], pa.binary()),  # from cell to cell
                "times": pa.array([times[x:y].astype(np.uint32).tobytes() for x, y in zip(own[:-1], own[1:])], pa.binary()),
            })

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held_rows in by_group(batches):
            block = [v for h in held_rows for v in h.column(1).to_pylist()]
            read = lambda c, d: [np.frombuffer(v, d) for h in held_rows for v in h.column(c).to_pylist()]
            hashes, counts, kinds = read(2, np.uint64), read(3, np.uint32), read(4, np.uint8)
            u, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.int64)
            begins = np.cumsum([0, *(len(h) for h in hashes)])
            around = []
            for at, step, times in zip(begins, read(5, np.uint32), read(6, np.uint32)):
                cell = np.cumsum(step, dtype=np.int64)
                around.append((inverse[at + cell // width] * width + cell % width, times))
            kind = classes_by_context(np.concatenate(kinds)[first].astype(np.int64), *_summed(around), gains, prior)
            seen = n > 0
            cut = lambda x: [v.tobytes() for v in np.split(x[inverse], begins[1:-1])]
            yield _tagged(block, bucket, cut(n), cut(kind.astype(np.uint8)))
            sums = [np.bincount(kind[seen], w, k) for w in (n[seen], None, (n[seen] == 1))]
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1] * k, pa.int64()), "bucket": pa.array(list(range(k)), pa.int64()), "n": pa.nulls(k, pa.binary()), "c": pa.nulls(k, pa.binary()), "tokens": pa.array(sums[0].astype(np.int64)), "types": pa.array(sums[1].astype(np.int64)), "ones": pa.array(sums[2].astype(np.int64))})

    def _tagged(block: list[int], bucket: int, back: list[bytes], kinds: list[bytes]) -> pa.RecordBatch:
        m = len(block)
        return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "bucket": pa.array([int(bucket)] * m, pa.int64()), "n": pa.array(back, pa.binary()), "c": pa.array(kinds, pa.binary()), "tokens": pa.nulls(m, pa.int64()), "types": pa.nulls(m, pa.int64()), "ones": pa.nulls(m, pa.int64())})

    by_block = placed.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block")
    lists = map_batches(by_block, gather, "bucket long, block long, h binary, n binary, c binary, steps binary, times binary")
    merged = materialize(map_batches(lists.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket"), total, "block long, bucket long, n binary, c binary, tokens long, types long, ones long"))
    tidy(spark)
    stats = merged.where("block = -1").groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("ones").alias("ones")).collect()
    tokens, types, ones = np.zeros(k), np.zeros(k), np.zeros(k)
    for r in stats:  # one row a class
        tokens[r["bucket"]], types[r["bucket"]], ones[r["bucket"]] = r["tokens"], r["types"], r["ones"]
    n_all, v_all = int(tokens.sum()), int(types.sum())
    unseen = np.clip((ones + 0.5) / (tokens + 1.0), 1e-9, 0.5)
    unseen[-1] = 1e-9  # the end is known
    within = (1 - unseen) / np.maximum(tokens, 1)
    bottom = n_all + 0.5 * (v_all + 1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """The texts of each block, in parts, with count and class of every token and the number of the first of each text."""
        for _, held_rows in by_group(batches):
            back: dict[int, tuple[bytes, bytes]] = {}
            texts: list[pa.RecordBatch] = []
            for h in held_rows:
                tags = h.column(1).to_pylist()
                for q, tag in enumerate(tags):
                    if tag == 0:
                        back[h.column(2)[q].as_py()] = h.column(3)[q].as_py(), h.column(4)[q].as_py()
                chosen = [q for q, tag in enumerate(tags) if tag == 1]
                if chosen:
                    texts.append(h.take(pa.array(chosen)))
            tokens = [tokens_of(h.column(6)) for h in texts]
            keys, _ = listed([hashes for hashes, _, _ in tokens])
            counts, kinds = (np.concatenate([np.frombuffer(back[b][q], d) for b in sorted(back)]) for q, d in enumerate((np.int64, np.uint8)))
            order = np.argsort(keys)
            keys, counts, kinds = keys[order], counts[order], kinds[order].astype(np.int64)
            for h, (hashes, _, at) in zip(texts, tokens):
                place = np.searchsorted(keys, hashes)
                yield h, counts[place], kinds[place], at

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k * k, np.int64)
        for h, _, c, at in coded(batches):
            use = np.repeat(~h.column(7).to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            previous = np.concatenate([[k - 1], c[:-1]])
            found += np.bincount((previous * k + c)[use], minlength=k * k)
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(found[cells], pa.int64())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, c, at in coded(batches):
            previous = np.concatenate([[k - 1], c[:-1]])
            base = (n + 0.5) / bottom
            emit = np.where(n > 0, n * within[c], unseen[c])
            p = LAMBDA * follow[previous, c] * emit + (1 - LAMBDA) * np.where(n > 0, base, base / k)
            sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end
            yield pa.RecordBatch.from_arrays([
                h.column(5), h.column(7), pa.array(np.diff(at), pa.int64()), pa.array(sums((n > 0).astype(np.int64)), pa.int64()),
                pa.array([n_all] * h.num_rows, pa.int64()), pa.array(sums(np.log10(base))), pa.array(sums(np.log10(p))),
            ], names=["id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    nothing = lambda t: F.lit(None).cast(t)
    dictionary = merged.where("block >= 0").select("block", F.lit(0).alias("kind"), "bucket", "n", "c", nothing("long").alias("id"), nothing("string").alias("t"), nothing("boolean").alias("held"))
    asked = placed.select("block", F.lit(1).alias("kind"), nothing("long").alias("bucket"), nothing("binary").alias("n"), nothing("binary").alias("c"), "id", "t", "held")
    jobs = dictionary.unionByName(asked).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind")
    moves = np.zeros(k * k)
    for r in map_batches(jobs, transitions, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # pairs of classes
        moves[r["cell"]] = r["n"]
    moves = moves.reshape(k, k)
    follow = (moves + 0.1) / (moves.sum(1, keepdims=True) + 0.1 * k)
    tidy(spark)
    out = map_batches(jobs, score, "id long, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnsRenamed({"id": id_col, "held": "held_out"})


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_class_lm": op10_class_lm}
ORACLES: dict[str, str] = {}
