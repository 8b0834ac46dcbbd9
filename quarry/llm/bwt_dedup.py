"""Exact substring dedup by merging shard Burrows-Wheeler transforms with iterative interleave refinement.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere else.  To keep the merge proportional to
what repeats, texts are parsed by content: the anchor of a window of ``span`` bytes is the place of its smallest k-gram
fingerprint, so equal windows have equal anchors at equal offsets, wherever they stand.  The context of an anchor is all
windows that have it.  Contexts with one fingerprint are one entry of a dictionary with its number of occurrences, and
only entries whose anchor k-gram occurs in another entry too have to be sorted.

The entries of an anchor, from whichever shards, start interleaved as they come.  Aligned at the anchor, one step of the
merge prepends one column: a stable partition of the interleave by the prepended byte (its transform's symbol), as in
merging transforms without sorting suffixes anew.  With the order goes, for each neighbour, the first column in which the
two differ; a step takes minima over the rows between.  Where neighbours agree for span columns, their windows are a
repeated interval.  Every column of every entry is read once.

The symbols are the bytes of a text, or its words: with ``words``, a passage of ``span`` words goes if the same words, A-Z
in lower case and whatever stands between them, also start anywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BASE, BASE_INV, discard, likely_in, likely_split, map_batches, materialize, mix64, powers, table, tidy, utf8, words_of
from quarry.llm.jaccard_join import by_group

SPAN, GRAM = 400, 40
#: The same in words: passages of over 50 words.
WORD_SPAN, WORD_GRAM = 51, 5
#: Bytes parsed at once, contexts merged at once (an anchor's are never parted), anchors of one bucket.
PARSE_BYTES, MERGE_ROWS, BUCKET = 1 << 19, 8_192, 250_000
#: Entries of one bucket that one task reads whole; of larger buckets, contexts are counted as rows, with partial counts.
HEAVY = 1_000_000
#: Entries of one anchor that one task merges; of more, their windows are dealt out by fingerprint instead.
GROUP_ROWS = 65_536
_PLACE = 30
_LOW = np.uint64((1 << _PLACE) - 1)


def symbols(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a batch of texts, the number of the first of each text (n + 1 entries), and the bytes of its text at which
    each symbol starts and ends (for bytes, nothing: a byte stands at its own number)."""
    raw, offsets = utf8(texts)
    if not words:
        return raw, offsets, offsets[:0], offsets[:0]
    starts, ends, hashes, first = words_of(raw, offsets)
    base = np.repeat(offsets[:-1], np.diff(first))
    return hashes, first, starts - base, ends - base


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For every anchor of a batch of texts, given as symbols: text number, fingerprint of its k-gram, fingerprint of its
    context, its place, and the first and last start of its windows (places within the text)."""
    none = tuple(np.zeros(0, d) for d in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(raw)
    if n < span:
        return none
    pw, inverse = powers(BASE, n), powers(BASE_INV, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), span - gram + 1)
    place = (least & _LOW).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + span <= ends)
    if not len(start):
        return none
    place = place[start]
    text = np.searchsorted(offsets, start, side="right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, lo, hi, text = place[first], start[first], start[last], text[first]
    context = mix64((sums[hi + span] - sums[lo]) * inverse[lo] + mix64(((a - lo) * 65_537 + (hi - lo)).astype(np.uint64)))
    base = offsets[text]
    return text, grams[a], context, a - base, lo - base, hi - base


def repeated_windows(group: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], span: int = SPAN, kind: type = np.uint8) -> np.ndarray:
    """Boolean rows x (span + 1): whether the window that starts c - span after the row's anchor also stands in another row
    of the same group.  Rows come sorted by group; contexts hold the symbols (of type kind) from lo to hi + span."""
    m = len(group)
    first, last = lo - place + span, hi - place + span  # columns of window starts; the anchor is at column span
    right = last + span
    width = int(right.max())
    _, flat = np.unique(np.frombuffer(b"".join(contexts), kind), return_inverse=True)
    end = int(flat.max()) + 1  # what a row reads before and after its context
    byte = np.zeros((width, m), np.int32)  # column-major: a step reads one row of it
    sizes = np.array([len(c) for c in contexts]) // np.dtype(kind).itemsize
    row = np.repeat(np.arange(m), sizes)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    byte[first[row] + inner, row] = flat
    _, rank = np.unique(group, return_inverse=True)
    order = np.arange(m)
    differ = np.full(m + 1, width, np.int64)  # first column in which a row and the one before it differ
    differ[0] = -1
    of = rank[order]
    differ[:m][np.concatenate([[True], of[1:] != of[:-1]])] = -1
    out = np.zeros((m, span + 1), bool)
    for c in range(width - 1, int(first.min()) - 1, -1):
        inside = (c >= first[order]) & (c < right[order])
        symbol = np.where(inside, byte[c, order], end)
        key = rank[order] * (end + 1) + symbol
        step = np.argsort(key, kind="stable")
        k = key[step]
        same = np.zeros(m, bool)
        same[1:] = (k[1:] == k[:-1]) & (symbol[step[1:]] < end)
        new = np.full(m + 1, c, np.int64)
        t = np.flatnonzero(same)
        if len(t):
            a, b = step[t - 1], step[t]
            near = b == a + 1
            new[t[near]] = differ[b[near]]
            if not near.all():
                a, b, t = a[~near], b[~near], t[~near]
                new[t] = np.minimum.reduceat(differ, np.column_stack([a + 1, b + 1]).ravel())[::2]
        order, differ = order[step], new
        if c <= span:
            alike = np.zeros(m, bool)
            alike[1:] = same[1:] & (new[1:m] >= c + span)
            alike[:-1] |= alike[1:]
            rows = order[alike]
            rows = rows[(c >= first[rows]) & (c <= last[rows])]
            out[rows, c] = True
    return out


def _least(span: int, words: bool) -> int:
    """Bytes that span symbols have at least."""
    return 2 * span - 1 if words else span


def _parse(docs: DataFrame, span: int, gram: int, buckets: int, words: bool) -> DataFrame:
    """Anchors of each distinct text, packed into one row for each bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            sizes = np.array(batch.column(2).to_pylist(), np.int64)
            chosen = []
            for k, (key, size) in enumerate(zip(keys, sizes)):
                if size >= _least(span, words) and key not in seen:
                    seen.add(key)
                    chosen.append(k)
            if len(seen) > 500_000:
                seen.clear()
            parts, held, total = [], [], 0
            for k in chosen:
                held.append(k)
                total += sizes[k]
                if total >= PARSE_BYTES:
                    parts.append(held)
                    held, total = [], 0
            if held:
                parts.append(held)
            for some in parts:
                read, offsets, _, _ = symbols(batch.column(1).take(pa.array(some)), words)
                text, g, ctx, a, lo, hi = anchors(read, offsets, span, gram)
                owner = np.array([keys[k] for k in some], np.int64)[text]
                b = (mix64(g) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                cells = [x[order] for x in (g, ctx, owner, a.astype(np.uint32), lo.astype(np.uint32), hi.astype(np.uint32))]
                b = b[order]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)) if len(b) else np.zeros(1, int)
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b[i]) for i, _ in spans], pa.int64())} | {n: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for n, x in zip("gckalh", cells)})

    return map_batches(docs.select("key", "t", "size"), run, "bucket long, g binary, c binary, k binary, a binary, l binary, h binary")


def _dictionary(parsed: DataFrame, span: int, buckets: int, limit: int) -> DataFrame:
    """Rows (key, g, a, lo, hi, done, single, wide): done, all windows from lo to hi are repeated (g and a mean nothing); else the entry has to be
    merged, single says whether its result is wanted, and wide whether its anchor has more than limit entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_group(batches):
            read = lambda c, d: np.concatenate([np.frombuffer(v, d) for h in held for v in h.column(c).to_pylist()])
            g, ctx, key = read(1, np.uint64), read(2, np.uint64), read(3, np.int64)
            a, lo, hi = (read(c, np.uint32).astype(np.int64) for c in (4, 5, 6))
            order = np.lexsort((lo, key, ctx, g))
            g, ctx, key, a, lo, hi = (x[order] for x in (g, ctx, key, a, lo, hi))
            keep = np.ones(len(g), bool)  # the same text came from several tasks
            keep[1:] = (g[1:] != g[:-1]) | (ctx[1:] != ctx[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])
            g, ctx, key, a, lo, hi = (x[keep] for x in (g, ctx, key, a, lo, hi))
            new_g = np.concatenate([[True], g[1:] != g[:-1]])
            new_c = new_g | np.concatenate([[True], ctx[1:] != ctx[:-1]])
            gid, cid = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
            times = np.bincount(cid)[cid]
            entries = np.bincount(gid[new_c])[gid]
            done = times > 1
            merge = new_c & (entries > 1)
            i = np.flatnonzero(merge)
            n = len(i)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[i]), "g": pa.array(g[i].astype(np.int64)), "a": pa.array(a[i]), "lo": pa.array(lo[i]), "hi": pa.array(hi[i]), "done": pa.array(np.zeros(n, bool)), "single": pa.array(times[i] == 1), "wide": pa.array(entries[i] > limit)})
            i = np.flatnonzero(done)  # neighbours, as in lines that repeat, make one run
            i = i[np.lexsort((lo[i], key[i]))]
            k, first, last = key[i], lo[i], hi[i]
            new = np.ones(len(i), bool)
            new[1:] = (k[1:] != k[:-1]) | (first[1:] > last[:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(i))[: len(begin)] - 1
            n = len(begin)
            none = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(k[begin]), "g": none, "a": none, "lo": pa.array(first[begin]), "hi": pa.array(last[end]), "done": pa.array(np.ones(n, bool)), "single": pa.array(np.zeros(n, bool)), "wide": pa.array(np.zeros(n, bool))})

    heavy = materialize(parsed.groupBy("bucket").agg(F.sum(F.octet_length("g")).alias("n")).where(F.col("n") > 8 * HEAVY).select("bucket"))
    several = not heavy.isEmpty()
    light = parsed.join(heavy, "bucket", "left_anti") if several else parsed
    spread = light.select("bucket", *"gckalh").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    out = map_batches(spread, run, _ENTRIES)
    return out.unionByName(_counted(parsed.join(heavy, "bucket", "left_semi"), limit)) if several else out


_ENTRIES = "key long, g long, a long, lo long, hi long, done boolean, single boolean, wide boolean"


def _counted(parsed: DataFrame, limit: int) -> DataFrame:
    """What _dictionary gives, for buckets of very many entries: no task holds an anchor or a context, since counts are
    partial and what is joined to them is written first, so that a skewed join can be split."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["g", "c", "k", "a", "l", "h"]).to_pylist():
                cells = [np.frombuffer(r[n], np.int64 if n in "gck" else np.uint32).astype(np.int64) for n in "gckalh"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["g", "c", "key", "a", "lo", "hi"])

    rows = map_batches(parsed, unpack, "g long, c long, key long, a long, lo long, hi long")
    rows = materialize(rows.groupBy("g", "c", "key", "lo").agg(F.min("a").alias("a"), F.min("hi").alias("hi")))  # a text came from several tasks
    contexts = materialize(rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "lo", "a", "hi")).alias("one")))
    shared = materialize(contexts.groupBy("g").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"))
    merge = contexts.join(shared, "g").select("one.key", "g", "one.a", "one.lo", "one.hi", F.lit(False).alias("done"), (F.col("times") == 1).alias("single"), (F.col("entries") > limit).alias("wide"))
    again = materialize(contexts.where("times > 1").select("g", "c"))
    none = F.lit(0).cast("long")
    done = rows.join(again, ["g", "c"], "left_semi").select("key", none.alias("g"), none.alias("a"), "lo", "hi", F.lit(True).alias("done"), F.lit(False).alias("single"), F.lit(False).alias("wide"))
    return merge.unionByName(done)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 50) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: long texts come with many runs, which are large as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _contexts(texts: DataFrame, wanted: DataFrame, span: int, words: bool) -> DataFrame:
    """The wanted entries with their symbols, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out: list[dict] = []  # wide goes along
            read, first, _, _ = symbols(batch.column(1), words)
            read = read.astype(np.uint32) if words else read  # half of a word's hash; a window has many words
            for key, base, entries in zip(batch.column(0).to_pylist(), first.tolist(), batch.column(2).to_pylist()):
                out += [{"g": e["g"], "key": key, "a": e["a"], "lo": e["lo"], "hi": e["hi"], "single": e["single"], "wide": e["wide"], "ctx": read[base + e["lo"] : base + e["hi"] + span].tobytes()} for e in entries]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, _CONTEXT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _CONTEXT)

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("g", "a", "lo", "hi", "single", "wide")).alias("entries"))  # of one text
    texts = likely_in(texts.select("key", "t"), "key", wanted.select("key"))  # most texts have none: they aren't shuffled
    return map_batches(texts.join(lists, "key"), run, "g long, key long, a long, lo long, hi long, single boolean, wide boolean, ctx binary")


_CONTEXT = pa.schema([("g", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("single", pa.bool_()), ("wide", pa.bool_()), ("ctx", pa.binary())])


def _merge(contexts: DataFrame, span: int, words: bool) -> DataFrame:
    """(key, lo, hi): runs of window starts that the merge finds repeated, for entries that occur once."""

    kind = np.uint32 if words else np.uint8

    def merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        g, key, a, lo, hi = (whole.column(k).to_numpy() for k in range(5))
        contexts = whole.column(7).to_pylist()
        keep = np.ones(len(g), bool)  # a text that several rows hold
        _, firsts = np.unique(np.column_stack([g, key, a, lo]), axis=0, return_index=True)
        keep[:] = False
        keep[firsts] = True
        i = np.flatnonzero(keep)
        found = repeated_windows(g[i], a[i], lo[i], hi[i], [contexts[k] for k in i], span, kind)
        found &= whole.column(5).to_numpy()[i][:, None]
        edge = np.zeros((len(i), span + 3), np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        r, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        shift = a[i][r] - span
        return pa.RecordBatch.from_pydict({"key": pa.array(key[i][r]), "lo": pa.array(begin + shift), "hi": pa.array(end - 1 + shift)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, group in by_group(batches):
            held += group
            rows += sum(h.num_rows for h in group)
            if rows >= MERGE_ROWS:
                yield merged(held)
                held, rows = [], 0
        if held:
            yield merged(held)

    return map_batches(contexts.repartition("g").sortWithinPartitions("g"), run, "key long, lo long, hi long")


def _deal(contexts: DataFrame, span: int, buckets: int, words: bool) -> DataFrame:
    """As _merge, for anchors with very many entries: each window goes to the bucket of its fingerprint, so that no task
    holds an anchor; a fingerprint that two places share is a repeat."""

    kind = np.uint32 if words else np.uint8

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ctx = part.column(7).to_pylist()
                lo, key, single = part.column(3).to_numpy(), part.column(1).to_numpy(), part.column(5).to_numpy(zero_copy_only=False)
                raw = np.frombuffer(b"".join(ctx), kind)
                pw, inverse = powers(BASE, len(raw)), powers(BASE_INV, len(raw))
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[: len(raw)], out=sums[1:])
                sizes = np.array([len(c) for c in ctx]) // raw.itemsize
                begin = np.cumsum(sizes) - sizes
                count = sizes - span + 1
                row = np.repeat(np.arange(len(ctx)), count)
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                place = begin[row] + inner
                h = mix64((sums[place + span] - sums[place]) * inverse[place])
                b = (mix64(h) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                cells = [x[order] for x in (h, key[row], lo[row] + inner, single[row].astype(np.uint8))]
                b = b[order]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b[i]) for i, _ in spans], pa.int64())} | {n: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for n, x in zip("hkps", cells)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_group(batches):
            h, key, start, single = (np.concatenate([np.frombuffer(v, d) for r in held for v in r.column(c).to_pylist()]) for c, d in ((1, np.uint64), (2, np.int64), (3, np.int64), (4, np.uint8)))
            order = np.lexsort((start, key, h))
            h, key, start, single = h[order], key[order], start[order], single[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1])
            h, key, start, single = h[keep], key[keep], start[keep], single[keep]
            run = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            use = (np.bincount(run)[run] > 1) & (single == 1)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[use]), "lo": pa.array(start[use]), "hi": pa.array(start[use])})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["h", "k", "p", "s"]).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["h"], np.int64)), pa.array(np.frombuffer(r["k"], np.int64)), pa.array(np.frombuffer(r["p"], np.int64)), pa.array(np.frombuffer(r["s"], np.uint8).astype(bool))], names=["h", "key", "lo", "single"])

    dealt = materialize(map_batches(contexts, windows, "bucket long, h binary, k binary, p binary, s binary"))
    heavy = materialize(dealt.groupBy("bucket").agg(F.sum(F.octet_length("h")).alias("n")).where(F.col("n") > 8 * HEAVY).select("bucket"))
    light = dealt.join(heavy, "bucket", "left_anti").select("bucket", *"hkps")
    out = map_batches(light.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket"), count, "key long, lo long, hi long")
    # in buckets of very many windows no task holds a fingerprint
    rows = map_batches(dealt.join(heavy, "bucket", "left_semi"), unpack, "h long, key long, lo long, single boolean")
    rows = materialize(rows.groupBy("h", "key", "lo").agg(F.max("single").alias("single")))
    again = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    return out.unionByName(rows.where("single").join(again, "h", "left_semi").select("key", "lo", F.col("lo").alias("hi")))


def _cut(rows: DataFrame, span: int, words: bool) -> DataFrame:
    """Remaining text, removed bytes and spans (in bytes) of texts (key, t, runs).  A cut may split a character: its bytes
    that stay show as the replacement character in rest, while sha is of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            _, first, starts, ends = symbols(batch.column(1), words)
            for key, text, runs, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), first.tolist()):
                spans: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"] + span) for r in runs):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                gone = sum(hi - lo for lo, hi in spans)
                if words:
                    spans = [[int(starts[at + lo]), int(ends[at + hi - 1])] for lo, hi in spans]
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append({"key": key, "removed": len(text) - len(rest), "symbols": gone, "spans": [{"start": a, "end": b} for a, b in spans], "rest": rest.decode("utf-8", "replace"), "sha": hashlib.sha256(rest).hexdigest()})
            if out:
                yield pa.RecordBatch.from_pylist(out, _CUT)

    return map_batches(rows, run, "key long, removed long, symbols long, spans array<struct<start: long, end: long>>, rest string, sha string")


_CUT = pa.schema([("key", pa.int64()), ("removed", pa.int64()), ("symbols", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rest", pa.string()), ("sha", pa.string())])


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _n_words(text):
    """Words of a text, as the operator counts them."""
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", words: bool = False) -> tuple[DataFrame, DataFrame]:
    """What repeats, by text: (copies, cut).

    copies: key (xxhash64 of a text), copies (rows with it), size (bytes).  A text of at least span symbols with several
    copies repeats as a whole and has no row in cut.  cut: key, removed (bytes), symbols (removed symbols), spans (bytes),
    rest (text), sha (of the bytes) for texts that lose some bytes.
    """
    rows = docs.select(_text(text_col).alias("t")).select(F.xxhash64("t").alias("key"), "t", F.octet_length("t").cast("long").alias("size"))
    copies = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")))
    total = (copies.agg(F.sum("size").alias("s")).first()["s"] or 0) // (4 if words else 1)
    buckets = max(1, -(-2 * total // ((span - gram) * BUCKET)))
    parsed = materialize(_parse(rows, span, gram, buckets, words))
    entries = materialize(_dictionary(parsed, span, buckets, GROUP_ROWS))
    discard(parsed)
    texts = rows.where(F.col("size") >= _least(span, words))
    merged = materialize(_merge(_contexts(texts, entries.where("not done and not wide"), span, words), span, words))
    tidy(docs.sparkSession)
    used = [entries, merged]
    runs = entries.where("done").select("key", "lo", "hi").unionByName(merged)
    wide = entries.where("not done and wide")
    if not wide.isEmpty():
        used.append(materialize(_deal(_contexts(texts, wide, span, words), span, buckets, words)))
        runs = runs.unionByName(used[-1])
    partial = materialize(runs.join(copies.where("copies > 1").select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    used.append(partial)
    tidy(docs.sparkSession)
    cut = materialize(_cut(likely_in(texts, "key", partial.select("key")).join(partial, "key").select("key", "t", "runs"), span, words))
    discard(*used)
    return copies, cut


def _whole(copies: DataFrame, span: int, words: bool) -> DataFrame:
    return copies.where((F.col("copies") > 1) & (F.col("size") >= _least(span, words))).select("key", F.lit(True).alias("all"))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", words: bool = False) -> DataFrame:
    """All columns of docs, with text_col without what repeats, and __n_bytes, __n_removed, __spans, __sha.

    Null texts count as empty and stay null.  The remaining bytes are cut at byte level: where a cut splits a character,
    the text shows the replacement character, while __sha is of the bytes.  With ``words``, span and gram count words, and a
    cut goes from the start of its first word to the end of its last.  A text shorter than span loses nothing.  Repeated
    rows are copies of one another and, from span on, lose the whole text.  An empty table gives no row.
    """
    copies, cut = repeats(docs, span, gram, text_col, words)
    text = _text(text_col)
    rows = docs.withColumn("__key", F.xxhash64(text)).withColumn("__n_bytes", F.octet_length(text).cast("long"))
    part = cut.select(F.col("key").alias("__key"), "removed", "spans", "rest", "sha")
    whole = _whole(copies, span, words).withColumnsRenamed({"key": "__key", "all": "__whole"})
    # most texts lose nothing: they aren't shuffled
    some, others = likely_split(rows, "__key", part.select("__key").unionByName(whole.select("__key")))
    out = some.join(whole, "__key", "left").join(part, "__key", "left")
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    full = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("__n_bytes").alias("end")))
    everything = F.col("__whole").isNotNull()
    if words:
        everything = F.when(everything, _n_words(text) >= span).otherwise(False)
    named = {
        text_col: F.when(everything, F.lit("")).when(F.col("sha").isNotNull(), F.col("rest")).otherwise(F.col(text_col)),
        "__n_removed": F.when(everything, F.col("__n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long"),
        "__spans": F.when(everything, full).otherwise(F.coalesce("spans", empty)),
        "__sha": F.when(everything, F.sha2(F.lit(""), 256)).when(F.col("sha").isNotNull(), F.col("sha")).otherwise(F.sha2(text, 256)),
    }
    keep = [c for c in docs.columns if c != text_col]
    same = {text_col: F.col(text_col), "__n_removed": F.lit(0).cast("long"), "__spans": empty, "__sha": F.sha2(text, 256)}
    out = out.select(*keep, "__n_bytes", *[v.alias(k) for k, v in named.items()]).unionByName(others.select(*keep, "__n_bytes", *[v.alias(k) for k, v in same.items()]))
    return out.select(*docs.columns, "__n_bytes", "__n_removed", "__spans", "__sha")


def op3_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, by strings of 400 bytes, and passage_words: how many words of the document lie in passages of
    over 50 words that also start elsewhere, many of which have fewer than 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    copies, cut = repeats(docs)
    _, passages = repeats(docs, WORD_SPAN, WORD_GRAM, words=True)
    text = _text("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"), _n_words(text).alias("n_words"))
    rows = rows.join(copies.where("copies > 1").select("key", F.lit(True).alias("all")), "key", "left")
    out = rows.join(cut.select("key", "removed", F.size("spans").alias("n"), "sha"), "key", "left").join(passages.select("key", "symbols"), "key", "left")
    every = F.col("all").isNotNull() & (F.col("n_bytes") >= SPAN)
    return out.select(
        "doc_id", "n_bytes",
        F.when(every, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(every, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
        F.when(F.col("all").isNotNull() & (F.col("n_words") >= WORD_SPAN), F.col("n_words")).otherwise(F.coalesce("symbols", F.lit(0))).cast("long").alias("passage_words"),
    )


QUERIES = {"op3_bwt_dedup": op3_bwt_dedup}
ORACLES: dict[str, str] = {}
