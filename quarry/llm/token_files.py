"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout of one dataset folder, for shard k:
``shard-k.ids``  token ids, little-endian, uint16 when the vocabulary allows it, else uint32
``shard-k.off``  int64, n_docs + 1 offsets in ids, from 0
``shard-k.doc``  int64, doc_id of each document (null: the smallest int64)
``manifest.json`` dtype, end_id and, for each shard, its files, documents, tokens and base (tokens of all shards before it)

Shards hold ascending ranges of doc_id, each sorted, so that base + offset is the global position.  Bases come from a
prefix sum of one count a shard.  A shard's files carry the task attempt in their name and are used only if the attempt
that wrote them delivered its count, so that a lost or repeated task cannot leave a mixed shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BASE, BASE_INV, MULT, map_batches, mix64, powers, shared_dir, table, utf8

NULL_ID = np.iinfo(np.int64).min
#: Chunks whose ids a worker keeps before it starts anew, and their bytes.  A cache only.
CACHE, CACHE_BYTES = 1_000_000, 1 << 25
#: Bytes of text whose chunks are looked up at once.
BLOCK = 1 << 20
_memo: dict[tuple[str, str], "Chunks"] = {}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def splits_at_spaces(path: str) -> bool:
    """Whether a space before another character always starts a new pre-token, as in byte-level BPE without normalizer."""
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")


@lru_cache(maxsize=2)
def id_bytes(path: str) -> np.ndarray:
    """Bytes that each id stands for, in a byte-level vocabulary."""
    vocab = tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for name, i in vocab.items():
        out[i] = len(name)
    return out


#: Bytes that are white space, and that are letters or digits, in ASCII.
_SPACE, _WORD = (np.array([k < 128 and test(chr(k)) for k in range(256)]) for test in (str.isspace, str.isalnum))


class Chunks:
    """Chunks that a worker has encoded, with their ids: a table of 64-bit hashes with linear probing.

    What is found by its hash is held against the chunk's own bytes, so that equal hashes never pass for equal chunks."""

    #: Kinds of chunks: a space before white space (a pre-token may cross it), a comma or full stop first, a letter or digit last.
    RUN, MARK, WORD = 1, 2, 4

    def __init__(self, path: str, dtype: np.dtype):
        self.path, self.known = path, 0
        self.slots = np.zeros(1 << 20, np.int32)  # number + 1 of a chunk, or 0
        self.hash, self.kind = np.zeros(1, np.uint64), np.zeros(1, np.uint8)
        self.raw, self.ids = np.zeros(1, np.uint8), np.zeros(1, dtype)
        self.raw_end, self.ids_end = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the chunks before each

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, numbers of ids and ids of chunks that stand side by side from the first start to the last end, and which
        of them have the hash of another one; new chunks are encoded."""
        raw, ends, starts = raw[starts[0] : ends[-1]], ends - starts[0], starts - starts[0]
        sizes = ends - starts
        power, inverse = _powers(len(raw))
        sums = np.cumsum((raw + np.uint64(1)) * power)
        before = np.concatenate([np.zeros(1, np.uint64), sums[ends[:-1] - 1]])
        hashes = mix64((sums[ends - 1] - before) * inverse[starts] + sizes.astype(np.uint64) * MULT)
        at = self._slot(hashes)
        if len(fresh := np.flatnonzero(at < 0)):
            _, first, where = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            first = fresh[first]
            at[fresh] = self.known + where
            self._add(raw, starts[first], ends[first], hashes[first])
        begin = self.raw_end.take(at)
        wrong = self.raw_end.take(at + 1) - begin != sizes
        begin -= starts
        place = np.repeat(begin, sizes)
        place += np.arange(len(raw))
        differ = np.flatnonzero(self.raw.take(place, mode="clip") != raw)
        if len(differ):
            wrong[np.searchsorted(ends, differ, side="right")] = True
        begin = self.ids_end.take(at)
        count = self.ids_end.take(at + 1) - begin
        after = np.cumsum(count)
        begin -= after - count
        place = np.repeat(begin, count)
        place += np.arange(len(place))
        return self.kind.take(at), count, self.ids.take(place), wrong

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the chunks with these hashes, -1 where there is none."""
        last = len(self.slots) - 1
        place = (hashes & np.uint64(last)).astype(np.int64)
        at = self.slots.take(place).astype(np.int64) - 1
        todo = np.flatnonzero((at >= 0) & (self.hash.take(at, mode="clip") != hashes))
        while len(todo):
            place[todo] = (place[todo] + 1) & last
            at[todo] = self.slots[place[todo]].astype(np.int64) - 1
            todo = todo[(at[todo] >= 0) & (self.hash.take(at[todo], mode="clip") != hashes[todo])]
        return at

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        last = len(self.slots) - 1
        place = (hashes & np.uint64(last)).astype(np.int64)
        while len(place):
            free = self.slots[place] == 0
            self.slots[place[free]] = numbers[free] + 1
            left = self.slots[place] != numbers + 1
            place, numbers = (place[left] + 1) & last, numbers[left]

    def _add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        n, old, tok = len(starts), self.known, tokenizer(self.path)
        whole, sizes = raw.tobytes(), ends - starts
        texts = [whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        first, second, final = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)], raw[ends - 1]
        blank, word = (sizes == 1) | _SPACE[second], _WORD[final]
        for k in np.flatnonzero((first == 32) & (sizes > 1) & (second > 127)).tolist():
            blank[k] = texts[k][1].isspace()
        for k in np.flatnonzero(final > 127).tolist():
            word[k] = texts[k][-1].isalnum()
        run = (first == 32) & blank
        kinds = run * self.RUN + ((first == 44) | (first == 46)) * self.MARK + word * self.WORD
        # Chunks side by side encode as each alone; their ends are where the bytes of the ids have summed to theirs.
        lengths, counts, found = id_bytes(self.path), np.zeros(n, np.int64), []
        spaced, alone = np.flatnonzero((first == 32) & ~run), np.flatnonzero((first != 32) | run)
        for at in range(0, len(spaced), 500):
            some = spaced[at : at + 500]
            ids = np.array(tok.encode_batch_fast(["".join([texts[k] for k in some.tolist()])], add_special_tokens=False)[0].ids, self.ids.dtype)
            counts[some] = np.diff(np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes[some])) + 1, prepend=0)
            found.append(ids)
        rows = [e.ids for e in tok.encode_batch_fast([texts[k] for k in alone.tolist()], add_special_tokens=False)]
        counts[alone] = [len(x) for x in rows]
        found.append(np.array(list(chain.from_iterable(rows)), self.ids.dtype))
        order = np.concatenate([spaced, alone])
        begin = np.empty(n, np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        self.ids, self.ids_end = self._append(self.ids, self.ids_end, np.concatenate(found), begin, counts)
        self.raw, self.raw_end = self._append(self.raw, self.raw_end, raw, starts, sizes)
        self.hash, self.kind = _room(self.hash, old + n), _room(self.kind, old + n)
        self.hash[old : old + n], self.kind[old : old + n] = hashes, kinds
        self.known = old + n
        if 2 * self.known > len(self.slots):
            self.slots = np.zeros(1 << (4 * self.known).bit_length(), np.int32)
            self._put(self.hash[: self.known], np.arange(self.known))
        else:
            self._put(hashes, np.arange(old, old + n))

    def _append(self, values: np.ndarray, ends: np.ndarray, more: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values with those of ``more`` from each begin on behind them, and where the values of each chunk end."""
        old, total, after = self.known, int(ends[self.known]), np.cumsum(sizes)
        values, ends = _room(values, total + int(after[-1])), _room(ends, old + len(sizes) + 1)
        values[total : total + after[-1]] = more[np.repeat(begin - after + sizes, sizes) + np.arange(after[-1])]
        ends[old + 1 : old + len(sizes) + 1] = total + after
        return values, ends


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one at least twice as long that begins with it, if it has fewer than size places."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


_power: list[np.ndarray] = [powers(BASE, 0), powers(BASE_INV, 0)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of hashes, and of its inverse."""
    if n > 4 * BLOCK:  # one very long chunk
        return powers(BASE, n)[:n], powers(BASE_INV, n)[:n]
    if n > len(_power[0]):
        _power[:] = powers(BASE, 2 * n), powers(BASE_INV, 2 * n)
    return _power[0][:n], _power[1][:n]


def encode_texts(path: str, texts: list[str], dtype: np.dtype) -> list[bytes]:
    """encode_column() of a list, as the packed ids of each text."""
    ids, ends = encode_column(path, pa.array(texts, pa.large_string()), dtype)
    raw, cuts = ids.tobytes(), (ends * dtype.itemsize).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def encode_column(path: str, texts: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all whole texts (null: empty), as the library's encode(text, add_special_tokens=False), and n + 1 offsets.

    Where pre-tokens never cross a space that stands before another character, the distinct chunks between such spaces are
    encoded once each and kept; texts with runs of spaces or what looks like a special token go whole.  Chunks also begin at
    commas and full stops, in texts where these only stand after letters and digits, so that a pre-token starts there.
    """
    todo, rows = np.arange(len(texts)), [np.zeros(0, dtype)] * len(texts)
    if splits_at_spaces(path):
        for marks in (True, False):
            todo = _encode_chunks(path, texts, dtype, todo, marks, rows)
    for k, e in zip(todo.tolist(), tokenizer(path).encode_batch_fast([texts[k].as_py() or "" for k in todo.tolist()], add_special_tokens=False)):
        rows[k] = np.array(e.ids, dtype)
    return np.concatenate(rows) if rows else np.zeros(0, dtype), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


def _encode_chunks(path: str, texts: pa.Array, dtype: np.dtype, todo: np.ndarray, marks: bool, rows: list[np.ndarray]) -> np.ndarray:
    """Sets the rows of texts that may be encoded by their chunks, and gives the other texts of todo."""
    raw, offsets = utf8(texts if len(todo) == len(texts) else texts.take(pa.array(todo)))
    if not len(raw):
        return todo[:0]
    memo = _memo.get((path, dtype.str))
    if memo is None or memo.known > CACHE or memo.raw_end[memo.known] > CACHE_BYTES:
        memo = _memo[path, dtype.str] = Chunks(path, dtype)
    cut = raw == 32
    if marks:
        cut |= (raw == 44) | (raw == 46)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))
    found, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        found.append(memo.find(raw, starts[at:to], ends[at:to]))
        at = to
    kinds, counts, ids, wrong = (np.concatenate(x) for x in zip(*found))
    bounds = np.searchsorted(starts, offsets)  # of each text's chunks
    odd = wrong | (kinds & Chunks.RUN > 0)
    if marks:
        after = np.zeros(len(kinds), bool)  # whether a chunk stands after a letter or digit of its text
        after[1:] = kinds[:-1] & Chunks.WORD > 0
        after[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
        odd |= (kinds & Chunks.MARK > 0) & ~after
    special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
    bad = np.searchsorted(np.flatnonzero(odd), bounds)
    bad = (bad[1:] > bad[:-1]) | np.isin(np.arange(len(todo)), np.searchsorted(offsets, special, side="right") - 1)
    cuts = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
    for k, a, b, no in zip(todo.tolist(), cuts[:-1], cuts[1:], bad.tolist()):
        if not no:
            rows[k] = ids[a:b]
    return todo[bad]


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode whole texts (null: empty) and write them in ascending order of id_col (nulls first, ties by text).

    Returns the manifest, which is also written.  Repeated ids are kept, one document each; an empty table gives no shard.
    Columns other than the two are ignored.  The driver receives one row a shard.
    """
    width = "uint16" if max(tokenizer(tokenizer_path).get_vocab_size(), end_id or 0) <= 0xFFFF else "uint32"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(width).newbyteorder("<")
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, root = pafs.FileSystem.from_uri(out)
        ids_file, ids, lengths = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_file is None:
                fs.create_dir(root, recursive=True)
                ids_file = fs.open_output_stream(f"{root}/{name}.ids")
            ids.append(batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8"))
            got, ends = encode_column(tokenizer_path, batch.column(1), dtype)
            if end_id is not None:
                got, ends = np.insert(got, ends[1:], end_id), ends + np.arange(len(ends))
            lengths += np.diff(ends).tolist()
            ids_file.write(got.tobytes())
        total = sum(lengths)
        if ids_file is None:
            return
        ids_file.close()
        with fs.open_output_stream(f"{root}/{name}.off") as f:
            f.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())
        with fs.open_output_stream(f"{root}/{name}.doc") as f:
            f.write(np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int64()), "name": pa.array([name]), "docs": pa.array([len(lengths)], pa.int64()), "tokens": pa.array([total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    shards = sorted(map_batches(rows, encode, "shard long, name string, docs long, tokens long").collect())
    base, listed = 0, []
    for s in shards:
        listed.append({"name": s["name"], "docs": s["docs"], "tokens": s["tokens"], "base": base})
        base += s["tokens"]
    manifest = {"dtype": width, "end_id": end_id, "tokens": base, "shards": listed}
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def map_file(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (global), tokens (array) of every document of a dataset folder, one task a shard."""
    return _scan(spark, out, "doc_id long, start long, tokens array<int>", lambda ids, off, doc, base: {
        "doc_id": _ids(doc),
        "start": pa.array(base + off[:-1], pa.int64()),
        "tokens": pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(ids.astype(np.int32))),
    })


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32, read from a dataset folder."""

    def digest(ids: np.ndarray, off: np.ndarray, doc: np.ndarray, base: int) -> dict:
        wide, at = ids.astype("<u4"), off - off[0]
        return {
            "doc_id": _ids(doc),
            "start": pa.array(base + off[:-1], pa.int64()),
            "n_tokens": pa.array(np.diff(off), pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
        }

    return _scan(spark, out, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _ids(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=np.asarray(doc == NULL_ID))


def _scan(spark: SparkSession, out: str, schema: str, build) -> DataFrame:
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = np.dtype(manifest["dtype"]).newbyteorder("<").str

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, off, doc = (map_file(fs, f"{root}/{name}.{x}", d) for x, d in (("ids", dtype), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 1000):
                    o = np.asarray(off[at : at + 1001])
                    yield pa.RecordBatch.from_pydict(build(np.asarray(ids[o[0] : o[-1]]), o, np.asarray(doc[at : at + 1000]), base))

    shards = [(s["name"], s["base"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "name string, base long")
    return map_batches(listed.repartition(max(1, len(shards)), "name") if len(shards) > 1 else listed, read, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, out)


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
