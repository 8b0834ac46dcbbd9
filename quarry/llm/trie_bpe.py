"""BPE encoding and decoding by prefix-sharing trie traversal.

For byte-pair encoding the last token of every prefix of a word is determined by the last tokens of its shorter prefixes:
it is the one vocabulary token t that ends the prefix such that t, and the last token of what stands before t, stay two
tokens when encoded side by side.  Distinct words go into a trie; a depth-first walk sets the last token of every node
once, whichever and however many words share that prefix.  A word's ids are read off backwards from its end node.

The trie is held as its depth-first order: the sorted distinct words, each entering the walk at the depth of the prefix it
shares with the word before.  Word ends carry the end-of-word suffix, which makes an end node a child of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, table

#: Words of one generation whose ids a worker keeps.  A cache only; workers outlive a stage, so it stays small.
CACHE = 120_000
#: Unicode White_Space, as the normalizer's pattern has it.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Texts of these characters only are normalized here; others by the library, whose Unicode tables count.
_PLAIN = regex.compile(r"[\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0132-\u017f\u2010-\u2027]*")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class TrieBPE:
    """Encoder for a BPE tokenizer file; immutable but for its caches."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        for option in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"):
            if model.get(option):
                raise ValueError(f"not supported: {option}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.name = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.added.items()}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]) or spec.get("decoder"):
            raise ValueError("not supported: added tokens that strip, or a decoder")
        self.split_added = regex.compile("(" + "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        pre = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", _WHITE[1:-1]))
        self.bytes = byte_characters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Rank of a token: base symbols first, then the order of merges.
        merged = {self.vocab[a + b] for a, b in pairs}
        base = [v for v in self.vocab.values() if v not in merged]
        self.rank = {v: i for i, v in enumerate(base)}
        self.parts: dict[int, tuple[int, int]] = {v: (v, v) for v in base}
        self.merge: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            new = self.vocab[a + b]
            if new in self.parts:
                raise ValueError("not supported: a token that two merges make")
            self.rank[new] = len(self.rank)
            self.parts[new] = (self.vocab[a], self.vocab[b])
            self.merge[(self.vocab[a], self.vocab[b])] = new
        #: Tokens inside words and at their ends, by their characters.
        self.inner = {k: v for k, v in self.vocab.items() if not (self.suffix and k.endswith(self.suffix) and len(k) > len(self.suffix))}
        self.final = {k[: -len(self.suffix)]: v for k, v in self.vocab.items() if k.endswith(self.suffix) and len(k) > len(self.suffix)} if self.suffix else self.inner
        self.longest = max(map(len, self.vocab))
        self.length = {v: len(k) for k, v in self.inner.items()} | {v: len(k) for k, v in self.final.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their characters are encoded together."""
        key = (left, right)
        if key in self.beside:
            return self.beside[key]
        # Undo merges, the later one first: a pair that could merge earlier than the merges undone so far would have.
        a, b, limit = left, right, len(self.rank) + 1
        ok = None
        while ok is None:
            joint = self.merge.get((a, b))
            if joint is not None and self.rank[joint] < limit:
                ok = False
            elif self.rank[a] > self.rank[b]:
                limit, was = self.rank[a], a
                a = self.parts[a][1]
                if a == was:
                    limit, was = self.rank[b] + 1, b
                    b = self.parts[b][0]
                    if b == was:
                        ok = True
            else:
                limit, was = self.rank[b] + 1, b
                b = self.parts[b][0]
                if b == was:
                    limit, was = self.rank[a], a
                    a = self.parts[a][1]
                    if a == was:
                        ok = True
        if len(self.beside) > 5 * self.cache:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def last_token(self, text: str, end: int, tokens: dict[str, int], last: list[int]) -> int:
        """The last token of text[:end], where last[n] is that of text[:n] for shorter n."""
        for start in range(max(0, end - self.longest), end):
            token = tokens.get(text[start:end])
            if token is not None and (start == 0 or self.stay_apart(last[start], token)):
                return token
        raise ValueError(f"no token ends {text[:end]!r}")

    def walk(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in byte characters) by one depth-first walk of their trie."""
        out: dict[str, list[int]] = {}
        last, before, known = [0], "", 0
        for word in sorted(words):
            shared, most = 0, min(known, len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word)):  # inner nodes below the shared prefix
                last.append(self.last_token(word, end, self.inner, last))
            before, known = word, max(len(word) - 1, 0)
            token, at, ids = self.last_token(word, len(word), self.final, last), len(word), []
            while True:
                ids.append(token)
                at -= self.length[token]
                if not at:
                    break
                token = last[at]
            out[word] = ids[::-1]
        return out

    def normalize(self, text: str) -> str:
        if _PLAIN.fullmatch(text):
            return text.lower()  # composed already; the pieces don't depend on which white space parts them
        return self.library.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """Pieces of a text in order; added tokens stand as themselves after a zero byte."""
        if self.split_added is None or "<|" not in text and not self.split_added.search(text):
            return self.pieces.findall(self.normalize(text))
        out: list[str] = []
        for k, part in enumerate(self.split_added.split(text)):
            out += ["\0" + part] if k % 2 else self.pieces.findall(self.normalize(part))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't known yet."""
        if len(self.memo) > self.cache:  # what comes again moves on from the last generation
            self.old, self.memo = self.memo, {}
        for p in pieces - self.memo.keys() & self.old.keys():
            self.memo[p] = self.old[p]
        new = list(pieces - self.memo.keys())
        plain = {p: p if p.isascii() and p.isprintable() else "".join([self.bytes[b] for b in p.encode()]) for p in new if p[0] != "\0"}
        ids = self.walk(list(set(plain.values())))
        for p in new:
            row = [self.added[p[1:]]] if p[0] == "\0" else ids[plain[p]]
            self.memo[p] = (len(row), " ".join(map(str, row)), " ".join([self.name[i] for i in row]))

    def forget(self) -> None:
        """Give up the caches: workers outlive a stage, and the next one needs their memory."""
        self.memo, self.old, self.beside = {}, {}, {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        self.learn({p for words in split for p in words})
        return [np.array(" ".join([self.memo[p][1] for p in words]).split(), np.int32).tolist() for words in split]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a file without decoder: names joined by spaces."""
        return " ".join([self.name[i] for i in ids if i in self.name])


@lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE) -> TrieBPE:
    return TrieBPE(path, cache)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(1).fill_null("").to_pylist()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, token_ids (array), decoded: the ids of each whole text (null: empty) and their decoded text.

    Rows with repeated or null ids stay as they are, one row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for part, texts in _texts(batches):
            split = [bpe.words(t) for t in texts]
            bpe.learn({p for words in split for p in words})
            ids = [np.array(" ".join([bpe.memo[p][1] for p in words]).split(), np.int32) for words in split]
            names = [" ".join([bpe.memo[p][2] for p in words]) for words in split]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_pydict({id_col: part.column(0), "token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "decoded": pa.array(names, pa.string())})
        bpe.forget()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, f"{rows.schema[0].simpleString().replace(':', ' ')}, token_ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 2 * CACHE) -> DataFrame:
    """Digests of what encode_documents() gives, from the same walk, joined piece by piece: id_col, n_tokens, ids_sha256
    (of decimal ids joined by one space), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path, cache)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part, texts in _texts(batches):
            split = [bpe.words(t) for t in texts]
            bpe.learn({p for words in split for p in words})
            counts, ids, names = [], [], []
            for words in split:
                got = [bpe.memo[p] for p in words]
                counts.append(sum([g[0] for g in got]))
                ids.append(sha(" ".join([g[1] for g in got])))
                names.append(sha(" ".join([g[2] for g in got])))
            yield pa.RecordBatch.from_pydict({id_col: part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(names)})

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, f"{rows.schema[0].simpleString().replace(':', ' ')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_trie_bpe": op5_trie_bpe}
ORACLES: dict[str, str] = {}
