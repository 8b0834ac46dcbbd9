import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward, empty, prose
from pyspark.sql import functions as F

from quarry.llm import common, token_files
from quarry.llm.token_files import encode_texts, read_token_files, token_digests, tokenizer, write_token_files
from quarry.llm.trie_bpe import encode_digests, encode_documents, encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = "abcdeèéßÄÖİıΣσς '’stvemll<|>/w0123½٣中文か́é \x1c\x85​﻿\U0001f600\t\n.,!?-—…"


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["a\n \nb", "<|endoftext|>", "x <|endoftext|> y", "", " ", "  a  b ", "don't I'LL 'S"]


def test_chunks_encode_as_whole_texts():
    texts = noise(5000) + [prose(k, 200) + ", a.b" for k in range(50)]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert encode_texts(BYTE, texts, np.dtype("<u2")) == want


def test_known_chunks_reach_the_library_once(monkeypatch):
    texts = [f" {prose(k, 60)}\n" for k in range(20)] + ["outer \0 nul, and a mark.\n", "", "é.\nß, x"] + [prose(k, 40) for k in range(5)]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer(BYTE).encode_batch(texts, add_special_tokens=False)]
    asked = []

    class Spy:
        def encode_batch_fast(self, rows, **options):
            asked.extend(rows)
            return tokenizer(BYTE).encode_batch_fast(rows, **options)

    monkeypatch.setattr(token_files, "_memo", {})
    assert encode_texts(BYTE, texts, np.dtype("<u2")) == want
    monkeypatch.setattr(token_files, "tokenizer", lambda path: Spy())
    assert encode_texts(BYTE, texts, np.dtype("<u2")) == want and not asked


@pytest.mark.parametrize("kept", [0xFF, 0xFFFFF])
def test_chunks_of_one_hash_or_of_many_blocks_stay_apart(monkeypatch, kept):
    texts = noise(800, 3) + [prose(k, 200) + ", a.b" for k in range(20)] + [None, "", " ", "a" * 5000 + " b", "\x1c.\x85 ,\u2003x \u3000y ٣.", "a\x1c b", "a \x1cb", "x\n\n y \n", "e,,f", ".a", "9.5 ½. ²,"]
    want = [np.array(e.ids, "<u2").tolist() for e in tokenizer(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr(token_files, "_memo", {})
    monkeypatch.setattr(token_files, "mix64", lambda x: x & np.uint64(kept))
    monkeypatch.setattr(token_files, "BLOCK", 700)
    for _ in range(2):
        ids, ends = token_files.encode_column(BYTE, pa.array(texts, pa.string()), np.dtype("<u2"))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    ids, ends = token_files.encode_column(BYTE, pa.array(texts, pa.string())[5:9], np.dtype("<u2"))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want[5:9]


def test_long_chunks_are_not_kept_for_ever(monkeypatch):
    monkeypatch.setattr(token_files, "_memo", {})
    monkeypatch.setattr(token_files, "CACHE_BYTES", 10_000)
    texts = ["".join(random.Random(k).choices("abcdefgh", k=4000)) + " x" for k in range(20)]
    for text in texts:
        assert encode_texts(BYTE, [text], np.dtype("<u2")) == [np.array(tokenizer(BYTE).encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
        (memo,) = token_files._memo.values()
        assert memo.raw_end[memo.known] < 15_000


def test_files_round_trip(spark, tmp_path):
    docs = awkward(spark, [(k, prose(k)) for k in range(300)] + [(None, "no id")]).repartition(5)
    out = f"file://{tmp_path}/d"
    manifest = write_token_files(docs, out, BYTE)
    got = {}
    start = 0
    rows = sorted(read_token_files(spark, out).collect(), key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
    for r in rows:
        assert r["start"] == start
        start += len(r["tokens"])
        got.setdefault(r["doc_id"], []).append(list(r["tokens"]))
    assert manifest["tokens"] == start
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(tokenizer(BYTE).encode(r["text"] or "", add_special_tokens=False).ids + [2])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    digests = {(r["doc_id"], r["start"]): r for r in token_digests(spark, out).collect()}
    for r in rows:
        d = digests[(r["doc_id"], r["start"])]
        assert d["n_tokens"] == len(r["tokens"]) and d["ids_crc32"] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())


def test_files_of_an_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/d"
    assert write_token_files(empty(spark), out, BYTE)["shards"] == []
    assert token_digests(spark, out).count() == 0


def test_trie_equals_the_library():
    bpe, texts = encoder(WORD), noise(5000, 2) + [prose(k, 100) for k in range(50)]
    got = bpe.encode_batch(texts)
    want = [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [bpe.decode(g) for g in got[:500]] == [bpe.library.decode(g, skip_special_tokens=False) for g in got[:500]]


def test_shared_prefixes_are_computed_once(monkeypatch):
    bpe, calls = encoder(WORD), []
    inner = bpe.last_token
    monkeypatch.setattr(bpe, "last_token", lambda *a: calls.append(a[0][: a[1]]) or inner(*a))
    bpe.walk(["overtaking", "overtake", "overtakes", "over"])
    prefixes = [c for c in calls if c == "overta"]
    assert len(prefixes) == 1


def test_encode_tables(spark):
    docs = awkward(spark, [(None, "No Id")])
    bpe = encoder(WORD)
    rows = encode_documents(docs, WORD).collect()
    assert len(rows) == docs.count()
    want = sorted((str(r["doc_id"]), bpe.library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r["doc_id"]), list(r["token_ids"])) for r in rows) == want
    import hashlib

    digests = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in encode_digests(docs, WORD).collect())
    assert digests == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want)
    decoded = {i: hashlib.sha256(bpe.library.decode(x, skip_special_tokens=False).encode()).hexdigest() for i, x in want}
    assert all(r["decoded_sha256"] == decoded[str(r["doc_id"])] for r in encode_digests(docs, WORD).collect())
    assert encode_digests(empty(spark), WORD).count() == 0


def test_words_and_shingles():
    import pyarrow as pa

    raw, offsets = common.utf8(pa.array([None, "Ab  c", "", "d\x0be f", "É\xa0x"]))
    starts, ends, hashes, first = common.words_of(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == ["Ab", "c", "d", "e", "f", "É\xa0x"]
    assert first.tolist() == [0, 0, 2, 2, 5, 6]
    grams, at = common.ngram_hashes(hashes, first, 2)
    assert np.diff(at).tolist() == [0, 1, 0, 2, 1]
    assert len(set(grams.tolist())) == len(grams)


def test_long_words_hash_by_content():
    import pyarrow as pa

    for n in (63, 64, 65, 500):
        raw, offsets = common.utf8(pa.array(["a" * n + " b", "b " + "A" * n, "a" * (n + 1)]))
        h = common.words_of(raw, offsets)[2]
        assert h[0] == h[3] and h[1] == h[2] and h[4] != h[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5)] + [(k, k + 1) for k in range(100, 180)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[1] == 1 and got[11] == 10 and got[180] == 100 and got[559] == 500 and 5 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefilter_keeps_all_wanted(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "k").withColumn("v", F.lit("x"))
    wanted = rows.where("k % 97 = 0").select("k")
    kept = common.likely_in(rows, "k", wanted)
    assert kept.join(wanted, "k", "left_semi").count() == wanted.count()
    assert kept.count() < 200 and kept.columns == rows.columns
    assert common.likely_in(rows, "k", wanted.where("k < 0")).count() == 0


def test_materialized_tables_stand_in_the_shared_folder(spark):
    df = common.materialize(spark.range(3))
    assert df.count() == 3 and df._quarry_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._quarry_path).count()
