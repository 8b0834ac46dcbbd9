import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty, prose

from quarry.llm import bwt_dedup, embedding_dedup, jaccard_join, string_tiling
from quarry.operators.graph_index import Graph


def near_copies(n=40, seed=0):
    """Families of texts with a few words changed, passages that many share, and a word list that differs by its end."""
    r = random.Random(seed)
    passage = prose(777, 30)
    rows = []
    for family in range(6):
        words = prose(1000 + family, 60 + 40 * family).split()
        for k in range(n // 6):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words) + str(r.randint(0, 9))
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, prose(2000 + k, 40) + " " + passage) for k in range(30)]
    start = len(rows)
    rows += [(start + k, " ".join(f"w{j}" for j in range(k, k + 60))) for k in range(25)]  # links chain
    return rows


def sets_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components_by_hand(rows, num=80, den=100):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_by_hand(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_against_all_pairs(spark, seed):
    docs = awkward(spark, near_copies(seed=seed)).repartition(4)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = components_by_hand(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert sizes == {(i, len(sets_by_hand(t))) for i, t in rows}


def test_jaccard_large_families_and_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_COUNT", 3)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 4)
    rows = near_copies(60, seed=3)
    rows += [(rows[0][0], prose(8000, 60)), (500, prose(8000, 60) + " x")]  # an id with two texts
    docs = awkward(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_keep_one(spark):
    docs = awkward(spark, near_copies() + [(None, prose(6)), (None, "z")])
    kept = jaccard_join.keep_one(docs)
    want = components_by_hand([(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()])
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want.items() if i == c)
    assert ids.count(None) == 2 and kept.columns == docs.columns
    assert jaccard_join.keep_one(empty(spark)).count() == 0
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_bit_counts_bound_the_overlap():
    r = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(r.integers(0, 400, r.integers(1, 200))).astype(np.uint64)
        y = np.unique(r.integers(0, 400, r.integers(1, 200))).astype(np.uint64)
        bits = jaccard_join.bitmap_bits(min(len(x), len(y)))
        maps = [jaccard_join.folded(jaccard_join.bitmap(z, jaccard_join.bitmap_bits(len(z))), bits) for z in (x, y)]
        differ = sum(int(a ^ b).bit_count() for a, b in zip(maps[0].tolist(), maps[1].tolist()))
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2


def cut_by_hand(texts, span):
    count = {}
    for b in texts:
        for k in range(len(b) - span + 1):
            count[b[k : k + span]] = count.get(b[k : k + span], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if count[b[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""))
    return out


def passages(seed=0):
    r = random.Random(seed)
    pool = [prose(3000 + k, 120) for k in range(6)]
    rows = []
    for k in range(40):
        p = r.choice(pool)
        a = r.randrange(0, len(p) // 2)
        rows.append((k, prose(4000 + k, r.randint(5, 80)) + p[a : a + r.randint(300, 700)] + prose(5000 + k, 30)))
    rows += [(45, prose(1, 20) + "é" + pool[0] + "é" + prose(2, 9)), (46, prose(3, 20) + "è" + pool[0] + "è" + prose(4, 9))]  # cuts within characters
    return rows + [(50, "ab" * 700), (51, "é" * 500), (52, prose(3000, 120)), (53, "x" * 400), (54, "x" * 399)]


@pytest.mark.parametrize("span, gram, limit", [(400, 40, 65_536), (60, 8, 65_536), (60, 59, 65_536), (400, 40, 3), (60, 8, 1)])
def test_repeats_against_all_windows(spark, monkeypatch, span, gram, limit):
    monkeypatch.setattr(bwt_dedup, "GROUP_ROWS", limit)
    docs = awkward(spark, passages()).repartition(3)
    rows = docs.collect()
    want = cut_by_hand([(r["text"] or "").encode() for r in rows], span)
    got = bwt_dedup.remove_repeats(docs, span, gram).collect()
    assert len(got) == len(rows)
    key = lambda i, x: (i, *x)
    expected = sorted(key(r["doc_id"], (n, g, s, hashlib.sha256(k).hexdigest())) for r, (n, g, s, k) in zip(rows, want))
    assert sorted((r["doc_id"], r["__n_bytes"], r["__n_removed"], len(r["__spans"]), r["__sha"]) for r in got) == expected
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["__spans"]) == r["__n_removed"]
    assert [r["text"] for r in got if r["doc_id"] == 900] == [None]


def words_by_hand(texts, span):
    """Removed bytes and spans of each text, by all windows of span words."""
    found = [[(m.start(), m.end(), m.group().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in texts]
    count = Counter(tuple(x[2] for x in f[k : k + span]) for f in found for k in range(len(f) - span + 1))
    out = []
    for b, f in zip(texts, found):
        gone = np.zeros(len(b) + 1, bool)
        marked = {j for k in range(len(f) - span + 1) if count[tuple(x[2] for x in f[k : k + span])] > 1 for j in range(k, k + span)}
        for j in marked:
            gone[f[j][0] : f[j + 1][0] if j + 1 in marked else f[j][1]] = True
        if len(marked) == len(f) and texts.count(b) > 1 and f and len(f) >= span:
            gone[: len(b)] = True
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), len(marked)))
    return out


def planted(seed=0):
    """Passages of 50 to 80 words, told apart only by case and white space, in documents of their own words."""
    rows = []
    for k in range(24):
        n = 50 + k // 2 * 3 % 31
        p = prose(6000 + k // 2, n)
        p = p.replace(" ", "\n").upper() if k % 2 and k % 3 == 0 else p
        rows.append((2000 + k, prose(7000 + k, 40) + " " + p + " " + prose(8000 + k, 60)))
    return [*rows, (2100, prose(6000, 50)), (2101, prose(6000, 51)), (2102, " " + prose(6100, 51) + " "), (2103, " " + prose(6100, 51) + " ")]


def test_buckets_of_very_many_entries(spark, monkeypatch):
    """The same result where no task reads a bucket whole, with anchors merged and with windows dealt out."""
    docs = awkward(spark, passages()).repartition(3)
    want = sorted(map(str, bwt_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(bwt_dedup, "HEAVY", 20)
    assert sorted(map(str, bwt_dedup.remove_repeats(docs).collect())) == want
    monkeypatch.setattr(bwt_dedup, "GROUP_ROWS", 2)
    assert sorted(map(str, bwt_dedup.remove_repeats(docs).collect())) == want


def test_tiles_of_many_large_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3, k, 10 + k % 4) for k in range(300)] + [(9, 900, 5), (9, 901, 5)], "g long, key long, size long")
    count = lambda: sorted((r["g"], r["tile"], r["key"]) for r in jaccard_join.tiled(rows, "g", 80, 100, 20).collect())
    few = count()
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert count() == few and {k for _, _, k in few} == {*range(300), 900, 901}
    meet = {(g, a) for g, t, a in few}
    assert len(meet) == 302


@pytest.mark.parametrize("span, gram, limit", [(51, 5, 65_536), (51, 5, 2), (12, 3, 65_536), (6, 5, 1)])
def test_repeated_words_against_all_windows(spark, monkeypatch, span, gram, limit):
    monkeypatch.setattr(bwt_dedup, "GROUP_ROWS", limit)
    docs = awkward(spark, planted()).repartition(3)
    rows = docs.collect()
    want = words_by_hand([(r["text"] or "").encode() for r in rows], span)
    got = bwt_dedup.remove_repeats(docs, span, gram, words=True).collect()
    expected = sorted((r["doc_id"], g, s) for r, (g, s, _) in zip(rows, want))
    assert sorted((r["doc_id"], r["__n_removed"], len(r["__spans"])) for r in got) == expected
    if span == 51:
        cut = {r["doc_id"] for r in got if r["__n_removed"]}
        assert {2000 + k for k in range(24) if 50 + k // 2 * 3 % 31 > 50} <= cut and 2100 not in cut and {2102, 2103} <= cut


def test_query_counts_words_of_passages(spark, tmp_path):
    docs = awkward(spark, planted())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = sorted((r["doc_id"], n, g, s, hashlib.sha256(k).hexdigest(), w) for r, (n, g, s, k), (_, _, w) in zip(rows, cut_by_hand(texts, 400), words_by_hand(texts, 51)))
    assert sorted(map(tuple, bwt_dedup.op3_bwt_dedup(spark, str(tmp_path)).collect())) == want


def test_repeats_of_an_empty_table(spark):
    out = bwt_dedup.remove_repeats(empty(spark))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "text", "lang", "source"]


def test_merge_order_does_not_matter():
    r = np.random.default_rng(1)
    base = r.integers(97, 100, 40).astype(np.uint8).tobytes()
    rows = [(0, 10, 4, 8, base[4:28]), (0, 10, 5, 7, base[5:27]), (0, 10, 2, 8, b"zz" + base[4:28]), (1, 10, 4, 8, base[4:28][::-1])]
    for order in ([0, 1, 2, 3], [2, 0, 1, 3], [1, 2, 0, 3]):
        some = [rows[k] for k in order]
        got = bwt_dedup.repeated_windows(*(np.array([s[c] for s in some]) for c in range(4)), [s[4] for s in some], span=20)
        for s, row in zip(some, got):
            starts = {c - 20 + s[1] for c in np.flatnonzero(row)}
            assert starts <= set(range(s[2], s[3] + 1))
            if s[0] == 1:
                assert not starts


def vectors(spark, n=400):
    r = np.random.default_rng(2)
    rows = []
    for k in range(n):
        v = r.normal(size=16)
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    for family in range(4):
        centre = r.normal(size=16)
        for _ in range(30):
            rows.append((len(rows), (centre + 0.05 * r.normal(size=16)).astype(np.float32).tolist(), 0))
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [None] + [1.0] * 15, 0), (5004, rows[0][1], None), (5005, [1.0, 2.0], 0), (5006, [], 0), (None, rows[0][1], 0), (5007, rows[0][1], rows[0][2]), (3, rows[3][1], 0)]
    return rows, spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, id string, a int")


@pytest.mark.parametrize("lot", [8, 1])
def test_embeddings_against_all_pairs(spark, monkeypatch, lot):
    monkeypatch.setattr(embedding_dedup, "LOT_BLOCKS", lot)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 32)
    rows, df = vectors(spark)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df.repartition(3), shard_rows=64).collect()}
    assert embedding_dedup.near_duplicates(df, shard_rows=64).count() == len(rows)
    good = {i: (v, label) for i, v, label in rows if i is not None and i < 5000 or i in (5005, 5007)}
    links = {i: 0 for i in good}
    up = {i: i for i in good}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in good:
        for b in good:
            if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]):
                x, y = np.array(good[a][0], float), np.array(good[b][0], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    assert {i: got[i]["n_links"] for i in good} == links
    assert all(got[i]["recall"] >= 0.99 and got[i]["beam"] > 0 for i in good) and got[5000]["recall"] is None
    assert {i: got[i]["component_id"] for i in good} == {i: find(i) for i in good}
    for bad in (5000, 5001, 5002, 5003, 5004, 5006):
        assert (got[bad]["n_links"], got[bad]["component_id"], got[bad]["kept"]) == (0, bad, True)
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_a_beam_that_misses_is_widened(monkeypatch):
    r = np.random.default_rng(4)
    centre = r.normal(size=8)
    x = centre + 0.02 * r.normal(size=(300, 8))
    monkeypatch.setattr(embedding_dedup, "FIRST_BEAM", 2)
    shard = embedding_dedup.Shard(np.arange(300), x, 0.93)
    assert len(shard.find(x[0], np.linalg.norm(x[0]))) == 300 and shard.recall >= 0.99
    monkeypatch.setattr(Graph, "search", lambda self, q, k, ef: [])
    blind = embedding_dedup.Shard(np.arange(300), x, 0.93)
    assert blind.scan and len(blind.find(x[0], np.linalg.norm(x[0]))) == 300


def test_audit_takes_the_worst_vector_and_copies_are_one_node(spark, monkeypatch):
    r = np.random.default_rng(5)
    apart = r.normal(size=(6, 16))
    x = np.concatenate([np.repeat(r.normal(size=(1, 16)), 600, 0), apart, apart + 0.01 * r.normal(size=(6, 16))]).astype(np.float32).astype(float)
    whole = Graph.search
    monkeypatch.setattr(Graph, "search", lambda self, q, k, ef: [c for c in whole(self, q, k, ef) if c[0] < 1e-7])  # near copies are lost
    shard = embedding_dedup.Shard(np.arange(612), x, 0.93)
    assert shard.scan and len(shard.ids) == 13 and shard.count.tolist() == [600] + [1] * 12
    assert len(shard.find(x[600], np.linalg.norm(x[600]))) == 2
    alone = embedding_dedup.Shard(np.arange(601), x[:601], 0.93)
    assert not alone.scan and embedding_dedup.Shard(np.arange(601), x[:601], 0.93, x[606:607]).scan
    monkeypatch.setattr(Graph, "search", whole)
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    got = {g["vec_id"]: g for g in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_rows=256).collect()}
    assert all(got[k]["n_links"] == 599 and got[k]["component_id"] == 0 for k in range(600))
    assert all(got[k]["n_links"] == 1 and got[k]["component_id"] == 600 + (k - 600) % 6 for k in range(600, 612))


BENCH = [(0, prose(70, 40)), (1, prose(71, 20)), (2, "only four words here"), (3, ""), (4, None), (5, prose(72, 50)), (5, prose(73, 30))]


def leak_docs():
    b = {i: t for i, t in BENCH if t}
    half = prose(70, 40).split()
    return [
        (0, prose(80, 50) + " " + prose(70, 40).upper() + " " + prose(81, 50)),
        (1, prose(82, 30) + " " + " ".join(half[20:]) + " and then " + " ".join(half[:20])),  # reordered
        (2, " ".join(half[:20])),  # half only
        (3, "say only four words here now"),
        (4, "only four other words here"),
        (5, " ".join(half[:17] + ["changed"] + half[18:])),
        (6, prose(73, 30) + "\n" + b[1]),
        (7, " ".join(reversed(half))),
    ]


def greedy_by_hand(item, doc, width):
    """Longest common unmarked runs by trying all of them."""
    used_i, used_d, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= width and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return total
        n, i, d = -best[0], best[1], best[2]
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
        total += n


def test_tiling_against_all_runs(spark):
    docs = awkward(spark, leak_docs())
    bench = spark.createDataFrame([(*x, "y") for x in BENCH], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"], r["n_words"], r["n_covered"]) for r in string_tiling.find_leaks(docs, bench).collect())
    want = []
    for d in docs.collect():
        for i, t in BENCH:
            item, doc = (t or "").lower().split(), (d["text"] or "").lower().split()
            if item:
                n = greedy_by_hand(item, doc[:400], min(5, len(item)))
                if n >= 0.8 * len(item):
                    want.append((d["doc_id"], i, len(item), n))
    assert got == sorted(want)
    assert {0, 1, 3, 5, 6} == {g[0] for g in got}
    rest = string_tiling.decontaminate(docs, bench)
    assert rest.columns == docs.columns and rest.count() == docs.count() - 5
    spans = {r["doc_id"]: r for r in string_tiling.find_leaks(docs, bench).collect() if r["item_id"] == 0}
    text = leak_docs()[0][1].encode()
    assert text[spans[0]["spans"][0]["start"] : spans[0]["spans"][-1]["end"]].decode().lower() == prose(70, 40)


def test_tiles_of_texts_that_repeat_themselves(spark):
    """The search for each longest match gives the tiles of the seed list, and keeps to the length of the texts."""
    r = np.random.default_rng(3)
    for k in range(200):
        item, doc = (r.integers(1, 2 + k % 4, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in r.integers(1, 60, 2))
        width = min(len(item), 3)
        seeds = [(i, d) for i in range(len(item) - width + 1) for d in range(len(doc) - width + 1) if np.array_equal(item[i : i + width], doc[d : d + width])]
        assert string_tiling.tiles_by_search(item, doc, width) == string_tiling.tiles_of(item, doc, seeds, width)
    phrase = "one phrase that is said over and over "
    docs = spark.createDataFrame([(1, phrase * 3000), (2, prose(8)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", phrase * 400), ("b", prose(9)), (None, phrase)], "item_id string, text string")
    got = {(x["doc_id"], x["item_id"], x["n_covered"]) for x in string_tiling.find_leaks(docs, items).collect()}
    assert got == {(1, "a", 3200), (1, None, 8)}
    assert [x["doc_id"] for x in string_tiling.decontaminate(docs, items).collect()] == [2, 3]


def test_tiling_in_blocks_and_empty_tables(spark, monkeypatch):
    docs = awkward(spark, leak_docs())
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    whole = sorted(map(str, string_tiling.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(string_tiling, "BLOCK_BYTES", 200)
    assert sorted(map(str, string_tiling.find_leaks(docs, bench).collect())) == whole
    assert string_tiling.find_leaks(docs, bench.where("item_id < 0")).count() == 0
    assert string_tiling.find_leaks(empty(spark), bench).count() == 0
    assert string_tiling.decontaminate(docs, bench.where("item_id < 0")).count() == docs.count()
