import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import WORDS, awkward, empty, prose

from quarry.llm import chat_rotation, class_lm
from quarry.llm.chat_rotation import rotate
from quarry.llm.class_lm import exchange, score_texts


def turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", ""), (1, 3, "ann", ""), (2, 0, "system", "alone"), (3, None, None, None), (None, 5, "cy", "é≠"), (4, 0, "ann", "x" * 5000), (4, 1024, "bob", "b"), (4, 2048, "ann", "c")]
    return spark.createDataFrame([(*r, "e", 0) for r in rows], "conv_id long, turn long, role string, text string, tag string, block int"), rows


def test_every_perspective_by_hand(spark):
    df, rows = turns(spark)
    got = rotate(df).collect()
    want = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        for who in {r[2] or "unknown" for r in mine} - {"system"}:
            at = 0
            for _, turn, speaker, text in mine:
                speaker, text = speaker or "unknown", text or ""
                tag = "<|assistant|>" if speaker == who else "<|system|>" if speaker == "system" else f"<|user name={speaker}|>"
                segment = f"{tag}\n{text}<|end|>\n"
                loss = speaker == who
                want.append((conv, who, turn, segment, at, at + len(segment), loss, at + len(tag) + 1 if loss else None, at + len(segment) - 1 if loss else None))
                at += len(segment)
    key = lambda x: str(x)
    assert sorted(((r["conv_id"], r["perspective"], r["turn"], r["segment"], r["char_start"], r["char_end"], r["loss"], r["loss_start"], r["loss_end"]) for r in got), key=key) == sorted(want, key=key)
    assert rotate(df.where("conv_id < 0")).count() == 0


def test_blocks_of_turns_add_up(spark, monkeypatch):
    df, _ = turns(spark)
    whole = sorted(map(str, rotate(df).collect()))
    monkeypatch.setattr(chat_rotation, "BLOCK", 2)
    assert sorted(map(str, rotate(df).collect())) == whole


def test_rendering_runs_no_python(spark):
    df, _ = turns(spark)
    plan = rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_scores_against_counts(spark):
    docs = awkward(spark, [(k, prose(k, 50)) for k in range(200)] + [(None, prose(1, 9))])
    rows = docs.collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) + [0] for r in rows]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    count = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r["doc_id"]), h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for r, ws, h in zip(rows, words, held))
    got = score_texts(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_classes_help_where_order_matters(spark):
    r = np.random.default_rng(1)
    kinds = [WORDS[:15], WORDS[15:30], WORDS[30:]]
    rows = [(k, " ".join(kinds[j % 3][r.integers(0, len(kinds[j % 3]))] for j in range(90))) for k in range(300)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    score, base, n = (sum(x[c] for x in got) for c in ("score", "base_score", "n_tokens"))
    assert score > base + 0.3 * n


def test_scores_of_odd_tables(spark):
    assert score_texts(empty(spark)).count() == 0
    only = awkward(spark).where("doc_id in (900, 901)")
    assert [r["n_tokens"] for r in score_texts(only).collect()] == [1, 1]


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(0)
    truth = r.integers(0, 3, 60)
    m = np.zeros((61, 61), np.int64)
    state = 0
    for _ in range(20_000):
        following = (truth[state] + 1) % 3
        nxt = r.choice(np.flatnonzero(truth == following))
        m[state, nxt] += 1
        state = nxt
    cls = exchange(m, classes=4, sweeps=10)
    assert cls[-1] == 3 and len({(a, b) for a, b in zip(truth, cls[:-1])}) == 3


def test_model_is_a_distribution():
    """Class transitions, emissions with an unseen event a class, and the base with its unseen event shared out sum to one."""
    k, follow = 3, np.array([0.2, 0.5, 0.3])
    counts = {0: [3, 1], 1: [2, 2, 1], 2: [4]}
    n, v = sum(map(sum, counts.values())), sum(map(len, counts.values()))
    total = 0.0
    for c, words in counts.items():
        unseen = (words.count(1) + 0.5) / (sum(words) + 1)
        emitted = [(1 - unseen) * w / sum(words) for w in words]
        total += 0.95 * follow[c] * (sum(emitted) + unseen) + 0.05 * (sum((w + 0.5) / (n + 0.5 * (v + 1)) for w in words) + 0.5 / (n + 0.5 * (v + 1)) / k)
    assert abs(total - 1) < 1e-12


def test_frequent_words_are_exact_whatever_the_batches(spark):
    # a flat vocabulary, each word below 1/20,000 of its batch; the words with an odd number stand there twice
    text = " ".join(f"w{k} w{k}" if k % 2 else f"w{k}" for k in range(30_000))
    rows = spark.createDataFrame([(text,), (" ".join(f"w{k}" for k in range(1, 4000, 2)),)], "t string")
    one, many = class_lm._frequent(rows.coalesce(1)), class_lm._frequent(rows.repartition(2))
    assert len(one) == class_lm.WORDS and np.array_equal(one, many)
    import pyarrow as pa

    thrice = class_lm.tokens_of(pa.array([" ".join(f"w{k}" for k in range(1, 4000, 2))]))[0]
    assert np.isin(one, thrice).all()


def brute_scores(rows, n_core):
    """The model by dictionaries, one token at a time: {doc_id: score}."""
    import pyarrow as pa

    fold = lambda i: zlib.crc32(str(i).encode()) % class_lm.FOLDS == class_lm.HELD_OUT
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    train = [words[i] for i in words if not fold(i)]
    count = Counter(w for ws in train for w in ws)
    number = {w: int(class_lm.tokens_of(pa.array([w]))[0][0]) for ws in words.values() for w in ws if w}
    ranked = sorted((w for w in count if w), key=lambda w: (-count[w], np.uint64(number[w]).astype(np.int64)))
    core = sorted(ranked[:n_core], key=number.__getitem__)
    last = len(core) + class_lm.TYPES

    def symbol(w):
        if w is None:
            return last
        b = w.encode()
        return core.index(w) if w in core else len(core) + (b[-1] * 257 + (b[-2] if len(b) > 1 else 0) * 31) % class_lm.TYPES

    pairs = np.zeros((last + 1, last + 1))
    for ws in train:
        for a, b in zip([None, *ws], ws):
            pairs[symbol(a), symbol(b)] += 1
    cls = exchange(pairs)
    k = cls[-1] + 1
    old = {w: int(cls[symbol(w)]) for ws in words.values() for w in ws}
    n = np.zeros((k, k))
    for ws in train:
        for a, b in zip([None, *ws], ws):
            n[old[a], old[b]] += 1
    mutual = lambda a, b: math.log((n[a, b] + 0.1) * (n + 0.1).sum() / ((n[a] + 0.1).sum() * (n[:, b] + 0.1).sum()))
    new = dict(old)
    for w in ranked[n_core:]:
        gain = np.zeros(k - 1)
        gain[old[w]] = class_lm.PRIOR
        for ws in train:
            for p, v in enumerate(ws):
                if v == w:
                    gain += [mutual(old[ws[p - 1] if p else None], c) + mutual(c, old[ws[p + 1]]) for c in range(k - 1)]
        new[w] = int(np.argmax(gain))
    moves, tokens, ones = np.full((k, k), 0.1), np.zeros(k), np.zeros(k)
    for ws in train:
        for a, b in zip([None, *ws], ws):
            moves[new[a], new[b]] += 1
    for w, c in count.items():
        tokens[new[w]] += c
        ones[new[w]] += c == 1
    unseen = np.clip((ones + 0.5) / (tokens + 1), 1e-9, 0.5)
    unseen[-1] = 1e-9
    bottom = tokens.sum() + 0.5 * (len(count) + 1)
    out = {}
    for i, ws in words.items():
        total = 0.0
        for a, b in zip([None, *ws], ws):
            c, m = new[b], count[b]
            emit = m * (1 - unseen[c]) / tokens[c] if m else unseen[c]
            total += math.log10(class_lm.LAMBDA * moves[new[a], c] / moves[new[a]].sum() * emit + (1 - class_lm.LAMBDA) * (m + 0.5) / bottom / (1 if m else k))
        out[i] = total
    return out, sum(new[w] != old[w] for w in new)


def test_scores_against_a_model_by_dictionaries(spark, monkeypatch):
    """Words without a symbol of their own get classes by their contexts; blocks and buckets of any size give the same."""
    monkeypatch.setattr(class_lm, "WORDS", 12)
    rows = [(i, prose(i, 30) + f" rare{i % 7} ZZ{i}") for i in range(60)] + [(100, None), (101, ""), (102, "ba"), (103, prose(3, 30) + " rare3 zz3")]
    expected, moved = brute_scores(rows, 12)
    assert moved > 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, bucket in ((class_lm.BLOCK_BYTES, class_lm.BUCKET), (3000, 40)):
        monkeypatch.setattr(class_lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(class_lm, "BUCKET", bucket)
        got = {r["doc_id"]: r["score"] for r in score_texts(docs).collect()}
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)
