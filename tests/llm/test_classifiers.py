import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, empty, prose

from quarry.llm import string_kernel as sk
from quarry.llm.gam_quality import FEATURES, fit_additive, fit_quality, keep_good, op9_gam_quality, score_quality, text_features
from quarry.llm.training import held_out


def brute_kernel(s, t, n=sk.ORDER, decay=sk.DECAY):
    def weights(z):
        d = defaultdict(float)
        for c in itertools.combinations(range(len(z)), n):
            d["".join(z[i] for i in c)] += decay ** (c[-1] - c[0] + 1)
        return d

    a, b = weights(s), weights(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_against_enumeration():
    a, b = ["idiot", "i-d-iot", "thesis", "abcabcabc", "ab", "éçé!é"], ["idiot", "moron", "hesits", "éçé"]
    assert np.allclose(sk.kernel(a, b), [[brute_kernel(x, y) for y in b] for x in a], atol=1e-5)
    assert np.allclose(sk.kernel(a, a, paired=True), [brute_kernel(x, x) for x in a], atol=1e-5)


def test_units_join_split_words():
    assert {"moron", "idiot"} <= sk.units("You M oron, i d i o t!")
    assert sk.units("") == set() == sk.units("a b")
    assert sk.holds_pairs(["idiot", "i-d-i-o-t", "idxiot", "the", ""], ["idiot"]).tolist() == [True, True, True, False, False]
    assert len(sk.windows("x" * 100)) > 1


def test_spelled_out_words_join_whatever_stands_beside_them():
    for text in ("i d i o t extraordinarily good", "say i d i o t", "a i d i o t is a", "extraordinarily i d i o t extraordinarily"):
        assert "idiot" in sk.units(text), text
    assert "disgusting" in sk.units("d i s g u s t i n g behaviours") and "disgustingbehaviours" in sk.units("d i s g u s t i n g behaviours")
    assert {"scum", "scumof"} <= sk.units("scu m of it") and "moron" in sk.units("mor o n")


def test_every_unit_is_valued_by_the_kernel():
    strings = ["idiot", "idio", "idiotic", "", "éçé!é", "zzz", "mormoron", "stpid", "a"]
    marks = ["idiot", "moron", "éçé", "stupid"]
    assert np.allclose(sk.prefix_kernel(strings, marks), [[brute_kernel(x, y) for y in marks] for x in strings], atol=1e-5)
    marks = ["stupid", "pathetic", "trash", "clown"]
    odd = ["st*pid", "stpid", "patetic", "trsh", "clwn", "t---r---a---s---h"]
    x = marks + ["table", "window", "garden"]
    model = sk.fit_machine(marks, marks, x, np.array([1.0] * 4 + [-1.0] * 3), np.ones(7))
    direct = sk.normalised(odd[:-1], marks, model.norms) @ model.weights + model.bias
    assert np.allclose(model.values(odd)[:-1], direct, atol=1e-4) and (model.values(odd) > sk._BACKGROUND).all()
    got = model.best(["a stpid thing", "", "trash", "clown trash clown"], {}, sk.Bound(model))
    assert got[0][1] == "stpid" and got[1] == (sk.FLOOR, "") and got[2][1] == "trash" and got[3][1] in ("clown", "trash")


def highest(model, text, floor):
    """Value and unit of the highest of all units of a text, each valued by the kernel."""
    found = sorted(sk.units(text))
    value = model.values(found) if found else np.zeros(0)
    top = max(value, default=floor)
    return (float(top), found[int(np.argmax(value))]) if top > floor else (floor, "")


def test_bound_loses_no_unit(spark):
    docs, labels = labelled(spark)
    model = sk.fit_toxicity(docs, labels)
    bound = sk.Bound(model)
    odd = ["blorg-face", "wretch\n-\nling wretchling", "b l o r g f a c e", "blorgfaceblorgfaceblorgface", "x blorgfac e", "$$$ %% __", "BLORGFACE.", "é" * 40, " ".join(prose(k, 3000) for k in range(3))]
    texts = [r["text"] or "" for r in docs.collect()][:120] + odd
    for floor in (sk.FLOOR, sk.MARGIN, -3.0):
        got = model.best(texts, {}, bound, floor)
        for text, (value, unit) in zip(texts, got):
            want = highest(model, text, floor)
            assert value == pytest.approx(want[0], abs=1e-4) and (unit == want[1] or abs(value - want[0]) < 1e-4), text[:80]


def test_query_against_all_units(spark, tmp_path):
    docs, labels = labelled(spark)
    long = spark.createDataFrame([(950, prose(1, 20_000) + " wretchl ing"), (951, prose(1, 20_000))], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(long)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = sk.fit_toxicity(docs, labels)
    got = sorted((r["doc_id"], r["score"], r["predicted"]) for r in sk.op2_string_kernel(spark, str(tmp_path)).collect())
    values = sorted((r["doc_id"], highest(model, r["text"] or "", sk.FLOOR)[0]) for r in docs.collect())
    want = [(k, float(model.probability(np.array([v]))[0])) for k, v in values]
    assert [k for k, _, _ in got] == [k for k, _ in want]
    assert np.allclose([s for _, s, _ in got], [s for _, s in want], atol=1e-3) and all(p == (s >= 0.3) for _, s, p in got)
    scores = {k: s for k, s, _ in got}
    assert scores[950] >= 0.3 > scores[951]


def labelled(spark, n=400):
    rows, labels = [], []
    for k in range(n):
        bad, junk = k % 5 == 0, k % 7 == 0
        text = prose(k, 60)
        if bad:
            words = text.split()
            words.insert(k % 50, ["blorgface", "wretchling"][k % 2])
            text = " ".join(words)
        if junk:
            text = " ".join(w + "%%%" for w in text.upper().split())
        rows.append((k, text))
        labels.append((k, 0 if junk else 1, int(bad)))
    labels += [(0, 0, 1), (None, 1, 1), (1, None, None), (99_999, 1, 0)]
    return awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_tolerates_inserted_characters(spark):
    docs, labels = labelled(spark)
    model = sk.fit_toxicity(docs, labels)
    assert isinstance(model, sk.KernelModel)
    got = sk.score_toxicity(docs, model, ["doc_id"]).collect()
    assert len(got) == docs.count()
    truth = {k: k % 5 == 0 for k in range(400)}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]
    assert np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got if r["doc_id"] >= 900)
    odd = spark.createDataFrame([(1, "say blorg face now"), (2, "say blorgxface now"), (3, "say b lorgface now"), (4, prose(3, 30))], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in sk.score_toxicity(odd, model, ["doc_id"]).collect()}
    assert scores[3] > 0.3 and scores[2] > scores[4]


def test_insults_split_in_two_pieces_are_found(spark):
    assert {"stupid", "pathetic"} <= sk.units("a stu pid and path etic plan")
    docs, labels = labelled(spark)
    model = sk.fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(1, "say blorg face now"), (2, "say blorgxface now"), (3, "wret chling here"), (4, prose(3, 30))], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in sk.score_toxicity(odd, model, ["doc_id"]).collect()}
    assert min(scores[k] for k in (1, 2, 3)) >= 0.3 > scores[4], scores


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 20)
    none = labels.where("doc_id < 0")
    assert sk.fit_toxicity(docs, none) == 0.5
    rows = sk.score_toxicity(docs, 0.5, ["doc_id"]).collect()
    assert {r["score"] for r in rows} == {0.5} and len(rows) == docs.count()
    model = fit_quality(docs, none)
    assert {round(r["score"], 6) for r in score_quality(docs, model, ["doc_id"]).collect()} == {0.5}
    assert score_quality(empty(spark), model, ["doc_id"]).count() == 0
    assert sk.score_toxicity(empty(spark), 0.5, ["doc_id"]).count() == 0
    assert fit_quality(empty(spark), labels).tables == []


def test_quality(spark):
    docs, labels = labelled(spark)
    model = fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in score_quality(docs, model, ["doc_id", "score"][:1]).collect()}
    held = {r["doc_id"] for r in docs.where(held_out()).collect()}
    right = [got[k]["predicted"] == (k % 7 != 0) for k in range(400) if k in held]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 400 and doc_id % 7 = 0").count() == 0


def test_a_model_without_labels_rejects_nothing(spark):
    docs, labels = labelled(spark, 20)
    for none in (labels.where("doc_id < 0"), labels.where("quality = 1")):
        assert keep_good(docs, fit_quality(docs, none)).count() == docs.count()


def test_features_of_odd_texts():
    import pyarrow as pa

    x = text_features(pa.array([None, "", " \n", "A", "a a a a", "\U0001f600 é"]))
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all() and not x[:2].any()
    assert x[4, FEATURES.index("distinct_words")] == pytest.approx(0.25)
    assert x[4, FEATURES.index("same_as_before")] == pytest.approx(0.75)
    assert text_features(pa.array([], pa.string())).shape == (0, len(FEATURES))


def plain_features(text):
    """The features of one text, word by word."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    words = [m[0].lower() for m in found]
    lines = [tuple(w for _, w in g) for _, g in itertools.groupby(zip((raw[: m.start()].count(b"\n") for m in found), words), key=lambda x: x[0])]
    is_letter = lambda c: chr(c).isalpha() and c < 128 or c >= 128
    is_symbol = lambda c: 32 < c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-!|"
    of = lambda kind: sum(map(kind, raw))
    n, size, per = len(words), len(raw), lambda a, b: a / max(b, 1)
    space = of(lambda c: c == 32 or 9 <= c <= 13)
    share = lambda kind: per(sum(1 for m in found if kind(m[0])), n)
    return [
        math.log2(n + 1), math.log2(size + 1), per(size - space, n), per(of(lambda c: 65 <= c <= 90), of(is_letter)), per(of(lambda c: 48 <= c <= 57), size),
        per(raw.count(b"!"), n), per(of(lambda c: chr(c) in ".,;:?'\"()-"), n), per(of(is_symbol), n), per(raw.count(b"|"), n), per(of(lambda c: c >= 128), size),
        per(space, size), math.log2(len(lines) + 1), per(n, len(lines)), per(sum(a == b for a, b in zip(words, words[1:])), n), per(len(set(words)), n),
        per(max(Counter(words).values(), default=0), n), per(len(set(zip(words, words[1:]))), n - 1), per(len(set(lines)), len(lines)),
        share(lambda w: is_symbol(w[-1])), share(lambda w: not any(map(is_letter, w))), share(lambda w: len(w) > 15), share(lambda w: len(w) <= 2),
        share(lambda w: 65 <= w[0] <= 90), share(lambda w: chr(w[-1]) in ".?!"),
    ]


def test_quality_query_against_a_plain_reading(spark, tmp_path):
    """Every row of the query equals features read word by word and tables looked up one at a time."""
    docs, labels = labelled(spark)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(960, "A a, B!\n\nA a, B!\nSHOUT || <> é≠ 12\t" + prose(2, 9000)), (961, "\n \n")], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = fit_quality(docs, labels)
    assert model.tables

    def score(text):
        x = plain_features(text)
        place = lambda cuts, j: sum(c <= x[j] for c in cuts)
        total = model.intercept + sum(values[place(cuts, j)] for j, (cuts, values) in enumerate(zip(model.cuts, model.tables)))
        total += sum(values[place(model.pair_cuts[a], a), place(model.pair_cuts[b], b)] for a, b, values in model.pairs)
        return 1 / (1 + math.exp(-max(-35, min(35, total))))

    want = sorted((r["doc_id"], score(r["text"])) for r in docs.collect())
    got = sorted((r["doc_id"], r["score"], r["predicted"]) for r in op9_gam_quality(spark, str(tmp_path)).collect())
    assert [k for k, _, _ in got] == [k for k, _ in want]
    assert np.allclose([v for _, v, _ in got], [v for _, v in want], atol=1e-9) and all(p == (v >= 0.7) for _, v, p in got)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x, y, rounds=20)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert (1, 0) in {(a, b) for a, b, _ in model.pairs}


def test_a_units_own_norm_leaves_fewer_to_value_and_loses_none():
    marks = ["moron", "idiot", "stupid"]
    model = sk.KernelModel(marks, sk.kernel(marks, marks, paired=True), marks, np.array([1.5, 1.5, 1.5]), -1.5)
    rng = np.random.default_rng(4)
    strings = sorted({"".join(c * int(rng.choice([0, 1, 1, 2])) for c in m + str(rng.choice(marks))[: int(rng.integers(0, 4))]) for m in marks for _ in range(1000)} | set(marks))
    strings = [x for x in strings if sk.ORDER <= len(x) <= sk.WIDTH]
    bound, floor = sk.Bound(model), -0.5
    total, own = bound.parts(strings, False)[0], sk.squared_norms(strings)
    by_length = bound.may_pass(total, np.array([len(x) for x in strings]), floor)
    by_norm = bound.may_pass(total, None, floor, own)
    value = model.values(strings)
    assert by_norm.sum() < by_length.sum() and not (by_norm & ~by_length).any() and by_norm[value > floor].all()
    np.testing.assert_allclose(model._highest(strings, bound, floor), np.maximum(value, floor), atol=1e-5)
    np.testing.assert_allclose(model._highest([x for x, ok in zip(strings, by_length) if ok], bound, floor, total[by_length]), np.maximum(value[by_length], floor), atol=1e-5)


def test_units_are_valued_once_a_block_and_none_is_lost(monkeypatch):
    marks = ["moron", "idiot", "stupid", "véquté", "jázßñ"]
    model = sk.KernelModel(marks, sk.kernel(marks, marks, paired=True), marks, np.array([1.5, 1.5, 1.5, 0.05, 0.02]), -1.5)
    bound, floor = sk.Bound(model), -0.5
    assert bound.size < 1 + len(set("".join(marks)))  # rare letters share classes
    rng = np.random.default_rng(5)
    pieces = ["mo", "r", "on", "mor", "i", "d", "ot", "id", "iot", "stu", "pid", "st", "up", "-", "o.", "_", "$$", "(mor", "o-n)", "vé", "qu", "té", "já", "zßñ", "worthwhileness", "counterweights", "unquestionable-", "extraordinarinesses", "table", "\n", "ab'c", "of"]
    texts = [" ".join(rng.choice(pieces, int(rng.integers(0, 12)))) for _ in range(1500)] + ["", "-", "i", "id", "i d", "mo ron", "mo r on", "x mo ro n y"]
    for text, (value, unit) in zip(texts, model.best(texts, {}, bound, floor)):
        want = highest(model, text, floor)
        assert value == pytest.approx(want[0], abs=1e-4) and (unit == want[1] or abs(value - want[0]) < 1e-4), text
    asked, inner = [], sk.KernelModel._valued
    monkeypatch.setattr(sk.KernelModel, "_valued", lambda self, strings, *rest: asked.append(len(strings)) or inner(self, strings, *rest))
    once = model.best(texts, {}, bound, floor), sum(asked)
    asked.clear()
    assert (model.best(texts * 5, {}, bound, floor), sum(asked)) == (once[0] * 5, once[1])


def test_joins_that_cannot_be_a_texts_highest_are_not_valued():
    marks = ["moron", "idiot", "stupid"]
    model = sk.KernelModel(marks, sk.kernel(marks, marks, paired=True), marks, np.array([1.5, 1.5, 1.5]), -1.5)
    rng = np.random.default_rng(6)
    pieces = ["".join(c for c in m * 2 if rng.random() < 0.6)[:8] for m in marks for _ in range(40)] + ["mor", "on", "of", "a"]
    texts = [" ".join(rng.choice([p for p in pieces if p], 60)) for _ in range(60)]
    floor, known = -1.4, {}
    got = model.best(texts, known, sk.Bound(model), floor)
    joins = {u for t in texts for u in sk.units(t)}
    value = dict(zip(joins, model.values(list(joins))))
    assert len(known) < sum(v > floor for v in value.values()) / 2
    assert all(abs(max(value[u], floor) - v) < 1e-4 for u, v in known.items() if u in value)
    for text, (v, unit) in zip(texts, got):
        want = highest(model, text, floor)
        assert v == pytest.approx(want[0], abs=1e-4) and (unit == want[1] or abs(v - want[0]) < 1e-4), text
