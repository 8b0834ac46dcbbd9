import public_tokenizers
import pytest
from helpers import awkward, prose

import corpus_pipeline
from quarry.llm.trie_bpe import encoder


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = [], []
    for k in range(160):
        text, good = prose(k, 120), 1
        if k % 4 == 0:
            text, good = " ".join(w + "$$$" for w in text.upper().split()), 0
        rows.append((k, text))
        labels.append((k, good, 0))
    passage = prose(9000, 110)
    rows += [(200, prose(300, 50) + " " + passage), (201, prose(301, 50) + " " + passage)]  # a repeated passage
    rows += [(210, prose(310, 100)), (211, prose(310, 100) + " end")]  # near copies
    rows += [(220, prose(320, 60) + " " + prose(7000, 40))]  # a leak
    awkward(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(7000, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            seen[k] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [k for k in range(160) if k % 4]
    assert not [k for k in range(0, 160, 4) if k in seen[0]] and set(clean) <= set(seen[0])
    assert 210 in seen[1] and 211 not in seen[1] and set(clean) <= set(seen[1])
    assert prose(9000, 110) not in seen[2][200] and seen[2][200].startswith(prose(300, 50)) and set(seen[2]) == set(seen[1])
    assert 220 not in seen[3] and set(seen[2]) - set(seen[3]) == {220}
    bpe = encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: bpe.library.encode(t or "", add_special_tokens=False).ids for i, t in seen[3].items()}
    assert {r["doc_id"]: list(r["token_ids"]) for r in docs.collect()} == want
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
