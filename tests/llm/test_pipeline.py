"""Each stage against a brute-force version on its own input."""

import sentencepiece

import corpus_pipeline as C
from conftest import SF_SMALL
from llm.fixtures import clashing, empty, hard
from llm.test_decontaminate import brute as contaminated_words
from llm.test_minhash import brute as components
from llm.test_pii import base
from scholarmetrics.llm import pieces, quality
from scholarmetrics.llm.common import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF_SMALL), name))
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "sentencepiece"]
    assert all(d.columns == columns for d in seen[:-1])
    rows = [{r.doc_id: r.asDict() for r in d.collect()} for d in seen]
    verdict = {r.doc_id: r.kept for r in quality.query(spark, SF_SMALL).collect()}
    assert set(rows[1]) == {i for i in rows[0] if verdict[i]}
    comp = components([(i, r["text"]) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {i for i in rows[1] if comp[i][1] == i}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hit = {i: contaminated_words(r["text"], items) for i, r in rows[2].items()}
    assert set(rows[3]) == {i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n)}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert base(r["text"]) == "" and (base(rows[3][i]["text"]) != "" or r["text"] == rows[3][i]["text"])
    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert set(rows[5]) == set(rows[4])
    assert all(r["ids"] == ref.encode(rows[4][i]["text"]) and r["round_trip"] for i, r in rows[5].items())
    assert C.run(spark, SF_SMALL).count() == len(rows[5])


def test_stages_on_hard_and_empty_rows(spark):
    for docs in (clashing(hard(spark), ["kept", "matches", "spans"]), empty(spark)):
        for name, stage in C.STAGES:
            out = materialize(stage(spark, docs, SF_SMALL), name)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (docs.count() > 0)
