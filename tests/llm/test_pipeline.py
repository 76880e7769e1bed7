from linequarry.llm import language_id as li
from linequarry.llm import mixing as mx
from linequarry.llm import sentencepiece_unigram as sp
from linequarry.llm.common import table
from tests.llm.test_dedup import components_brute, exact_brute, fingerprint_brute

import corpus_pipeline


def test_stages(spark, sf):
    """Each stage's rows against a plain computation on what the stage before kept."""
    docs = table(spark, sf, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = docs.cache()
        out[name] = (before.toPandas(), docs.toPandas())
        if name != "SentencePiece":
            assert docs.columns == before.columns, name
    a, b = out["language ID"]
    model = tuple(sorted(li.fit_on_folds(table(spark, sf, "documents")).items()))
    assert sorted(b.doc_id) == sorted(i for i, t in zip(a.doc_id, a.text, strict=True) if not li.judge(t, model)[2])
    assert len(b) > 0.97 * len(a)
    a, b = out["exact dedup"]
    assert sorted(b.doc_id) == sorted(r[0] for r in exact_brute(list(zip(a.doc_id, a.text, strict=True))) if r[3])
    a, b = out["SimHash near-dedup"]
    assert sorted(b.doc_id) == sorted(set(components_brute([fingerprint_brute(t) for t in a.text], list(a.doc_id))))
    a, b = out["mixing sources"]
    assert set(b.doc_id) == set(a.doc_id) and len(b) >= len(a)
    a, b = out["SentencePiece"]
    m = sp.load()
    assert sorted(b.doc_id) == sorted(a.doc_id) and b.round_trip.all()
    text = dict(zip(a.doc_id, a.text, strict=True))
    assert all(m.decode(list(ids)) == text[i] for i, ids in zip(b.doc_id, b.ids, strict=True))


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and rows.count() > 0


def test_empty(spark, tmp_path, sf):
    table(spark, sf, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mx.op2_mixing(spark, str(tmp_path)).count() == 0
