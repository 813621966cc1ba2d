"""What a Python worker keeps after a task, and what a batch of texts carries."""

import pyarrow as pa

from pagewarden.llm import jaccard, language, packing
from pagewarden.llm.tokens import encoder


def batches(n=3):
    for k in range(n):
        yield pa.record_batch({"doc_id": [2 * k, 2 * k + 1], "text": [f"one two{k} three four", None]})


def test_cache_of_pieces_goes_with_the_task():
    first = [b.to_pylist() for b in packing._pieces(None, 2048, batches())]
    assert not encoder(None).at
    assert first == [b.to_pylist() for b in packing._pieces(None, 2048, batches())]
    part = packing._pieces(None, 2048, batches())
    next(part)
    assert encoder(None).at
    part.close()
    assert not encoder(None).at


def test_language_sends_texts_once(spark, docs_of):
    docs = docs_of([(k, "some english words here", "en", "s") for k in range(40)] + [(41, None), (42, "123"), (43, "")])
    kept = language.keep_identified(spark, docs)
    inner = kept._jdf.queryExecution().analyzed().children().apply(0).schema()
    kinds = [(f.name(), f.dataType().typeName()) for f in (inner.apply(k) for k in range(inner.size()))]
    assert [k for k in kinds if k not in docs.dtypes and k[1] == "string"] == []
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_jaccard_sends_small_batches(spark, docs_of, monkeypatch):
    seen, real = {}, jaccard.persist

    def persist(spark, df, name):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return real(spark, df, name)

    monkeypatch.setattr(jaccard, "persist", persist)
    docs = docs_of([(k, "a b c d e f g h i j k l m n" + " z" * (k % 2)) for k in range(8)])
    assert {r["class_id"] for r in jaccard.jaccard_join(spark, docs).collect()} == {0}
    assert seen["jaccard-signatures"] <= 1000 and seen["jaccard-links"] <= 1000
