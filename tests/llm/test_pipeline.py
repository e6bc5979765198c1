"""The pipeline's stages keep clean documents, take out what they should and return the columns of documents."""

import pytest

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "bpe"]
    left, seen = docs.count(), []
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append((name, left, n := docs.count()))
        assert n <= left
        left = n
    assert left > 0.7 * seen[0][1]
    out = p.STAGES[-1][1](spark, docs, DIR)
    assert out.count() == left and out.where("n_tokens < 0").count() == 0


def test_entry_registers_all():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} < names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
