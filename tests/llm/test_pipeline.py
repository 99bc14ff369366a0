"""The pipeline's stages one after another, each against what it must do."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TINY = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "mix", "pack"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = corpus_pipeline.written(out, "stage")
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.run(spark, TINY).count() == packed.count()


def test_odd_rows_and_an_empty_table(spark, documents, odd):
    long = " ".join(f"word{i}" for i in range(60_000))
    secret = "The key stands here and must go: password = hunter2secret9 and so on for all of these words"
    docs = documents([*odd, (20, long, "c"), (21, secret, "b"), (21, secret, "b")], extra=True)
    for df, want in ((docs, {4, 5, 20, 21, None}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            df = corpus_pipeline.written(out, "odd")
            gone = {5} if name != "quality_rules" else set()  # a near copy of 4
            assert {r["doc_id"] for r in df.select("doc_id").collect()} <= want - gone
        assert not df.where("text like '%hunter2%'").count()
        packed = corpus_pipeline.STAGES[-1][1](spark, df, "")
        assert packed.where("piece = 0").count() == df.count()
