import corpus_pipeline
from quakespark.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents").cache()
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
        if name == "mixing":
            assert rows.select("doc_id").distinct().count() == before.count()
        elif name == "pii":
            assert rows.count() == before.count() and rows.where("text like '%@mail%'").isEmpty()
        else:
            assert 0 < rows.count() < before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert out.count() == rows.count() and out.where("n_tokens is null").isEmpty()


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).count() == 0


def test_near_copies_by_text_of_repeated_ids(spark):
    words = [f"word{i} is here" for i in range(40)]
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(2, a, "x"), (5, b, "y"), (5, a, "z"), (None, a, "n"), (7, None, "e"), (8, "", "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted(r._id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == ["e", "n", "x", "y"]
