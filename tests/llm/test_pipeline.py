import pytest

import corpus_pipeline
from quern.llm import mixing


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], data).persist()
        if name != "packing":
            assert out.columns == columns
        held.append(out)
    start, known, lines, apart, mixed, packed = held
    assert known.count() >= 0.97 * start.count()
    flat = [s for r in lines.collect() for s in r.text.split("\n") if s.strip(" ")]
    assert len(flat) == len(set(flat))
    assert 0 < apart.count() <= lines.count()
    words = lambda f: f.agg({"s": "sum"}).first()[0]
    total = words(apart.select(mixing.words(apart.text).alias("s")))
    assert abs(words(mixed.select(mixing.words(mixed.text).alias("s"))) - 1.5 * total) < 0.1 * total
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_odd_rows(spark, data, which, request):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).persist()
        docs.count()


def test_columns_named_like_those_of_operators(spark, data):
    """Extra columns pass through the stages under names that the operators use themselves."""
    names = ["score", "rejected", "lang_pred", "row", "kept", "copies", "size", "class_id", "cleaned"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).selectExpr("*", *(f"doc_id AS {n}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).persist()
        assert docs.columns[-len(names) :] == names, name
        assert all(r[n] == r["doc_id"] for r in docs.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0
