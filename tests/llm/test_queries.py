import corpus_pipeline
from plurality import llm


def test_every_query_is_registered_once():
    names = sorted(llm.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(llm.oracle_sql()) <= set(names)


def test_pipeline_stages_on_edges(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "b", 0), (2, None, "en", "b", 0)]
    rows += [(10 + i, f"word{i} stone river token = abcdef{i}{i}{i}{i}secretvalue other{i} thing{i}", "en", "a", 9) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() > 0
    assert all(stage(spark, docs.limit(0), "").count() == 0 for _, stage in corpus_pipeline.STAGES)
