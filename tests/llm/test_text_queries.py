"""The registered text queries against their SQL twins, and the pipeline, at the smallest scale."""

import pytest

import corpus_pipeline
from daybook.llm.queries import QUERIES, TWINS
from daybook.plans.compare import differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), TWINS[name], SF_DIR) == []


def test_pipeline_keeps_columns_and_shrinks(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        path_rows = out.count()
        assert 0 < path_rows <= n, name
        docs, n = out, path_rows
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert mixed.select("doc_id").distinct().count() <= n
