import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from helpers_llm import awkward, empty, labels  # noqa: E402


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_on_awkward_tables(spark, tmp_path, make):
    docs = make(spark)
    labels(spark, [(1, 1, 0), (17, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
    assert docs.selectExpr("count(*) = count(DISTINCT sequence_id) AS ok").head().ok


def test_run_equals_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = [f for _, f in corpus_pipeline.STAGES]
    kept = parts[0](spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    from tabvet.llm import quality_rules
    rules = quality_rules.learned_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids == {r.doc_id for r in quality_rules.judge(docs, rules).filter("kept").collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    per = {}
    for r in packed:
        assert len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.length <= 2048
        per.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(per) <= ids and all(a == b for a, b in per.values())
