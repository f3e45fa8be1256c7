from __future__ import annotations

import corpus_pipeline
import pytest
from llm import cases

import __spark_entry__ as driver
from shelfline.llm import decontamination, jaccard_join
from shelfline.llm.oracles import ORACLES
from shelfline.llm.queries import QUERIES
from shelfline.llm.text import stored
from verification.compare import duck, mismatch

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) < set(driver.queries()) and "pipeline" in driver.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(spark, duck(SMALL), name, SMALL) is None


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "near_duplicates":
            groups = cases.components(list(before.items()))
            assert set(after) == {doc for doc, (_, least) in groups.items() if doc == least}
        elif name == "decontamination":
            leaking = {r.doc_id for r in decontamination.leaks(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaking
        elif name == "personal_data":
            assert set(after) == set(before) and any(after[d] != before[d] for d in after)
        else:
            assert len(after) < len(before)
        if name != "personal_data":
            assert all(after[d] == before[d] for d in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_run_ends_in_packed_pieces(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 100


def test_awkward_documents_pass_the_stages(spark):
    docs = cases.frame(spark, cases.corpus())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
    nothing = jaccard_join.one_of_each(docs.limit(0))
    assert nothing.count() == 0
