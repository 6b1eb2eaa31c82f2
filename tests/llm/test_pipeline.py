"""The stages one after the other, each against what it should do to its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tessera.llm import common, decontaminate, queries, simhash
from tests.compare import DATA
from tests.llm.test_operators import hostile

TINY = str(DATA / "sf0.001")


def test_each_stage_takes_effect(spark):
    docs = queries.table(spark, TINY, "documents")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, TINY), "test-stage")
        assert docs.columns == names, name
        assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3]
    assert decontaminate.contained_items(docs, queries.table(spark, TINY, "benchmark")).count() == 0
    groups = simhash.near_duplicates(docs)
    assert groups.where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())


def test_hostile_rows_go_through(spark):
    docs = hostile(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, TINY), "test-stage")
    assert "sequence_id" in docs.columns


def test_empty_table_goes_through(spark):
    docs = queries.table(spark, TINY, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, TINY), "test-stage")
    assert docs.count() == 0
