"""Rows without a doc_id, or that share one."""

from tessera.llm import decontaminate, simhash

A, B, C, D = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
ROWS = [(None, A), (None, B), (None, B), (1, C), (1, D), (2, C), (3, A)]


def test_dedup_keeps_a_row_of_each_component(spark):
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, _row int").repartition(3)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, B), (1, C), (1, D), (3, A)]


def test_clean_judges_each_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([("i", A), ("j", D)], "item_id string, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(docs, items).collect()) == [(0, B), (0, B), (1, C), (2, C)]
