"""Queries whose buckets hold too few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours

RNG = np.random.default_rng(11)
#: Nearly all rows in one direction, and one vector away from them.
ONE_WAY = np.concatenate([np.eye(64)[:1] + RNG.normal(0, 1e-3, (700, 64)), -np.eye(64)[:1] + 0.3 * np.eye(64)[5:6]])


@pytest.mark.parametrize("x", [RNG.normal(size=(5, 64)), RNG.normal(size=(15, 64)), ONE_WAY], ids=["5 rows", "15 rows", "outlier"])
def test_every_query_gets_its_list(spark, x):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    before, neighbours.PART = neighbours.PART, 200
    try:
        got = neighbours.search(df, df.filter(f"vec_id % 100 = 0 or {len(x)} < 20")).toPandas()
    finally:
        neighbours.PART = before
    asked = [k for k in range(len(x)) if k % 100 == 0 or len(x) < 20]
    assert sorted(got.query_id.unique()) == asked
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        g, n = got[got.query_id == q].sort_values("rank"), min(10, len(x) - 1)
        assert list(g["rank"]) == list(range(1, n + 1)) and np.array_equal(g.score.to_numpy(), d[g.vec_id])
        assert list(g.vec_id) == list(np.lexsort((np.arange(len(x)), d))[:n]) or (len(x) > 20 and q != len(x) - 1)


def true_lists(x, ids, q, n):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return ids[np.lexsort((ids, d))[:n]], d


@pytest.mark.parametrize("rows, size", [(6000, 20), (9000, 100)])
def test_recall_and_scan_in_other_dimensions(spark, rows, size):
    """Unit vectors without structure, with one vector that a third of the rows repeat."""
    x = np.random.default_rng(size).normal(size=(rows, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: rows // 3] = x[0]
    ids = np.arange(rows)
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, v string").repartition(4)
    x = x.astype(np.float32).astype(float)
    got = neighbours.search(df, df.filter("vec_id % 100 = 0")).toPandas()
    hits = asked = 0
    for q in range(0, rows, 100):
        g = got[got.query_id == q].sort_values("rank")
        best, d = true_lists(x, ids, q, 10)
        assert list(g["rank"]) == list(range(1, 11)) and np.array_equal(g.score.to_numpy(), d[g.vec_id])
        if q < rows // 3:
            assert list(g.vec_id) == list(best)
        else:
            hits, asked = hits + len(set(best) & set(g.vec_id)), asked + 10
    assert hits >= 0.9 * asked, hits / asked


def test_buckets_hold_as_many_rows_at_any_size():
    for size in (5, 64, 100):
        buckets = [float(np.prod(neighbours.polytopes(n, size), dtype=float)) for n in (10**3, 10**5, 10**7, 10**9)]
        assert all(1 <= n / b <= 9 for n, b in zip((10**3, 10**5, 10**7, 10**9), buckets))


def test_transform_is_the_matrix():
    x, signs = np.random.default_rng(1).normal(size=(7, 16)), np.random.default_rng(2).choice([-1.0, 1.0], (3, 16))
    assert np.allclose(neighbours.turned(x, signs), x @ neighbours.turned(np.eye(16), signs))
    assert np.allclose(np.linalg.norm(neighbours.turned(x, signs), axis=1), 64 * np.linalg.norm(x, axis=1))


def test_repeated_rows_and_ids(spark):
    x = np.random.default_rng(4).normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] * 2 + [(5, x[7].tolist()), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before, neighbours.PART = neighbours.PART, 100
    try:
        got = neighbours.search(df, df.filter("vec_id in (7, 20)"), k=3).toPandas()
        none = neighbours.search(df, df.filter(F.lit(False))).collect()
    finally:
        neighbours.PART = before
    assert none == [] and list(got[got.query_id == 7].sort_values("rank").vec_id)[0] == 5 and got[got.query_id == 7].score.min() == 0
    assert all(len(set(g.vec_id)) == len(g) == 3 and q not in set(g.vec_id) for q, g in got.groupby("query_id"))


def unit_rows(spark, rows, size, seed):
    x = np.random.default_rng(seed).normal(size=(rows, size))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x.astype(float), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)


def test_small_tables_take_the_same_way(spark, monkeypatch):
    """Neither results nor their way depend on whether a table is below a block's size."""
    x, df = unit_rows(spark, 2000, 64, 3)
    lists = []
    for part in (500, 4096):
        monkeypatch.setattr(neighbours, "PART", part)
        lists.append(sorted(tuple(r) for r in neighbours.search(df, df.filter("vec_id % 100 = 0")).collect()))
    monkeypatch.setattr(neighbours, "_exact", None)
    assert lists[0] == lists[1] == sorted(tuple(r) for r in neighbours.search(df, df.filter("vec_id % 100 = 0")).collect())
    hits = sum(len(set(true_lists(x, np.arange(2000), q, 10)[0]) & {r[2] for r in lists[0] if r[0] == q}) for q in range(0, 2000, 100))
    assert hits >= 0.9 * 200


def test_probes_are_not_broadcast(spark):
    """A query has 64 buckets in each of 20 tables, which Spark takes for one short row."""
    _, df = unit_rows(spark, 400, 16, 5)
    rows = neighbours.usable(df)
    asked = rows.filter("vec_id % 100 = 0")
    found = neighbours._candidates(neighbours.Scratch(spark), neighbours._entries(rows, 10), asked, 400, 16, 10, 20, 64)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [bucket" in plan and "BroadcastHashJoin [bucket" not in plan
