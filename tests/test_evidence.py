"""Cells, evidence operators and sinks, by hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, evidence, generators
from tessera.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, values, schema, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {schema}").select(f(F.col("x"))).collect()]


def test_cells(spark):
    assert one(spark, ["n/a - a|b", " N/A ", "n/a:", "", "slow\nhost", None], "string", cells.reason) == ["n/a — a\\|b", None, None, None, "n/a — slow host", None]
    assert one(spark, ["64K", "1024M", "1025M", "0", "7", "K", "1k", "9" * 30, "4K\n", None], "string", cells.size_bytes) == [65536, 1 << 30, None, None, 7, None, None, None, None, None]
    assert one(spark, [1e-7, 12345678.5, 100.0, -0.0, None], "double", cells.number) == ["0.0000001", "12345678.5", "100", "0", ""]
    assert one(spark, [65536, 65280], "long", cells.size_label) == ["64 KiB", "65280 B"]
    assert one(spark, ["a|<b>&`[c]\n"], "string", cells.escaped) == ["a&#124;&lt;b&gt;&amp;&#96;&#91;c&#93; "]
    assert one(spark, ["a/b", "../a", "a/..", "a/..b", "/a", "c:a", "a\\b", "", None], "string", cells.confined) == [True, False, False, True, False, False, False, False, False]


def test_pmu_needs_every_part(spark):
    data = [("a", p, v) for p, v in (("real_n", 900), ("real_0", 100), ("stub_n", 300), ("stub_0", 100))] + [("b", "real_n", 1), ("c", "real_n", None)]
    df = spark.createDataFrame(data, "k string, part string, v long")
    assert rows(evidence.pmu_adjusted(df, ["k"], "part", ["v"], 200)) == [("a", 3.0), ("b", None), ("c", None)]


def test_ledger_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    assert rows(evidence.ledger_difference(a, b, ["k"])) == [(1, 1), (3, -1)]


def test_refs_end_at_an_element(spark):
    refs = spark.createDataFrame([("a/x.json", 1, "s"), ("x.json", 1, "s"), ("q.json", 1, "s")], "ref string, bytes int, sha256 string")
    held = spark.createDataFrame([("r/a/x.json", 1, "s"), ("r/ba/x.json", 1, "s"), ("x.json", 2, "s")], "path string, bytes int, sha256 string")
    assert rows(evidence.resolved(refs, held).select("ref", "path")) == [("a/x.json", "r/a/x.json"), ("x.json", "r/a/x.json"), ("x.json", "r/ba/x.json")]


def test_crossings(spark):
    df = spark.createDataFrame([("a", k, k, 2) for k in range(5)] + [("b", 0, 1, 2)], "k string, h int, x int, y int")
    assert rows(evidence.crossings(df, "k", "h", "x", "y")) == [("a", 1, 3), ("b", 0, None)]
    assert rows(evidence.monotone(df, "k", "h", "x")) == [("a", True, 0, 4), ("b", True, 1, 1)]


def test_tolerance_is_inclusive(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.11, 0.0), (0.4, 0.2)], "c double, s double")
    assert [r[0] for r in df.select(evidence.within_tolerance(F.col("c"), F.col("s"))).collect()] == [True, False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2.5, "x", None), (1.0, "y", 3)], "b double, a string, c int")
    sinks.json_lines(df.coalesce(1), f"{tmp_path}/j")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"a":"x","b":2.5,"c":null}', '{"a":"y","b":1.0,"c":3}']
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.json_lines(df, f"{tmp_path}/j")
    with pytest.raises(Exception, match="not finite"):
        sinks.json_lines(spark.createDataFrame([(float("nan"),)], "b double"), f"{tmp_path}/n")
    sinks.csv(df.coalesce(1), f"{tmp_path}/c", ["c", "a"])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["c,a", ",x", "3,y"]
    sinks.replace_group(spark.createDataFrame([(1, "p"), (2, "q")], "v int, g string"), f"{tmp_path}/g", "g")
    sinks.replace_group(spark.createDataFrame([(9, "q")], "v int, g string"), f"{tmp_path}/g", "g")
    assert rows(spark.read.parquet(f"{tmp_path}/g").select("v", "g")) == [(1, "p"), (9, "q")]


def test_splitmix_is_the_sequential_generator(spark):
    state, want = 7, []
    for _ in range(50):
        state = (state + generators.SPLITMIX[0]) % generators.WORD
        z = (state ^ state >> 30) * generators.SPLITMIX[1] % generators.WORD
        z = (z ^ z >> 27) * generators.SPLITMIX[2] % generators.WORD
        want.append(z ^ z >> 31)
    bound = (1 << 63) - 25  # refuses about half of a word's values
    limit = generators.WORD - generators.WORD % bound
    assert rows(generators.draws(spark, 50, bound, 7).select("i", "draw")) == [(k, z % bound) for k, z in enumerate(want) if z < limit]
    assert rows(generators.draws(spark, 50, 64, 7).select("draw", "i")) == sorted((z % 64, k) for k, z in enumerate(want))


def test_region_trace_boundaries(spark):
    t = dict(rows(generators.region_trace(spark, 100, 100)))
    assert len(t) == 212 and set(t.values()) == {0} and min(t) == -12 and max(t) == 199
    with pytest.raises(ValueError):
        generators.region_trace(spark, 10, 11)
