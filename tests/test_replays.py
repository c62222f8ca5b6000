"""Generators and audits against plain sequential versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import audits, generators, judges

MASK = (1 << 64) - 1


def stream(seed):
    while True:
        seed = (seed + generators.SPLITMIX[0]) & MASK
        z = ((seed ^ (seed >> 30)) * generators.SPLITMIX[1]) & MASK
        z = ((z ^ (z >> 27)) * generators.SPLITMIX[2]) & MASK
        yield z ^ (z >> 31)


@pytest.mark.parametrize("size", [3_000_000, 50_000_000, 17_825_792])
def test_clustered_and_hot_set(spark, size):
    end, draw, want = size - generators.LENGTH, stream(20260912), []
    for i in range(1000):
        if i % 32 == 0:
            anchor = next(draw) % (end - generators.SPAN + 1)
        want.append(anchor + next(draw) % generators.SPAN)
    assert [r.byte_offset for r in generators.clustered(spark, size, 1000).orderBy("i").collect()] == want
    if end // generators.LENGTH < 16 * generators.HOT:
        with pytest.raises(ValueError):
            generators.hot_set(spark, size)
        return
    draw, hot, want = stream(20260911), [], []
    while len(hot) < generators.HOT:
        b = next(draw) % (end // generators.LENGTH + 1)
        hot += [b] * (b not in hot)
    for _ in range(1000):
        at = hot[next(draw) % generators.HOT] * generators.LENGTH
        want.append(at + next(draw) % min(generators.LENGTH, end - at + 1))
    assert [r.byte_offset for r in generators.hot_set(spark, size, 1000).orderBy("i").collect()] == want


def test_one_bit_plan(spark):
    lengths = [1, 7, 65_280, 10**11 + 7]
    got = generators.one_bit_plan(spark.createDataFrame([(n,) for n in lengths], "n long"), "n").collect()
    digests = [hashlib.sha256(f"{generators.CASE}{k}".encode()).digest() for k in range(100)]
    want = {(n, k, int.from_bytes(h[:8], "big") * n >> 64, h[8] % 8) for n in lengths for k, h in enumerate(digests)}
    assert {tuple(r) for r in got} == want and len(got) == 400


def test_window_law_roles_and_refusals(spark):
    schema = "id int, d_bps long, w_bytes long, q_bytes long, measured_us long, probe_us long"
    rows = [(1, 10**6, 1, 5, 10**6, 10), (2, 10**6, 1000, 5, 10**6, 10), (3, 10**6, 1024, 10, 1033, 10), (4, 10**6, 1024, 11, 1033, 10)]
    got = {r.id: (r.verdict, r.model_status, r.error_percent) for r in judges.window_law(spark.createDataFrame(rows, schema)).collect()}
    assert got[1][0] == "CALIBRATION_ONLY" and got[2][0] == "DIAGNOSTIC_ONLY" and got[3] == ("PASS", "VALID", 0.0) and got[4] == ("FAIL", "FAIL", 0.0)
    for bad in [(1, 10**6, 65_537, 5, 1, 1), (1, 0, 1, 5, 1, 1), (1, 10**6, 0, 5, 1, 1)]:
        with pytest.raises(Exception, match="window law"):
            judges.window_law(spark.createDataFrame([bad], schema)).collect()


def test_throughput_problems(spark):
    points = spark.createDataFrame([("a", 1, 10.0, 0.01), ("a", 2, 10.1, 0.01), ("b", 1, 5.0, 0.0)], "codec string, copies long, value double, cv double")
    flat = spark.createDataFrame([("a", True, 10.1, None), ("b", False, None, "n/a - data edge"), ("c", True, 1.0, None)], "codec string, plateau boolean, value double, reason string")
    assert audits.throughput(points, points, flat, flat).collect() == []
    wrong = points.withColumn("value", F.when(F.col("copies") == 2, 10.2).otherwise(F.col("value")))
    heads = spark.createDataFrame([("a", True, 10.0, None), ("b", False, 5.0, " ")], "codec string, plateau boolean, value double, reason string")
    got = sorted((r.codec, r.copies or 0, r.problem) for r in audits.throughput(points, wrong.filter("codec = 'a'"), flat, heads).collect())
    assert got == [("a", 0, "headline"), ("a", 2, "rate"), ("b", 0, "headline"), ("b", 0, "reason"), ("b", 1, "rate"), ("b", 1, "spread"), ("c", 0, "headline"), ("c", 0, "plateau")]


def test_silence_reasons(spark):
    schema = "host string, load1 double, disk_available_bytes long, sampling_seconds double, processes array<struct<cpu_percent: double, own_process: boolean>>"
    quiet = ("h", 0.49, 20_000_000_001, 1.0, [(50.0, True), (9.9, False)])
    loud = ("x", 0.5, 20_000_000_000, 0.9, [(10.0, False)])
    status, reasons = judges.silence("h")
    got = [tuple(r) for r in spark.createDataFrame([quiet, loud], schema).select(status, reasons).collect()]
    assert got == [("PASS", []), ("FAILED", list(judges.NOISE))]
