"""Readers and the block store."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import store, text


@pytest.mark.parametrize("codec", sorted(store.CODECS))
def test_region_reads_return_the_bytes(spark, codec):
    rng = random.Random(4)
    raw = bytes(rng.randrange(256) for _ in range(10_000))
    cuts = [0, 1, 700, 701, 5000, 10_000]
    pieces = spark.createDataFrame([("c", a, raw[a:b]) for a, b in zip(cuts, cuts[1:])] + [("c", 10_000, b"")], "corpus string, piece_off long, bytes binary")
    blocks = store.encode(pieces, codec, 1024).cache()
    asked = [(0, 0, 1), (1, 1023, 1025), (2, 0, 10_000), (3, 9_999, 10_000), (4, 9_999, 10_001), (5, -1, 4), (6, 5, 5), (7, 20_000, 20_001)]
    asked += [(10 + k, a, a + rng.randrange(1, 3000)) for k, a in enumerate(rng.randrange(7000) for _ in range(20))]
    got = {r.request_id: r for r in store.read(blocks, spark.createDataFrame([(k, "c", a, b) for k, a, b in asked], "request_id int, corpus string, lo long, hi long"), codec, 1024).collect()}
    for k, a, b in asked:
        want = raw[a:b] if 0 <= a < b <= len(raw) else None
        assert (None if got[k].bytes is None else bytes(got[k].bytes)) == want, (a, b)
    assert (got[1].blocks, got[1].decoded) == (2, 2048)
    g = store.geometry(blocks).first()
    assert (g.units, g.raw, g.largest, g.whole) == (10, 10_000, 1024, True)


def test_a_corrupt_block_is_refused(spark):
    pieces = spark.createDataFrame([("c", 0, b"abc" * 100)], "corpus string, piece_off long, bytes binary")
    bad = store.encode(pieces, "zlib", 100).withColumn("sha256", F.lit("0"))
    with pytest.raises(Exception, match="digest"):
        store.decode(bad, "zlib").collect()


def test_text_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"query":0,"byte_offset":5,"requested_bytes":10,"verified":true,"latency_ms":0.5}\n{"query":1,"byte_offset":95,"verified":true,"latency_ms":-1}\n')
    rows = text.samples(spark, str(tmp_path / "s.json"))
    assert sorted(r.problem for r in text.broken_samples(rows, 100, 10, 2).collect()) == ["latency is not positive and finite", "range outside the input"]
    assert [r.problem for r in text.broken_samples(rows.limit(1), 100, 10, 2).collect()] == ["wrong number of samples"]
    (tmp_path / "a.bed").write_text("#c\nchr1\t0\t5\tx\n")
    assert [tuple(r) for r in text.bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 0, 5, "x")]
    (tmp_path / "p.csv").write_text("12;;cycles;1;100\n<not supported>;;misses;0;0\n")
    assert {r.event: r.value for r in text.perf(spark, str(tmp_path / "p.csv")).collect()} == {"cycles": 12.0, "misses": None}
    (tmp_path / "t").write_text("5 16384\n")
    assert text.trace(spark, str(tmp_path / "t")).first()["length"] == 16384
