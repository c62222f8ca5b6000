"""Seeded request traces. The values of a seed are fixed: other tools replay the same trace."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The linear congruential generator's factor and step, and SplitMix64's
LCG = (6364136223846793005, 1442695040888963407)
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
WORD = 1 << 64


def region_trace(spark: SparkSession, size: int, length: int, seed: int = 20260909, warm: int = 10, timed: int = 200) -> DataFrame:
    """query, byte_offset: the first and last range, then warm-ups (all of negative number), then timed requests.

    Each state needs the one before, so these few (warm + timed) are made on the driver.
    """
    if not 0 < length <= size:
        raise ValueError("a request must lie within the input")
    offsets = [0, size - length]
    for _ in range(warm + timed):
        seed = (seed * LCG[0] + LCG[1]) % WORD
        offsets.append(seed % (size - length + 1))
    return spark.createDataFrame([(k - warm - 2, x) for k, x in enumerate(offsets)], "query long, byte_offset long")


def _mixed(seed: int, bound: int):
    limit = WORD - WORD % bound

    @F.arrow_udf(T.StructType([T.StructField("draw", T.LongType()), T.StructField("uniform", T.DoubleType())]))
    def run(counter: pa.Array) -> pa.Array:
        step, a, b = (np.uint64(x) for x in SPLITMIX)
        z = np.uint64(seed % WORD) + (counter.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)) * step
        z = (z ^ (z >> np.uint64(30))) * a
        z = (z ^ (z >> np.uint64(27))) * b
        z ^= z >> np.uint64(31)
        refused = z >= np.uint64(limit) if limit < WORD else np.zeros(len(z), bool)
        draw = pa.array((z % np.uint64(bound)).astype(np.int64), mask=refused)
        return pa.StructArray.from_arrays([draw, pa.array((z >> np.uint64(11)) / float(1 << 53))], ["draw", "uniform"])

    return run


def draws(spark: SparkSession, n: int, bound: int, seed: int = 20260910) -> DataFrame:
    """i, draw in [0, bound) and uniform in [0, 1) for n counters of SplitMix64, 1 <= bound < 2^63.

    A state is a function of its counter, so any number is made in parallel. A counter that rejection refuses (fewer than
    bound in 2^64) has no row; the others, in the order of i, are the generator's sequence.
    """
    d = spark.range(n).select(F.col("id").alias("i"), _mixed(seed, bound)(F.col("id")).alias("d"))
    return d.select("i", "d.draw", "d.uniform").filter("draw is not null")


def _drawn(counter: str, bound: int, seed: int) -> Column:
    """The draw of a counter that must not be refused: a refusal would shift all draws after it."""
    draw = _mixed(seed, bound)(F.expr(counter))["draw"]
    return F.coalesce(draw, F.raise_error(F.lit("a draw was refused; take another seed")).cast("long"))


# Requests of a profile, request length, distance of a cluster's requests, requests of a cluster, hot blocks
REQUESTS, LENGTH, SPAN, CLUSTER, HOT = 5000, 16384, 1 << 20, 32, 64


def clustered(spark: SparkSession, size: int, n: int = REQUESTS, seed: int = 20260912) -> DataFrame:
    """i, anchor and byte_offset: each CLUSTER requests fall within SPAN after an anchor of their own.

    One stream: a cluster's anchor is drawn first, then an offset for each of its requests, so request i takes draw
    i + i div 32 + 1 and its anchor draw 33 (i div 32).
    """
    end = size - LENGTH
    if end < SPAN:
        raise ValueError("the input is too small for clusters")
    rows = spark.range(n).withColumnRenamed("id", "i")
    rows = rows.withColumn("anchor", _drawn(f"{CLUSTER + 1} * (i div {CLUSTER})", end - SPAN + 1, seed))
    return rows.select("i", "anchor", (F.col("anchor") + _drawn(f"i + i div {CLUSTER} + 1", SPAN, seed)).alias("byte_offset"))


def hot_set(spark: SparkSession, size: int, n: int = REQUESTS, seed: int = 20260911) -> DataFrame:
    """i, block and byte_offset: requests into HOT blocks, the first distinct ones drawn. One stream goes on for the
    requests, two draws each: which hot block, and where in it."""
    end = size - LENGTH
    blocks, some = end // LENGTH + 1, 64 * HOT
    if blocks < 16 * HOT:
        raise ValueError("the input is too small for hot blocks")
    first = draws(spark, some, blocks, seed).groupBy("draw").agg(F.min("i").alias("at")).orderBy("at").limit(HOT)
    chosen = [(r["draw"], r["at"]) for r in first.collect()]  # HOT rows
    used = chosen[-1][1] + 1
    hot = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(chosen)], "k long, block long")
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("k", _drawn(f"{used} + 2 * i", HOT, seed))
    rows = rows.join(F.broadcast(hot), "k")
    whole, last = _drawn(f"{used} + 2 * i + 1", LENGTH, seed), _drawn(f"{used} + 2 * i + 1", end % LENGTH + 1, seed)
    return rows.select("i", "block", (F.col("block") * LENGTH + F.when(F.col("block") == blocks - 1, last).otherwise(whole)).alias("byte_offset"))


def scaled(digest: Column, n: Column) -> Column:
    """The first 8 bytes of a hex digest as a share of 2^64 of n (less than 10^12), in exact integers."""
    first = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    product, word = first * n.cast("decimal(12,0)"), F.lit(str(WORD)).cast("decimal(20,0)")
    return ((product - product % word) / word).cast("long")


# The text whose digest plans a case, and how many there are
CASE, CASES = "axis5:20261003:", 100


def one_bit_plan(archives: DataFrame, length: str) -> DataFrame:
    """archives with case_id, byte_at and bit of CASES corruptions: the same place and bit of each case at any length."""
    cases = archives.withColumn("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CASES - 1).cast("long"))))
    digest = F.sha2(F.concat(F.lit(CASE), F.col("case_id").cast("string")), 256)
    return cases.select("*", scaled(digest, F.col(length)).alias("byte_at"), (F.conv(F.substring(digest, 17, 2), 16, 10).cast("long") % 8).alias("bit"))
