"""Readers of the plain text inputs: samples, traces, indexes, annotations. Every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "query int, byte_offset long, requested_bytes long, verified boolean, latency_ms double, decoded_bytes long"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of region samples; a malformed line fails the read."""
    return spark.read.schema(SAMPLE).json(path, mode="FAILFAST")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated intervals; lines that start with # are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, lo long, hi long, label string", mode="FAILFAST")


def fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, length long, base_offset long, line_bases long, line_bytes long", mode="FAILFAST")


def trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="byte_offset long, length long", mode="FAILFAST")


def perf(spark: SparkSession, path: str) -> DataFrame:
    """Counters of `perf stat -x ;`: what was not counted is null."""
    raw = spark.read.csv(path, sep=";", comment="#", schema="value string, unit string, event string, run_time string, share string")
    return raw.filter("event is not null").select("event", F.expr("try_cast(value as double)").alias("value"))


def broken_samples(rows: DataFrame, size: int, region: int, expected: int) -> DataFrame:
    """Violations of the sample contract: a row each for what is wrong, none if all is well."""
    each = rows.select(
        "query",
        F.explode(F.array_compact(F.array(
            F.when(~F.coalesce("verified", F.lit(False)), "not verified"),
            F.when(~F.coalesce((F.col("latency_ms") > 0) & (F.col("latency_ms") < float("inf")), F.lit(False)), "latency is not positive and finite"),
            F.when(~F.coalesce((F.col("byte_offset") >= 0) & (F.col("byte_offset") + region <= size), F.lit(False)), "range outside the input"),
            F.when(~F.coalesce((F.col("query") >= 0) & (F.col("query") < expected), F.lit(False)), "query number out of range"),
        ))).alias("problem"),
    )
    counted = rows.agg(F.count("*").alias("n"), F.count_distinct("query").alias("d")).filter((F.col("n") != expected) | (F.col("d") != expected))
    return each.unionByName(counted.select(F.lit(None).cast("int").alias("query"), F.lit("wrong number of samples").alias("problem")))
