"""Inputs of the benchmark operators, as views over the synthetic tables: one definition for each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, d):
    """Region samples: one timed read each."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("codec"), F.col("event_id").alias("query"), (F.col("user_id") % 10).alias("config"), (F.col("event_id") % 3).alias("pass"),
        F.col("value").alias("latency_ms"), ((F.col("event_id") * 2654435761) % 50000000).alias("byte_offset"), F.lit(16384).cast("long").alias("requested_bytes"),
        (16384 * (1 + F.col("event_id") % 5)).alias("decoded_bytes"),
    )


def archives(spark, d):
    """Archive sizes by codec, file and granularity."""
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("codec"), F.col("l_suppkey").alias("file"), F.pow(F.lit(4), F.col("l_linenumber") + 5).cast("long").alias("g"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("input_bytes"), F.round(F.col("l_extendedprice") * (1 + F.col("l_discount")) * 20).cast("long").alias("archive_bytes"),
        F.round(F.col("l_quantity") * 8).cast("long").alias("index_bytes"),
    )


def decodes(spark, d):
    """Timed full decodes."""
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("codec"), (F.col("o_orderkey") % 9).alias("repeat"), (F.col("o_totalprice") / 1000).alias("wall_ms"),
        F.pow(F.lit(2), F.col("o_custkey") % 4).cast("long").alias("copies"),
    )


def requests(spark, d):
    """Byte ranges asked for."""
    e = table(spark, d, "events")
    lo = (F.col("event_id") * 7919) % 1000000
    return e.select(F.col("event_id").alias("request_id"), lo.alias("lo"), (lo + 1 + F.col("event_id") % 16384).alias("hi"))


def units(spark, d):
    """Sizes of independent units, in the order of unit_id; character counts stand for bytes."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.length("text").cast("long").alias("ulen"))


def intervals(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + 1 + F.col("l_linenumber")).cast("long").alias("hi"))


def observations(spark, d):
    """Outcomes of decoding corrupted archives."""
    e, i = table(spark, d, "events"), F.col("event_id")
    code = F.when(i % 11 == 0, -11).when(i % 13 == 0, 1).otherwise(0)
    return e.select(i.alias("id"), (i % 5).alias("kind"), (i % 2 == 0).alias("hash_enabled"), (i % 2 != 0).alias("started"), (i % 7 == 0).alias("timed_out"), code.alias("returncode"), (i % 17 != 0).alias("bytes_equal"))


def curve(spark, d):
    """Points of granularity curves with their one-block baselines."""
    k = F.col("p_size") % 8
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.split("p_type", " ")[0].alias("grp"), (4096 * F.pow(F.lit(2), k)).cast("long").alias("g"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("baseline_bytes"), F.round(F.col("p_retailprice") * (100 + 10 * (8 - k))).cast("long").alias("point_bytes"),
    )


#: The same views for DuckDB.
SQL = {
    "samples": "SELECT event_type AS codec, event_id AS query, user_id % 10 AS config, event_id % 3 AS pass, value AS latency_ms, (event_id * 2654435761) % 50000000 AS byte_offset, CAST(16384 AS BIGINT) AS requested_bytes, 16384 * (1 + event_id % 5) AS decoded_bytes FROM events",
    "archives": "SELECT concat(l_returnflag, l_linestatus) AS codec, l_suppkey AS file, CAST(pow(4, l_linenumber + 5) AS BIGINT) AS g, CAST(round(l_extendedprice * 100) AS BIGINT) AS input_bytes, CAST(round(l_extendedprice * (1 + l_discount) * 20) AS BIGINT) AS archive_bytes, CAST(round(l_quantity * 8) AS BIGINT) AS index_bytes FROM lineitem",
    "decodes": "SELECT o_orderpriority AS codec, o_orderkey % 9 AS repeat, o_totalprice / 1000 AS wall_ms, CAST(pow(2, o_custkey % 4) AS BIGINT) AS copies FROM orders",
    "requests": "SELECT event_id AS request_id, (event_id * 7919) % 1000000 AS lo, (event_id * 7919) % 1000000 + 1 + event_id % 16384 AS hi FROM events",
    "units": "SELECT doc_id AS unit_id, length(text) AS ulen FROM documents",
    "intervals": "SELECT l_suppkey AS chrom, l_partkey AS lo, l_partkey + 1 + l_linenumber AS hi FROM lineitem",
    "observations": "SELECT event_id AS id, event_id % 5 AS kind, event_id % 2 = 0 AS hash_enabled, event_id % 2 <> 0 AS started, event_id % 7 = 0 AS timed_out, CASE WHEN event_id % 11 = 0 THEN -11 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS returncode, event_id % 17 <> 0 AS bytes_equal FROM events",
    "curve": "SELECT p_partkey AS id, p_brand AS file, split_part(p_type, ' ', 1) AS grp, CAST(4096 * pow(2, p_size % 8) AS BIGINT) AS g, CAST(round(p_retailprice * 100) AS BIGINT) AS baseline_bytes, CAST(round(p_retailprice * (100 + 10 * (8 - p_size % 8))) AS BIGINT) AS point_bytes FROM part",
}


def sql(body: str, *views: str, **more: str) -> str:
    """DuckDB text with the named views, and more of its own, in front."""
    heads = [f"{v} AS ({SQL[v]})" for v in views] + [f"{k} AS ({text})" for k, text in more.items()]
    return f"WITH {', '.join(heads)} {body}" if heads else body
