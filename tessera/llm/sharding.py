"""Proportional stratified interleaving of rows into shards, in DataFrame operations only.

Rows are shuffled by a seeded hash within their source; row r of n gets the fractional rank (2 r + 1) / (2 n). Sorted by
it, every stretch of the whole holds each source in its share, and cutting the order into equal stretches makes shards
whose row counts differ by at most one.

No window spans a source or the table. The hash's leading bits put a source's rows into buckets of about BUCKET rows;
counts by bucket, summed up over the buckets, give each bucket's first rank, and a window only ranks the rows of one
bucket. The global order is ranked the same way over stretches of the fractional rank. Only ids, sizes, hashes and
checksums are shuffled, never texts.

Defined results: a null source is a source of its own, a null text is empty; rows that agree in doc_id, size and
checksum are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS, SEED = 16, "tessera-6"
#: Rows that one window ranks, about.
BUCKET = 10_000
_HASH = 1 << 60


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """rows with their rank from 0 within keys, by bucket and then order. Counts by bucket are few, as buckets are large."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bucket]], F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    return rows.withColumn("_within", within).join(starts, same).withColumn(rank, F.col("_start") + F.col("_within") - 1).drop("_start", "_within", *[f"_{k}" for k in [*keys, bucket]])


def shards(docs: DataFrame, n: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = scratch.cut(docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hashed.alias("h")))
    sources = rows.groupBy("source").agg(F.count("*").alias("of"))
    sources = sources.select(F.col("source").alias("s"), "of", F.expr(f"(1 + of div {BUCKET})").alias("buckets"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("b", F.floor(F.col("h") / _HASH * F.col("buckets")).cast("long")).drop("s", "buckets")
    tie = ["h", "doc_id", "text_crc32", "size"]
    rows = _ranked(rows, ["source"], "b", tie, "r").withColumn("at", (2 * F.col("r") + 1) / (2 * F.col("of")))
    total = sources.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("n")).first()["n"]
    stretches = 1 + total // BUCKET
    rows = rows.withColumn("g", F.floor(F.col("at") * stretches).cast("long"))
    rows = _ranked(rows, [], "g", ["at", F.col("source").asc_nulls_first(), *tie], "place")
    shard = F.expr(f"place * {n} div {max(total, 1)}").cast("int")
    rows = rows.withColumn("shard", shard)
    # the first place p of shard k is the least with p * n div total = k
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.expr(f"(shard * {total} + {n - 1}L) div {n}")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
