"""Pareto fronts and constrained choice: larger ratio and smaller p50 are better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def front_by_dominance(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Rows that no other dominates, by a theta anti join: the definition, for small inputs and as a check of skyline().

    others: the rows that may dominate, all by default; the front of all rows is enough.
    """
    others = rows if others is None else others
    o = others.select(F.col("ratio").alias("r2"), F.col("p50").alias("p2"))
    beats = (F.col("r2") >= F.col("ratio")) & (F.col("p2") <= F.col("p50")) & ((F.col("r2") > F.col("ratio")) | (F.col("p2") < F.col("p50")))
    return rows.join(o, beats, "left_anti")


def dominators(rows: DataFrame, key: str) -> DataFrame:
    """For each dominated row, the sorted keys of the rows that dominate it."""
    o = rows.select(F.col(key).alias("by"), F.col("ratio").alias("r2"), F.col("p50").alias("p2"))
    beats = (F.col("r2") >= F.col("ratio")) & (F.col("p2") <= F.col("p50")) & ((F.col("r2") > F.col("ratio")) | (F.col("p2") < F.col("p50")))
    return rows.join(o, beats).groupBy(key).agg(F.array_sort(F.collect_list("by")).alias("dominated_by"))


def skyline(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """The same front in two passes that scale: no pair of rows is formed.

    Only the best ratio of each p50 can be on the front; it is if it beats the best ratio of every smaller p50. The running
    maximum is taken first over ranges of p50 and then within each range.
    """
    best = rows.filter("ratio is not null and p50 is not null").groupBy("p50").agg(F.max("ratio").alias("top"))
    cuts = best.agg(F.percentile_approx("p50", [k / buckets for k in range(1, buckets)], 10_000).alias("cuts"))
    ranged = best.crossJoin(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("p50")))).drop("cuts")
    before = F.max("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    heads = ranged.groupBy("b").agg(F.max("top").alias("m")).select("b", before.alias("earlier"))
    within = F.max("top").over(Window.partitionBy("b").orderBy("p50").rowsBetween(Window.unboundedPreceding, -1))
    kept = ranged.withColumn("within", within).join(F.broadcast(heads), "b").filter(F.coalesce(F.col("top") > F.greatest("within", "earlier"), F.lit(True)))
    on = kept.select(F.col("p50").alias("_p"), F.col("top").alias("_t"))
    return rows.join(on, (F.col("p50") == F.col("_p")) & (F.col("ratio") == F.col("_t")), "left_semi")


def best_per(rows: DataFrame, key: str, order: list[Column], where: Column | None = None) -> DataFrame:
    """The first eligible row of each key in order (which must be total)."""
    rows = rows if where is None else rows.filter(where)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def without_choice(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Keys that have rows but none eligible."""
    return rows.select(key).distinct().join(chosen, key, "left_anti")
