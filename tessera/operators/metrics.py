"""Scalar metrics, ratios of sums, histograms and verdicts against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_of_sums(df: DataFrame, keys: list[str], above: Column, below: Column, name: str) -> DataFrame:
    """Sum of above over sum of below: never a mean of ratios."""
    return df.groupBy(*keys).agg(F.sum(above).alias("above"), F.sum(below).alias("below")).withColumn(name, F.col("above") / F.col("below"))


def break_even(full_ms: Column, p50_ms: Column) -> Column:
    """Reads after which a full decode is cheaper."""
    return (F.floor(full_ms / p50_ms) + 1).cast("long")


def mb_per_s(n_bytes: Column, ms: Column) -> Column:
    return n_bytes / ms / 1000


def blocks_touched(offset: Column, length: Column, g: int) -> Column:
    return (F.floor((offset + length - 1) / g) - F.floor(offset / g) + 1).cast("long")


def curve_percent(whole: Column, point: Column) -> Column:
    """Cost of granularity, signed, in percent."""
    return F.when((whole > 0) & (point > 0), 100 * (1 - whole / point))


def curve_fraction(whole: Column, point: Column) -> Column:
    return F.when((whole > 0) & (point > 0), 1 - whole / point)


def isclose(a: Column, b: Column, rel: float = 1e-12, absolute: float = 1e-10) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def positive(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0), F.lit(False))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def relative(df: DataFrame, metric: str, key: str, baseline: str, limit: float, at_least: bool) -> DataFrame:
    """Each row's metric over the baseline row's, and PASS or FAIL against limit. One baseline row: a scalar join."""
    base = df.filter(F.col(key) == baseline).select(F.col(metric).alias("base")).limit(1)
    rel = F.col(metric) / F.col("base")
    return df.crossJoin(F.broadcast(base)).withColumn("relative", rel).withColumn("verdict", F.when(rel >= limit if at_least else rel <= limit, "PASS").otherwise("FAIL"))


def against(df: DataFrame, baseline: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Left join on null-safe keys; a missing baseline leaves a reason, never 0."""
    base = baseline.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(metric).alias("base"))
    joined = df.join(base, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("relative", F.col(metric) / F.col("base")).withColumn("reason", F.when(F.col("base").isNull(), "n/a - no baseline in this run"))


def entropy(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Shannon entropy in bits of the block distribution, and the distinct blocks, by two-level aggregation."""
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"), F.count("*").alias("blocks"))
    return total.select(*keys, "n", "blocks", F.greatest(F.lit(0.0), F.log2("n") - F.col("_s") / F.col("n")).alias("entropy"))
