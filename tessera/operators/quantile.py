"""Nearest-rank percentiles, averaged medians and spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of the sketch that brackets an exact rank is one in so many.
ACCURACY = 10_000


def rank_of(percent: int, n: Column) -> Column:
    """1-based nearest rank ceil(percent * n / 100) in integers."""
    return F.floor((n * percent + 99) / 100)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: dict) -> DataFrame:
    """keys, n, and the exact nearest-rank percentile for each name in percents (a percent, or a pair of it and a function from n to the rank).

    A mergeable sketch brackets each rank; one more pass counts what lies below the bracket and ranks only what lies in
    it, a few ten-thousandths of a group. No task sorts a whole group.
    """
    ranks = {name: p if isinstance(p, tuple) else (p, lambda n, p=p: rank_of(p, n)) for name, p in percents.items()}
    shares = [s for p, _ in ranks.values() for s in (max(0.0, p / 100 - 3 / ACCURACY), min(1.0, p / 100 + 3 / ACCURACY))]
    rows = df.select(*keys, F.col(value).alias("_v")).filter("_v is not null")
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", shares, ACCURACY).alias("_cut"))
    met = rows.join(sketch, keys) if keys else rows.crossJoin(sketch)
    parts = []
    for k, (name, (_, rank)) in enumerate(ranks.items()):
        lo, hi = F.col("_cut")[2 * k], F.col("_cut")[2 * k + 1]
        counted = met.filter(F.col("_v") <= hi).groupBy(*keys, "n", F.when(F.col("_v") >= lo, F.col("_v")).alias("_v")).agg(F.count("*").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
        parts.append(counted.withColumn("_upto", upto).filter(F.col("_v").isNotNull() & (F.col("_upto") >= rank(F.col("n")))).groupBy(*keys, "n").agg(F.min("_v").alias(name)))
    return reduce(lambda a, b: a.join(b, [*keys, "n"]), parts)


def averaged_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the mean of the two middle values (or the middle one), found as ranks, so that no task holds a group."""
    middle = {"_lo": (50, lambda n: F.floor((n + 1) / 2)), "_hi": (50, lambda n: F.floor(n / 2) + 1)}
    return nearest_rank(df, keys, value, middle).select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, averaged median, mean, population coefficient of variation (0 for one value), min and max."""
    v = F.col(value)
    cv = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_pop(v) / F.avg(v))
    rest = df.groupBy(*keys).agg(F.avg(v).alias("mean"), cv.alias("cv"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = averaged_median(df, keys, value)
    return middle.join(rest, keys) if keys else middle.crossJoin(rest)
