"""Comparing runs, ledgers and cohorts, and the verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("real_n", "real_0", "stub_n", "stub_0")


def pmu_adjusted(df: DataFrame, keys: list[str], part: str, values: list[str], queries: int) -> DataFrame:
    """Counters per query without start-up and harness: ((real_n - real_0) - (stub_n - stub_0)) / queries.

    A part that is missing, or has a null, makes the result null.
    """
    of = lambda p, v: F.when(F.count_if((F.col(part) == p) & F.col(v).isNull()) == 0, F.sum(F.when(F.col(part) == p, F.col(v))))
    net = lambda v: ((of("real_n", v) - of("real_0", v)) - (of("stub_n", v) - of("stub_0", v))) / queries
    return df.groupBy(*keys).agg(*[net(v).alias(v) for v in values])


def compared(old: DataFrame, new: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Both runs' metric by key, the signed change, and which side has the key."""
    a, b = (df.select(*keys, F.col(metric).alias(name), F.lit(True).alias(f"_{name}")) for df, name in ((old, "old"), (new, "new")))
    side = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "extra").otherwise("both")
    return a.join(b, keys, "full").select(*keys, "old", "new", (F.col("new") / F.col("old") - 1).alias("change"), side.alias("side"))


def within_tolerance(change: Column, spread: Column, least: float = 0.1) -> Column:
    """A change within the calibrated tolerance: the larger of `least` and twice the spread, (max - min) / min, of repeats."""
    return F.abs(change) <= F.greatest(F.lit(least), 2 * spread)


def ledger_difference(planned: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ, with the difference (positive: missing), as one aggregation and no join."""
    both = planned.select(*keys, F.lit(1).alias("_n")).unionByName(found.select(*keys, F.lit(-1).alias("_n")))
    return both.groupBy(*keys).agg(F.sum("_n").alias("lacking")).filter("lacking <> 0")


def _leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def resolved(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """References (ref, bytes, sha256) with the artifacts (path, bytes, sha256) they name: same content, and a path that ends in ref.

    A path can only end in ref if its last element does too, so that joins the keys: equal files do not meet as all pairs.
    """
    r, m = refs.withColumn("_leaf", _leaf(F.col("ref"))), manifest.withColumn("_leaf", _leaf(F.col("path")))
    ends = (F.col("path") == F.col("ref")) | F.endswith("path", F.concat(F.lit("/"), "ref"))
    return r.join(m, ["bytes", "sha256", "_leaf"]).filter(ends).drop("_leaf")


def agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """Positions at which two answer lists agree, and all positions; the shorter list's rest does not agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y)), lambda s: s))
    return same.cast("long"), F.greatest(F.size(a), F.size(b)).cast("long")


def cohort(listed: DataFrame, local: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n listed rows, in list order, that exist locally with equal keys (a top-n report)."""
    return listed.join(local.select(*keys).distinct(), keys, "left_semi").orderBy(order).limit(n)


def monotone(df: DataFrame, key: str, along: str, value: str) -> DataFrame:
    """Whether value never falls along an axis, and its first and last values."""
    step = F.col(value) >= F.lag(value).over(Window.partitionBy(key).orderBy(along))
    return df.withColumn("_up", step).groupBy(key).agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("nondecreasing"), F.min_by(value, along).alias("first"), F.max_by(value, along).alias("last"))


def crossings(df: DataFrame, key: str, along: str, a: str, b: str) -> DataFrame:
    """How often, and first where, the answer to `a > b` changes along an axis."""
    over = F.col(a) > F.col(b)
    flip = over != F.lag(over).over(Window.partitionBy(key).orderBy(along))
    return df.withColumn("_flip", flip).groupBy(key).agg(F.count_if("_flip").alias("crossings"), F.min(F.when(F.col("_flip"), F.col(along))).alias("first_at"))


def aggregate_verdict(entries: DataFrame, keys: list[str], foreign: Column, own: Column, variants: list[str], least: int = 4) -> DataFrame:
    """Verdict over entries (family, variant, data_status, verdict): enough foreign families with valid data, every own variant
    there, all data valid and all verdicts PASS."""
    ok, good = F.col("data_status") == "PASS", F.col("verdict") == "PASS"
    found = entries.groupBy(*keys).agg(
        F.count_distinct(F.when(foreign & ok, F.col("family"))).alias("foreign_families"),
        F.count_distinct(F.when(own & F.col("variant").isin(variants), F.col("variant"))).alias("_own"),
        F.bool_and(ok).alias("_valid"), F.bool_and(good).alias("_passed"),
    )
    covered = (F.col("foreign_families") >= least) & (F.col("_own") == len(variants))
    return found.select(
        *keys, "foreign_families", covered.alias("covered"), F.when(F.col("_valid"), "PASS").otherwise("FAILED").alias("data_status"),
        F.when(covered & F.col("_valid") & F.col("_passed"), "PASS").otherwise("FAIL").alias("verdict"),
    )


def deploy_gate(rows: DataFrame, mode: Column, kinds: list[str]) -> DataFrame:
    """Rows of the kinds that count as measured, and whether to publish: at least one, in a real release."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(kinds)).alias("measured"), F.bool_and(F.coalesce(mode == "real", F.lit(False))).alias("_real")).select("n", "measured", (F.coalesce("_real", F.lit(False)) & (F.col("measured") > 0)).alias("deploy"))


def shortfall(need: Column, free: int) -> Column:
    return F.greatest(need - free, F.lit(0))
