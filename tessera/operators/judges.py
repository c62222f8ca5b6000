"""Contracts and verdicts: corruption outcomes, completeness, homogeneity, plateaus, window law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("detected", "hang", "crash", "refusal", "harmless", "silent_error")


def outcome() -> Column:
    """Class of an observation, first rule that holds."""
    return (
        F.when(~F.col("started"), "detected").when(F.col("timed_out"), "hang").when(F.col("returncode") < 0, "crash")
        .when(F.col("returncode") > 0, "refusal").when(F.col("bytes_equal"), "harmless").otherwise("silent_error")
    )


def outcome_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    """A column for every outcome, 0 where there is none, and integrity: FAIL if any error was silent."""
    counted = observations.withColumn("outcome", outcome()).groupBy(*keys).pivot("outcome", list(OUTCOMES)).agg(F.count("outcome")).na.fill(0)
    return counted.withColumn("integrity", F.when(F.col("silent_error") > 0, "FAIL").otherwise("PASS"))


def missing_and_extra(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    e, o = expected.select(keys).distinct(), observed.select(keys).distinct()
    return e.join(o, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(o.join(e, keys, "left_anti").withColumn("problem", F.lit("extra")))


def homogeneous(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values of each field, and whether there is one; a null is a value."""
    held = [F.count_distinct(F.coalesce(F.to_json(F.struct(f)), F.lit("{}"))).alias(f) for f in fields]
    wide = rows.agg(*held)
    return wide.unpivot([], fields, "field", "distinct_values").withColumn("homogeneous", F.col("distinct_values") == 1)


def plateau(points: DataFrame, key: str, size: str, median: str, cv: str, last: int = 3, limit: float = 0.05) -> DataFrame:
    """The value at the largest size if the last three medians and their spreads are within limit, else a reason."""
    tail = points.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(size)))).filter(F.col("_k") <= last)
    found = tail.groupBy(key).agg(F.count("*").alias("n"), (F.max(median) / F.min(median) - 1).alias("span"), F.max(cv).alias("worst_cv"), F.max_by(median, size).alias("at_last"))
    flat = (F.col("n") == last) & (F.col("span") <= limit) & (F.col("worst_cv") <= limit)
    return found.withColumn("plateau", flat).withColumn("value", F.when(flat, F.col("at_last"))).withColumn("reason", F.when(~flat, "n/a - data edge: no plateau up to the largest size"))


def window_law(rows: DataFrame) -> DataFrame:
    """Diagnosis of a measured window time: role, error_percent, c0_ok, model_status and verdict.

    The law is t = c0 + (W + Q - 1) / D with c0 = probe - Q / D, so t = probe + (W - 1) / D. Windows of the verdict set
    PASS within 20 percent (inclusive) if c0 is not negative, else FAIL; a window outside it has its role for a verdict. The
    tests are exact in decimals; error_percent is signed, and null where the predicted time is not positive, which fails.
    rows: d_bps, w_bytes, q_bytes, measured_us, probe_us, all exact (decimal or long) and positive, W at most 65536; others are refused.
    """
    d, e = "decimal(12,0)", "decimal(18,4)"
    sound = (F.col("w_bytes") >= 1) & (F.col("w_bytes") <= 65536) & (F.least("d_bps", "q_bytes", "measured_us", "probe_us") > 0)
    x = rows.withColumn("_d", F.when(F.coalesce(sound, F.lit(False)), F.col("d_bps").cast(d)).otherwise(F.raise_error(F.lit("window law: positive numbers and 1 <= W <= 65536 required")).cast(d)))
    x = x.withColumn("_m", F.col("measured_us").cast(e)).withColumn("_p", F.col("probe_us").cast(e))
    law = F.col("_p") * F.col("_d") + (F.col("w_bytes") - 1).cast("decimal(10,0)") * 1_000_000  # t * D, in byte-microseconds
    off = F.col("_m") * F.col("_d") - law
    c0 = F.col("_p") * F.col("_d") >= F.col("q_bytes").cast("decimal(10,0)") * 1_000_000
    within = (law > 0) & (F.abs(off) * 5 <= law)
    error = F.when(law > 0, 100 * off.cast("double") / law.cast("double"))
    is_role = role(F.col("w_bytes"))
    verdict = F.when(is_role == "VERDICT", F.when(within & c0, "PASS").otherwise("FAIL")).otherwise(is_role)
    return x.withColumn("role", is_role).withColumn("error_percent", error).withColumn("c0_ok", c0).withColumn("model_status", F.when(c0, "VALID").otherwise("FAIL")).withColumn("verdict", verdict).drop("_d", "_m", "_p")


def role(w: Column) -> Column:
    return F.when(w == 1, "CALIBRATION_ONLY").when(w.isin(1024, 8192, 65536), "VERDICT").otherwise("DIAGNOSTIC_ONLY")


def suppressed(rows: DataFrame, key: str, passed: Column, metric: str) -> DataFrame:
    """The mean of metric by key; any failure makes the status FAILED and the metric null."""
    found = rows.groupBy(key).agg(F.bool_and(passed).alias("ok"), F.avg(metric).alias("m"), F.count("*").alias("n"))
    return found.select(key, "n", F.when(F.col("ok"), "PASS").otherwise("FAILED").alias("status"), F.when(F.col("ok"), F.col("m")).alias(metric))


# What a quiet host is, and the reasons given
LOAD, DISK, SAMPLE_S, HEAVY = 0.5, 20_000_000_000, 1, 10.0
NOISE = ("wrong host", "load1 is not below 0.5", "insufficient available data-disk space", "CPU sample interval too short", "foreign heavy CPU process")


def silence(host: str) -> tuple[Column, Column]:
    """Status of a snapshot (host, load1, disk_available_bytes, sampling_seconds, processes) and why it FAILED, in order."""
    heavy = F.exists("processes", lambda p: (p["cpu_percent"] >= HEAVY) & ~p["own_process"])
    rules = (F.col("host") != host, ~(F.col("load1") < LOAD), ~(F.col("disk_available_bytes") > DISK), F.col("sampling_seconds") < SAMPLE_S, heavy)
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), why) for rule, why in zip(rules, NOISE)]))
    return F.when(F.size(reasons) > 0, "FAILED").otherwise("PASS"), reasons
