"""Contracts between tables: unique scopes, coverage, baselines of equal input, kept prefixes, truth of requests, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap


def one_each(wanted: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each wanted scope its number of rows, and the value where it is exactly one; otherwise a reason."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("matches"), F.max(value).alias(value))
    n = F.coalesce("matches", F.lit(0))
    reason = F.when(n == 0, "missing").when(n > 1, "duplicate")
    return wanted.select(*keys).distinct().join(found, keys, "left").select(*keys, n.alias("matches"), F.when(n == 1, F.col(value)).alias(value), reason.alias("reason"))


def gains(ratio: Column, base_ratio: Column, p50: Column, base_p50: Column) -> tuple[Column, Column, Column]:
    """Density gain and latency penalty in percent, and the margin between them."""
    gain, penalty = (ratio / base_ratio - 1) * 100, (p50 / base_p50 - 1) * 100
    return gain, penalty, gain - penalty


def strict_int(text: Column) -> Column:
    """The integer that a JSON text is; null for fractions, exponents, truth values, other strings and what a long can't hold."""
    return F.when(text.rlike(r"\A-?(0|[1-9][0-9]*)\z"), text.try_cast("long"))


def window_ok(start: Column, end: Column, length: Column) -> Column:
    """0 <= start < end <= length; false where one is null."""
    return F.coalesce((start >= 0) & (start < end) & (end <= length), F.lit(False))


def curve_of(points: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """Each point's cost 1 - base/point, where its baseline exists and was made of the same input."""
    base = bases.select(*keys, F.col("input").alias("_input"), F.col("bytes").alias("base"))
    state = F.when(F.col("base").isNull(), "no baseline").when(~F.col("input").eqNullSafe(F.col("_input")), "other input").otherwise("ok")
    met = points.join(base, keys, "left").withColumn("state", state).drop("_input")
    return met.withColumn("c", F.when(F.col("state") == "ok", 1 - F.col("base") / F.col("bytes")))


def uncovered(members: DataFrame, group: str, assembly: str) -> DataFrame:
    """Groups that lack assemblies of the cohort, and which. A group's set is bounded by the cohort."""
    pairs = members.select(group, assembly).distinct()
    everyone = pairs.agg(F.collect_set(assembly).alias("_all"))
    seen = pairs.groupBy(group).agg(F.collect_set(assembly).alias("_seen"))
    lacks = F.array_sort(F.array_except("_all", "_seen"))
    return seen.crossJoin(F.broadcast(everyone)).select(group, lacks.alias("missing")).filter(F.size("missing") > 0)  # one row of names


#: Most requests that one copy of a stretch's text serves.
SERVED = 1 << 16


def truth(requests: DataFrame, pieces: DataFrame, least: int = 1 << 12) -> DataFrame:
    """Hash and length of the text that each request [lo, hi) covers, from pieces (uoff, ulen, text) that it overlaps.

    Text is moved once for a stretch, not for each request. A request is hashed from the stretch that begins at the multiple
    of a power of two at or before lo, of that power twice; the power is at least the request's length, so a stretch's row
    is bounded by four times the longest request in it (or `least` twice). Only stretches that are asked for get text, and a
    copy for each SERVED requests. Rows of equal request_id and range count as one request whose pieces come as often. A
    request beyond the pieces is marked, as its text is short.
    """
    long = F.greatest(F.col("hi") - F.col("lo"), F.lit(least))
    width = F.pow(F.lit(2), F.length(F.bin(long - 1))).cast("long")
    at = F.floor(F.col("lo") / F.col("width")) * F.col("width")
    stretch = ["width", "at"]
    asked = requests.select("request_id", "lo", "hi", width.alias("width")).withColumn("at", at)
    of = asked.filter("hi > lo").groupBy(*stretch).agg(F.floor(F.count("*") / SERVED).alias("last"))
    of = of.select("*", F.col("at").alias("lo"), (F.col("at") + 2 * F.col("width")).alias("hi"))
    cut = overlap(of, pieces).select(*stretch, "last", (F.col("uoff") + F.col("skip")).alias("lo"), "take", F.expr("substring(text, CAST(skip + 1 AS INT), CAST(take AS INT))").alias("slice"))
    texts = cut.groupBy(*stretch, "last").agg(F.array_sort(F.collect_list(F.struct("lo", "take", "slice"))).alias("slices"))
    texts = texts.select(*stretch, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("copy"), "slices")
    times = F.count("*").over(Window.partitionBy("request_id", "lo", "hi"))
    dealt = asked.withColumn("times", times).join(of.select(*stretch, "last"), stretch, "left").withColumn("copy", F.pmod(F.xxhash64("request_id"), F.col("last") + 1)).drop("last")
    met = dealt.join(texts.hint("merge"), [*stretch, "copy"], "left")
    begin = lambda x: F.greatest(x["lo"], F.col("lo"))
    end = lambda x: F.least(x["lo"] + x["take"], F.col("hi"))
    own = F.filter("slices", lambda x: begin(x) < end(x))
    n = F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + end(x) - begin(x)), F.lit(0)) * F.col("times")
    part = lambda x: F.repeat(F.substring(x["slice"], (begin(x) - x["lo"] + 1).cast("int"), (end(x) - begin(x)).cast("int")), F.col("times").cast("int"))
    inside = n == F.col("hi") - F.col("lo")
    found = F.when(inside & (F.size(own) > 0), F.sha2(F.array_join(F.transform(own, part), ""), 256))
    return met.select("request_id", n.alias("length"), found.alias("sha256"), inside.alias("inside"))


def rotated(position: Column, shift: Column, n: Column) -> Column:
    """Place of a position after an order of n is rotated left by shift."""
    return F.pmod(position - shift, n)


def prefix_kept(old: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """One row: rows of the old log, those that the new one keeps at their position, changes or drops, and those it adds."""
    values = [c for c in old.columns if c != position]
    a = old.select(position, F.struct(*values).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(position, F.struct(*values).alias("_new"), F.lit(True).alias("_b"))
    was, there = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    count = lambda c, name: F.count_if(c).alias(name)
    return a.join(b, position, "full").agg(count(was, "prior"), count(was & there & same, "kept"), count(was & there & ~same, "changed"), count(was & ~there, "dropped"), count(~was, "added"))


def breaks(blocks: DataFrame) -> DataFrame:
    """Blocks after which no other begins: the last one, and one before each gap. An equi-join of ends with starts."""
    full = blocks.filter("ulen > 0")
    starts = full.select(F.col("uoff").alias("_at")).distinct()
    return full.withColumn("_end", F.col("uoff") + F.col("ulen")).join(starts, F.col("_end") == F.col("_at"), "left_anti").select("block_id", F.col("_end").alias("end"))


def kinds(rows: DataFrame, kind: str) -> DataFrame:
    """One row: counts by kind as text, by name."""
    parts = rows.groupBy(kind).agg(F.count("*").alias("n")).select(F.concat(F.col(kind), F.lit("="), F.col("n").cast("string")).alias("part"))
    text = F.array_join(F.array_sort(F.collect_list("part")), ", ")
    return parts.agg(F.when(F.count("*") == 0, "no rows").otherwise(text).alias("kinds"))


def ordered_places(rows: DataFrame, table: str) -> DataFrame:
    """Each row's place in its table: by format, variant, hash mode and window, absent ones as '' and 0."""
    w = Window.partitionBy(table).orderBy("format", "variant", F.coalesce("hash_mode", F.lit("")), F.coalesce("window_bytes", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(w))


def batch_audit(rows: DataFrame, keys: list[str], baseline: Column) -> DataFrame:
    """Rules that a recorded batch row breaks: relation to the baseline of its keys, verdict, entropy within [0, log2 n]."""
    base = rows.filter(baseline).groupBy(*keys).agg(F.count("*").alias("_n"), F.max("value").alias("_base"))
    rules = {
        "baseline": ~F.col("_n").eqNullSafe(1),
        "relation": ~F.col("relative").eqNullSafe(F.col("value") / F.col("_base")),
        "verdict": ~F.col("status").eqNullSafe(F.when(F.col("relative") >= 1, "pass").otherwise("fail")),
        "entropy": ~F.coalesce((F.col("entropy") >= 0) & (F.col("entropy") <= F.log2("n") + 1e-9), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return rows.join(base, keys, "left").withColumn("broken", F.array_join(broken, ",")).drop("_n", "_base")
