"""Half-open intervals and blocks: merging, gaps, as-of and overlap joins, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def prefix_starts(rows: DataFrame, order: str, size: str, start: str, stride: int = 1 << 12) -> DataFrame:
    """Each row's start is the sum of the sizes before it. Sums are taken over strides of order first, so no window spans the table."""
    rows = rows.withColumn("_s", F.floor(F.col(order) / stride))
    heads = rows.groupBy("_s").agg(F.sum(size).alias("_t"))
    heads = heads.withColumn("_h", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = F.coalesce(F.sum(size).over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(start, within).join(heads, "_s").withColumn(start, F.col(start) + F.col("_h")).drop("_s", "_h")


#: Rows of intervals for each task that merges them; a key with more is cut into stretches of about a quarter of that.
TASK_ROWS = 1 << 19


def _same(key: str):
    return F.col(key).eqNullSafe(F.col("_key"))


def _stretches(rows: DataFrame, key: str) -> tuple[DataFrame, int, bool]:
    """Rows dealt over tasks that grow in number with them, that number, and whether a key is cut.

    A key of more than TASK_ROWS rows is cut by approximate quantiles of lo, so rows with the same lo stay together, and those
    without lo. Then rows have a stretch; it is null in keys that are not cut. The cuts are collected (one for each quarter of
    TASK_ROWS rows at most), as quantiles found again may differ.
    """
    each = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total, most = each.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // TASK_ROWS)
    if most <= TASK_ROWS:
        return rows.repartition(tasks, key), tasks, False
    parts = 1 + 4 * most // TASK_ROWS
    large = each.filter(F.col("_n") > TASK_ROWS).withColumnRenamed(key, "_key")
    at = F.percentile_approx("lo", [k / parts for k in range(1, parts)], max(10000, 10 * parts))
    edges = []
    for k, n, cuts in rows.join(F.broadcast(large), _same(key)).groupBy("_key", "_n").agg(at).collect():
        own = 1 + 4 * n // TASK_ROWS
        cuts = sorted({cuts[i * parts // own - 1] for i in range(1, own)}) if cuts else []
        edges += [(k, *x) for x in zip([None, *cuts], [*cuts, None], range(len(cuts) + 1), strict=True)]
    types = StructType([StructField("_key", rows.schema[key].dataType), *(StructField(x, rows.schema["lo"].dataType) for x in ("_from", "_to")), StructField("stretch", IntegerType())])
    inside = (F.col("_from").isNull() | (F.col("lo") > F.col("_from"))) & (F.col("_to").isNull() | (F.col("lo") <= F.col("_to"))) & F.col("lo").isNotNull()
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(edges, types)), _same(key) & inside, "left").drop("_key", "_from", "_to")
    return rows.repartition(tasks, key, "stretch"), tasks, True


def merge(rows: DataFrame, key: str, stretches: bool = False) -> DataFrame:
    """Union of intervals by key; touching ones merge. Tasks grow in number with the rows, also where a key holds most of them.

    stretches: keep the stretch an interval starts in, if a key was cut.
    """
    rows, tasks, cut = _stretches(rows.select(key, "lo", "hi"), key)
    group = [key, "stretch"] if cut else [key]
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last("lo"), F.asc_nulls_last("hi"))
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    again = F.struct("lo", "hi").eqNullSafe(F.lag(F.struct("lo", "hi")).over(w))
    new = rows.withColumn("new", F.when((F.col("lo") <= before) | again, 0).otherwise(1))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    islands = new.withColumn("island", island).groupBy(*group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if cut:
        islands = _stitched(islands, key, tasks)
    return islands.drop("island") if stretches else islands.drop("island", "stretch")


def _heads(rows: DataFrame, key: str, *of) -> DataFrame:
    """A row for each stretch, _s. As an aggregate it lets no filter pass, so Spark reads one exchange for these and for the rows."""
    return rows.groupBy(F.col(key).alias("_key"), "stretch").agg(F.max("stretch").alias("_s"), *of)


def _stitched(islands: DataFrame, key: str, tasks: int) -> DataFrame:
    """Islands of stretches become islands of keys.

    Those that start at or before the largest end of all earlier stretches come first in theirs, and belong to the last island
    before that starts anew. So each stretch needs one row of what lies before it; islands meet only within one owner's stretch.
    """
    heads = _heads(islands, key, F.max("hi").alias("_top"), F.max("lo").alias("_lo"), F.max("island").alias("_i")).filter("_s IS NOT NULL")
    w = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_reach", F.max("_top").over(w))
    anew = F.when(F.col("_lo") <= F.col("_reach"), None).otherwise(F.struct(F.col("_s").alias("s"), F.col("_i").alias("i")))
    heads = heads.withColumn("_owner", F.last(anew, ignorenulls=True).over(w)).select("_key", "_s", "_reach", "_owner")
    met = islands.join(F.broadcast(heads), _same(key) & (F.col("stretch") == F.col("_s")), "left")
    owned = lambda x, own: F.when(F.col("lo") <= F.col("_reach"), F.col(f"_owner.{x}")).otherwise(F.col(own))
    met = met.select(key, "stretch", owned("s", "stretch").alias("_s"), owned("i", "island").alias("island"), "lo", "hi")
    ends = (F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = met.groupBy(key, "stretch", "_s", "island").agg(*ends).select(key, F.col("_s").alias("stretch"), "island", "lo", "hi")
    return met.repartition(tasks, key, "stretch").groupBy(key, "stretch", "island").agg(*ends)


def gaps(merged: DataFrame, key: str, end: int, least: int) -> DataFrame:
    """Stretches of [0, end) of at least `least` that no merged interval covers, in one pass over the intervals of a key.

    Where merged has the stretches of merge(), a pass goes over one stretch, and the ends of stretches and keys come from aggregates.
    """
    cut = "stretch" in merged.columns
    w = Window.partitionBy(key, *["stretch"] * cut).orderBy(F.asc_nulls_last("lo"))
    long = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias("lo")
    if cut:
        heads = _heads(merged, key, F.max_by("hi", "lo").alias("_hi"), F.max("hi").alias("_top"))
        tail = heads.groupBy(F.col("_key").alias(key)).agg(F.max("_top").cast("long").alias("lo")).withColumn("hi", F.lit(end).cast("long"))
        heads = heads.filter("_s IS NOT NULL").select("_key", "_s", F.lag("_hi").over(Window.partitionBy("_key").orderBy("_s")).alias("_edge"))
        inner = merged.select("*", F.lag("hi").over(w).alias("_lag"), F.lag(F.lit(1)).over(w).isNull().alias("_first"))
        inner = inner.join(F.broadcast(heads), _same(key) & (F.col("stretch") == F.col("_s")), "left")
        inner = inner.select(key, long(F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag"))), F.col("lo").cast("long").alias("hi"))
        return inner.unionByName(tail).filter(F.col("hi") - F.col("lo") >= least)
    before = F.struct(long(F.lag("hi").over(w)), F.col("lo").cast("long").alias("hi"))
    after = F.struct(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("lo"), F.lit(end).cast("long").alias("hi"))
    last = F.lead(F.lit(1)).over(w).isNull()
    each = merged.select(key, before.alias("before"), after.alias("after"), last.alias("last"))
    both = each.select(key, F.inline(F.when(F.col("last"), F.array("before", "after")).otherwise(F.array("before"))))
    return both.filter(F.col("hi") - F.col("lo") >= least)


def _bins(lo, hi, width: int):
    return F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))


def overlap(requests: DataFrame, blocks: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Pairs of requests [lo, hi) and blocks [uoff, uoff + ulen) that overlap, with the slice of the block.

    Both sides are cut at multiples of width, so the join is an equi-join on the bin; a pair is kept in the bin where its
    overlap starts. A block or request of many widths makes as many rows, so width is chosen near a block's size.
    """
    end = F.col("uoff") + F.col("ulen")
    r = requests.withColumn("bin", _bins(F.col("lo"), F.col("hi"), width))
    b = blocks.filter("ulen > 0").withColumn("bin", _bins(F.col("uoff"), end, width))
    start = F.greatest("lo", "uoff")
    met = r.join(b, "bin").filter((F.col("uoff") < F.col("hi")) & (end > F.col("lo")) & (F.floor(start / width) == F.col("bin")))
    return met.withColumn("skip", start - F.col("uoff")).withColumn("take", F.least("hi", end) - start).drop("bin")


def asof_block(points: DataFrame, blocks: DataFrame, at: str, width: int = 1 << 16) -> DataFrame:
    """The block that holds each point; null block_id beyond the last one."""
    b = blocks.filter("ulen > 0").withColumn("bin", _bins(F.col("uoff"), F.col("uoff") + F.col("ulen"), width))
    p = points.withColumn("bin", F.floor(F.col(at) / width))
    inside = (p["bin"] == b["bin"]) & (b["uoff"] <= p[at]) & (p[at] < b["uoff"] + b["ulen"])
    return p.join(b, inside, "left").drop("bin")


def overlap_by_definition(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nested-loop form of overlap(), to check it with."""
    end = F.col("uoff") + F.col("ulen")
    met = requests.join(blocks.filter("ulen > 0"), (F.col("uoff") < F.col("hi")) & (end > F.col("lo")))
    start = F.greatest("lo", "uoff")
    return met.withColumn("skip", start - F.col("uoff")).withColumn("take", F.least("hi", end) - start)
