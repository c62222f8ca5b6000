"""Queries over the views, one for each operator, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import generators, intervals, judges, metrics, pareto, quantile
from . import contracts, evidence, views  # noqa: F401  the first two register their queries
from .registry import ORACLE_SQL, QUERIES, query, r9  # noqa: F401
from .views import sql, table

# Percentiles, medians, spread

_NEAREST = "SELECT codec, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99 FROM samples GROUP BY codec"


@query("w01_nearest_rank", sql(_NEAREST, "samples"))
def w01(spark, d):
    return quantile.nearest_rank(views.samples(spark, d), ["codec"], "latency_ms", {"p50": 50, "p95": 95, "p99": 99})


@query("a03_quantiles_and_rate", sql("SELECT a.*, round(n * 1000 / t, 9) AS reads_per_s FROM a JOIN s USING (codec)", "samples", a=_NEAREST, s="SELECT codec, sum(latency_ms) AS t FROM samples GROUP BY codec").replace("round(n * 1000 / t, 9)", "round(n * 1000 / t, 6)"))
def a03(spark, d):
    total = views.samples(spark, d).groupBy("codec").agg(F.sum("latency_ms").alias("t"))
    return w01(spark, d).join(total, "codec").withColumn("reads_per_s", F.round(F.col("n") * 1000 / F.col("t"), 6)).drop("t")


@query("a05_averaged_median", sql("SELECT codec, copies, count(*) AS n, round(median(wall_ms), 9) AS median, round(avg(wall_ms), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_pop(wall_ms) / avg(wall_ms) END, 9) AS cv, min(wall_ms) AS min, max(wall_ms) AS max FROM decodes GROUP BY ALL", "decodes"))
def a05(spark, d):
    s = quantile.spread(views.decodes(spark, d), ["codec", "copies"], "wall_ms")
    return s.withColumn("median", r9("median")).withColumn("mean", F.round("mean", 6)).withColumn("cv", r9("cv"))


@query("a06_nearest_rank_decode", sql("SELECT codec, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY wall_ms) AS median FROM decodes GROUP BY codec", "decodes"))
def a06(spark, d):
    return quantile.nearest_rank(views.decodes(spark, d), ["codec"], "wall_ms", {"median": 50})


@query("w07_representative_run", sql("SELECT codec, o AS run, wall_ms FROM (SELECT codec, repeat AS o, wall_ms, row_number() OVER (PARTITION BY codec ORDER BY wall_ms, repeat) AS k FROM m) WHERE k = 5", "decodes", m="SELECT codec, repeat, min(wall_ms) AS wall_ms FROM decodes GROUP BY codec, repeat"))
def w07(spark, d):
    """The fifth of nine runs by time, then index."""
    m = views.decodes(spark, d).groupBy("codec", "repeat").agg(F.min("wall_ms").alias("wall_ms"))
    k = F.row_number().over(Window.partitionBy("codec").orderBy("wall_ms", "repeat"))
    return m.withColumn("k", k).filter("k = 5").select("codec", F.col("repeat").alias("run"), "wall_ms")


@query("a23_nine_runs", sql("SELECT codec, round(median(wall_ms), 9) AS median_ms, min(wall_ms) AS min_ms, max(wall_ms) AS max_ms, round(200000 / median(wall_ms), 9) AS answers_per_s FROM decodes WHERE repeat >= 3 GROUP BY codec", "decodes"))
def a23(spark, d):
    """Median, least and most of the measured runs; warm-ups (repeats below 3) are left out."""
    s = quantile.spread(views.decodes(spark, d).filter("repeat >= 3"), ["codec"], "wall_ms")
    return s.select("codec", r9("median").alias("median_ms"), F.col("min").alias("min_ms"), F.col("max").alias("max_ms"), r9(200000 / F.col("median")).alias("answers_per_s"))


# Ratios, verdicts

@query("a04_amplification", sql("SELECT codec, config, CAST(sum(decoded_bytes) AS BIGINT) AS above, CAST(sum(requested_bytes) AS BIGINT) AS below, sum(decoded_bytes) / sum(requested_bytes) AS amplification FROM samples GROUP BY ALL", "samples"))
def a04(spark, d):
    return metrics.ratio_of_sums(views.samples(spark, d), ["codec", "config"], F.col("decoded_bytes"), F.col("requested_bytes"), "amplification")


@query("p01_archive_ratio", sql("SELECT codec, g, CAST(sum(input_bytes) AS BIGINT) AS above, CAST(sum(archive_bytes + index_bytes) AS BIGINT) AS below, CAST(sum(input_bytes) AS DOUBLE) / CAST(sum(archive_bytes + index_bytes) AS DOUBLE) AS ratio FROM archives GROUP BY ALL", "archives"))
def p01(spark, d):
    return metrics.ratio_of_sums(views.archives(spark, d), ["codec", "g"], F.col("input_bytes"), F.col("archive_bytes") + F.col("index_bytes"), "ratio")


@query("p02_file_only_ratio", sql("SELECT codec, g, CAST(sum(input_bytes) AS BIGINT) AS above, CAST(sum(archive_bytes) AS BIGINT) AS below, CAST(sum(input_bytes) AS DOUBLE) / CAST(sum(archive_bytes) AS DOUBLE) AS file_ratio FROM archives GROUP BY ALL", "archives"))
def p02(spark, d):
    return metrics.ratio_of_sums(views.archives(spark, d), ["codec", "g"], F.col("input_bytes"), F.col("archive_bytes"), "file_ratio")


@query("p03_curve_percent", sql("SELECT id, g, round(100 * (1 - CAST(baseline_bytes AS DOUBLE) / point_bytes), 9) AS c_percent, round(1 - CAST(baseline_bytes AS DOUBLE) / point_bytes, 9) AS c_fraction FROM curve", "curve"))
def p03(spark, d):
    """Granularity cost in percent (P-03) and as a fraction (P-04), signed."""
    w, p = F.col("baseline_bytes"), F.col("point_bytes")
    return views.curve(spark, d).select("id", "g", r9(metrics.curve_percent(w, p)).alias("c_percent"), r9(metrics.curve_fraction(w, p)).alias("c_fraction"))


@query("p05_rates", sql("SELECT codec, repeat, round(sum(copies) * 1000000 / sum(wall_ms) / 1000, 6) AS mb_per_s, round(count(*) * 1000 / sum(wall_ms), 9) AS ranges_per_s FROM decodes GROUP BY ALL", "decodes"))
def p05(spark, d):
    t = F.sum("wall_ms")
    return views.decodes(spark, d).groupBy("codec", "repeat").agg(F.round(metrics.mb_per_s(F.sum("copies") * 1000000, t), 6).alias("mb_per_s"), r9(F.count("*") * 1000 / t).alias("ranges_per_s"))


@query("p06_break_even", sql("SELECT codec, round(full_ms, 9) AS full_ms, p50, CAST(floor(full_ms / p50) AS BIGINT) + 1 AS break_even_n FROM f CROSS JOIN p", "samples", "decodes", f="SELECT codec, median(wall_ms) AS full_ms FROM decodes GROUP BY codec", p="SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50 FROM samples"))
def p06(spark, d):
    full = quantile.averaged_median(views.decodes(spark, d), ["codec"], "wall_ms", "full_ms").drop("n")
    p50 = quantile.nearest_rank(views.samples(spark, d), [], "latency_ms", {"p50": 50}).select("p50")
    return full.crossJoin(F.broadcast(p50)).select("codec", r9("full_ms").alias("full_ms"), "p50", metrics.break_even(F.col("full_ms"), F.col("p50")).alias("break_even_n"))


@query("p08_blocks_touched", sql("SELECT query, (byte_offset + requested_bytes - 1) // 65280 - byte_offset // 65280 + 1 AS blocks FROM samples", "samples"))
def p08(spark, d):
    return views.samples(spark, d).select("query", metrics.blocks_touched(F.col("byte_offset"), F.col("requested_bytes"), 65280).alias("blocks"))


@query("a08_histogram", sql("SELECT codec, decoded_bytes, count(*) AS n FROM samples GROUP BY ALL", "samples"))
def a08(spark, d):
    return metrics.histogram(views.samples(spark, d), ["codec"], "decoded_bytes")


@query("p10_relative_verdict", sql("SELECT a.codec, a.p50, a.p50 / b.p50 AS relative, CASE WHEN a.p50 / b.p50 <= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a CROSS JOIN (SELECT p50 FROM a WHERE codec = 'click') b", "samples", a=_NEAREST))
def p10(spark, d):
    """p50 against the same run's baseline codec (J-01, P-10)."""
    return metrics.relative(w01(spark, d).select("codec", "p50"), "p50", "codec", "click", 1.0, False).drop("base")


_J02 = "SELECT codec, config, CASE WHEN config % 3 = 0 THEN NULL ELSE config END AS profile, avg(decoded_bytes) AS m FROM samples GROUP BY codec, config"


@query("j02_null_safe_baseline", sql("SELECT a.codec, a.config, a.profile, round(a.m, 6) AS m, round(b.base, 6) AS base, round(a.m / b.base, 9) AS relative, CASE WHEN b.base IS NULL THEN 'n/a - no baseline in this run' END AS reason FROM a LEFT JOIN b ON a.profile IS NOT DISTINCT FROM b.profile", "samples", a=_J02, b="SELECT profile, avg(m) AS base FROM a WHERE codec = 'click' AND config < 7 GROUP BY profile"))
def j02(spark, d):
    s = views.samples(spark, d).groupBy("codec", "config").agg(F.avg("decoded_bytes").alias("m")).withColumn("profile", F.when(F.col("config") % 3 != 0, F.col("config")))
    base = s.filter("codec = 'click' and config < 7").groupBy("profile").agg(F.avg("m").alias("m"))
    return metrics.against(s, base, ["profile"], "m").select("codec", "config", "profile", F.round("m", 6).alias("m"), F.round("base", 6).alias("base"), r9("relative").alias("relative"), "reason")


@query("a10_entropy", sql("SELECT codec, CAST(sum(c) AS BIGINT) AS n, count(*) AS blocks, round(greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)), 9) AS entropy FROM b GROUP BY codec", "samples", b="SELECT codec, byte_offset // 1048576 AS block, count(*) AS c FROM samples GROUP BY ALL"))
def a10(spark, d):
    """Entropy of request-start blocks (A-10) and distinct blocks (A-11)."""
    s = views.samples(spark, d).withColumn("block", F.floor(F.col("byte_offset") / 1048576))
    return metrics.entropy(s, ["codec"], "block").withColumn("entropy", r9("entropy"))


@query("f05_isclose", sql("SELECT id, abs(c - k) <= greatest(1e-12 * greatest(abs(c), abs(k)), 1e-10) AS close FROM (SELECT id, 1 - CAST(baseline_bytes AS DOUBLE) / point_bytes AS c, round(1 - CAST(baseline_bytes AS DOUBLE) / point_bytes, 3) AS k FROM curve)", "curve"))
def f05(spark, d):
    c = metrics.curve_fraction(F.col("baseline_bytes"), F.col("point_bytes"))
    return views.curve(spark, d).select("id", metrics.isclose(c, F.round(c, 3)).alias("close"))


# Pareto

_PICK_KEY = "SELECT concat(codec, ':', g, ':', file) AS key, codec, g, sum(input_bytes) / CAST(sum(archive_bytes + index_bytes) AS DOUBLE) AS ratio, round(avg(index_bytes), 3) AS p50 FROM archives GROUP BY codec, g, file"
_BEATS = "o.ratio >= r.ratio AND o.p50 <= r.p50 AND (o.ratio > r.ratio OR o.p50 < r.p50)"


def points(spark, d):
    a = views.archives(spark, d).groupBy("codec", "g", "file").agg((F.sum("input_bytes") / F.sum(F.col("archive_bytes") + F.col("index_bytes"))).alias("ratio"), F.round(F.avg("index_bytes"), 3).alias("p50"))
    return a.select(F.concat_ws(":", "codec", "g", "file").alias("key"), "codec", "g", "ratio", "p50")


@query("w06_skyline", sql(f"SELECT * FROM p r WHERE NOT EXISTS (SELECT 1 FROM p o WHERE {_BEATS})", "archives", p=_PICK_KEY))
def w06(spark, d):
    """The Pareto front in its scalable form."""
    return pareto.skyline(points(spark, d))


_FRONT = sql(f"SELECT * FROM p r WHERE NOT EXISTS (SELECT 1 FROM p o WHERE {_BEATS})", "archives", p=_PICK_KEY)


@query("j14_pareto_anti", _FRONT)
@query("j14_pareto_anti_all", _FRONT)
def j14(spark, d):
    """The front by the anti join: a row that any row dominates is dominated by one on the front, so pairs are rows x front."""
    p = points(spark, d)
    return pareto.front_by_dominance(p, pareto.skyline(p))


@query("w05_constrained_best", sql("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY ratio DESC, p50, g, key) AS k FROM p WHERE p50 <= 200) WHERE k = 1", "archives", p=_PICK_KEY))
def w05(spark, d):
    return pareto.best_per(points(spark, d), "codec", [F.desc("ratio"), F.col("p50"), F.col("g"), F.col("key")], F.col("p50") <= 200)


@query("w05_fastest", sql("SELECT codec, g, ratio, p50, key FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY p50, ratio DESC, g, key) AS k FROM p WHERE ratio >= 4.9) WHERE k = 1", "archives", p=_PICK_KEY))
def w05_fastest(spark, d):
    """The other choice: the least p50 among points of a ratio."""
    return pareto.best_per(points(spark, d), "codec", [F.col("p50"), F.desc("ratio"), F.col("g"), F.col("key")], F.col("ratio") >= 4.9).select("codec", "g", "ratio", "p50", "key")


@query("f03_without_fast", sql("SELECT DISTINCT codec FROM p WHERE codec NOT IN (SELECT codec FROM p WHERE p50 <= 107)", "archives", p=_PICK_KEY))
def f03_fast(spark, d):
    p = points(spark, d)
    return pareto.without_choice(p, p.filter("p50 <= 107"), "codec")


@query("f03_without_choice", sql("SELECT DISTINCT codec FROM p WHERE codec NOT IN (SELECT codec FROM p WHERE ratio >= 4.97)", "archives", p=_PICK_KEY))
def f03(spark, d):
    p = points(spark, d)
    return pareto.without_choice(p, p.filter("ratio >= 4.97"), "codec")


# Curves

@query("a14_curve_groups", sql("SELECT grp, g, min(c) AS min_c, median(c) AS median_c, max(c) AS max_c, round(1 - CAST(sum(baseline_bytes) AS DOUBLE) / CAST(sum(point_bytes) AS DOUBLE), 9) AS total_c FROM (SELECT *, round(1 - CAST(baseline_bytes AS DOUBLE) / point_bytes, 9) AS c FROM curve) GROUP BY grp, g", "curve"))
def a14(spark, d):
    c = views.curve(spark, d).withColumn("c", r9(metrics.curve_fraction(F.col("baseline_bytes"), F.col("point_bytes"))))
    return c.groupBy("grp", "g").agg(F.min("c").alias("min_c"), F.median("c").alias("median_c"), F.max("c").alias("max_c"), r9(1 - F.sum("baseline_bytes") / F.sum("point_bytes")).alias("total_c"))


@query("a18_grouping_sets", sql("SELECT codec, g, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(archive_bytes) AS BIGINT) AS archive_bytes FROM archives GROUP BY GROUPING SETS ((codec), (codec, g))", "archives"))
def a18(spark, d):
    c, g = F.col("codec"), F.col("g")
    return views.archives(spark, d).groupingSets([[c], [c, g]], c, g).agg(F.sum("input_bytes").alias("input_bytes"), F.sum("archive_bytes").alias("archive_bytes"))


_BY_FILE = "SELECT codec, file, CAST(sum(archive_bytes) AS BIGINT) AS b FROM archives GROUP BY codec, file"


@query("j04_paired_differences", sql("SELECT count(*) AS pairs, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives, median(d) AS median_d, min(d) AS min_d, max(d) AS max_d FROM (SELECT a.b - c.b AS d FROM f a JOIN f c ON a.file = c.file AND a.codec = 'AF' AND c.codec = 'RF')", "archives", f=_BY_FILE))
def j04(spark, d):
    """Paired differences of two groups by file (J-04, A-15)."""
    f = views.archives(spark, d).filter("codec in ('AF', 'RF')").groupBy("file").pivot("codec", ["AF", "RF"]).agg(F.sum("archive_bytes")).dropna()
    x = F.col("AF") - F.col("RF")
    return f.agg(F.count("*").alias("pairs"), F.sum((x > 0).cast("long")).alias("positives"), F.median(x).alias("median_d"), F.min(x).alias("min_d"), F.max(x).alias("max_d"))


@query("j05_wins", sql("SELECT c.codec AS other, count(*) AS files, CAST(sum(CASE WHEN a.b < c.b THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM f a JOIN f c ON a.file = c.file AND a.codec = 'AF' AND c.codec <> 'AF' GROUP BY c.codec", "archives", f=_BY_FILE))
def j05(spark, d):
    f = views.archives(spark, d).groupBy("codec", "file").agg(F.sum("archive_bytes").alias("b"))
    own = f.filter("codec = 'AF'").select("file", F.col("b").alias("own"))
    return f.filter("codec <> 'AF'").join(own, "file").groupBy(F.col("codec").alias("other")).agg(F.count("*").alias("files"), F.sum((F.col("own") < F.col("b")).cast("long")).alias("wins"))


@query("a17_last_point", sql("SELECT file, max(g) AS g, arg_max(point_bytes, g * 100000 + id) AS at_last FROM curve GROUP BY file", "curve"))
def a17(spark, d):
    return views.curve(spark, d).groupBy("file").agg(F.max("g").alias("g"), F.max_by("point_bytes", F.col("g") * 100000 + F.col("id")).alias("at_last"))


# Throughput

_RATES = "SELECT codec, copies, median(copies * 1000 / wall_ms) AS m, stddev_pop(copies * 1000 / wall_ms) / avg(copies * 1000 / wall_ms) AS cv FROM decodes GROUP BY codec, copies"


@query("w02_plateau", sql("SELECT codec, n, round(span, 9) AS span, round(worst_cv, 9) AS worst_cv, p AS plateau, CASE WHEN p THEN at_last END AS value, CASE WHEN NOT p THEN 'n/a - data edge: no plateau up to the largest size' END AS reason FROM (SELECT codec, count(*) AS n, max(m) / min(m) - 1 AS span, max(cv) AS worst_cv, arg_max(m, copies) AS at_last, count(*) = 3 AND max(m) / min(m) - 1 <= 0.05 AND max(cv) <= 0.05 AS p FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY copies DESC) AS k FROM t) WHERE k <= 3 GROUP BY codec)", "decodes", t=_RATES))
def w02(spark, d):
    """Plateau of the last three scales, and its value or reason (W-02, W-03)."""
    rate = F.col("copies") * 1000 / F.col("wall_ms")
    t = quantile.spread(views.decodes(spark, d).withColumn("rate", rate), ["codec", "copies"], "rate").withColumnRenamed("median", "m")
    return judges.plateau(t, "codec", "copies", "m", "cv").select("codec", "n", r9("span").alias("span"), r9("worst_cv").alias("worst_cv"), "plateau", "value", "reason")


@query("w16_paired_speedup", sql("SELECT codec, round(median(a / b), 9) AS median_of_ratios, round(median(a) / median(b), 9) AS ratio_of_medians FROM (SELECT codec, repeat, min(wall_ms) FILTER (WHERE copies = 1) AS a, min(wall_ms) FILTER (WHERE copies = 2) AS b FROM decodes GROUP BY codec, repeat) GROUP BY codec", "decodes"))
def w16(spark, d):
    """Speed-up paired by repeat, and the ratio of medians, two different metrics."""
    p = views.decodes(spark, d).groupBy("codec", "repeat").agg(F.min(F.when(F.col("copies") == 1, F.col("wall_ms"))).alias("a"), F.min(F.when(F.col("copies") == 2, F.col("wall_ms"))).alias("b"))
    return p.groupBy("codec").agg(r9(F.median(F.col("a") / F.col("b"))).alias("median_of_ratios"), r9(F.median("a") / F.median("b")).alias("ratio_of_medians"))


# Blocks and intervals

_BLOCKS = "SELECT unit_id AS block_id, ulen, CAST(coalesce(sum(ulen) OVER (ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS uoff FROM units"


def blocks(spark, d):
    return intervals.prefix_starts(views.units(spark, d), "unit_id", "ulen", "uoff").select(F.col("unit_id").alias("block_id"), "ulen", "uoff")


@query("w04_prefix_starts", sql("SELECT * FROM b", "units", b=_BLOCKS))
def w04(spark, d):
    return blocks(spark, d)


@query("j09_fixed_block", sql("SELECT request_id, lo // 65536 AS block_id FROM requests", "requests"))
def j09(spark, d):
    return views.requests(spark, d).select("request_id", F.floor(F.col("lo") / 65536).alias("block_id"))


@query("j10_asof_block", sql("SELECT request_id, b.block_id FROM requests r LEFT JOIN b ON b.ulen > 0 AND b.uoff <= r.lo AND r.lo < b.uoff + b.ulen", "requests", "units", b=_BLOCKS))
def j10(spark, d):
    return intervals.asof_block(views.requests(spark, d), blocks(spark, d), "lo").select("request_id", "block_id")


_OVERLAP = "SELECT request_id, block_id, greatest(lo, uoff) - uoff AS skip, least(hi, uoff + ulen) - greatest(lo, uoff) AS take FROM requests JOIN b ON ulen > 0 AND uoff < hi AND uoff + ulen > lo"


@query("j11_overlap", sql(_OVERLAP, "requests", "units", b=_BLOCKS))
def j11(spark, d):
    return intervals.overlap(views.requests(spark, d), blocks(spark, d)).select("request_id", "block_id", "skip", "take")


@query("b07_decoded_work", sql("SELECT request_id, count(*) AS blocks, CAST(sum(ulen) AS BIGINT) AS decoded, CAST(sum(take) AS BIGINT) AS returned FROM (SELECT m.*, b.ulen FROM m JOIN b USING (block_id)) GROUP BY request_id", "requests", "units", b=_BLOCKS, m=_OVERLAP))
def b07(spark, d):
    """Work of reading each request on its own: every touched block counts each time."""
    m = intervals.overlap(views.requests(spark, d), blocks(spark, d))
    return m.groupBy("request_id").agg(F.count("*").alias("blocks"), F.sum("ulen").alias("decoded"), F.sum("take").alias("returned"))


@query("b08_batch_work", sql("SELECT CAST(sum(ulen) AS BIGINT) AS loop_decoded, CAST((SELECT sum(ulen) FROM b WHERE block_id IN (SELECT block_id FROM m)) AS BIGINT) AS batch_decoded FROM (SELECT b.ulen FROM m JOIN b USING (block_id))", "requests", "units", b=_BLOCKS, m=_OVERLAP))
def b08(spark, d):
    """Decoded work of a loop of reads, and of a batch that decodes each touched block once."""
    each = intervals.overlap(views.requests(spark, d), blocks(spark, d)).groupBy("block_id").agg(F.count("*").alias("c"), F.first("ulen").alias("ulen"))
    return each.agg(F.sum(F.col("c") * F.col("ulen")).alias("loop_decoded"), F.sum("ulen").alias("batch_decoded"))


@query("b06_geometry", sql("SELECT count(*) AS units, count(*) FILTER (WHERE ulen = 0) AS empty, CAST(sum(ulen) AS BIGINT) AS raw, max(ulen) AS largest FROM units", "units"))
def b06(spark, d):
    return views.units(spark, d).agg(F.count("*").alias("units"), F.count_if(F.col("ulen") == 0).alias("empty"), F.sum("ulen").alias("raw"), F.max("ulen").alias("largest"))


_MERGED = "SELECT chrom, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT chrom, lo, hi FROM intervals))) GROUP BY chrom, island"


@query("w08_merge", sql(_MERGED, "intervals"))
def w08(spark, d):
    return intervals.merge(views.intervals(spark, d), "chrom")


_GAPS = "SELECT chrom, coalesce(lag(hi) OVER (PARTITION BY chrom ORDER BY lo), 0) AS lo, lo AS hi FROM m UNION ALL SELECT chrom, max(hi), 200000 FROM m GROUP BY chrom"


@query("w09_gaps", sql("SELECT chrom, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM g WHERE hi - lo >= 5", "intervals", m=_MERGED, g=_GAPS))
def w09(spark, d):
    merged = intervals.merge(views.intervals(spark, d), "chrom", stretches=True)
    return intervals.gaps(merged, "chrom", 200000, 5).select("chrom", "lo", F.col("hi").cast("long").alias("hi"))


@query("w10_weighted_starts", sql("SELECT chrom, CAST(sum(hi - lo - 5 + 1) AS BIGINT) AS starts, count(*) AS gaps FROM g WHERE hi - lo >= 5 GROUP BY chrom", "intervals", m=_MERGED, g=_GAPS))
def w10(spark, d):
    """Valid starts of windows of 5 in the gaps: the weights that a pick draws from."""
    return w09(spark, d).groupBy("chrom").agg(F.sum(F.col("hi") - F.col("lo") - 5 + 1).alias("starts"), F.count("*").alias("gaps"))


# Requests, truth, coordinates

@query("p14_translations", sql("SELECT request_id, lo AS start0, hi - 1 AS last0, lo + 1 AS start1, hi AS last1, hi - lo AS length FROM requests", "requests"))
def p14(spark, d):
    lo, hi = F.col("lo"), F.col("hi")
    return views.requests(spark, d).select("request_id", lo.alias("start0"), (hi - 1).alias("last0"), (lo + 1).alias("start1"), hi.alias("last1"), (hi - lo).alias("length"))


@query("p15_fasta_address", sql("SELECT request_id, 100 + (lo // 60) * 61 + lo % 60 AS address FROM requests", "requests"))
def p15(spark, d):
    return views.requests(spark, d).select("request_id", (100 + F.floor(F.col("lo") / 60) * 61 + F.col("lo") % 60).alias("address"))


_CANON = "translate(replace(replace(text, chr(13), ''), chr(10), ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def canonical(text):
    """Without line ends, ASCII letters in upper case; other letters as they are."""
    return F.translate(F.translate(text, "\r\n", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@query("p17_canonical", f"SELECT doc_id, length({_CANON}) AS n, sha256({_CANON}) AS sha, md5({_CANON}) AS md FROM documents")
def p17(spark, d):
    """Canonical sequences and their digests (P-17, P-18)."""
    c = canonical(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.sha2(c, 256).alias("sha"), F.md5(c).alias("md"))


@query("a24_ordered_hash", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def a24(spark, d):
    """Digest of a response's pieces in order."""
    pieces = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), 256).alias("sha"), F.sum(F.length("text")).alias("n"))


@query("p16_prefix_count", "SELECT doc_id, n, least(n, (n // 61) * 60 + least(n % 61, 60)) AS canonical FROM (SELECT doc_id, length(text) AS n FROM documents)")
def p16(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n"), F.least(n, F.floor(n / 61) * 60 + F.least(n % 61, F.lit(60))).alias("canonical"))


@query("p26_hash_position", "SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::HUGEINT * 1000 // 18446744073709551616::HUGEINT AS BIGINT) AS position FROM documents")
def p26(spark, d):
    """A position from a digest's first 8 bytes, scaled to 1000 in exact integers."""
    return table(spark, d, "documents").select("doc_id", generators.scaled(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(1000)).alias("position"))


_HEADER = "SELECT doc_id AS id, doc_id % 4 AS stream, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT AS h FROM documents"


@query("p23_flag_bits", sql("SELECT id, " + ", ".join(f"(h >> {b}) & 1 = 1 AS bit{b}" for b in range(60, 64)) + ", lower(hex(CASE WHEN stream = 0 THEN h & 10376293541461622783::UBIGINT ELSE h & 9223372036854775807::UBIGINT END)) AS total FROM x", x=_HEADER))
def p23(spark, d):
    """The flags of a stream's 64-bit header and its size without them: bits 60 to 62 of the first stream, bit 63 of the others."""
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), 16, -10).cast("long")
    flags = [(F.shiftrightunsigned(h, b).bitwiseAND(1) == 1).alias(f"bit{b}") for b in range(60, 64)]
    total = F.when(F.col("doc_id") % 4 == 0, h.bitwiseAND(F.lit(~(7 << 60)))).otherwise(h.bitwiseAND(F.lit((1 << 63) - 1)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), *flags, F.lower(F.hex(total)).alias("total"))


@query("p24_covered_bytes", sql("SELECT request_id, greatest(0, least(900000, ((hi - 1) // 4096 + 1) * 4096) - lo // 4096 * 4096) AS covered FROM requests", "requests"))
def p24(spark, d):
    end = (F.floor((F.col("hi") - 1) / 4096) + 1) * 4096
    return views.requests(spark, d).select("request_id", F.greatest(F.lit(0), F.least(F.lit(900000), end) - F.floor(F.col("lo") / 4096) * 4096).alias("covered"))


@query("p25_expected_blocks", sql("SELECT id, (point_bytes + g - 1) // g AS blocks FROM curve", "curve"))
def p25(spark, d):
    return views.curve(spark, d).select("id", F.expr("(point_bytes + g - 1) div g").alias("blocks"))


@query("p28_window_role", sql("SELECT id, CASE WHEN w = 1 THEN 'CALIBRATION_ONLY' WHEN w IN (1024, 8192, 65536) THEN 'VERDICT' ELSE 'DIAGNOSTIC_ONLY' END AS role FROM (SELECT id, g // 4 AS w FROM curve)", "curve"))
def p28(spark, d):
    return views.curve(spark, d).select("id", judges.role(F.floor(F.col("g") / 4)).alias("role"))


@query("p13_signed_change", sql("SELECT id, round(CAST(point_bytes AS DOUBLE) / baseline_bytes - 1, 9) AS change, round(100 * (1 - CAST(point_bytes AS DOUBLE) / baseline_bytes), 9) AS reduction FROM curve", "curve"))
def p13(spark, d):
    x = F.col("point_bytes") / F.col("baseline_bytes")
    return views.curve(spark, d).select("id", r9(x - 1).alias("change"), r9(100 * (1 - x)).alias("reduction"))


@query("a35_two_bit_capacity", "SELECT source, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS packed, CAST(sum(length(regexp_replace(text, '[ACGTacgt]', '', 'g'))) AS BIGINT) AS exceptions FROM documents GROUP BY source")
def a35(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.expr("(length(text) + 3) div 4")).alias("packed"), F.sum(F.length(F.regexp_replace("text", "[ACGTacgt]", ""))).alias("exceptions"))


@query("a25_mean_granule", sql("SELECT codec, CAST(sum(archive_bytes) FILTER (WHERE archive_bytes > 0) AS DOUBLE) / count(*) FILTER (WHERE archive_bytes > 0) AS q FROM archives GROUP BY codec", "archives"))
def a25(spark, d):
    return views.archives(spark, d).filter("archive_bytes > 0").groupBy("codec").agg((F.sum("archive_bytes") / F.count("*")).alias("q"))


# Judges

@query("v11_outcomes", sql("SELECT id, CASE WHEN NOT started THEN 'detected' WHEN timed_out THEN 'hang' WHEN returncode < 0 THEN 'crash' WHEN returncode > 0 THEN 'refusal' WHEN bytes_equal THEN 'harmless' ELSE 'silent_error' END AS outcome FROM observations", "observations"))
def v11(spark, d):
    return views.observations(spark, d).select("id", judges.outcome().alias("outcome"))


@query("a19_outcome_counts", sql("SELECT kind, hash_enabled, " + ", ".join(f"count(*) FILTER (WHERE o = '{o}') AS {o}" for o in judges.OUTCOMES) + ", CASE WHEN count(*) FILTER (WHERE o = 'silent_error') > 0 THEN 'FAIL' ELSE 'PASS' END AS integrity FROM (SELECT *, CASE WHEN NOT started THEN 'detected' WHEN timed_out THEN 'hang' WHEN returncode < 0 THEN 'crash' WHEN returncode > 0 THEN 'refusal' WHEN bytes_equal THEN 'harmless' ELSE 'silent_error' END AS o FROM observations) GROUP BY kind, hash_enabled", "observations"))
def a19(spark, d):
    """Outcomes by mode with zeros, and integrity (A-19, A-20)."""
    return judges.outcome_counts(views.observations(spark, d), ["kind", "hash_enabled"])


@query("j07_missing_and_extra", sql("SELECT codec, config, 'missing' AS problem FROM e WHERE (codec, config) NOT IN (SELECT (codec, config) FROM o) UNION ALL SELECT codec, config, 'extra' FROM o WHERE (codec, config) NOT IN (SELECT (codec, config) FROM e)", "samples", e="SELECT codec, config FROM (SELECT DISTINCT codec FROM samples), (SELECT unnest(range(5, 15)) AS config)", o="SELECT DISTINCT codec, config FROM samples"))
def j07(spark, d):
    """Completeness of a grid of codecs and configurations."""
    s = views.samples(spark, d)
    grid = s.select("codec").distinct().crossJoin(spark.range(5, 15).withColumnRenamed("id", "config"))
    return judges.missing_and_extra(grid, s, ["codec", "config"])


@query("j06_same_trace", sql("SELECT coalesce(a.query, b.query) AS query, a.byte_offset AS a_offset, b.byte_offset AS b_offset FROM (SELECT * FROM samples WHERE pass <> 0) a FULL JOIN (SELECT query + query % 2 * 3 AS query, byte_offset FROM samples WHERE pass <> 1) b ON a.query = b.query WHERE a.byte_offset IS DISTINCT FROM b.byte_offset", "samples"))
def j06(spark, d):
    """Where two passes' traces are not the same."""
    s = views.samples(spark, d)
    a = s.filter("pass <> 0").select("query", F.col("byte_offset").alias("a_offset"))
    b = s.filter("pass <> 1").select((F.col("query") + F.col("query") % 2 * 3).alias("query"), F.col("byte_offset").alias("b_offset"))
    return a.join(b, "query", "full").filter(~F.col("a_offset").eqNullSafe(F.col("b_offset")))


@query("a28_homogeneous", sql("SELECT field, n AS distinct_values, n = 1 AS homogeneous FROM (SELECT 'codec' AS field, count(DISTINCT codec) AS n FROM samples UNION ALL SELECT 'requested_bytes', count(DISTINCT requested_bytes) FROM samples UNION ALL SELECT 'pass', count(DISTINCT pass) FROM samples)", "samples"))
def a28(spark, d):
    return judges.homogeneous(views.samples(spark, d), ["codec", "requested_bytes", "pass"])


@query("v07_suppressed_metrics", sql("SELECT kind, count(*) AS n, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAILED' END AS status, CASE WHEN bool_and(ok) THEN avg(returncode) END AS returncode FROM (SELECT kind * 10 + id % 2 AS kind, returncode, NOT (timed_out AND id % 2 = 1) AS ok FROM observations) GROUP BY kind", "observations"))
def v07(spark, d):
    """Any failure makes a group FAILED and takes its metrics away."""
    o = views.observations(spark, d).withColumn("kind", F.col("kind") * 10 + F.col("id") % 2)
    return judges.suppressed(o, "kind", ~(F.col("timed_out") & (F.col("id") % 2 == 1)), "returncode")


_LAW = (
    "SELECT k AS id, w AS w_bytes, q AS q_bytes, 50000000 AS d_bps, p AS probe_us, greatest(1, (p * 50000000 + (w - 1) * 1000000) * (70 + k % 61) // 5000000000) AS measured_us "
    "FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 8192 WHEN 3 THEN 65536 ELSE p_size * 100 END AS BIGINT) AS w, "
    "CAST(1 + p_partkey % 150 * 400 AS BIGINT) AS q, CAST(120 + p_partkey % 900 AS BIGINT) AS p FROM part)"
)


@query("a31_window_law", sql("SELECT id, CASE WHEN w_bytes = 1 THEN 'CALIBRATION_ONLY' WHEN w_bytes IN (1024, 8192, 65536) THEN 'VERDICT' ELSE 'DIAGNOSTIC_ONLY' END AS role, round(100 * (CAST(measured_us * d_bps - law AS DOUBLE)) / law, 6) AS error_percent, c0 AS c0_ok, CASE WHEN c0 THEN 'VALID' ELSE 'FAIL' END AS model_status, CASE WHEN w_bytes IN (1024, 8192, 65536) THEN CASE WHEN 5 * abs(measured_us * d_bps - law) <= law AND c0 THEN 'PASS' ELSE 'FAIL' END WHEN w_bytes = 1 THEN 'CALIBRATION_ONLY' ELSE 'DIAGNOSTIC_ONLY' END AS verdict FROM (SELECT *, probe_us * d_bps + (w_bytes - 1) * 1000000 AS law, probe_us * d_bps >= q_bytes * 1000000 AS c0 FROM x)", x=_LAW))
def a31(spark, d):
    k = F.col("p_partkey").cast("long")
    w = F.when(k % 5 == 0, 1).when(k % 5 == 1, 1024).when(k % 5 == 2, 8192).when(k % 5 == 3, 65536).otherwise(F.col("p_size") * 100).cast("long")
    x = table(spark, d, "part").select(k.alias("id"), w.alias("w_bytes"), (1 + k % 150 * 400).alias("q_bytes"), F.lit(50000000).cast("long").alias("d_bps"), (120 + k % 900).alias("probe_us"))
    x = x.withColumn("measured_us", F.greatest(F.lit(1), F.expr("(probe_us * 50000000 + (w_bytes - 1) * 1000000) * (70 + id % 61) div 5000000000")))
    return judges.window_law(x).select("id", "role", F.round("error_percent", 6).alias("error_percent"), "c0_ok", "model_status", "verdict")


_QUIET = (
    "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE 'bench' END AS host, (s_suppkey % 100) / 100.0 AS load1, CAST(round(abs(s_acctbal) * 10000000) AS BIGINT) AS disk, "
    "(s_suppkey % 9) / 4.0 AS sampling, (s_suppkey % 40) / 2.0 AS cpu_a, s_suppkey % 3 = 0 AS own_a, (s_suppkey % 8) * 1.5 AS cpu_b FROM supplier"
)


@query("f13_silence_gate", sql("SELECT s_suppkey, CASE WHEN len(r) > 0 THEN 'FAILED' ELSE 'PASS' END AS status, array_to_string(r, ',') AS reasons FROM (SELECT s_suppkey, list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{why}' END" for rule, why in zip(("host <> 'bench'", "NOT load1 < 0.5", "NOT disk > 20000000000", "sampling < 1", "(cpu_a >= 10 AND NOT own_a) OR cpu_b >= 10"), judges.NOISE)) + "], lambda x: x IS NOT NULL) AS r FROM q)", q=_QUIET))
def f13(spark, d):
    k = F.col("s_suppkey")
    process = lambda cpu, own: F.struct(cpu.cast("double").alias("cpu_percent"), own.alias("own_process"))
    s = table(spark, d, "supplier").select(
        k, F.when(k % 7 == 0, "other").otherwise("bench").alias("host"), ((k % 100) / 100).alias("load1"), F.round(F.abs("s_acctbal") * 10000000).cast("long").alias("disk_available_bytes"),
        ((k % 9) / 4).alias("sampling_seconds"), F.array(process((k % 40) / 2, k % 3 == 0), process((k % 8) * 1.5, F.lit(False))).alias("processes"),
    )
    status, reasons = judges.silence("bench")
    return s.select(k, status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query("a22_stored_bytes", sql("SELECT count(*) AS paths, CAST(sum(b) FILTER (WHERE k = 1) AS BIGINT) AS stored, count(*) FILTER (WHERE k > 1) AS conflicts FROM (SELECT concat(codec, file) AS path, max(index_bytes) AS b, count(DISTINCT index_bytes) AS k FROM archives GROUP BY path)", "archives"))
def a22(spark, d):
    """Bytes over distinct paths; a path with two sizes is a conflict and is not summed."""
    p = views.archives(spark, d).groupBy(F.concat("codec", "file").alias("path")).agg(F.max("index_bytes").alias("b"), F.count_distinct("index_bytes").alias("k"))
    return p.agg(F.count("*").alias("paths"), F.sum(F.when(F.col("k") == 1, F.col("b"))).alias("stored"), F.count_if(F.col("k") > 1).alias("conflicts"))


_SINGLE = sql("SELECT config, CASE WHEN count(DISTINCT codec) = 1 THEN min(codec) END AS codec, count(DISTINCT codec) AS codecs FROM samples GROUP BY config", "samples")


@query("a29_singletons", _SINGLE)
@query("a29_singletons_all", _SINGLE)
def a29(spark, d):
    s = views.samples(spark, d).groupBy("config").agg(F.collect_set("codec").alias("c"))
    return s.select("config", F.when(F.size("c") == 1, F.col("c")[0]).alias("codec"), F.size("c").cast("long").alias("codecs"))


_WIDE = sql("SELECT codec, " + ", ".join(f"max(latency_ms) FILTER (WHERE config = {k}) AS c{k}" for k in range(10)) + " FROM samples GROUP BY codec", "samples")


@query("p09_wide_pivot", _WIDE)
@query("p09_wide_pivot_all", _WIDE)
def p09(spark, d):
    """Long metrics as columns; the ten values are named, so no pass looks for them."""
    s = views.samples(spark, d).groupBy("codec").pivot("config", list(range(10))).agg(F.max("latency_ms"))
    return s.select("codec", *[F.col(str(k)).alias(f"c{k}") for k in range(10)])


@query("u01_union_families", sql("SELECT 'samples' AS family, codec, count(*) AS n FROM samples GROUP BY codec UNION ALL SELECT 'decodes', codec, count(*) FROM decodes GROUP BY codec UNION ALL SELECT 'archives', codec, count(*) FROM archives GROUP BY codec", "samples", "decodes", "archives"))
def u01(spark, d):
    one = lambda name: getattr(views, name)(spark, d).groupBy("codec").agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "codec", "n")
    return one("samples").unionByName(one("decodes")).unionByName(one("archives"))


# The scorecard

@query(
    "scorecard",
    sql(
        "SELECT a.codec, a.n, a.p50, a.p99, amp.amplification, e.entropy, a.p50 / b.p50 AS relative_p50, CASE WHEN a.p50 / b.p50 <= 1 THEN 'PASS' ELSE 'FAIL' END AS p50_verdict, a.p99 / b.p99 AS relative_p99, CASE WHEN a.p99 / b.p99 <= 1 THEN 'PASS' ELSE 'FAIL' END AS p99_verdict, CAST(floor(100 / a.p50) AS BIGINT) + 1 AS break_even_n FROM a JOIN amp USING (codec) JOIN e USING (codec) CROSS JOIN (SELECT p50, p99 FROM a WHERE codec = 'click') b",
        "samples", a=_NEAREST, amp="SELECT codec, sum(decoded_bytes) / sum(requested_bytes) AS amplification FROM samples GROUP BY codec",
        blk="SELECT codec, byte_offset // 1048576 AS block, count(*) AS c FROM samples GROUP BY ALL", e="SELECT codec, round(greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)), 9) AS entropy FROM blk GROUP BY codec",
    ),
)
def scorecard(spark, d):
    """One row a codec: latency, amplification, entropy, verdicts against the baseline, break-even."""
    s = views.samples(spark, d)
    q = quantile.nearest_rank(s, ["codec"], "latency_ms", {"p50": 50, "p99": 99})
    amp = metrics.ratio_of_sums(s, ["codec"], F.col("decoded_bytes"), F.col("requested_bytes"), "amplification").select("codec", "amplification")
    base = q.filter("codec = 'click'").select(F.col("p50").alias("b50"), F.col("p99").alias("b99"))
    rows = q.join(amp, "codec").join(a10(spark, d).select("codec", "entropy"), "codec").crossJoin(F.broadcast(base))
    r50, r99 = F.col("p50") / F.col("b50"), F.col("p99") / F.col("b99")
    passed = lambda r: F.when(r <= 1, "PASS").otherwise("FAIL")
    return rows.select("codec", "n", "p50", "p99", "amplification", "entropy", r50.alias("relative_p50"), passed(r50).alias("p50_verdict"), r99.alias("relative_p99"), passed(r99).alias("p99_verdict"), metrics.break_even(F.lit(100), F.col("p50")).alias("break_even_n"))
