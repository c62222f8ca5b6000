"""Queries of the contracts between tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, intervals, metrics, quantile
from . import views
from .registry import query, r9
from .views import sql, table


@query("f01_one_each", sql("SELECT codec, config, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN v END AS latency_ms, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS reason FROM (SELECT DISTINCT codec, config FROM samples) LEFT JOIN (SELECT codec, config, count(*) AS n, max(latency_ms) AS v FROM samples WHERE query % 40 = 1 GROUP BY ALL) USING (codec, config)", "samples"))
def f01(spark, d):
    """Scopes among recorded points: exactly one row, none, or too many. The record holds the queries 1, 41, 81 and so on."""
    s = views.samples(spark, d)
    return contracts.one_each(s, s.filter("query % 40 = 1"), ["codec", "config"], "latency_ms")


@query("f02_measured", "SELECT s_suppkey FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'planned' ELSE 'measured' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN 'nan'::DOUBLE WHEN s_suppkey % 11 = 0 THEN 'inf'::DOUBLE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_acctbal END AS value FROM supplier) WHERE status = 'measured' AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE AND value > 0")
def f02(spark, d):
    """Measured rows with a finite, positive value (F-02, F-06)."""
    k = F.col("s_suppkey")
    value = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).when(k % 13 != 0, F.col("s_acctbal").cast("double"))
    rows = table(spark, d, "supplier").select(k, F.when(k % 3 == 0, "planned").otherwise("measured").alias("status"), value.alias("value"))
    return rows.filter((F.col("status") == "measured") & metrics.positive(F.col("value"))).select("s_suppkey")


@query("p11_gains", sql("SELECT g, round((a.ratio / b.ratio - 1) * 100, 6) AS density_gain, round((a.p50 / b.p50 - 1) * 100, 6) AS latency_penalty, round((a.ratio / b.ratio - 1) * 100 - (a.p50 / b.p50 - 1) * 100, 6) AS margin FROM t a JOIN t b USING (g) WHERE a.codec = 'AF' AND b.codec = 'RF'", "archives", t="SELECT codec, g, sum(input_bytes) / sum(archive_bytes) AS ratio, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY index_bytes) AS DOUBLE) AS p50 FROM archives GROUP BY codec, g"))
def p11(spark, d):
    a = views.archives(spark, d).filter("codec in ('AF', 'RF')")
    p50 = quantile.nearest_rank(a, ["codec", "g"], "index_bytes", {"p50": 50})
    t = metrics.ratio_of_sums(a, ["codec", "g"], F.col("input_bytes"), F.col("archive_bytes"), "ratio").join(p50, ["codec", "g"])
    own, base = t.filter("codec = 'AF'").select("g", "ratio", "p50"), t.filter("codec = 'RF'").select("g", F.col("ratio").alias("r"), F.col("p50").alias("p"))
    gain, penalty, margin = contracts.gains(F.col("ratio"), F.col("r"), F.col("p50"), F.col("p"))
    return own.join(base, "g").select("g", F.round(gain, 6).alias("density_gain"), F.round(penalty, 6).alias("latency_penalty"), F.round(margin, 6).alias("margin"))


_TEXTS = "SELECT request_id, hi, CASE WHEN request_id % 17 = 0 THEN concat(lo, '.0') WHEN request_id % 19 = 0 THEN 'true' WHEN request_id % 23 = 0 THEN concat('0', lo) WHEN request_id % 29 = 0 THEN concat('-', lo) WHEN request_id % 31 = 0 THEN CAST(hi AS VARCHAR) ELSE CAST(lo AS VARCHAR) END AS s FROM requests"


@query("p27_window_lengths", sql("SELECT request_id, i AS start, coalesce(i >= 0 AND i < hi AND hi <= 900000, false) AS ok FROM (SELECT request_id, hi, CASE WHEN regexp_full_match(s, '-?(0|[1-9][0-9]*)') THEN TRY_CAST(s AS BIGINT) END AS i FROM x)", "requests", x=_TEXTS))
def p27(spark, d):
    r, k = views.requests(spark, d), F.col("request_id")
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    s = F.when(k % 17 == 0, F.concat(lo, F.lit(".0"))).when(k % 19 == 0, "true").when(k % 23 == 0, F.concat(F.lit("0"), lo)).when(k % 29 == 0, F.concat(F.lit("-"), lo)).when(k % 31 == 0, hi).otherwise(lo)
    x = r.select(k, "hi", contracts.strict_int(s).alias("start"))
    return x.select(k, "start", contracts.window_ok(F.col("start"), F.col("hi"), F.lit(900000)).alias("ok"))


@query("j03_curve_of_input", sql("SELECT id, CASE WHEN b.base IS NULL THEN 'no baseline' WHEN p.input <> b.input THEN 'other input' ELSE 'ok' END AS state, CASE WHEN p.input = b.input THEN round(1 - b.base / p.point_bytes, 9) END AS c FROM (SELECT *, CASE WHEN id % 10 = 0 THEN 'x' ELSE file END AS input FROM curve) p LEFT JOIN (SELECT file, grp, file AS input, min(baseline_bytes) AS base FROM curve WHERE file <> 'Brand#11' GROUP BY file, grp) b ON p.file = b.file AND p.grp = b.grp", "curve"))
def j03(spark, d):
    c = views.curve(spark, d)
    bases = c.filter("file <> 'Brand#11'").groupBy("file", "grp").agg(F.min("baseline_bytes").alias("bytes")).withColumn("input", F.col("file"))
    points = c.select("id", "file", "grp", F.col("point_bytes").alias("bytes"), F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("file")).alias("input"))
    return contracts.curve_of(points, bases, ["file", "grp"]).select("id", "state", r9("c").alias("c"))


@query("j08_uncovered_groups", sql("SELECT config, array_to_string(list_sort(list(codec)), ',') AS missing FROM (SELECT config, codec FROM (SELECT DISTINCT config FROM m) CROSS JOIN (SELECT DISTINCT codec FROM m) EXCEPT SELECT config, codec FROM m) GROUP BY config", "samples", m="SELECT config, codec FROM samples WHERE NOT (config = 3 AND codec = 'click') AND NOT (config = 7 AND codec > 'login')"))
def j08(spark, d):
    m = views.samples(spark, d).filter("not (config = 3 and codec = 'click') and not (config = 7 and codec > 'login')")
    return contracts.uncovered(m, "config", "codec").withColumn("missing", F.array_join("missing", ","))


_PIECES = "SELECT doc_id AS block_id, text, CAST(length(text) AS BIGINT) AS ulen, CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS uoff FROM documents"


def pieces(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), "text", F.length("text").cast("long").alias("ulen"))
    return intervals.prefix_starts(p.drop("text"), "block_id", "ulen", "uoff").join(p.drop("ulen"), "block_id")


@query("j12_truth_of_requests", sql("SELECT r.request_id, coalesce(n, 0) AS length, CASE WHEN n = hi - lo THEN s END AS sha256, coalesce(n, 0) = hi - lo AS inside FROM requests r LEFT JOIN (SELECT request_id, CAST(sum(least(hi, uoff + ulen) - greatest(lo, uoff)) AS BIGINT) AS n, sha256(string_agg(substring(text, greatest(lo, uoff) - uoff + 1, least(hi, uoff + ulen) - greatest(lo, uoff)), '' ORDER BY uoff)) AS s FROM requests JOIN p ON ulen > 0 AND uoff < hi AND uoff + ulen > lo GROUP BY request_id) USING (request_id)", "requests", p=_PIECES))
def j12(spark, d):
    return contracts.truth(views.requests(spark, d), pieces(spark, d))


@query("t04_rotated_order", sql("SELECT profile, size, codec, (place + k - (profile + size) % k) % k AS turn FROM (SELECT codec, row_number() OVER (ORDER BY codec) - 1 AS place, count(*) OVER () AS k FROM (SELECT DISTINCT codec FROM samples)) CROSS JOIN range(5) a(profile) CROSS JOIN range(4) b(size)", "samples"))
def t04(spark, d):
    """Order of codecs for each workload: rotated by the numbers of its profile and size."""
    names = views.samples(spark, d).agg(F.array_sort(F.collect_set("codec")).alias("names"))
    grid = names.select("names", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("profile")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("size"))
    rows = grid.select("profile", "size", F.posexplode("names").alias("place", "codec"), F.size("names").alias("k"))
    return rows.select("profile", "size", "codec", contracts.rotated(F.col("place"), (F.col("profile") + F.col("size")) % F.col("k"), F.col("k")).alias("turn"))


@query("u04_kept_prefix", "SELECT count(x) AS prior, count(*) FILTER (WHERE x = y AND a.p IS NOT DISTINCT FROM b.p) AS kept, count(*) FILTER (WHERE x = y AND a.p IS DISTINCT FROM b.p) AS changed, count(*) FILTER (WHERE y IS NULL) AS dropped, count(*) FILTER (WHERE x IS NULL) AS added FROM (SELECT o_orderkey AS x, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT o_orderkey AS y, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS p FROM orders WHERE o_orderkey % 89 <> 0) b ON x = y")
def u04(spark, d):
    """A log against its later version, in which some rows are changed, dropped and added."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.filter("o_orderstatus <> 'P'").select(k, F.col("o_totalprice").alias("p"))
    return contracts.prefix_kept(old, o.filter(k % 89 != 0).select(k, F.when(k % 97 != 0, F.col("o_totalprice")).alias("p")), "o_orderkey")


@query("w04_continuity", sql("SELECT block_id, uoff + ulen AS \"end\" FROM b WHERE ulen > 0 AND block_id % 50 <> 7 AND uoff + ulen NOT IN (SELECT uoff FROM b WHERE ulen > 0 AND block_id % 50 <> 7)", b="SELECT block_id, ulen, uoff FROM (" + _PIECES + ")"))
def w04_continuity(spark, d):
    """Blocks that no other follows, when every fiftieth is lost."""
    b = intervals.prefix_starts(views.units(spark, d), "unit_id", "ulen", "uoff").withColumnRenamed("unit_id", "block_id")
    return contracts.breaks(b.filter("block_id % 50 <> 7"))


@query("w15_places", "SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY format, variant, coalesce(hash_mode, ''), coalesce(window_bytes, 0)) AS place FROM (SELECT p_brand AS \"table\", p_type AS format, p_name AS variant, CASE WHEN p_size % 3 = 0 THEN 'on' WHEN p_size % 3 = 1 THEN 'off' END AS hash_mode, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 1024 END AS window_bytes, count(*) AS n FROM part GROUP BY ALL)")
def w15(spark, d):
    s = F.col("p_size")
    keys = [F.col("p_brand").alias("table"), F.col("p_type").alias("format"), F.col("p_name").alias("variant"), F.when(s % 3 == 0, "on").when(s % 3 == 1, "off").alias("hash_mode"), F.when(s % 4 > 0, s % 4 * 1024).alias("window_bytes")]
    return contracts.ordered_places(table(spark, d, "part").groupBy(*keys).agg(F.count("*").alias("n")), "table")


@query("a32_kinds", "SELECT string_agg(concat(k, '=', n), ', ' ORDER BY k) AS kinds FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY k)")
def a32_kinds(spark, d):
    return contracts.kinds(table(spark, d, "orders"), "o_orderstatus")


_BATCH = "SELECT codec, config, count(*) AS n, count(*) * 1000.0 / CAST(sum(CAST(round(latency_ms * 1000) AS BIGINT)) AS DOUBLE) AS value FROM samples GROUP BY codec, config"


@query("v04_batch_audit", sql("SELECT codec, config, concat_ws(',', CASE WHEN relative <> value / base THEN 'relation' END, CASE WHEN status <> CASE WHEN relative >= 1 THEN 'pass' ELSE 'fail' END THEN 'verdict' END, CASE WHEN entropy > log2(n) + 1e-9 THEN 'entropy' END) AS broken FROM (SELECT *, CASE WHEN (relative >= 1) = (config <> 5) THEN 'pass' ELSE 'fail' END AS status FROM (SELECT a.*, b.value AS base, CASE WHEN a.config = 3 THEN a.value / b.value * 2 ELSE a.value / b.value END AS relative, CASE WHEN a.config = 6 THEN log2(a.n) + 1 ELSE log2(a.n) / 2 END AS entropy FROM t a JOIN t b ON a.config = b.config AND b.codec = 'click'))", "samples", t=_BATCH))
def v04(spark, d):
    """Recorded batch rows; relations of config 3, verdicts of 5 and entropies of 6 are wrong."""
    micro = F.sum(F.round(F.col("latency_ms") * 1000).cast("long"))
    t = views.samples(spark, d).groupBy("codec", "config").agg(F.count("*").alias("n"), (F.count("*") * 1000.0 / micro).alias("value"))
    rel = F.col("value") / F.col("b") * F.when(F.col("config") == 3, 2.0).otherwise(1.0)
    rows = t.join(t.filter("codec = 'click'").select("config", F.col("value").alias("b")), "config").withColumn("relative", rel)
    rows = rows.withColumn("status", F.when((F.col("relative") >= 1) == (F.col("config") != 5), "pass").otherwise("fail"))
    rows = rows.withColumn("entropy", F.when(F.col("config") == 6, F.log2("n") + 1).otherwise(F.log2("n") / 2)).drop("b")
    return contracts.batch_audit(rows, ["config"], F.col("codec") == "click").select("codec", "config", "broken")
