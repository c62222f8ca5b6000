"""Queries over evidence: cells and names, run against run, ledgers, cohorts, sampling, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audits, cells, evidence, generators, intervals, judges, metrics, quantile
from ..sources import store
from . import views
from .registry import query, r9
from .views import sql, table

# Cells and names. A text of both engines is stated once.

_REASON = "CASE s_suppkey % 5 WHEN 0 THEN 'n/a - no disk|drive' WHEN 1 THEN 'N/A' WHEN 2 THEN '  n/a: slow host ' WHEN 3 THEN 'n/a -' ELSE s_name END"


@query("p19_reasons", "SELECT s_suppkey, CASE WHEN trim(b) <> '' AND lower(b) <> 'n/a' THEN concat('n/a — ', replace(replace(b, '|', '\\|'), chr(10), ' ')) END AS cell FROM (SELECT s_suppkey, regexp_replace(trim(x), '(?i)^n/a(\\s*[:—-]\\s*|\\s+)', '') AS b FROM (SELECT s_suppkey, " + _REASON + " AS x FROM supplier))")
def p19(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", cells.reason(F.expr(_REASON)).alias("cell"))


_TOKEN = "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, 'K') WHEN 1 THEN concat(p_size, 'M') WHEN 2 THEN concat(p_size, 'G') WHEN 3 THEN '0' WHEN 4 THEN concat(p_size * 100, 'M') ELSE concat('', p_size) END"


@query("p20_size_tokens", "SELECT p_partkey, token, CASE WHEN regexp_matches(token, '^[0-9]+[KM]?$') AND n BETWEEN 1 AND 1073741824 THEN n END AS bytes FROM (SELECT *, CAST(regexp_extract(token, '^[0-9]+') AS BIGINT) * CASE right(token, 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 ELSE 1 END AS n FROM (SELECT p_partkey, " + _TOKEN + " AS token FROM part))")
def p20(spark, d):
    t = F.expr(_TOKEN)
    return table(spark, d, "part").select("p_partkey", t.alias("token"), cells.size_bytes(t).alias("bytes"))


@query("p21_numbers", "SELECT s_suppkey, CASE WHEN x IS NULL THEN '' WHEN x = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(CAST(CAST(x AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS cell FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 4096.0 / 8 END::DOUBLE AS x FROM supplier)")
def p21(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", cells.number(F.when(k % 3 != 0, k * F.lit(4096.0) / 8)).alias("cell"))


@query("p22_size_labels", sql("SELECT id, CASE WHEN (g + id % 2) % 1024 = 0 THEN concat((g + id % 2) // 1024, ' KiB') ELSE concat(g + id % 2, ' B') END AS label FROM curve", "curve"))
def p22(spark, d):
    return views.curve(spark, d).select("id", cells.size_label(F.col("g") + F.col("id") % 2).alias("label"))


@query("p29_table_ids", sql("SELECT DISTINCT concat('axis', config, CASE WHEN config % 2 = 0 THEN concat('-threads-', config) END, CASE WHEN pass < 2 THEN concat('-hash-', CASE pass WHEN 0 THEN 'on' ELSE 'off' END) END, '-W', CASE WHEN config % 3 = 0 THEN 'none' ELSE CAST(1024 * config AS VARCHAR) END) AS id FROM samples", "samples"))
def p29(spark, d):
    c, p = F.col("config"), F.col("pass")
    id_ = cells.table_id(F.concat(F.lit("axis"), c), F.when(c % 2 == 0, c), F.when(p == 0, "on").when(p == 1, "off"), F.when(c % 3 != 0, 1024 * c))
    return views.samples(spark, d).select(id_.alias("id")).distinct()


_ESC = "text"
for _a, _b in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'|'", "&#124;"), ("chr(10)", " "), ("chr(13)", " "), ("'['", "&#91;"), ("']'", "&#93;"), ("'`'", "&#96;")):
    _ESC = f"replace({_ESC}, {_a}, '{_b}')"


@query("p30_escaped", f"SELECT doc_id, length({_ESC}) AS n, sha256({_ESC}) AS sha FROM documents")
def p30(spark, d):
    e = cells.escaped(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(e).cast("long").alias("n"), F.sha2(e, 256).alias("sha"))


@query("f07_names", "SELECT p_partkey, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS brand_ok, regexp_matches(replace(p_brand, '#', '-'), '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS label_ok, regexp_matches(CASE p_partkey % 3 WHEN 0 THEN sha256(p_brand) WHEN 1 THEN upper(sha256(p_brand)) ELSE substr(sha256(p_brand), 2) END, '^[0-9a-f]{64}$') AS sha_ok FROM part")
def f07(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", b.rlike(cells.LABEL).alias("brand_ok"), F.replace(b, F.lit("#"), F.lit("-")).rlike(cells.LABEL).alias("label_ok"), F.when(F.col("p_partkey") % 3 == 0, F.sha2(b, 256)).when(F.col("p_partkey") % 3 == 1, F.upper(F.sha2(b, 256))).otherwise(F.substring(F.sha2(b, 256), 2, 64)).rlike(cells.SHA256).alias("sha_ok"))


_PATH = "CASE s_suppkey % 6 WHEN 0 THEN concat('/', s_name) WHEN 1 THEN concat('a/../', s_name) WHEN 2 THEN concat('c:', s_name) WHEN 3 THEN concat('a/..b/', s_name) WHEN 4 THEN '..' ELSE concat('evidence/', s_name) END"


@query("f08_confined_paths", f"SELECT s_suppkey, NOT (x LIKE '/%' OR contains(x, ':') OR contains(x, chr(92)) OR list_contains(string_split(x, '/'), '..')) AS ok FROM (SELECT s_suppkey, {_PATH} AS x FROM supplier)")
def f08(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", cells.confined(F.expr(_PATH)).alias("ok"))


@query("f12_alphabet", "SELECT doc_id, regexp_full_match(text, '[ACGTacgt]*') AS bases, regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^ACGTacgt]', '', 'g') ELSE left(text, 1) END, '[ACGTacgt]*') AS kept FROM documents")
def f12(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(cells.BASES).alias("bases"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(t, "[^ACGTacgt]", "")).otherwise(F.left(t, F.lit(1))).rlike(cells.BASES).alias("kept"))


# Sampling and order

_STARTS = "SELECT unit_id, ulen - 63 AS ulen, CAST(coalesce(sum(ulen - 63) OVER (ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS uoff FROM units WHERE ulen >= 64"


@query("w11_window_draws", sql("SELECT request_id, unit_id, lo - uoff AS start FROM requests r LEFT JOIN s ON uoff <= lo AND lo < uoff + ulen", "requests", "units", s=_STARTS))
def w11(spark, d):
    """Draws over all valid starts of windows of 64, as unit and start; every valid start is as likely."""
    starts = views.units(spark, d).filter("ulen >= 64").withColumn("ulen", F.col("ulen") - 63)
    placed = intervals.asof_block(views.requests(spark, d), intervals.prefix_starts(starts, "unit_id", "ulen", "uoff"), "lo")
    return placed.select("request_id", "unit_id", (F.col("lo") - F.col("uoff")).alias("start"))


@query("w12_sorted_prefix", sql("SELECT codec, byte_offset, row_number() OVER (PARTITION BY codec ORDER BY byte_offset, query) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY query) AS k FROM samples) WHERE k <= 200", "samples"))
def w12(spark, d):
    """The first 200 requests of each codec, sorted by offset: the sorted profile is the uniform one's prefix in order."""
    first = F.row_number().over(Window.partitionBy("codec").orderBy("query"))
    at = F.row_number().over(Window.partitionBy("codec").orderBy("byte_offset", "query")) - 1
    return views.samples(spark, d).withColumn("k", first).filter("k <= 200").select("codec", "byte_offset", at.cast("long").alias("position"))


@query("w13_clusters", sql("SELECT query // 32 AS cluster, count(*) AS n, min(byte_offset) AS lo, max(byte_offset) AS hi, arg_min(byte_offset, query) AS anchor FROM samples GROUP BY ALL", "samples"))
def w13(spark, d):
    c = views.samples(spark, d).groupBy(F.expr("query div 32").alias("cluster"))
    return c.agg(F.count("*").alias("n"), F.min("byte_offset").alias("lo"), F.max("byte_offset").alias("hi"), F.min_by("byte_offset", "query").alias("anchor"))


_ALONG = "SELECT codec, config, CAST(sum(decoded_bytes) AS BIGINT) AS a, CAST(sum(byte_offset % 98304) AS BIGINT) AS b FROM samples GROUP BY codec, config"


def _along(spark, d):
    return views.samples(spark, d).groupBy("codec", "config").agg(F.sum("decoded_bytes").alias("a"), F.sum(F.col("byte_offset") % 98304).alias("b"))


@query("w14_monotone", sql("SELECT codec, coalesce(bool_and(up), true) AS nondecreasing, arg_min(a, config) AS first, arg_max(a, config) AS last FROM (SELECT *, a >= lag(a) OVER (PARTITION BY codec ORDER BY config) AS up FROM t) GROUP BY codec", "samples", t=_ALONG))
def w14(spark, d):
    return evidence.monotone(_along(spark, d), "codec", "config", "a")


@query("w14_crossings", sql("SELECT codec, count(*) FILTER (WHERE flip) AS crossings, min(config) FILTER (WHERE flip) AS first_at FROM (SELECT *, (a > b) <> lag(a > b) OVER (PARTITION BY codec ORDER BY config) AS flip FROM t) GROUP BY codec", "samples", t=_ALONG))
def w14b(spark, d):
    return evidence.crossings(_along(spark, d), "codec", "config", "a", "b")


@query("f11_cohort", "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'Supplier#%' AND s_acctbal > 0 AND (s_suppkey, s_nationkey) IN (SELECT (c_custkey, c_nationkey % 5 + s.s_nationkey - s.s_nationkey % 5) FROM customer JOIN supplier s ON s.s_suppkey = c_custkey) ORDER BY s_suppkey LIMIT 10")
def f11(spark, d):
    """The first ten listed rows that are eligible and exist locally with the same identity."""
    listed = table(spark, d, "supplier").filter("s_name like 'Supplier#%' and s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey")
    own = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"))
    local = table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("s_suppkey")).select("s_suppkey", (F.col("c_nationkey") % 5 + F.col("n") - F.col("n") % 5).alias("s_nationkey"))
    return evidence.cohort(listed, local, ["s_suppkey", "s_nationkey"], "s_suppkey", 10).select("s_suppkey", "s_name")


# Sums and accounts

@query("a09_stream_sums", sql("SELECT codec, stream, CAST(sum(v) AS BIGINT) AS total FROM (SELECT codec, unnest([0, 1, 2, 3]) AS stream, unnest([decoded_bytes, requested_bytes, byte_offset % 100, config]) AS v FROM samples) GROUP BY ALL", "samples"))
def a09(spark, d):
    """A vector of four streams summed by position."""
    four = F.array("decoded_bytes", "requested_bytes", F.col("byte_offset") % 100, "config")
    s = views.samples(spark, d).select("codec", four.alias("v")).groupBy("codec").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(4)]).alias("v"))
    return s.select("codec", F.posexplode("v").alias("stream", "total"))


@query("a13_group_ratios", sql("SELECT a.codec, a.g, count(*) AS files, round(CAST(sum(a.i) AS DOUBLE) / sum(a.s), 9) AS ratio, round(CAST(sum(a.s) AS DOUBLE) / sum(b.s), 9) AS size_vs_base, count(*) FILTER (WHERE a.s < b.s) AS wins FROM t a JOIN t b ON a.g = b.g AND a.file = b.file AND b.codec = 'NO' AND a.codec <> 'NO' GROUP BY a.codec, a.g", "archives", t="SELECT codec, g, file, CAST(sum(input_bytes) AS BIGINT) AS i, CAST(sum(archive_bytes) AS BIGINT) AS s FROM archives GROUP BY codec, g, file"))
def a13(spark, d):
    t = views.archives(spark, d).groupBy("codec", "g", "file").agg(F.sum("input_bytes").alias("i"), F.sum("archive_bytes").alias("s"))
    base = t.filter("codec = 'NO'").select("g", "file", F.col("s").alias("b"))
    met = t.filter("codec <> 'NO'").join(base, ["g", "file"]).groupBy("codec", "g")
    return met.agg(F.count("*").alias("files"), r9(F.sum("i") / F.sum("s")).alias("ratio"), r9(F.sum("s") / F.sum("b")).alias("size_vs_base"), F.count_if(F.col("s") < F.col("b")).alias("wins"))


@query("a16_saved_bytes", sql("SELECT codec, old_meta - new_meta AS saved_meta, old_stream - new_stream AS saved_stream, old_meta + old_stream - new_meta - new_stream AS saved FROM (SELECT codec, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE g {op} 262144), 0) AS BIGINT) AS {side}_{n}" for side, op in (("old", "<="), ("new", ">")) for n, c in (("meta", "index_bytes"), ("stream", "archive_bytes"))) + " FROM archives GROUP BY codec)", "archives"))
def a16(spark, d):
    """Bytes saved, in metadata and in streams; the parts must make the whole."""
    of = lambda c, keep: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0))
    small = F.col("g") <= 262144
    s = views.archives(spark, d).groupBy("codec").agg((of("index_bytes", small) - of("index_bytes", ~small)).alias("saved_meta"), (of("archive_bytes", small) - of("archive_bytes", ~small)).alias("saved_stream"), (of("archive_bytes", small) + of("index_bytes", small)).alias("old"), (of("archive_bytes", ~small) + of("index_bytes", ~small)).alias("new"))
    saved = F.col("old") - F.col("new")
    whole = F.when(saved == F.col("saved_meta") + F.col("saved_stream"), saved).otherwise(F.raise_error(F.lit("saved parts do not make the whole")).cast("long"))
    return s.select("codec", "saved_meta", "saved_stream", whole.alias("saved"))


@query("a21_elapsed", sql("SELECT codec, pass, CAST(sum(CAST(floor(latency_ms * 1000) AS BIGINT)) AS BIGINT) / 1000000.0::DOUBLE AS seconds FROM samples GROUP BY codec, pass", "samples"))
def a21(spark, d):
    """Elapsed whole units are summed before they become seconds."""
    return views.samples(spark, d).groupBy("codec", "pass").agg((F.sum(F.floor(F.col("latency_ms") * 1000)) / 1000000).alias("seconds"))


@query("a27_decode_speed", sql("SELECT codec, round(1000000 / median(wall_ms), 6) AS d_q, round(0.5 - 100 / (1000000 / median(wall_ms)), 9) AS c0 FROM decodes WHERE repeat >= 3 GROUP BY codec", "decodes"))
def a27(spark, d):
    """Speed from the timed decodes alone (A-27), and the constant that remains of a probe of 0.5 at Q = 100 (A-26)."""
    speed = 1000000 / F.col("median")
    return quantile.averaged_median(views.decodes(spark, d).filter("repeat >= 3"), ["codec"], "wall_ms").select("codec", F.round(speed, 6).alias("d_q"), r9(0.5 - 100 / speed).alias("c0"))


@query("a33_attempts", sql("SELECT codec, repeat AS slot, count(*) AS attempts, count(*) - 1 AS retries FROM decodes GROUP BY codec, repeat", "decodes"))
def a33(spark, d):
    return views.decodes(spark, d).groupBy("codec", F.col("repeat").alias("slot")).agg(F.count("*").alias("attempts"), (F.count("*") - 1).alias("retries"))


@query("a34_suite_totals", sql("SELECT g, count(*) AS rows, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(archive_bytes + index_bytes) AS BIGINT) AS stored_bytes FROM archives GROUP BY ROLLUP (g)", "archives"))
def a34(spark, d):
    return views.archives(spark, d).rollup("g").agg(F.count("*").alias("rows"), F.sum("input_bytes").alias("input_bytes"), F.sum(F.col("archive_bytes") + F.col("index_bytes")).alias("stored_bytes"))


@query("a36_disk_budget", sql("SELECT codec, need, greatest(need - 20000000, 0) AS shortfall FROM (SELECT codec, CAST(sum(archive_bytes + index_bytes) // 100 AS BIGINT) AS need FROM archives GROUP BY codec)", "archives"))
def a36(spark, d):
    n = views.archives(spark, d).groupBy("codec").agg(F.sum(F.col("archive_bytes") + F.col("index_bytes")).alias("s")).select("codec", F.expr("s div 100").alias("need"))
    return n.withColumn("shortfall", evidence.shortfall(F.col("need"), 20000000))


_COUNTERS = "SELECT codec, config, CASE query % 4 WHEN 0 THEN 'real_n' WHEN 1 THEN 'real_0' WHEN 2 THEN 'stub_n' ELSE 'stub_0' END AS part, CASE WHEN config = 3 AND query % 40 = 3 THEN NULL ELSE byte_offset % 1000 END AS instructions, decoded_bytes AS cycles FROM samples"


@query("p12_pmu_adjusted", sql("SELECT codec, config, i AS instructions, c AS cycles, round(i / nullif(c, 0), 9) AS ipc FROM (SELECT codec, config, " + ", ".join("((" + ") - (".join(" - ".join(f"CASE WHEN count(*) FILTER (WHERE part = '{p}' AND {v} IS NULL) = 0 THEN CAST(sum({v}) FILTER (WHERE part = '{p}') AS BIGINT) END" for p in pair) for pair in (("real_n", "real_0"), ("stub_n", "stub_0"))) + f")) / 200.0::DOUBLE AS {n}" for v, n in (("instructions", "i"), ("cycles", "c"))) + " FROM t GROUP BY codec, config)", "samples", t=_COUNTERS))
def p12(spark, d):
    q = F.col("query") % 4
    part = F.when(q == 0, "real_n").when(q == 1, "real_0").when(q == 2, "stub_n").otherwise("stub_0")
    c = views.samples(spark, d).select("codec", "config", part.alias("part"), F.when(~((F.col("config") == 3) & (F.col("query") % 40 == 3)), F.col("byte_offset") % 1000).alias("instructions"), F.col("decoded_bytes").alias("cycles"))
    p = evidence.pmu_adjusted(c, ["codec", "config"], "part", ["instructions", "cycles"], 200)
    return p.withColumn("ipc", r9(F.col("instructions") / F.nullif("cycles", F.lit(0))))


# Run against run

_RUNS = "SELECT codec, repeat, median(wall_ms) AS m FROM decodes GROUP BY codec, repeat"


@query("f10_calibrated_tolerance", sql("SELECT codec, round(n / o - 1, 9) AS change, round(s, 9) AS spread, abs(n / o - 1) <= greatest(0.1, 2 * s) AS inside FROM (SELECT codec, median(m) FILTER (WHERE repeat < 5) AS o, median(m) FILTER (WHERE repeat >= 5) AS n, max(m) FILTER (WHERE repeat < 5) / min(m) FILTER (WHERE repeat < 5) - 1 AS s FROM t GROUP BY codec)", "decodes", t=_RUNS))
def f10(spark, d):
    """The spread of calibration runs is (max - min) / min of their medians (A-37)."""
    t = views.decodes(spark, d).groupBy("codec", "repeat").agg(F.median("wall_ms").alias("m"))
    early, late = F.when(F.col("repeat") < 5, F.col("m")), F.when(F.col("repeat") >= 5, F.col("m"))
    s = t.groupBy("codec").agg((F.median(late) / F.median(early) - 1).alias("change"), (F.max(early) / F.min(early) - 1).alias("spread"))
    return s.select("codec", r9("change").alias("change"), r9("spread").alias("spread"), evidence.within_tolerance(F.col("change"), F.col("spread")).alias("inside"))


@query("f09_prediction_hits", sql("SELECT file, round(q, 9) AS q, q BETWEEN 1.2 AND 1.6 AS hit FROM (SELECT file, CAST(max(point_bytes) AS DOUBLE) / min(point_bytes) - 1 AS q FROM curve GROUP BY file)", "curve"))
def f09(spark, d):
    q = F.max("point_bytes") / F.min("point_bytes") - 1
    return views.curve(spark, d).groupBy("file").agg(q.alias("q")).select("file", r9("q").alias("q"), F.col("q").between(1.2, 1.6).alias("hit"))


@query("j15_gates", sql("SELECT codec, g, o.m AS old, n.m AS new, round(CAST(n.m AS DOUBLE) / o.m - 1, 9) AS change, CASE WHEN n.m IS NULL THEN 'missing' WHEN o.m IS NULL THEN 'extra' ELSE 'both' END AS side FROM o FULL JOIN n USING (codec, g)", "archives", o="SELECT codec, g, CAST(sum(archive_bytes) AS BIGINT) AS m FROM archives WHERE file % 2 = 0 AND g > 4096 GROUP BY codec, g", n="SELECT codec, g, CAST(sum(archive_bytes) AS BIGINT) AS m FROM archives WHERE file % 2 = 1 AND g < 10000000 GROUP BY codec, g"))
def j15(spark, d):
    """An old run against a new one by codec and granularity; keys of one side stay visible."""
    m = lambda where: views.archives(spark, d).filter(where).groupBy("codec", "g").agg(F.sum("archive_bytes").alias("m"))
    return evidence.compared(m("file % 2 = 0 and g > 4096"), m("file % 2 = 1 and g < 10000000"), ["codec", "g"], "m").withColumn("change", r9("change"))


_MAP = [("p50_old", "latency_ms"), ("decoded_old", "decoded_bytes")]


@query("j16_mapped_metrics", sql("SELECT codec, new_name AS metric, o.v AS old, n.v AS new, o.v = n.v AS same FROM (SELECT codec, unnest(['p50_old', 'decoded_old']) AS name, unnest([max(latency_ms), max(decoded_bytes)::DOUBLE]) AS v FROM samples WHERE pass = 0 GROUP BY codec) o JOIN (VALUES ('p50_old', 'latency_ms'), ('decoded_old', 'decoded_bytes')) m(old_name, new_name) ON o.name = old_name JOIN (SELECT codec, unnest(['latency_ms', 'decoded_bytes']) AS name, unnest([max(latency_ms), max(decoded_bytes)::DOUBLE]) AS v FROM samples WHERE pass = 1 GROUP BY codec) n USING (codec) WHERE n.name = new_name", "samples"))
def j16(spark, d):
    """Historical metrics met with fresh ones of another name, through a small table of names."""
    def long(p, names):
        wide = views.samples(spark, d).filter(F.col("pass") == p).groupBy("codec").agg(F.max("latency_ms").alias(names[0]), F.max("decoded_bytes").cast("double").alias(names[1]))
        return wide.unpivot(["codec"], names, "name", "v")

    names = spark.createDataFrame(_MAP, "name string, metric string")
    old = long(0, [a for a, _ in _MAP]).join(F.broadcast(names), "name").select("codec", "metric", F.col("v").alias("old"))
    new = long(1, [b for _, b in _MAP]).select("codec", F.col("name").alias("metric"), F.col("v").alias("new"))
    return old.join(new, ["codec", "metric"]).withColumn("same", F.col("old") == F.col("new"))


@query("j17_resolved_refs", "SELECT doc_id, path FROM (SELECT doc_id, length(text) AS b, sha256(text) AS s, concat(source, '/', doc_id, '.txt') AS ref FROM documents) JOIN (SELECT length(text) AS b, sha256(text) AS s, concat('evidence/', source, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END, '/', doc_id, '.txt') AS path FROM documents) USING (b, s) WHERE ends_with(path, '/' || ref)")
def j17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    name = F.concat(F.col("doc_id"), F.lit(".txt"))
    refs = docs.select("doc_id", "bytes", "sha256", F.concat("source", F.lit("/"), name).alias("ref"))
    held = docs.select("bytes", "sha256", F.concat(F.lit("evidence/"), "source", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), F.lit("/"), name).alias("path"))
    return evidence.resolved(refs, held).select("doc_id", "path")


@query("j18_ledger", sql("SELECT codec, config, CAST(sum(n) AS BIGINT) AS lacking FROM (SELECT codec, config, 1 AS n FROM samples WHERE pass <> 0 UNION ALL SELECT codec, config, -1 FROM samples WHERE pass <> 1) GROUP BY codec, config HAVING sum(n) <> 0", "samples"))
def j18(spark, d):
    s = views.samples(spark, d)
    return evidence.ledger_difference(s.filter("pass <> 0"), s.filter("pass <> 1"), ["codec", "config"])


@query("j19_frozen_order", "SELECT doc_id AS ordinal, quality, length(text) AS n, sha256(text) AS truth FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def j19(spark, d):
    """Requests, the selection and the truth; the order that was frozen stays as a column."""
    chosen = table(spark, d, "labels").filter("quality = 1").select("doc_id", "quality")
    return table(spark, d, "documents").join(chosen, "doc_id").select(F.col("doc_id").alias("ordinal"), "quality", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("truth"))


@query("j20_equal_of_total", "SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE md5(text) = md5(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END)) AS equal FROM documents GROUP BY lang, source")
def j20(spark, d):
    t = table(spark, d, "documents")
    mine, prepared = t.select("doc_id", "lang", "source", F.md5("text").alias("a")), t.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("b"))
    return mine.join(prepared, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("total"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


@query("j21_mismatches", "SELECT o_orderkey, o_custkey AS recorded, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey + (c_custkey % 11 = 0)::INT END AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey IS DISTINCT FROM CASE WHEN c_custkey % 7 <> 0 THEN c_custkey + (c_custkey % 11 = 0)::INT END")
def j21(spark, d):
    """Records whose file differs or is not there."""
    k = F.col("c_custkey")
    files = table(spark, d, "customer").select(k, F.when(k % 7 != 0, k + (k % 11 == 0).cast("int")).alias("found"))
    met = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("recorded")).join(files, F.col("recorded") == k, "left")
    return met.filter(~F.col("recorded").eqNullSafe(F.col("found"))).select("o_orderkey", "recorded", "found")


@query("j22_answers_by_position", "SELECT p_partkey, CAST(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i] = b[i], false))) AS BIGINT) AS agreed, CAST(greatest(len(a), len(b)) AS BIGINT) AS total FROM (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' X' END, ' ') AS b FROM part)")
def j22(spark, d):
    a, b = F.split("p_type", " "), F.split(F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" X"))), " ")
    agreed, total = evidence.agreement(a, b)
    return table(spark, d, "part").select("p_partkey", agreed.alias("agreed"), total.alias("total"))


# Growth, mutations, verdicts

@query("g09_growth", sql("SELECT codec, copies, count(*) AS n, CAST(sum(copies * 1000) AS BIGINT) AS bytes FROM (SELECT codec, unnest([1, 2, 4, 8]) AS copies FROM archives) GROUP BY ALL", "archives"))
def g09(spark, d):
    """Corpora of 1, 2, 4 and 8 copies; sizes scale without the copies being made."""
    n = views.archives(spark, d).groupBy("codec").agg(F.count("*").alias("n"))
    return n.select("codec", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("copies"), "n").withColumn("bytes", F.col("n") * F.col("copies") * 1000)


@query("g08_one_bit_plan", sql("SELECT unit_id, k AS case_id, CAST(('0x' || substr(s, 1, 16))::UBIGINT::HUGEINT * ulen // 18446744073709551616::HUGEINT AS BIGINT) AS byte_at, CAST(('0x' || substr(s, 17, 2))::BIGINT % 8 AS BIGINT) AS bit FROM units, (SELECT k, sha256(concat('axis5:20261003:', k)) AS s FROM (SELECT unnest(range(100)) AS k)) WHERE ulen > 0", "units"))
def g08(spark, d):
    """A hundred one-bit corruptions of every unit."""
    return generators.one_bit_plan(views.units(spark, d).filter("ulen > 0"), "ulen").drop("ulen")


_ENTRIES = "SELECT config, concat('f', id % 6) AS family, CASE WHEN id % 6 = 0 THEN CASE WHEN id % 12 = 0 THEN 'q4k' ELSE 'q16k' END END AS variant, CASE WHEN config = 1 AND id % 97 = 0 THEN 'FAILED' ELSE 'PASS' END AS data_status, CASE WHEN config = 2 AND id % 89 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT query AS id, config FROM samples WHERE config <> 4 OR query % 6 < 4)"


@query("a30_aggregate_verdict", sql("SELECT config, f AS foreign_families, f >= 4 AND o = 2 AS covered, CASE WHEN v THEN 'PASS' ELSE 'FAILED' END AS data_status, CASE WHEN f >= 4 AND o = 2 AND v AND p THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT config, count(DISTINCT family) FILTER (WHERE family <> 'f0' AND data_status = 'PASS') AS f, count(DISTINCT variant) FILTER (WHERE family = 'f0' AND variant IN ('q4k', 'q16k')) AS o, bool_and(data_status = 'PASS') AS v, bool_and(verdict = 'PASS') AS p FROM e GROUP BY config)", "samples", e=_ENTRIES))
def a30(spark, d):
    i, c = F.col("query"), F.col("config")
    e = views.samples(spark, d).filter((c != 4) | (i % 6 < 4)).select(
        "config", F.concat(F.lit("f"), i % 6).alias("family"), F.when(i % 12 == 0, "q4k").when(i % 6 == 0, "q16k").alias("variant"),
        F.when((c == 1) & (i % 97 == 0), "FAILED").otherwise("PASS").alias("data_status"), F.when((c == 2) & (i % 89 == 0), "FAIL").otherwise("PASS").alias("verdict"),
    )
    return evidence.aggregate_verdict(e, ["config"], F.col("family") != "f0", F.col("family") == "f0", ["q4k", "q16k"])


@query("a32_deploy_gate", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS measured, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) > 0 AS deploy FROM orders")
def a32(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.lit("real").alias("mode"))
    return evidence.deploy_gate(o, F.col("mode"), ["F", "P"])


@query("v13_quantile_order", sql("SELECT codec, config, p50 <= p95 AND p95 <= p99 AS ordered, n FROM (SELECT codec, config, n, CASE WHEN config = 3 THEN p99 ELSE p50 END AS p50, p95, p99 FROM (SELECT codec, config, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM samples GROUP BY codec, config))", "samples"))
def v13(spark, d):
    """Recorded quantiles must be in order; the record of config 3 has its p99 for its p50."""
    q = quantile.nearest_rank(views.samples(spark, d), ["codec", "config"], "latency_ms", {"p50": 50, "p95": 95, "p99": 99})
    q = q.withColumn("p50", F.when(F.col("config") == 3, F.col("p99")).otherwise(F.col("p50")))
    return q.select("codec", "config", ((F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))).alias("ordered"), "n")


_POINTS = "SELECT codec, copies, n, v, c, CASE WHEN copies = 2 AND codec LIKE '1%' THEN v * 1.001 ELSE v END AS rv, CASE WHEN copies = 4 AND codec LIKE '2%' THEN c + 0.1 ELSE c END AS rc FROM (SELECT codec, copies, count(*) AS n, copies * 1000 / median(wall_ms) AS v, stddev_pop(copies * 1000 / wall_ms) / avg(copies * 1000 / wall_ms) AS c FROM decodes GROUP BY codec, copies)"
_TAIL = "SELECT codec, count(*) = 3 AND max(v) / min(v) - 1 <= 0.05 AND max(c) <= 0.05 AS p, arg_max(v, copies) AS last FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY copies DESC) AS k FROM t) WHERE k <= 3 GROUP BY codec"


@query("v03_throughput_audit", sql("SELECT codec, copies, 'rate' AS problem FROM t WHERE NOT abs(rv - v) <= 1e-9 * greatest(abs(rv), abs(v)) UNION ALL SELECT codec, copies, 'spread' FROM t WHERE NOT abs(rc - c) <= 1e-9 * greatest(abs(rc), abs(c)) UNION ALL SELECT codec, NULL, 'plateau' FROM z WHERE codec LIKE '3%' UNION ALL SELECT codec, NULL, 'reason' FROM z WHERE NOT p AND codec LIKE '4%'", "decodes", t=_POINTS, z=_TAIL))
def v03(spark, d):
    """Problems of a record of throughput: some rates, a spread, a plateau decision and a reason are recorded wrong."""
    s = views.decodes(spark, d).withColumn("rate", F.col("copies") * 1000 / F.col("wall_ms"))
    wall = quantile.averaged_median(s, ["codec", "copies"], "wall_ms", "wall").drop("n")
    cv = s.groupBy("codec", "copies").agg((F.stddev_pop("rate") / F.avg("rate")).alias("cv"))
    points = wall.join(cv, ["codec", "copies"]).select("codec", "copies", (F.col("copies") * 1000 / F.col("wall")).alias("value"), "cv")
    kind = F.substring("codec", 1, 1)
    noted = points.select("codec", "copies", F.when((F.col("copies") == 2) & (kind == "1"), F.col("value") * 1.001).otherwise(F.col("value")).alias("value"), F.when((F.col("copies") == 4) & (kind == "2"), F.col("cv") + 0.1).otherwise(F.col("cv")).alias("cv"))
    flat = judges.plateau(points, "codec", "copies", "value", "cv")
    headline = flat.select("codec", (F.col("plateau") != (kind == "3")).alias("plateau"), F.when(kind != "4", F.col("reason")).alias("reason"), "value")
    return audits.throughput(points, noted, flat, headline)


@query("v22_matched_blocks", sql("SELECT unit_id, count(*) AS blocks, count(*) FILTER (WHERE nxt IS NOT NULL AND size <> 4096) AS unmatched FROM (SELECT unit_id, size, lead(pos) OVER (PARTITION BY unit_id ORDER BY pos) AS nxt FROM (SELECT unit_id, pos, CASE WHEN unit_id % 9 = 0 AND pos = 0 THEN 4000 ELSE least(4096, ulen - pos) END AS size FROM (SELECT unit_id, ulen, unnest(range(0, ulen, 4096)) AS pos FROM units))) GROUP BY unit_id", "units"))
def v22(spark, d):
    """Blocks of each unit that are not of the stated size, its last one apart; the last is the one with the largest start, so no window."""
    b = views.units(spark, d).filter("ulen > 0").select("unit_id", "ulen", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ulen") - 1, F.lit(4096).cast("long"))).alias("at"))
    b = b.withColumn("size", F.when((F.col("unit_id") % 9 == 0) & (F.col("at") == 0), 4000).otherwise(F.least(F.lit(4096), F.col("ulen") - F.col("at"))))
    odd = F.col("size") != 4096
    last = F.max_by(odd.cast("int"), "at")
    return b.groupBy("unit_id").agg(F.count("*").alias("blocks"), (F.count_if(odd) - last).alias("unmatched"))


# Generators

@query("g01_region_trace", "WITH RECURSIVE r(k, s) AS (SELECT 0, 20260909::HUGEINT UNION ALL SELECT k + 1, (s * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT FROM r WHERE k < 210) SELECT CAST(k - 11 AS BIGINT) AS query, CAST(s % (1000000 - 16384 + 1) AS BIGINT) AS byte_offset FROM r WHERE k > 0 UNION ALL SELECT -12, 0 UNION ALL SELECT -11, 1000000 - 16384")
def g01(spark, d):
    return generators.region_trace(spark, 1000000, 16384)


_MIX = "SELECT i, (20260910::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM range(20000) t(i)"
_MIXED = "SELECT i, xor(z, z >> 31) AS z FROM (SELECT i, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM (SELECT i, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m))"


@query("g02_splitmix_draws", sql("SELECT i, CAST(z % 50000000 AS BIGINT) AS draw, CAST(z >> 11 AS DOUBLE) / 9007199254740992 AS uniform FROM x", m=_MIX, x=_MIXED))
def g02(spark, d):
    return generators.draws(spark, 20000, 50000000)


def _mixed_sql(seed: int, n: int) -> dict[str, str]:
    return {"m": _MIX.replace("20260910", str(seed)).replace("20000", str(n)), "x": _MIXED}


@query("g03_clustered_profile", sql("SELECT r AS i, CAST(a.z % 48935041 AS BIGINT) AS anchor, CAST(a.z % 48935041 + o.z % 1048576 AS BIGINT) AS byte_offset FROM range(5000) t(r) JOIN x a ON a.i = 33 * (r // 32) JOIN x o ON o.i = r + r // 32 + 1", **_mixed_sql(20260912, 6000)))
def g03(spark, d):
    """The clustered profile of an input of 50,000,000 bytes."""
    return generators.clustered(spark, 50000000)


@query("g03_hot_set_profile", sql("SELECT r AS i, block, CAST(block * 16384 + CASE WHEN block = 3050 THEN w.z % (49983616 % 16384 + 1) ELSE w.z % 16384 END AS BIGINT) AS byte_offset FROM range(5000) t(r) CROSS JOIN (SELECT max(first_i) + 1 AS used FROM hot) u JOIN x b ON b.i = used + 2 * r JOIN x w ON w.i = used + 2 * r + 1 JOIN hot ON hot.k = b.z % 64", **_mixed_sql(20260911, 15000), hot="SELECT CAST(block AS BIGINT) AS block, first_i, row_number() OVER (ORDER BY first_i) - 1 AS k FROM (SELECT z % 3051 AS block, min(i) AS first_i FROM x WHERE i < 4096 GROUP BY 1 ORDER BY first_i LIMIT 64)"))
def g03_hot(spark, d):
    return generators.hot_set(spark, 50000000)


@query("g03_uniform_and_sorted", sql("SELECT n, r - 1 AS i, byte_offset, CAST(row_number() OVER (PARTITION BY n ORDER BY byte_offset, r) - 1 AS BIGINT) AS sorted_at FROM (SELECT i + 1 AS r, CAST(z % 49983617 AS BIGINT) AS byte_offset FROM x), (SELECT unnest([100, 600, 2000, 5000]) AS n) WHERE r <= n", **_mixed_sql(20260910, 5000)))
def g03_sizes(spark, d):
    """The uniform profile's prefixes of four sizes, and where each request stands in the sorted profile of that size."""
    rows = generators.draws(spark, generators.REQUESTS, 50000000 - generators.LENGTH + 1).select("i", F.col("draw").alias("byte_offset"))
    rows = rows.withColumn("n", F.explode(F.array(*map(F.lit, (100, 600, 2000, 5000))))).filter("i < n")
    at = F.row_number().over(Window.partitionBy("n").orderBy("byte_offset", "i")) - 1
    return rows.select("n", "i", "byte_offset", at.cast("long").alias("sorted_at"))


# The block store

_BYTES = "SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS size FROM documents WHERE text <> ''"
_WORK = "least(((hi - 1) // 1024 + 1) * 1024, size) - lo // 1024 * 1024"


def _store(spark, d):
    t = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return t, store.encode(t.select(F.col("doc_id").cast("string").alias("corpus"), F.lit(0).cast("long").alias("piece_off"), "bytes"), "zlib", 1024)


@query("b03_region_reads", sql(f"SELECT doc_id AS request_id, sha256(unhex(substr(h, 2 * lo + 1, 2 * (hi - lo)))) AS sha, (hi - 1) // 1024 - lo // 1024 + 1 AS blocks, {_WORK} AS decoded FROM (SELECT *, least(size, lo + 1 + doc_id % 5000) AS hi FROM (SELECT *, doc_id * 7919 % size AS lo FROM t))", t=_BYTES))
def b03(spark, d):
    """A byte range of every text, read through the store that was built of all texts."""
    t, blocks = _store(spark, d)
    asked = t.select(F.col("doc_id").alias("request_id"), F.col("doc_id").cast("string").alias("corpus"), F.length("bytes").cast("long").alias("size")).withColumn("lo", F.col("request_id") * 7919 % F.col("size"))
    asked = asked.withColumn("hi", F.least("size", F.col("lo") + 1 + F.col("request_id") % 5000))
    return store.read(blocks, asked, "zlib", 1024).select("request_id", F.sha2("bytes", 256).alias("sha"), "blocks", "decoded")


@query("b04_full_decode", sql("SELECT doc_id AS request_id, sha256(unhex(h)) AS sha, size AS bytes FROM t", t=_BYTES))
def b04(spark, d):
    t, blocks = _store(spark, d)
    asked = t.select(F.col("doc_id").alias("request_id"), F.col("doc_id").cast("string").alias("corpus"), F.lit(0).cast("long").alias("lo"), F.length("bytes").cast("long").alias("hi"))
    return store.read(blocks, asked, "zlib", 1024).select("request_id", F.sha2("bytes", 256).alias("sha"), F.length("bytes").cast("long").alias("bytes"))


@query("b01_encoded_blocks", sql("SELECT CAST(doc_id AS VARCHAR) AS corpus, (size + 1023) // 1024 AS units, size AS raw, least(size, 1024) AS largest, true AS whole FROM t", t=_BYTES))
def b01(spark, d):
    """Geometry of the blocks that encoding made; stored bytes depend on the compressor and are left out."""
    return store.geometry(_store(spark, d)[1]).select("corpus", "units", "raw", "largest", "whole")
