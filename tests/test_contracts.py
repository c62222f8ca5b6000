"""Contracts between tables, by hand-computed cases."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import contracts, intervals


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_scope_has_exactly_one_row(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "k string, v double")
    w = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    assert rows(contracts.one_each(w, r, ["k"], "v")) == [("a", 1, 1.0, None), ("b", 2, None, "duplicate"), ("c", 0, None, "missing")]


def test_strict_integers_and_windows(spark):
    texts = ["0", "-1", "12", "012", "1.0", "1e3", "true", "", " 1", "1\n", "9" * 30, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(contracts.strict_int(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, -1, 12] + [None] * 9
    w = spark.createDataFrame([(0, 5, 5), (-1, 5, 5), (5, 5, 5), (0, 6, 5), (None, 1, 5)], "s long, e long, n long")
    assert [r[0] for r in w.select(contracts.window_ok(F.col("s"), F.col("e"), F.col("n"))).collect()] == [True, False, False, False, False]


def test_curve_needs_a_baseline_of_the_same_input(spark):
    p = spark.createDataFrame([("f", "h1", 200), ("f", "h2", 200), ("g", "h1", 200)], "file string, input string, bytes long")
    b = spark.createDataFrame([("f", "h1", 150)], "file string, input string, bytes long")
    got = contracts.curve_of(p, b, ["file"]).select("file", "input", "state", "c")
    assert rows(got) == [("f", "h1", "ok", 0.25), ("f", "h2", "other input", None), ("g", "h1", "no baseline", None)]


def test_groups_cover_the_cohort(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b")], "g long, a string")
    assert rows(contracts.uncovered(m, "g", "a")) == [(2, ["a"])]
    assert rows(contracts.uncovered(m.limit(0), "g", "a")) == []


def test_truth_spans_pieces_and_marks_requests_beyond_them(spark):
    text = "acgtéxyz0123456789"
    pieces = spark.createDataFrame([(0, 4, text[:4]), (4, 0, ""), (4, 5, text[4:9]), (9, 9, text[9:])], "uoff long, ulen long, text string")
    asked = spark.createDataFrame([(1, 0, 18), (2, 3, 10), (3, 17, 19), (4, 40, 41), (5, 4, 5)], "request_id long, lo long, hi long")
    sha = lambda a, b: hashlib.sha256(text[a:b].encode()).hexdigest()
    want = [(1, 18, sha(0, 18), True), (2, 7, sha(3, 10), True), (3, 1, None, False), (4, 0, None, False), (5, 1, sha(4, 5), True)]
    assert rows(contracts.truth(asked, pieces)) == want
    by_definition = intervals.overlap_by_definition(asked, pieces).groupBy("request_id").agg(F.sum("take"))
    assert rows(by_definition) == [(k, n) for k, n, _, _ in want if n]


def test_truth_moves_text_once_for_many_requests(spark, monkeypatch):
    """Slices of each request do not pass a shuffle; long and repeated requests, gaps and copies of a stretch count as before."""
    text = "".join(chr(97 + k * k % 23) for k in range(40_000)) + "é日" * 50
    cuts = [0, 1, 1, 9000, 9001, 30_000, len(text)]
    parts = [(a, b - a, text[a:b]) for a, b in zip(cuts, cuts[1:])] + [(50_000, 10, "x" * 10)]
    pieces = spark.createDataFrame(parts, "uoff long, ulen long, text string").repartition(3)
    asked = [(k, 7 * k, 7 * k + 1 + k * 13 % 9000) for k in range(2000)] + [(5000, 0, len(text)), (5001, 4095, 4097), (5002, 4096, 4096 + 4096), (5003, 45_000, 50_005), (5004, 50_000, 50_010), (5005, -5, 3), (5006, 5, 5)]
    twice = [(6000, 10, 20), (6000, 10, 20), (6001, len(text) - 5, len(text) + 5), (6001, len(text) - 5, len(text) + 5), (None, None, None)]
    frame = spark.createDataFrame(asked + twice, "request_id long, lo long, hi long").repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    covered = lambda lo, hi: "".join(t[max(lo - u, 0) : max(hi - u, 0)] for u, _, t in sorted(parts))
    want = []
    for k, lo, hi in asked:
        part = covered(lo, hi)
        want.append((k, len(part), sha(part) if part and len(part) == hi - lo else None, len(part) == hi - lo))
    doubled = "".join(c * 2 for c in [covered(len(text) - 5, len(text))])
    want += [(6000, 20, None, False)] * 2 + [(6001, 10, sha(doubled), True)] * 2 + [(None, 0, None, None)]
    met = []
    monkeypatch.setattr(contracts, "SERVED", 100)
    monkeypatch.setattr(contracts, "overlap", lambda r, p: met.append(r.count()) or intervals.overlap(r, p))
    assert rows(contracts.truth(frame, pieces)) == sorted(want, key=str)
    assert met[0] < 40


def test_kept_prefix(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "at long, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (5, "e")], "at long, v string")
    assert rows(contracts.prefix_kept(old, new, "at")) == [(4, 2, 1, 1, 1)]
    assert rows(contracts.prefix_kept(old.limit(0), new.limit(0), "at")) == [(0, 0, 0, 0, 0)]


def test_breaks_and_kinds(spark):
    b = spark.createDataFrame([(1, 0, 5), (2, 5, 0), (3, 5, 5), (4, 12, 3)], "block_id long, uoff long, ulen long")
    assert rows(contracts.breaks(b)) == [(3, 10), (4, 15)]
    k = spark.createDataFrame([("b",), ("a",), ("b",)], "kind string")
    assert rows(contracts.kinds(k, "kind")) == [("a=1, b=2",)]
    assert rows(contracts.kinds(k.limit(0), "kind")) == [("no rows",)]


def test_batch_audit_names_the_broken_rule(spark):
    good = [("x", "base", 4, 10.0, 1.0, "pass", 2.0), ("x", "own", 4, 5.0, 0.5, "fail", 0.0)]
    bad = [("x", "r", 4, 5.0, 0.6, "fail", 0.0), ("x", "v", 4, 5.0, 0.5, "pass", 0.0), ("x", "e", 4, 5.0, 0.5, "fail", 2.1), ("y", "n", 4, 5.0, 0.5, "fail", None)]
    df = spark.createDataFrame(good + bad, "p string, codec string, n long, value double, relative double, status string, entropy double")
    got = dict(rows(contracts.batch_audit(df, ["p"], F.col("codec") == "base").select("codec", "broken")))
    assert got == {"base": "", "own": "", "r": "relation", "v": "verdict", "e": "entropy", "n": "baseline,relation,entropy"}
