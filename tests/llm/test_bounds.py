"""Bounds of samples and blocks, classifiers held against plain versions, odd rows of fitted classifiers and the pipeline."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, labelled, quality, toxicity

TEXTS = [None, "", "  ", "One two two, three.\nOne two two, three.\n\nÉcole 日本 !!", "x" * 3000, "a|b #c\tD 42.\r\nline", "word " * 3000]


def test_sample_has_a_row_for_each_id(spark):
    docs = spark.createDataFrame([(k % 3, f"t{k}") for k in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)] + [(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", F.lit(True), 5).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in got) == [(0, "t0", 1), (1, "t1", 1), (2, "t101", 0)]


def plain_statistics(text):
    raw = (text or "").encode()
    n, low = max(len(raw), 1), raw.lower()
    words, lines = low.translate(bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))).split(b" "), low.replace(b"\r", b"\n").split(b"\n")
    words, lines = [w for w in words if w], [x for x in lines if x]
    count, of = Counter(words), max(len(words), 1)
    shares = [sum(raw.count(bytes([c])) for c in set(members)) / n for members in quality.CLASSES.values()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [*shares, math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / of, len(count) / of, again / of, sum(v == 1 for v in count.values()) / of, len(raw) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1)]


def test_statistics_as_counted_plainly():
    assert np.allclose(quality.measure(pa.array(TEXTS)), [plain_statistics(t) for t in TEXTS])


def test_compiled_score_is_the_sum_of_rules(spark):
    rng = np.random.default_rng(2)
    stats = rng.random((60, len(quality.STATISTICS)))
    label = (stats[:, 0] > 0.5) & (stats[:, 3] < 0.6)
    rows = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int")
    model = quality.fit(rows)
    got = [r[0] for r in rows.select(model.column(F.col("stats"))).collect()]
    want = [1 / (1 + math.exp(-model.intercept - sum(w for rule, w in model.rules if all(lo < s[i] <= hi for i, lo, hi in rule.bounds)))) for s in stats]
    assert model.rules and np.allclose(got, want) and np.mean((np.array(got) >= 0.5) == label) > 0.9


def plain_terms(text):
    words = [w for w in bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in (text or "").encode().lower()).split()]
    return {w for w in words} | {(k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) > k}


def test_score_is_the_plain_sum_over_pairs():
    seen = [(row, bucket) for _, _, rows, buckets in [next(toxicity.terms(pa.array(TEXTS)))] for row, bucket in zip(rows.tolist(), buckets.tolist())]
    assert [len({b for r, b in seen if r == k}) for k in range(len(TEXTS))] == [len(plain_terms(t)) for t in TEXTS]
    rng, inputs = np.random.default_rng(1), sorted({b for _, b in seen})[::2]
    model = toxicity.Machine(np.array(inputs), 0.3, rng.normal(size=len(inputs)), rng.normal(0, 0.3, (len(inputs), toxicity.FACTORS)))
    got = model.score(*model.present(np.array([r for r, _ in seen]), np.array([b for _, b in seen])), len(TEXTS))
    for k in range(len(TEXTS)):
        here = [inputs.index(b) for b in sorted({b for r, b in seen if r == k}) if b in inputs]
        z = 0.3 + sum(model.weights[i] for i in here) + sum(model.factors[a] @ model.factors[b] for i, a in enumerate(here) for b in here[:i])
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_fitted_classifier_on_odd_rows(spark, module):
    rows = [(k, "vile idiots!!!! ####" if k % 4 == 0 else f"a calm walk by the river {k}.") for k in range(200)]
    odd = [(None, "vile idiots!!!! ####"), (4, None), (4, "vile idiots!!!! ####"), (4, ""), (901, "calm " * 60_000), (None, None)]
    docs = spark.createDataFrame([(*r, 9, "x", 0.5) for r in rows + odd], "doc_id long, text string, label int, stats string, score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), int(k % 4 == 0), "y") for k in range(200)] * 2, "doc_id long, quality int, toxic int, text string")
    got = module.scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 206
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    bad = 0 if module is quality else 1
    assert all(r.predicted == bad for k in range(8, 200, 4) for r in by[k]) and all(r.predicted == 1 - bad for k in range(1, 200, 4) for r in by[k])
    assert len(by[4]) == 4 and len({r.score for r in by[4]}) == 2 and by[901][0].predicted == 1 - bad and sorted(r.predicted for r in by[None]) in ([0, 1], [bad, bad])


def test_bpe_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 300)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    t = bpe.load(bpe.VOCABULARY)
    rows = [(k, f"Block {k} of it's words <|endoftext|> {'again ' * (k % 7)}日 {k * k}") for k in range(90)] + [(5, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs.coalesce(2), docs.repartition(3)):
        got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.round_trip(frame).collect()), key=str)
        assert got == sorted(((i, t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows), key=str)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    story = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    rows = [(k, story(k)) for k in range(12)] + [(3, story(3)), (None, story(50)), (20, None), (21, ""), (22, None), (23, "long " * 50_000), (24, story(0) + " mail me@x.org")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, block string, _row int"
    spark.createDataFrame([(*r, None, "s", 1, 2, "b", 3) for r in rows], schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", story(5)), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, None, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = p.Scratch(spark).cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), name
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens > 0) for r in p.run(spark, str(tmp_path)).collect())
    want = [(-1, True), *[(k, True) for k in range(12) if k != 5], (20, False), (23, True)]
    assert [x for x in got if x[0] != 24] == want
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/none").collect() == []


def test_bpe_bodies_and_words_unpack_to_what_was_packed():
    rng = np.random.default_rng(5)
    for n, most in ((0, 1), (1, 1), (300, 2), (5000, 254), (5000, 255), (5000, 256), (9000, 4000)):
        drawn = rng.integers(0, most, n)
        number = {}
        body = np.array([number.setdefault(x, len(number)) for x in drawn.tolist()], np.uint32)
        assert (bpe._unpack_body(bpe._pack_body(body)) == body).all()
    every = np.arange(1000, dtype=np.uint32)
    assert (bpe._unpack_body(bpe._pack_body(every)) == every).all()
    for words in ([], [b"a"], [b"", b" \xc3\xa9", b"x" * 70_000, b"\n"]):
        assert bpe._unpack_words(bpe._pack_words(words)) == words
