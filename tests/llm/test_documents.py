"""Operators on documents against brute force, with nulls, empty and very long texts, repeats and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, pii, sharding, simhash

LONG = "lorem ipsum dolor sit amet " * 40_000
PASSAGE = " ".join(f"w{k}" for k in range(30))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today"),
    (3, None), (4, ""), (5, "  \t\n"), (6, LONG), (7, f"before {PASSAGE} after"), (8, f"{PASSAGE.upper()}; tail words here"), (8, f"{PASSAGE.upper()}; tail words here"),
    (9, "one"), (10, "two words"), (11, "naïve Éclair – “quoted” 日本語 ՘x <|endoftext|> \x00 it's 42"), (12, "mail a.b@c.example.com or x@y.zz, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, +1 (555) 123-4567"),
    (13, "IBAN GB82 WEST 1234 5698 7654 32; ssn 123-45-6789; +49 89 1234567 1.2.3.4.5"), (14, "9" * 50_000), (15, "a" * 200_000 + "@b.co"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, source string, fp string, block string, h string, n long, n_chars long, part int"
    return spark.createDataFrame([(i, t, None if i % 3 else f"s{i % 2}", "x", "y", "z", 1, 2, 3) for i, t in TEXTS], schema).repartition(3)


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(i, fingerprint(t)) for i, t in TEXTS]
    near = {i: {i} for i, _ in prints}
    for _ in range(len(prints)):
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 2:
                    near[i] |= near[j]
    assert got == sorted((i, f"{f:016x}", min(near[i])) for i, f in prints)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    probes, found = {i: set() for i in range(3000)}, set()
    for r, k in zip(*simhash._keys(x, True)):
        probes[r].add(k)
    found = {r for r, k in zip(*simhash._keys(y, False)) if k in probes[r]}
    assert len(found) == 3000


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    from tessera.llm.common import Scratch

    got = {r.node: r.root for r in simhash.components(Scratch(spark), edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}


def test_dedup_keeps_one_of_each_group(docs):
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("p", PASSAGE), ("s", "two WORDS"), ("s", "two WORDS"), ("e", ""), ("n", None), ("m", "not anywhere in these")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.matches(docs, items).collect())
    want = []
    for i, t in TEXTS:
        words, hit, names = WORD.findall((t or "").translate(LOWER)), set(), set()
        for name, text in (("p", PASSAGE), ("s", "two words"), ("m", "not anywhere in these")):
            item = WORD.findall(text)
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add(name)
        want.append((i, len(words), len(hit), tuple(sorted(names))))
    assert got == sorted(want)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == sorted(i for i, *_ in TEXTS if i not in (7, 8, 10))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z beta gamma"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    assert {r.doc_id: r.n_hit > 0 for r in decontaminate.matches(docs, items, slop=1).collect()} == {1: True, 2: False, 3: False}


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
}


def base(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, (rx, ok)) in enumerate(BASE.items()) for m in re.finditer(rx, text) if ok(m[0]))


@pytest.mark.parametrize("text", [t or "" for i, t in TEXTS if i not in (6, 14, 15)] + ["a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "+1--------- +12 3456 7890x", "..@.x a@b..c z@q.r.", "4111-1111-1111-1111 0", "x@y.z"])
def test_base_spans(text):
    assert [(s["start"], s["end"], s["kind"]) for s in pii.spans(text) if s["kind"] in pii.BASE] == [(a, b, kind) for a, _, b, kind in base(text)]


def test_pii(docs):
    got = {r.doc_id: [(s["kind"], s["start"]) for s in r.found] for r in pii.find(docs).collect()}
    assert got[3] == got[4] == got[14] == [] and got[15] == [("email", 0)]
    assert [k for k, _ in got[12]] == ["email", "email", "ip", "card", "phone"]
    assert [k for k, _ in got[13]] == ["iban", "ssn", "ip"]  # the number runs on to 16 digits, so there is no phone
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[12].text.startswith("mail <EMAIL> or <EMAIL>, ip <IP>") and clean[12].n_chars == len(clean[12].text)
    assert clean[3].text is None and clean[1].text == TEXTS[0][1]


def test_bpe_matches_the_library(spark, docs):
    t = bpe.load(bpe.VOCABULARY)
    found = bpe.round_trip(docs)
    got = sorted((r.doc_id, r.ids, r.decoded) for r in found.collect())
    assert got == sorted((i, t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in TEXTS)
    some = found.filter("doc_id in (3, 11, 12)")
    assert {r.doc_id: r.text for r in bpe.decode(some).collect()} == {i: x or "" for i, x in TEXTS if i in (3, 11, 12)}


def test_bpe_splits_near_code_points_as_the_library():
    t, split = bpe.load(bpe.VOCABULARY).pre_tokenizer, bpe.splitter(bpe.VOCABULARY)
    for c in map(chr, [*range(0x500), 0x558, 0x3000, 0x1F600]):
        s = f"a{c}1 {c}{c} x\n {c}"
        assert split(s) == [s[a:b] for _, (a, b) in t.pre_tokenize_str(s)], repr(c)


def test_shards(spark):
    rows = [(k, "x" * (k % 5), "hot" if k < 60 else None if k < 75 else "b") for k in range(100)] + [(7, "same", "hot")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    before, sharding.BUCKET = sharding.BUCKET, 10
    try:
        got = sharding.shards(df, 8).collect()
    finally:
        sharding.BUCKET = before
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert len(got) == 103 and all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    hot = {k for k, _, s in rows if s == "hot"}
    assert all(6 <= sum(r.shard == s and r.doc_id in hot for r in got) <= 10 for s in range(8))
    key = lambda i: int(hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest()[:15], 16)
    n = {s: sum(x[2] == s for x in rows) for s in ("hot", None, "b")}
    ranked = [((2 * k + 1) / (2 * n[s]), s or "", i) for s in n for k, i in enumerate(sorted((i for i, _, x in rows if x == s), key=lambda i: (key(i), i)))]
    order = [i for _, _, i in sorted(ranked, key=lambda x: (x[0], x[1]))]
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.dedup, pii.find, pii.redact, bpe.round_trip, sharding.shards])
def test_empty_table(docs, run):
    assert run(docs.filter(F.lit(False))).collect() == []


def test_empty_tables_of_decontamination(spark, docs):
    items = spark.createDataFrame([("p", PASSAGE)], "item_id string, text string")
    assert decontaminate.matches(docs.limit(0), items).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.matches(docs, items.limit(0)).collect())
