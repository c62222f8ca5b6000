"""Decontamination with many slices and blocks, equal hashes of different words, and very many windows."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate

WORDS = [f"w{k}" for k in range(40)]


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(f"i{k}", text(rng.randint(0, 20))) for k in range(30)] + [("i3", text(15)), (None, "w1 w2"), ("n", None)]
    docs = [(k, text(rng.randint(0, 60)) + " " + (items[k % 30][1] if k % 2 else "")) for k in range(60)] + [(None, items[5][1]), (1, None), (1, "")]
    return docs, items


def plain(docs, items, size):
    out = []
    for i, text in docs:
        words, hit, names = (text or "").split(), set(), set()
        for name, item in items:
            item = (item or "").split()
            n = min(size, len(item))
            for k in range(len(words) - n + 1 if n else 0):
                if any(words[k : k + n] == item[j : j + n] for j in range(len(item) - n + 1)):
                    hit.update(range(k, k + n))
                    names.add(name)
        out.append((i, len(words), len(hit), sorted(x for x in names if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("windows, block", [(7, 200), (200_000, 200), (7, 1 << 20)])
def test_slices_and_blocks(spark, monkeypatch, windows, block):
    monkeypatch.setattr(decontaminate, "WINDOWS", windows)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = corpus(windows + block)
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string"), size=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, [x for x in r["items"] if x is not None]) for r in got), key=str) == plain(docs, items, 3)


def table(windows):
    """Windows whose terms stand from the rarest, as they come from the ordered table."""
    at = [sorted(range(len(w)), key=lambda k: -hash_of(w[k])) for w in windows]
    return pa.table({"ats": pa.array([list(a) for a in at], pa.list_(pa.int32())), "terms": pa.array([[hash_of(w[k]) for k in a] for w, a in zip(windows, at)], pa.list_(pa.int64())), "words": [[w[k] for k in a] for w, a in zip(windows, at)], "items": [[f"i{n}"] for n in range(len(windows))]})


def hash_of(word):
    return int(word[1:])


def block_of(words):
    terms = sorted({hash_of(w) for w in words})
    lists = [[k for k, w in enumerate(words) if hash_of(w) == t] for t in terms]
    deltas = np.concatenate([np.diff(x, prepend=0) for x in lists])
    return np.array(terms), pa.array([next(w for w in words if hash_of(w) == t) for t in terms]), np.array([len(x) for x in lists]), deltas


def test_equal_hashes_of_different_words_do_not_match():
    tests = decontaminate.Windows(table([["a1", "b2", "a3"]]))
    assert [s for s, _ in tests.find(*block_of(["x7", "a1", "b2", "a3"]), 0)] == [1]
    assert list(tests.find(*block_of(["x7", "a1", "c2", "a3"]), 0)) == []


def test_cost_of_a_block_hardly_grows_with_the_windows():
    rng = random.Random(3)
    some = block_of([f"w{rng.randint(0, 3000)}" for _ in range(30_000)])
    took = []
    for n in (1000, 100_000):
        tests = decontaminate.Windows(table([[f"w{rng.randint(0, 3_000_000)}" for _ in range(13)] for _ in range(n)]))
        began = time.process_time()
        for _ in range(5):
            assert list(tests.find(*some, 0)) == []
        took.append(time.process_time() - began)
    assert took[1] < 0.2 + 5 * took[0]
