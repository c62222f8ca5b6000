"""Benchmark decontamination by a positional inverted index over training documents.

Documents are indexed in blocks of some megabytes. A row of the index is one block: its documents' bounds, every term that
a test item could ask for with its word, and the postings, which are the term's positions in the block. (A bit set of fixed
size, made from the test terms, keeps other terms out; its false positives only cost space.) The index is a written table.

Collection frequencies of its terms order the terms of each test window from the rarest, and windows are keyed by it. In a
block only windows whose rarest term the block has are looked at, then those whose terms it has all; of these the position
lists, shifted by the term's offset in the window, are intersected from the rarest until empty or until the whole window is
matched. slop > 0 lets each term stand that far from its place (proximity matches); 0 asks for exact phrases. Terms are
found by 64-bit hashes and count only where the words are equal.

Test windows go to the tasks in slices of at most about WINDOWS, one pass over the index and a written table a slice, so
what the driver and a task hold has a fixed bound whatever the size of the benchmark. A block is bounded by BLOCK or one document.

Defined results: null and wordless texts have no words and are not contaminated; a wordless item has no window; repeated
items count once by item_id; repeated documents each get a row; other columns are ignored by matches() and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .textblocks import LOWER, Hasher, bounds, chunks, owners

WINDOW, SHARE = 13, 20
#: Bytes of text in a block.
BLOCK = 1 << 20
#: Test windows held by a task at once.
WINDOWS = 200_000
#: A term's frequency goes to that many parts of the windows that have it, as some terms are in most of them.
SALTS = 16
#: Bits of the set that keeps terms no test asks for out of the index.
BITS = 1 << 23
#: Unused positions between documents; more than a window and its slop.
GAP = 256
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _terms(texts: pa.Array, limit: int = 1 << 20):
    """(first row, rows, row of each word, hash of each word, words by number) by chunks of texts."""
    for first, n, data, off in chunks(texts, limit):
        data = LOWER[data]
        starts, ends = bounds(data, off, _WORD)

        def words(of, data=data, starts=starts, ends=ends):
            raw = data.tobytes()
            return [raw[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist())]

        yield first, n, owners(starts, off), Hasher(data)(starts, ends), words


def _item_terms(batches):
    for batch in batches:
        for first, n, rows, hashes, words in _terms(batch.column(1)):
            cut = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(words(np.arange(len(rows))), pa.binary()).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *lists], ["item_id", "terms", "words"])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (string), window (hash of its words), terms and words of every window."""
    found = items.select(F.col("item_id").cast("string"), "text").mapInArrow(_item_terms, "item_id string, terms array<long>, words array<string>")
    found = found.filter(F.size("terms") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("terms") - size, F.lit(0)))))
    found = found.select("item_id", *[F.slice(c, F.col("at") + 1, size).alias(c) for c in ("terms", "words")])
    return found.withColumn("window", F.xxhash64("words")).distinct()


def _bit_set(tests: DataFrame) -> np.ndarray:
    at = F.explode("terms").alias("term")
    rows = tests.select(at).select((F.col("term").bitwiseAND(BITS - 1)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word"))
    out = np.zeros(BITS // 64, np.uint64)
    for r in rows.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect():  # at most BITS / 64 rows
        out[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


_INDEX = "block string, doc_ids array<long>, firsts array<long>, sizes array<long>, terms array<long>, words array<string>, counts array<long>, positions binary"


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """A row for each block: its documents, its terms and their positions (deltas, term after term)."""
    # Positions count the block's words, with GAP unused places between documents, so that no window spans two.

    def run(batches):
        nth = 0
        for batch in batches:
            for first, n, rows, hashes, words in _terms(batch.column(1), BLOCK):
                sizes = np.bincount(rows, minlength=n)
                firsts = np.cumsum(sizes) - sizes + GAP * np.arange(n)
                bit = hashes & np.uint64(BITS - 1)
                kept = np.flatnonzero(wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                order = kept[np.argsort(hashes[kept].view(np.int64), kind="stable")]
                terms, cut = np.unique(hashes[order].view(np.int64), return_index=True)
                at = order + GAP * rows[order]
                delta = np.diff(at, prepend=0)
                delta[cut] = at[cut]
                name, nth = f"{TaskContext.get().partitionId()}-{nth}", nth + 1
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), one(batch.column(0).slice(first, n), pa.int64()), one(firsts, pa.int64()), one(sizes, pa.int64()), one(terms, pa.int64()),
                     one(pa.array(words(order[cut]), pa.binary()).cast(pa.string()), pa.string()), one(np.diff(cut, append=len(at)), pa.int64()), pa.array([delta.astype("<u4").tobytes()], pa.binary())],
                    ["block", "doc_ids", "firsts", "sizes", "terms", "words", "counts", "positions"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)


def _ordered(tests: DataFrame, found: DataFrame) -> DataFrame:
    """window, items and its (offset, term, word) from the rarest; windows with a term that no document has are gone."""
    frequency = found.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    frequency = frequency.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = tests.groupBy("window").agg(F.first(F.arrays_zip("terms", "words")).alias("terms"), F.collect_set("item_id").alias("items"))
    spread = each.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "x")).select("window", "size", "at", F.col("x.terms").alias("term"), F.col("x.words").alias("word"))
    spread = spread.withColumn("salt", F.pmod("window", F.lit(SALTS)).cast("int")).join(frequency, ["term", "salt"])
    rare = spread.groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term", "word"))).alias("rare")).filter(F.size("rare") == F.col("size"))
    return rare.join(each.select("window", "items"), "window").select("window", "items", *[F.expr(f"transform(rare, x -> x.{c})").alias(f"{c}s") for c in ("at", "term", "word")])


def aligned(starts: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
    """The starts that have a position at most slop away."""
    if not len(positions) or not len(starts):
        return starts[:0]
    k = np.searchsorted(positions, starts - slop)
    return starts[(k < len(positions)) & (positions[np.minimum(k, len(positions) - 1)] <= starts + slop)]


class Windows:
    """A slice of test windows as arrays: by rarest term, with their terms as numbers of a sorted vocabulary."""

    def __init__(self, rows: pa.Table):
        lists = {c: rows.column(c).combine_chunks() for c in ("ats", "terms", "words", "items")}
        flat = lists["terms"].flatten().to_numpy()
        self.vocabulary, first, number = np.unique(flat, return_index=True, return_inverse=True)
        self.words = lists["words"].flatten().take(pa.array(first))
        size = lists["terms"].value_lengths().to_numpy().astype(np.int64)
        end = np.cumsum(size)
        order = np.argsort(number[end - size], kind="stable") if len(size) else np.zeros(0, np.int64)
        at = (end - size)[order, None] + np.minimum(np.arange(max(size, default=1)), size[order, None] - 1)  # short ones repeat their last term
        self.size, self.terms, self.ats = size[order], number[at].astype(np.int32), lists["ats"].flatten().to_numpy()[at].astype(np.int32)
        self.starts = np.searchsorted(self.terms[:, 0], np.arange(len(self.vocabulary) + 1))
        self.items = lists["items"].take(pa.array(order))

    def find(self, terms: np.ndarray, words: pa.Array, counts: np.ndarray, positions: np.ndarray, slop: int):
        """(start, number of the window) of every match in a block."""
        at = np.searchsorted(self.vocabulary, terms)
        here = np.flatnonzero((at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == terms)) if len(self.vocabulary) else np.zeros(0, np.int64)
        equal = pc.equal(words.take(pa.array(here)), self.words.take(pa.array(at[here]))).to_numpy(zero_copy_only=False).astype(bool)
        here, at = here[equal], at[here[equal]]
        ends = np.cumsum(counts)
        first, last = self.starts[at], self.starts[at + 1]
        some = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum()) if len(at) else np.zeros(0, np.int64)
        slot = dict(zip(at.tolist(), here.tolist()))
        held = np.zeros(len(self.vocabulary) + 1, bool)
        held[at] = True
        for w in some[held[self.terms[some]].all(1)].tolist():
            lists, starts = {}, None
            for t, a in zip(self.terms[w, : self.size[w]].tolist(), self.ats[w, : self.size[w]].tolist()):
                k = slot[t]
                if t not in lists:
                    lists[t] = np.cumsum(positions[ends[k] - counts[k] : ends[k]], dtype=np.int64)
                starts = lists[t] - a if starts is None else aligned(starts, lists[t] - a, slop)
                if not len(starts):
                    break
            for s in starts.tolist():
                yield s, w


def _search(tests: Windows, slop: int):
    """Matches of the windows in each block, by document."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, firsts, sizes, terms, words, counts, positions = (batch.column(c)[k] for c in ("block", "firsts", "sizes", "terms", "words", "counts", "positions"))
                firsts, sizes = firsts.values.to_numpy(), sizes.values.to_numpy()
                hits: dict[int, tuple[set, set]] = {}
                for s, w in tests.find(terms.values.to_numpy(), words.values, counts.values.to_numpy(), np.frombuffer(positions.as_buffer(), "<u4"), slop):
                    d = int(np.searchsorted(firsts, s, "right")) - 1
                    if d >= 0:
                        places, names = hits.setdefault(d, (set(), set()))
                        start = s - int(firsts[d])
                        places.update(range(start, min(start + int(tests.size[w]), int(sizes[d]))))
                        names.add(w)
                rows = [(block.as_py(), d, sorted({i for w in names for i in tests.items[w].as_py()}), sorted(places)) for d, (places, names) in hits.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], ["block", "nth", "items", "places"])

    return run


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a matched window) and items (sorted ids of items with one) of every row."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    tests = scratch.cut(windows(items, size))
    found = scratch.cut(index(docs, _bit_set(tests)), row_group=16 << 20)
    ordered = scratch.cut(_ordered(tests, found))
    slices = -(-ordered.count() // WINDOWS) or 1
    hits = None
    for k in range(slices):
        rows = ordered.filter(F.pmod(F.xxhash64("window"), F.lit(slices)) == k).select("ats", "terms", "words", "items").toArrow()  # about WINDOWS rows
        part = found.mapInArrow(_search(Windows(rows), slop), "block string, nth long, items array<string>, places array<long>")
        part = scratch.cut(part)
        hits = part if hits is None else hits.unionByName(part)
    scratch.drop(tests, ordered)
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  one list for each slice
    hits = hits.groupBy("block", "nth").agg(distinct("items").alias("items"), F.size(distinct("places")).cast("long").alias("n_hit"))
    rows = found.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("nth", "doc"))
    rows = rows.select("block", F.col("nth").cast("long").alias("nth"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.sizes").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits, ["block", "nth"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def judged(found: DataFrame) -> DataFrame:
    return found.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they have. Each row is judged by its own text, whatever its doc_id."""
    rows, row = Scratch(docs.sparkSession).numbered(docs)
    bad = judged(matches(rows.select(F.col(row).alias("doc_id"), "text"), items)).filter("contaminated").select(F.col("doc_id").alias("bad"))
    return rows.join(bad, rows[row] == bad["bad"], "left_anti").drop(row)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
