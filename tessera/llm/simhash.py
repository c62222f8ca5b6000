"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments (22, 21 and 21 bits), each a vector of the perfect binary Golay code
[23, 12, 7]. Two fingerprints that differ in at most two bits agree exactly in one segment i, and differ by at most
one bit in another segment j (pigeonhole over the two errors). For a vector x of segment j, let c(x) be the codeword
it decodes to, at most 3 bits away. If y differs from x by one bit, c(y) is at most 4 bits from x. So every
fingerprint is indexed under (i, segment i, c(segment j)) and looked up under the one to six codewords at most 4 bits
from segment j, for the six ordered pairs (i, j): an equi-join on keys of 33 to 34 bits that misses no pair. XOR and
bit_count then verify each candidate.

Exact copies share a fingerprint and count as one node, so a group of copies makes no pairs. Components come from
alternating large-star and small-star steps on the links, written to the shared folder after each round.

Defined results: null or wordless text has fingerprint zero, linked like any other; repeated rows each get a row;
an empty table gives no rows; other columns, whatever their names, pass through dedup() and are ignored elsewhere.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Shift and width of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the Golay code (fixed value).
GOLAY = 0xC75


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: only A-Z and the six ASCII space characters
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text in slices
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    found = [fingerprint(t.as_py()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", fingerprint_of(docs["text"]).alias("fp"))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit vectors by the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def error_patterns() -> np.ndarray:
    """By syndrome: the pattern of weight 3 or less first, then those of weight 4; -1 where there are fewer than six."""
    near = np.array([sum(1 << bit for bit in bits) for weight in range(5) for bits in combinations(range(23), weight)])
    at = _syndromes(near)
    out = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    order = np.argsort(at, kind="stable")
    for s, p in zip(at[order].tolist(), near[order].tolist()):
        out[s, used[s]] = p
        used[s] += 1
    return out


def _keys(fps: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and join keys: one codeword of each fuzzy segment, or (wide) all within 4 bits."""
    patterns, rows, keys = error_patterns(), [], []
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    for j, x in enumerate(parts):
        near = patterns[_syndromes(x)][:, : 6 if wide else 1]
        row, col = np.nonzero(near >= 0)
        message = (x[row] ^ near[row, col]) >> 11
        for i in range(3):
            if i != j:
                rows.append(row)
                keys.append(((i * 3 + j) << 34) | (parts[i][row] << 12) | message)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, wide: bool) -> DataFrame:
    name = "probe" if wide else "node"

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                rows, keys = _keys(part.view(np.uint64), wide)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", name])

    return nodes.select("fp").mapInArrow(run, f"key long, {name} long")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints at most two bits apart. nodes: one row per fingerprint in fp."""
    found = _keyed(nodes, True).join(_keyed(nodes, False), "key").filter("probe < node")
    return found.filter(F.bit_count(F.col("probe").bitwiseXOR(F.col("node"))) <= MAX_BITS).select(F.col("probe").alias("a"), F.col("node").alias("b")).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, root for every node with a link; root is the smallest node it reaches.

    Large-star links each node's larger neighbours to its smallest, small-star its smaller ones, until each node
    points straight at its root. A round is two grouped minima, each joined back; no neighbour list is built.
    """
    now, seen = scratch.cut(edges), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b")
        after = scratch.cut(small.unionByName(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def _rooted(scratch: Scratch, fps: DataFrame, first: Column) -> DataFrame:
    """fp, root of its component and first (an aggregate over the rows of fp) of every fingerprint."""
    nodes = scratch.cut(fps.groupBy("fp").agg(first.alias("first")))
    roots = components(scratch, links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return scratch.cut(named)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, component_id) of every fingerprint."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.cut(fingerprints(docs))
    named = _rooted(scratch, fps, F.min("doc_id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps, named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    fps, groups = _grouped(docs)
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id (null after all others), one of them if several rows have it.

    Rows are told apart by a number of their own, so texts that share a doc_id, or have none, stay if their components differ.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows, row = scratch.numbered(docs)
    fps = scratch.cut(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("place"), fingerprint_of(rows["text"]).alias("fp")))
    keep = _rooted(scratch, fps, F.min("place")).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept"))
    return rows.join(keep, rows[row] == keep["kept"], "left_semi").drop(row)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
