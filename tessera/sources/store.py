"""A block-compressed store as a DataFrame: independently decodable blocks, region reads and batch reads.

A corpus is a table (corpus, piece_off, bytes) of non-overlapping pieces. encode() cuts it at multiples of g and compresses
each block on its own. Reads join requests to the block directory (an equi-join on the block number, since g is fixed),
decode each touched block once, slice it for every request and put the slices together in order.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> (encode a block, decode a block)
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "zlib": (lambda b: zlib.compress(b, 6), zlib.decompress),
    "zstd": (lambda b: zstandard.compress(b, 3), zstandard.decompress),
    "xz": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
    "bz2": (bz2.compress, bz2.decompress),
}


def _coder(codec: str, decode: bool):
    code = CODECS[codec][decode]

    @F.arrow_udf(T.BinaryType())
    def run(blocks: pa.Array) -> pa.Array:
        return pa.array([None if b is None else code(b) for b in blocks.to_pylist()], pa.binary())

    return run


def encode(pieces: DataFrame, codec: str, g: int) -> DataFrame:
    """corpus, codec, g, block_id, uoff, ulen, clen, sha256 and payload of every block of g bytes (the last may be shorter)."""
    start, size = F.col("piece_off"), F.length("bytes")
    cut = pieces.filter(size > 0).select("corpus", "piece_off", "bytes", F.explode(F.sequence(F.floor(start / g), F.floor((start + size - 1) / g))).alias("block_id"))
    lo = F.greatest(F.col("block_id") * g, start)
    part = F.expr(f"substring(bytes, cast(greatest(block_id * {g}, piece_off) - piece_off as int) + 1, cast(least((block_id + 1) * {g}, piece_off + length(bytes)) - greatest(block_id * {g}, piece_off) as int))")
    parts = cut.select("corpus", "block_id", lo.alias("at"), part.alias("part"))
    raw = parts.groupBy("corpus", "block_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("part").alias("part")))).alias("p"))  # at most g bytes
    raw = raw.select("corpus", "block_id", F.unhex(F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("raw"))
    coded = raw.withColumn("payload", _coder(codec, False)(F.col("raw")))
    return coded.select("corpus", F.lit(codec).alias("codec"), F.lit(g).alias("g"), "block_id", (F.col("block_id") * g).alias("uoff"), F.length("raw").cast("long").alias("ulen"), F.length("payload").cast("long").alias("clen"), F.sha2("raw", 256).alias("sha256"), "payload")


def decode(blocks: DataFrame, codec: str) -> DataFrame:
    """blocks with raw; a block whose bytes are not those its digest names is an error, never a short answer."""
    out = blocks.withColumn("raw", _coder(codec, True)(F.col("payload")))
    return out.withColumn("raw", F.when(F.sha2("raw", 256) == F.col("sha256"), F.col("raw")).otherwise(F.raise_error(F.lit("a block does not match its digest"))))


def read(blocks: DataFrame, requests: DataFrame, codec: str, g: int) -> DataFrame:
    """request_id, bytes (null if any byte asked for is outside the corpus), blocks and decoded bytes of each request.

    requests: request_id, corpus, lo, hi. Every touched block is decoded once, whatever the number of requests (the batch
    read); `decoded` counts its length for each request, the work of a loop of single reads.
    """
    asked = requests.select("request_id", "corpus", "lo", "hi", F.explode_outer(F.when((F.col("lo") >= 0) & (F.col("hi") > F.col("lo")), F.sequence(F.floor(F.col("lo") / g), F.floor((F.col("hi") - 1) / g)))).alias("block_id"))
    touched = blocks.join(asked.select("corpus", "block_id").distinct(), ["corpus", "block_id"], "left_semi")
    raw = decode(touched, codec).select("corpus", "block_id", "uoff", "ulen", "raw")
    met = asked.join(raw, ["corpus", "block_id"], "left")
    part = F.expr("substring(raw, cast(greatest(lo, uoff) - uoff as int) + 1, cast(least(hi, uoff + ulen) - greatest(lo, uoff) as int))")
    parts = met.select("request_id", "lo", "hi", "block_id", "ulen", F.hex(part).alias("part"))
    out = parts.groupBy("request_id", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("block_id", "part"))).alias("p"), F.count("ulen").alias("blocks"), F.coalesce(F.sum("ulen"), F.lit(0)).alias("decoded"))
    found = F.unhex(F.array_join(F.transform("p", lambda x: x["part"]), ""))
    return out.select("request_id", F.when((F.col("hi") > F.col("lo")) & (F.length(found) == F.col("hi") - F.col("lo")), found).alias("bytes"), "blocks", "decoded")


def geometry(blocks: DataFrame) -> DataFrame:
    """Units, raw and stored bytes, the largest unit, and whether blocks tile the corpus without gaps."""
    end = F.col("uoff") + F.col("ulen")
    g = blocks.groupBy("corpus", "codec", "g").agg(F.count("*").alias("units"), F.sum("ulen").alias("raw"), F.sum("clen").alias("stored"), F.max("ulen").alias("largest"), F.max(end).alias("end"), F.count_if(F.col("ulen") < F.col("g")).alias("short"))
    return g.withColumn("whole", (F.col("raw") == F.col("end")) & (F.col("short") <= 1)).drop("end", "short")
