"""Byte-pair encoding and decoding through a table of distinct words.

Documents are taken in blocks of some megabytes, each split once. A block becomes its distinct words, dealt by hash into
buckets, and a body: its documents as numbers of those words in order of appearance, and the bucket of each word. Bucket by
bucket all blocks' words meet, each distinct word is encoded once, and the ids go back to the blocks, where they are joined
to the documents by word position. What is shuffled is compressed blocks, never a row for each word of the corpus; bodies
pass through the first shuffle beside the words. A bucket holds the vocabulary divided by the number of shuffle partitions
and is a task of its own; a task that has met KNOWN words forgets them and encodes again what it meets after that. A block
is bounded by BLOCK or one document.

Decoding joins ids with the id-to-piece table (one row for each id of the vocabulary, so its size is fixed): in
round_trip() for each distinct word of a block, in decode() for a table of ids.

A task that runs again after an executor was lost must make the same blocks. A table that comes from a shuffle is written
first, as its rows may come in another order then; a digest of the block's documents names it, so a block that came out
differently finds no partner and the job fails instead of mixing words.

Defined results: null and empty texts have no tokens and decode to an empty text; repeated rows are encoded alike;
other columns pass through nothing and clash with nothing; the special token's string in a text is that token, as in
the tokenizers library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, small_batches, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK = 5 << 20
#: Words whose ids a task holds at once.
KNOWN = 500_000
#: Bytes of documents returned to Spark at once.
BATCH = 4 << 20


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


@functools.cache
def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def splitter(path: str):
    """text -> words, as the vocabulary file's special tokens and pre-tokenizer split it."""
    specials = [a["content"] for a in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    fast, far = regex.compile(public_tokenizers.PATTERN).findall, regex.compile("[\u0500-\U0010ffff]").search
    own = load(path).pre_tokenizer.pre_tokenize_str

    def words(text: str) -> list[str]:
        # Beyond these code points the two know different versions of Unicode, so the library itself splits.
        return [text[a:b] for _, (a, b) in own(text)] if far(text) else fast(text)

    if not specials:
        return words
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")").split

    def split(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return words(text)
        return [w for k, part in enumerate(cut(text)) for w in ([part] if k % 2 else words(part))]

    return split


@functools.cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    spec = json.load(open(path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    out = {i: bytes(map(byte.__getitem__, token)) for token, i in spec["model"]["vocab"].items()}
    out |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 by planes of bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _join(head: bytes, tail: bytes) -> bytes:
    return len(head).to_bytes(4, "little") + head + tail


def _parts(data: bytes) -> tuple[bytes, bytes]:
    end = 4 + int.from_bytes(data[:4], "little")
    return data[4:end], data[end:]


def _pack_words(words: list[bytes]) -> bytes:
    return _join(_pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 9))


def _unpack_words(data: bytes) -> list[bytes]:
    lengths, raw = _parts(data)
    raw, ends = zstandard.decompress(raw), np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _pack_body(numbers: np.ndarray) -> bytes:
    """Numbers given in order of first appearance: 0 for a new one, a byte for a low one, else 255 and the number apart."""
    new = np.diff(np.maximum.accumulate(numbers.astype(np.int64)), prepend=-1) > 0
    short = np.where(new, 0, np.minimum(numbers, 254) + 1).astype(np.uint8)
    return _join(zstandard.compress(short.tobytes(), 3), _pack(numbers[short == 255]))


def _unpack_body(data: bytes) -> np.ndarray:
    short, far = _parts(data)
    short = np.frombuffer(zstandard.decompress(short), np.uint8)
    numbers, new = short.astype(np.uint32), short == 0
    numbers[new] = np.arange(1, new.sum() + 1)
    numbers -= 1
    numbers[short == 255] = _unpack(far)
    return numbers


_BLOCK = "block string, part int, doc_ids array<long>, lengths binary, buckets binary, payload binary"
_names = ["block", "part", "doc_ids", "lengths", "buckets", "payload"]


def _rows(block: str, rows: list[tuple]) -> pa.RecordBatch:
    part, ids, lengths, buckets, payload = zip(*rows)
    arrays = [pa.array([block] * len(rows)), pa.array(part, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(lengths, pa.binary()), pa.array(buckets, pa.binary()), pa.array(payload, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, _names)


def _split(path: str, buckets: int):
    """Blocks of documents: for each its body (part -1), then its distinct words by bucket."""

    def finish(nth, ids, lengths, numbers, flat, digest):
        words = [w.encode() for w in numbers]
        part = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        block = f"{TaskContext.get().partitionId()}-{nth}-{digest.hexdigest()[:24]}"
        yield _rows(block, [(-1, ids, _pack(np.array(lengths, np.uint32)), _pack(part), _pack_body(np.concatenate(flat)))])
        order = np.argsort(part, kind="stable")  # within a bucket, by first appearance in the block
        cuts = np.searchsorted(part[order], np.arange(buckets + 1))
        for p in range(buckets):
            if cuts[p] < cuts[p + 1]:
                yield _rows(block, [(p, None, None, None, _pack_words([words[i] for i in order[cuts[p] : cuts[p + 1]]]))])

    def run(batches):
        split = splitter(path)
        nth, ids, lengths, numbers, flat, digest, held = 0, [], [], _Numbers(), [], hashlib.sha256(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = split(text)
                ids.append(doc_id)
                lengths.append(len(words))
                flat.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                digest.update(f"{doc_id}:{len(words)}:{zlib.crc32(text.encode())};".encode())
                held += len(text)
                if held >= BLOCK:
                    yield from finish(nth, ids, lengths, numbers, flat, digest)
                    nth, ids, lengths, numbers, flat, digest, held = nth + 1, [], [], _Numbers(), [], hashlib.sha256(), 0
        if ids:
            yield from finish(nth, ids, lengths, numbers, flat, digest)

    return run


def _encode(path: str):
    """The ids of each block's words; a task encodes each of its distinct words once. Bodies pass through."""

    def run(batches):
        t, known = load(path), {}
        for batch in batches:
            for row, (block, part, payload) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5))):
                if part < 0:
                    yield batch.slice(row, 1)
                    continue
                if len(known) > KNOWN:
                    known = {}
                words = _unpack_words(payload.as_py())
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 20_000):
                    some = new[at : at + 20_000]
                    for w, e in zip(some, t.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                        known[w] = np.array(e.ids, np.uint32).tobytes()
                found = list(map(known.__getitem__, words))
                counts = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                yield _rows(block, [(part, None, _pack(counts), None, _pack(np.frombuffer(b"".join(found), "<u4")))])

    return run


def _assemble(path: str):
    """Joins words' ids to the documents of their block, by position."""

    def documents(body, parts, piece):
        counts = np.concatenate([_unpack(c) for c, _ in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ids = np.concatenate([_unpack(x) for _, x in parts] or [np.zeros(0, np.uint32)]).astype(np.int32)
        end = np.cumsum(counts)
        pieces_of = list(map(piece.__getitem__, ids.tolist()))  # the id-to-piece join
        text_of = [pieces_of[a] if a + 1 == b else b"".join(pieces_of[a:b]) for a, b in zip((end - counts).tolist(), end.tolist())]
        doc_ids, lengths, part, flat = body[0], _unpack(body[1]).astype(np.int64), _unpack(body[2]), _unpack_body(body[3])
        if len(part) != len(counts):
            raise RuntimeError("a block's words and documents do not belong together")
        place = np.empty(len(part), np.uint32)
        place[np.argsort(part, kind="stable")] = np.arange(len(part))
        at, out, held = 0, [], 0
        for doc_id, n in zip(doc_ids, lengths.tolist()):
            words = place[flat[at : at + n]]
            at += n
            size = counts[words]
            first = np.repeat(end[words] - np.cumsum(size), size)
            out.append((doc_id, ids[first + np.arange(len(first))], b"".join(map(text_of.__getitem__, words.tolist())).decode("utf-8", "replace")))
            held += 8 * n
            if held >= BATCH:
                yield out
                out, held = [], 0
        if out:
            yield out

    def to_batch(rows):
        offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[1] for r in rows])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[2] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    def run(batches):
        piece, block, body, parts = pieces(path), None, None, []
        for batch in batches:
            for name, part, ids, lengths, buckets, payload in zip(*(batch.column(k) for k in range(6))):
                if name.as_py() != block:
                    if block is not None:
                        yield from map(to_batch, documents(body, parts, piece))
                    block, body, parts = name.as_py(), None, []
                if part.as_py() < 0:
                    body = (ids.as_py(), lengths.as_py(), buckets.as_py(), payload.as_py())
                else:
                    parts.append((lengths.as_py(), payload.as_py()))
                if body is None:
                    raise RuntimeError("a block has words but no documents")
        if block is not None:
            yield from map(to_batch, documents(body, parts, piece))

    return run


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (text) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = Scratch(spark).cut(docs)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.mapInArrow(_split(path, buckets), _BLOCK)
    dealt = blocks.repartitionById(buckets, F.when(F.col("part") < 0, F.pmod(F.hash("block"), F.lit(buckets))).otherwise(F.col("part")))
    meet = dealt.mapInArrow(_encode(path), _BLOCK).repartition("block").sortWithinPartitions("block", "part")
    return meet.mapInArrow(_assemble(path), "doc_id long, ids array<int>, decoded string")


def piece_table(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    return spark.createDataFrame(list(enumerate(pieces(path))), "id int, piece binary")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of a table of doc_id and ids. The broadcast side has one row for each id of the vocabulary."""
    keyed = tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))  # before the rows are exploded
    rows = keyed.select(F.struct("doc_id", "row").alias("key"), F.posexplode_outer("ids").alias("at", "id"))
    found = rows.join(F.broadcast(piece_table(tokens.sparkSession, path)), "id", "left").groupBy("key")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.hex("piece"), F.lit("")).alias("piece"))))
    return found.agg(F.decode(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")), "utf-8").alias("text")).select("key.doc_id", "text")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of round_trip()'s rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))
