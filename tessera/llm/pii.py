"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds are email, ip, card (Luhn) and phone; every confirmed base span stays. Added kinds are iban (mod-97) and ssn,
kept at a score of at least 0.5. A span's score starts from its kind and rises when a context word of that kind stands
within 40 characters. Offsets are code points, end exclusive.

All patterns scan in linear time: a run of characters is entered only at its start, and an address is found from its @.

Defined results: null and empty texts have no spans; matches that fail their check are dropped without a second try;
spans are ordered by start, then kind in the order of KINDS; repeated rows each get their own spans; other columns are
ignored by find() and kept by redact().
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.8, 1.0), "ssn": (0.3, 0.7)}
CONTEXT = {
    "email": "mail email contact address write", "ip": "ip host server address login", "card": "card visa mastercard credit payment",
    "phone": "phone call tel mobile contact", "iban": "iban bank account transfer", "ssn": "ssn social security taxpayer",
}
LEAST, NEAR = 0.5, 40

_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_context = {k: re.compile(rf"\b(?:{'|'.join(words.split())})\b", re.I) for k, words in CONTEXT.items()}
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    last = 0
    for m in _domain.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _local_chars:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def proposals(text: str):
    """(start, kind, end) of every confirmed span."""
    if "@" in text:
        for a, b in _emails(text):
            yield a, 0, b
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.start(), 1, m.end()
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.start(), 3, m.end()
    for m in _iban.finditer(text):
        if mod97(m[0]):
            yield m.start(), 4, m.end()
    for m in _ssn.finditer(text):
        yield m.start(), 5, m.end()


def spans(text: str) -> list[dict]:
    found = []
    for start, k, end in sorted(proposals(text)):
        kind = KINDS[k]
        near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
        score = SCORES[kind][bool(_context[kind].search(near))]
        if k < len(BASE) or score >= LEAST:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_arrow_spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([spans(t.as_py() or "") for t in texts], _arrow_spans)


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact_text(t.as_py()) if t.is_valid else None for t in texts], pa.string())


def redact_text(text: str) -> str:
    """Each span becomes <KIND>; a span that overlaps an earlier one only lengthens what is cut."""
    out, at = [], 0
    for s in spans(text):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found, an array of (kind, start, end, score)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", spans_of(docs["text"]).alias("found"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with spans replaced in text, and n_chars set to the new length where there is such a column."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", redacted(docs["text"]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
