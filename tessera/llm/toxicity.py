"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their leading 3 to 8 bytes, hashed to 2^20 buckets. Over the labelled sample Spark
counts in how many texts of each class a bucket occurs; the most telling buckets (signed chi-square) become the
machine's inputs. Inputs are the buckets that occur more often in texts of label 1 and in three of them at least: what speaks
for the other label is its absence. score = sigmoid(bias + sum of weights of the buckets present + sum over pairs of <v_i, v_j>), so two
terms together (an insult and a group mention) can weigh more or less than their sum. Each bucket counts once a text
however long the text is, and the whole text is read.

Defined results: null and empty texts score as a text without terms; if the sample lacks a class, every score is the
share of label 1 in it (0.5 if it is empty); repeated rows are scored alike; other columns are ignored by scores() and
kept by clean().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table
from .labelled import ROWS_PER_CLASS, remainder, sample, shift
from .textblocks import LOWER, Hasher, bounds, chunks, owners

BUCKETS, INPUTS, FACTORS, PREFIXES = 1 << 20, 2048, 8, range(3, 9)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array):
    """(first row, rows, row of each term, bucket of each term) by chunks of texts."""
    for first, n, data, off in chunks(texts):
        data = LOWER[data]
        starts, ends = bounds(data, off, _WORD)
        of, hashed = owners(starts, off), Hasher(data)
        rows, buckets = [of], [hashed(starts, ends)]
        for k in PREFIXES:
            longer = ends - starts > k
            rows.append(of[longer])
            buckets.append(hashed(starts[longer], starts[longer] + k) + np.uint64(k))
        yield first, n, np.concatenate(rows), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, inputs: np.ndarray, n: int) -> np.ndarray:
        """rows, inputs: the distinct (row, input) pairs that are present."""
        z = self.bias + np.bincount(rows, self.weights[inputs], n)
        for v in self.factors.T:
            x = v[inputs]
            z += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def present(self, rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.full(BUCKETS, -1, np.int32)
        slot[self.buckets] = np.arange(len(self.buckets))
        inputs = slot[buckets]
        pairs = np.unique(rows[inputs >= 0] * np.int64(len(self.buckets) + 1) + inputs[inputs >= 0])
        return np.divmod(pairs, len(self.buckets) + 1)


def _counts(batches):
    for batch in batches:
        label = batch.column("label").to_numpy()
        for first, n, rows, buckets in terms(batch.column("text")):
            seen, at = np.divmod(np.unique(rows * np.int64(BUCKETS) + buckets), BUCKETS)
            ones = label[first + seen] == 1
            pos, neg = np.bincount(at[ones], minlength=BUCKETS), np.bincount(at[~ones], minlength=BUCKETS)
            used = np.flatnonzero(pos + neg)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(pos[used]), pa.array(neg[used])], ["bucket", "pos", "neg"])


def fit(rows: DataFrame, prior: float = 0.0) -> Machine:
    """rows: doc_id, text and label (0 or 1), at most 2 * ROWS_PER_CLASS of them with a doc_id each; prior is added to the log-odds if both classes occur."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    none = Machine(np.zeros(0, np.int64), float(np.log((n1 + 0.5) / (n0 + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    if not n0 or not n1:
        return none
    counted = rows.mapInArrow(_counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos") / n1, F.col("neg") / n0
    all_ = (F.col("pos") + F.col("neg")) / (n0 + n1)
    telling = F.when(p > q, (p - q) * (p - q) / (all_ * (1 - all_) + 1 / (n0 + n1)))
    top = counted.filter("pos >= 3").withColumn("t", telling).filter("t > 0").orderBy(F.desc("t"), "bucket").limit(INPUTS)
    model = Machine(np.array(sorted(r["bucket"] for r in top.collect()), np.int64), none.bias, np.zeros(0), np.zeros((0, FACTORS)))

    def present(batches):
        for batch in batches:
            for first, k, at, buckets in terms(batch.column("text")):
                row, inputs = model.present(at, buckets)
                cut = np.searchsorted(row, np.arange(k + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(inputs.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, k), batch.column("label").slice(first, k), lists], ["doc_id", "label", "inputs"])

    what = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, inputs array<int>"
    matrix = rows.mapInArrow(present, what).toArrow().sort_by("doc_id")  # bounded; ordered, so that fits repeat
    lists = matrix.column("inputs").combine_chunks()
    model = _train(model, matrix.column("label").to_numpy(), np.asarray(lists.flatten()), np.asarray(lists.value_lengths()))
    model.bias += prior
    return model


def _train(model: Machine, label: np.ndarray, inputs: np.ndarray, lengths: np.ndarray, epochs: int = 40, step: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adam on the logistic loss of the rows, mini-batches in a seeded order."""
    rng, k = np.random.default_rng(7), len(model.buckets)
    off = np.concatenate([[0], np.cumsum(lengths)])
    p = {"b": np.array([model.bias]), "w": np.zeros(k), "v": rng.normal(0, 0.02, (k, FACTORS))}
    m, s, t = {a: np.zeros_like(x) for a, x in p.items()}, {a: np.zeros_like(x) for a, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 512):
            rows = order[at : at + 512]
            size = lengths[rows]
            of = np.repeat(np.arange(len(rows)), size)
            x = inputs[np.repeat(off[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, of, p["v"][x])
            now = Machine(model.buckets, p["b"][0], p["w"], p["v"])
            d = (now.score(of, x, len(rows)) - label[rows]) / len(rows)
            g = {"b": np.array([d.sum()]), "w": np.bincount(x, d[of], k) + decay * p["w"], "v": decay * p["v"]}
            np.add.at(g["v"], x, d[of][:, None] * (sums[of] - p["v"][x]))
            t += 1
            for a in p:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                s[a] = 0.999 * s[a] + 0.001 * g[a] ** 2
                p[a] = p[a] - step * (m[a] / (1 - 0.9**t)) / (np.sqrt(s[a] / (1 - 0.999**t)) + 1e-8)
    return Machine(model.buckets, float(p["b"][0]), p["w"], p["v"])


def score(model: Machine, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        parts = [model.score(*model.present(rows, buckets), n) for _, n, rows, buckets in terms(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Machine:
    """A machine fitted on labels whose crc32(doc_id) mod 5 is not 0, at most per_class of each class, with the prior of all of them."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    which = labels, "toxic", remainder(F.col("doc_id"), 5) != 0, per_class
    rows = scratch.cut(sample(docs, *which))
    model = fit(rows, shift(*which))
    scratch.drop(rows)
    return model


def scores(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> DataFrame:
    found = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score(train(docs, labels, per_class), docs["text"]).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they have."""
    return docs.filter(score(train(docs, labels), docs["text"]) < 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
