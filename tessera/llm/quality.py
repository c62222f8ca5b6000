"""Document quality by a sparse rule ensemble.

Statistics of the whole text (shares of byte classes, word and line lengths, repetition) are the only inputs. A forest
of shallow trees is grown on the labelled sample; the path to each of its nodes is a rule, a conjunction of bounds on
statistics. A logistic regression with an L1 penalty weighs the rules and drops most; the rest is compiled into one
Spark column: sigmoid(intercept + sum of weights of the rules that hold).

Defined results: null and empty texts have all statistics 0 and get a score like any text; if the sample lacks a class,
every score is the share of label 1 in it (0.5 if it is empty); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table
from .labelled import ROWS_PER_CLASS, remainder, sample, shift
from .textblocks import LOWER, Hasher, bounds, chunks, owners

#: Byte classes whose share of the text is a statistic.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*@^~<>{}[]=+_\\/", "quote": b"\"'`()-:;", "space": b" \t", "line": b"\n\r", "high": bytes(range(128, 256))}
STATISTICS = [*CLASSES, "log_bytes", "log_words", "word_length", "distinct_words", "repeated_words", "single_words", "line_length", "distinct_lines"]
TREES, DEPTH, PENALTY = 24, 3, 0.002


def _set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASS = [_set(x) for x in CLASSES.values()]
_WORD, _LINE = ~_set(b" \t\n\r\x0b\x0c"), ~_set(b"\n\r")


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: distinct hashes, and those that occur once."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    once = new & np.concatenate([new[1:], [True]]) if len(new) else new
    return np.bincount(rows[new], minlength=n), np.bincount(rows[once], minlength=n)


def measure(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    parts = [np.zeros((0, len(STATISTICS)))]
    for _, n, data, off in chunks(texts):
        size = np.diff(off)
        some = np.maximum(size, 1)
        out = []
        for members in _CLASS:
            seen = np.concatenate([[0], np.cumsum(members[data])])
            out.append((seen[off[1:]] - seen[off[:-1]]) / some)
        data, count = LOWER[data], lambda rows: np.bincount(rows, minlength=n)  # noqa: B023
        hashed = Hasher(data)
        starts, ends = bounds(data, off, _WORD)
        of, words = owners(starts, off), hashed(starts, ends)
        n_words = np.maximum(count(of), 1)
        again = np.zeros(len(of), bool)
        again[1:] = (of[1:] == of[:-1]) & (words[1:] == words[:-1])
        distinct, single = _distinct(of, words, n)
        lengths = np.bincount(of, ends - starts, n)
        starts, ends = bounds(data, off, _LINE)
        in_line = owners(starts, off)
        n_lines = np.maximum(count(in_line), 1)
        lines, _ = _distinct(in_line, hashed(starts, ends), n)
        out += [np.log1p(size), np.log1p(count(of)), lengths / n_words, distinct / n_words, count(of[again]) / n_words, single / n_words, size / n_lines, lines / n_lines]
        parts.append(np.stack(out, 1))
    return np.concatenate(parts)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    rows = measure(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self, stats: Column) -> Column:
        tests = [stats[i] > lo for i, lo, _ in self.bounds if lo > -np.inf] + [stats[i] <= hi for i, _, hi in self.bounds if hi < np.inf]
        return reduce(lambda a, b: a & b, tests)


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: Column) -> Column:
        z = reduce(lambda a, b: a + b, [F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


def _paths(node, held: dict[int, tuple[float, float]]) -> list[Rule]:
    found = [Rule(tuple((i, *b) for i, b in sorted(held.items())))] if held else []
    if node.subtreeDepth() == 0:
        return found
    i, cut = node.split().featureIndex(), node.split().threshold()
    lo, hi = held.get(i, (-np.inf, np.inf))
    return found + _paths(node.leftChild(), held | {i: (lo, min(hi, cut))}) + _paths(node.rightChild(), held | {i: (max(lo, cut), hi)})


def fit(rows: DataFrame, prior: float = 0.0) -> Ensemble:
    """rows: stats (array of STATISTICS) and label (0 or 1); prior is added to the log-odds if both classes occur."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Ensemble(float(np.log((n1 + 0.5) / (n0 + 0.5))) if n else 0.0, [])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird", minInstancesPerNode=3, subsamplingRate=0.7)
    trees = forest.fit(rows.select(array_to_vector("stats").alias("features"), F.col("label").cast("double").alias("label"))).trees
    rules = list(dict.fromkeys(r for t in trees for r in _paths(t._call_java("rootNode"), {})))
    if not rules:
        return Ensemble(float(np.log(n1 / n0)) + prior, [])
    held = F.array(*[r.column(F.col("stats")).cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60)
    model = lasso.fit(rows.select(array_to_vector(held).alias("features"), F.col("label").cast("double").alias("label")))
    return Ensemble(float(model.intercept) + prior, [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w])


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Ensemble:
    """An ensemble fitted on labels whose crc32(doc_id) mod 3 is not 1, at most per_class of each class, with the prior of all of them."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    which = labels, "quality", remainder(F.col("doc_id"), 3) != 1, per_class
    rows = sample(docs, *which)
    rows = scratch.cut(rows.select("doc_id", statistics(rows["text"]).alias("stats"), "label").orderBy("doc_id"))  # ordered, so that fits repeat
    model = fit(rows, shift(*which))
    scratch.drop(rows)
    return model


def scores(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> DataFrame:
    model = train(docs, labels, per_class)
    found = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), statistics(docs["text"]).alias("stats"))
    found = found.select("doc_id", "held_out", model.column(F.col("stats")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
