"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of each class that a classifier is fitted on.
ROWS_PER_CLASS = 10_000


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def allowed(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id and label (1 if any of its labels is 1) of the rows that train picks."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(train & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def shift(labels: DataFrame, label: str, train: Column, per_class: int = ROWS_PER_CLASS) -> float:
    """What a model fitted on sample() lacks in log-odds: the bound cuts each class by its own share, all labels have the true prior."""
    n = {r["label"]: r["count"] for r in allowed(labels, label, train).groupBy("label").count().collect()}
    lost = {k: math.log(c / min(c, per_class)) for k, c in n.items()}
    return lost.get(1, 0.0) - lost.get(0, 0.0)


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text and label of at most per_class rows of each class, those of smallest hashed doc_id; train picks the rows allowed.

    A doc_id with several labels counts as 1 if any is 1, and one with several texts gives its smallest text, so the sample
    has a row for each doc_id. Its ids are at most 2 * per_class longs, so the broadcast below has a fixed bound, and at
    most that many texts of each task are shuffled.
    """
    rows = allowed(labels, label, train)
    some = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
