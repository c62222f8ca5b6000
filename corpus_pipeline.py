"""A corpus pipeline: each stage reads what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

Defined results: null texts are empty for every stage and stay null in the tables between; of rows with equal texts (null and
empty ones too) one stays, that of the smallest doc_id; a document without doc_id is one like any other; without labels of both
classes nothing is toxic unless all labels are; columns beside doc_id and text pass through, whatever their names, and are
never inputs; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, pii, simhash, toxicity
from tessera.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.dedup(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, and its decoding, as digests."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [("toxicity", toxic), ("simhash_dedup", dedup), ("decontamination", contamination), ("pii", private), ("bpe", tokens)]

#: SimHash, the learned classifier and the vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = scratch.cut(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
