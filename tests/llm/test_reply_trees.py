"""Cycles, repeated and missing ids, long paths, and the loss mask of reply trees."""

import pytest

from tessera.llm import chat
from tessera.llm.common import Scratch

SCHEMA = "tree long, id long, parent long, role string, text string, key long, leaf string"


def told(spark, rows, best=None, **kw):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted((r.tree, r["rank"], [t[1] for t in chat.parse(r.formatted)]) for r in chat.conversations(df, best, **kw).collect())
    return [(t, texts) for t, _, texts in got]


def test_cycles_have_a_root(spark):
    rows = [(1, 1, 1, "u", "self"), (2, 5, 7, "u", "five"), (2, 6, 5, "u", "six"), (2, 7, 6, "u", "seven"), (2, 8, 6, "u", "eight"), (2, 1, 8, "u", "one"), (3, 1, None, "u", "a"), (3, 2, 1, "u", "b")]
    assert told(spark, rows) == [(1, ["self"]), (2, ["five", "six", "eight", "one"]), (2, ["five", "six", "seven"]), (3, ["a", "b"])]


def test_repeated_and_null_ids(spark):
    rows = [(1, 1, None, "u", "root")] * 2 + [(1, 2, 1, "u", "reply")] * 2 + [(2, None, None, "u", "x"), (2, None, 1, "u", "y"), (2, 1, None, "u", "z"), (2, 3, None, "u", None)]
    assert told(spark, rows) == [(1, ["root", "reply"])] * 2 + [(1, ["root"]), (2, ["z", "y"]), (2, ["x"]), (2, [""])]


def test_best_branch_by_score(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, None, "u", "a"), (1, 2, 1, "u", "b"), (1, 3, 2, "u", "c"), (1, 4, 1, "u", "good")]
    assert told(spark, rows, 1) == [(1, ["a", "b", "c"])]
    assert told(spark, rows, 1, score=F.when(F.col("text") == "good", 9).otherwise(1)) == [(1, ["a", "good"])]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 200])
def test_paths_of_any_length(spark, n):
    links = spark.createDataFrame([(0, k, k, k - 1 if k else None) for k in range(n)], "tree int, id long, key long, up long").repartition(2)
    scratch = Scratch(spark)
    assert sorted(r.back for r in chat.paths(scratch, links).collect()) == list(range(n))
    scratch.close()


def test_loss_mask_cuts_what_was_written(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\n<\\|x"
    turns = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", "é日<|"), (1, 3, "user", "end"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = chat.conversations(chat.chained(turns))
    got = got.select("tree", chat.under_mask(got["formatted"], chat.loss_mask(got["formatted"])).alias("loss"))
    assert {r.tree: r.loss for r in got.collect()} == {1: odd + "é日<|", 2: ""}
