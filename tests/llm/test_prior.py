"""Priors of classifiers fitted on a bounded sample."""

import pytest

from tessera.llm import quality, toxicity


@pytest.mark.parametrize("module", [quality, toxicity])
def test_bounded_sample_keeps_the_prior(spark, module):
    """A sign that 60 % of the rare class and 40 % of the other have says no more than 1 in 7, however few rows are fitted."""
    rows = [(k, "one two !!!! four" if (k // 10) % 5 < (3 if k % 10 == 0 else 2) else "one two three four", int(k % 10 == 0)) for k in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    whole, few = (module.scores(docs, labels, n).toPandas() for n in (10_000, 100))
    assert whole.predicted.sum() == few.predicted.sum() == 0
    assert abs(whole.score.mean() - 0.1) < 0.03 and abs(few.score.mean() - 0.1) < 0.03
