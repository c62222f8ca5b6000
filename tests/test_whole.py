"""Queries over all rows, against brute force."""

import pandas as pd

from tessera.plans import catalog, views

SF = "/root/testdata/sf0.001"


def test_front_of_all_points(spark):
    p = catalog.points(spark, SF).toPandas()
    front = {r.key for r in p.itertuples() if not ((p.ratio >= r.ratio) & (p.p50 <= r.p50) & ((p.ratio > r.ratio) | (p.p50 < r.p50))).any()}
    assert {r.key for r in catalog.QUERIES["j14_pareto_anti_all"](spark, SF).collect()} == front


def test_all_samples_and_configs(spark):
    s = views.samples(spark, SF).toPandas()
    got = catalog.QUERIES["a29_singletons_all"](spark, SF).toPandas().set_index("config").codecs
    assert got.sort_index().to_dict() == s.groupby("config").codec.nunique().to_dict()
    wide = catalog.QUERIES["p09_wide_pivot_all"](spark, SF).toPandas().set_index("codec")
    want = s.pivot_table(index="codec", columns="config", values="latency_ms", aggfunc="max").reindex(columns=range(10)).rename(columns="c{}".format)
    pd.testing.assert_frame_equal(wide.sort_index(), want.sort_index(), check_names=False)
