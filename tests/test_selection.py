"""Quantiles by groups against NumPy, and searches that have to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearloom.functions import selection


def test_a_group_of_nine_tenths_and_many_short_ones(spark):
    rng = np.random.default_rng(0)
    groups = {"hot": np.exp(rng.normal(0, 3, 9000)), None: rng.integers(0, 3, 300).astype(float), "one": np.array([4.0]), "same": np.full(700, 2.5), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    groups |= {f"g{i}": rng.normal(i, 1, int(rng.integers(1, 9))) for i in range(100)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("hot", None), ("hot", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.999, 1.0]
    for few in (10**6, 250, 2):
        got = {r.k: r.q for r in selection.by_group(df, ["k"], F.col("x"), shares, few=few).collect()}
        assert set(got) == {*groups, "none"}
        for k, x in groups.items():
            if k != "wide":
                assert np.allclose(got[k], np.quantile(x, shares), rtol=1e-12, atol=0), (k, few)
        assert got["wide"][2] == 0.5 and got["none"] is None or got["none"] == [None] * 5


def test_whole_tables_and_two_keys(spark):
    x = np.arange(1000.0)
    df = spark.createDataFrame([(int(v) % 2, int(v) % 3, float(v)) for v in x], "a int, b int, x double")
    assert selection.by_group(df, [], F.col("x"), [0.25], few=10).first().q == [pytest.approx(249.75)]
    got = {(r.a, r.b): r.m for r in selection.medians(df, ["a", "b"], F.col("x"), "m").collect()}
    assert got == {(a, b): np.median(x[(x % 2 == a) & (x % 3 == b)]) for a in (0, 1) for b in (0, 1, 2)}
    assert selection.by_group(df.limit(0), ["a"], F.col("x"), [0.5]).count() == 0


def test_a_search_ends_when_values_are_missing_or_not_finite(spark, monkeypatch):
    monkeypatch.setattr(selection, "WIDENINGS", 3)
    for bad in (float("nan"), None):
        rows = spark.createDataFrame([(float(i),) for i in range(50)] + [(bad,)] * 60, "x double")
        with pytest.raises(ValueError):
            selection.narrowed(rows, [0.9], 110, [(0.0, 50.0)])
    far = spark.createDataFrame([(1e300,), (-1e300,), (5.0,)], "x double")
    assert selection.narrowed(far, [0.5, 1.0], 3, [(0.0, 1.0), (0.0, 1.0)]) == [5.0, 1e300]
