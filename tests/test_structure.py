"""Direct relations of a planted chain; patterns that both halves have, and those that they don't."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import structure as st


def test_a_chain_has_no_short_cut(spark):
    rnd = np.random.default_rng(1)
    n = 60 * 20
    a = rnd.normal(size=n)
    b = 0.8 * a + 0.6 * rnd.normal(size=n)
    c = 0.8 * b + 0.6 * rnd.normal(size=n)
    z = rnd.normal(size=n)
    rows = [(f, i // 20, i % 20, float(x[i])) for f, x in (("a", a), ("b", b), ("c", c), ("z", z)) for i in range(n)]
    rows += [("a", 999, 0, 1e6)]  # a cell without the other fields
    got = {(r.a, r.b): r for r in st.direct_relations(spark.createDataFrame(rows, "field string, u int, year int, x double")).collect()}
    assert {k for k, r in got.items() if r.direct} == {("a", "b"), ("b", "c")}
    assert got["a", "c"].rho > 0.5 and got["a", "b"].partial > 0.2
    one = spark.createDataFrame([("a", 1, 1, 1.0)], "field string, u int, year int, x double")
    assert st.direct_relations(one).count() == 0


def test_a_factor_carries_relations(spark):
    rnd = np.random.default_rng(2)
    n = 1000
    common = rnd.normal(size=n)
    x = {f: common + 0.7 * rnd.normal(size=n) for f in "abcdef"}
    x["b"] = x["b"] + 0.0
    rows = [(f, i // 10, i % 10, float(v[i])) for f, v in x.items() for i in range(n)]
    df = spark.createDataFrame(rows, "field string, u int, year int, x double")
    with_factor = st.direct_relations(df, factors=1).collect()
    assert sum(r.direct for r in with_factor) == 0 and all(r.rho > 0.5 for r in with_factor)


def test_lasso_like_its_conditions():
    rnd = np.random.default_rng(3)
    corr = np.corrcoef(rnd.normal(size=(200, 6)).T + rnd.normal(size=200))
    b = st.lasso(corr, 2, 0.2, np.zeros(6))
    slope = corr[:, 2] - corr @ b
    for i in (0, 1, 3, 4, 5):
        assert abs(slope[i]) <= 0.2 + 1e-6 and (b[i] == 0 or slope[i] == pytest.approx(0.2 * np.sign(b[i]), abs=1e-5))


def test_matching_and_stability(spark):
    assert np.allclose(st.matched(np.array([[0.9, 0.8], [0.85, 0.1]])), [0.8, 0.85])
    rnd = np.random.default_rng(5)
    places, years = 40, 12
    own = np.where(np.arange(places) < 12, 3.0, 0.0)
    wave = np.array([0, 1, 0, 1, 1, 0] * 2, float)
    planted = 50 * (1 + np.outer(own, wave))
    for rate, low, high in ((planted, 0.9, 1.01), (np.full((places, years), 50.0), -0.01, 0.99)):
        cells = spark.createDataFrame([(u, t, int(rnd.poisson(rate[u, t])), 50.0) for u in range(places) for t in range(years)], "u int, year int, y long, mu double")
        got = st.pattern_stability(cells, 1, F.col("year") < 6).first()
        assert low < got.stability < high and got.stability == min(got["first"], got["second"])
