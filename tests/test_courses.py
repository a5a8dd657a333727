"""Courses, predictive mixtures, shapes and interventions on planted series and against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import distributions as d
from cellweave.operators import courses, mixtures


def planted(seed=3, places=400, years=10, tau=(4.0, 16.0), phi=30.0):
    rnd = np.random.default_rng(seed)
    x = courses.design(list(range(2000, 2000 + years)), ("level", "slope"))
    b = rnd.normal(0, 1 / np.sqrt(tau), (places, 2))
    mu = rnd.uniform(5, 60, (places, years))
    m = mu * np.exp(b @ x.T)
    y = rnd.poisson(m * rnd.gamma(phi, 1 / phi, m.shape))
    rows = [(u, 2000 + t, int(y[u, t]), float(mu[u, t]), phi) for u in range(places) for t in range(years)]
    return rows, b, x


def test_courses_recover_strengths_and_agree_with_numpy(spark):
    rows, b, x = planted()
    cells = spark.createDataFrame(rows, "u int, year int, y long, mu double, phi double").repartition(3)
    got = {r.u: r for r in courses.place_courses(cells, ahead=(2010, 2011)).collect()}
    tau = np.array(got[0].strength)
    assert np.abs(np.log(tau / [4.0, 16.0])).max() < 0.35
    fit = np.array([got[u].coef for u in range(len(b))])
    assert np.corrcoef(fit[:, 0], b[:, 0])[0, 1] > 0.95 and np.corrcoef(fit[:, 1], b[:, 1])[0, 1] > 0.7
    inside = np.abs(fit - b) / np.array([got[u].sd for u in range(len(b))])
    assert 0.62 < (inside < 1).mean() < 0.75
    y, mu = (np.array([[r[k] for r in rows if r[0] == 7]], float) for k in (2, 3))
    m = mu * np.exp(fit[7] @ x.T)
    w = 1 / (1 + m / 30)
    assert np.abs(((y - m) * w) @ x - tau * fit[7]).max() < 1e-5  # the slope of the posterior is nought
    cov = np.linalg.inv((x.T * (m * w)) @ x + np.diag(tau))
    assert np.allclose(cov, got[7].cov, rtol=1e-6)
    assert np.allclose(got[7].fitted, m[0]) and np.allclose(got[7].eta_var, ((x @ cov) * x).sum(1))
    new = courses.design([2010, 2011], ("level", "slope"), base=list(range(2000, 2010)))
    assert np.allclose(got[7].shift, new @ (fit[7] * [1, 0.5])) and np.allclose(got[7].shift_var, ((new @ cov) * new).sum(1))


def test_courses_odd_places(spark):
    rows = [(1, 2000, 5, 4.0, 10.0), (1, 2002, 6, 4.0, 10.0), (2, 2001, 0, 0.0, 10.0), (3, 2000, 900, 1.0, 1e9), (3, 2001, 1000, 1.0, 1e9)]
    cells = spark.createDataFrame(rows, "u int, year int, y long, mu double, phi double")
    got = {r.u: r for r in courses.place_courses(cells, strength=[1.0, 1.0]).collect()}
    assert list(got[2].coef) == [0, 0] and list(got[1].at) == [2000, 2002] and got[3].coef[0] > 4
    assert [len(r.fitted) for r in (got[1], got[2], got[3])] == [2, 1, 2] and got[1].strength == [1.0, 1.0]
    long = courses.by_period(courses.place_courses(cells, ahead=(2003,)))
    assert long.count() == 5
    assert courses.place_courses(cells.limit(0)).count() == 0


def test_season_is_found(spark):
    rnd = np.random.default_rng(5)
    amp = rnd.normal(0, 0.5, 200)
    rows = [(u, t, int(rnd.poisson(40 * np.exp(amp[u] * np.sin(2 * np.pi * t / 12)))), 40.0, 1e9) for u in range(200) for t in range(36)]
    cells = spark.createDataFrame(rows, "u int, month int, y long, mu double, phi double")
    got = {r.u: r.coef for r in courses.place_courses(cells, at="month", terms=("level", "slope", "season")).collect()}
    assert np.abs([got[u][2] - amp[u] for u in range(200)]).max() < 0.15
    assert np.abs([got[u][3] for u in range(200)]).max() < 0.15


def test_mixture_scores_and_quantiles(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        w = rnd.dirichlet([1, 1, 1])
        mu = rnd.uniform(1, 80, 3)
        phi = rnd.choice([2.0, 20.0, 1e9], 3)
        k = rnd.choice(3, p=w)
        y = rnd.poisson(mu[k] * (rnd.gamma(phi[k], 1 / phi[k]) if phi[k] < 1e8 else 1))
        rows.append((i, int(y), w.tolist(), mu.tolist(), phi.tolist(), float(rnd.random())))
    df = spark.createDataFrame(rows, "i int, y long, weight array<double>, mu array<double>, phi array<double>, v double")
    got = df.withColumn("s", mixtures.mixture_score("y", "weight", "mu", "phi", "v")).withColumn("q", mixtures.mixture_quantile(F.lit(0.9), "weight", "mu", "phi")).collect()
    pit = np.sort([r.s.pit for r in got])
    assert np.abs(pit - (np.arange(3000) + 0.5) / 3000).max() < 1.36 / np.sqrt(3000)
    assert abs(np.mean([r.s.z for r in got])) < 0.06 and abs(np.std([r.s.z for r in got]) - 1) < 0.06
    for r in got[:60]:
        k = np.arange(2000.0)
        p = sum(w * np.exp(d.nb_logpmf(k, m, f)) for w, m, f in zip(r.weight, r.mu, r.phi))
        assert r.s.upper == pytest.approx(p[r.y :].sum(), abs=1e-6) and r.s.loglik == pytest.approx(np.log(p[r.y]), rel=1e-6)
        assert r.q == int(np.argmax(np.cumsum(p) >= 0.9))
        mean = (k * p).sum()
        assert r.s.mean == pytest.approx(mean, rel=1e-6)
        assert mean + mean**2 / r.s.phi == pytest.approx((k * k * p).sum() - mean**2, rel=1e-3)


def test_regimes_weigh_the_true_rule(spark):
    t = np.arange(15)
    rise, level = 1000 * np.exp(0.12 * t), 1000 * np.exp(np.where(t % 2, 0.2, -0.2))
    rows = [(g, 2000 + int(i), float(v[i]), 1000.0) for g, v in (("rise", rise), ("level", level)) for i in t]
    rows += [("short", 2013, 5.0, 10.0)]
    cells = spark.createDataFrame(rows, "g string, year int, y double, n double")
    got = {r.g: r for r in mixtures.regimes(cells, 2014, steps=2).collect()}
    best = lambda g: mixtures.RULES[int(np.argmax(got[g].weight))]
    assert best("rise") == "linear" and best("level") in ("flat", "last")
    assert np.allclose(got["short"].weight, 0.25)
    assert got["rise"].rate[3][1] == pytest.approx(0.12 * 16, abs=0.01)
    later = spark.createDataFrame([(1, "rise", 2015, 7, 100.0), (2, "rise", 2016, 7, 100.0)], "u int, g string, year int, y long, n double")
    shifts = spark.createDataFrame([(1, 2015, 0.5, 0.1)], "u int, at long, shift double, shift_var double")
    out = {r.u: r for r in mixtures.predictive(later, mixtures.regimes(cells, 2014, steps=2), shifts, 2014, phi=F.lit(10.0)).collect()}
    assert out[1].mu[3] == pytest.approx(100 * np.exp(0.12 * 15 + 0.5), rel=0.02) and out[1].phi[0] == pytest.approx(1 / 0.2)
    assert out[2].mu[3] == pytest.approx(100 * np.exp(0.12 * 16), rel=0.02) and out[2].phi[0] == pytest.approx(10)
