"""Interventions, shapes and profiles on planted series and against plain fits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from cellweave.operators import shapes


def correlated(rnd, rows, periods, sd, rho):
    apart = np.abs(np.subtract.outer(np.arange(periods), np.arange(periods)))
    cov = sd * sd * rho**apart
    return rnd.multivariate_normal(np.zeros(periods), cov, rows), cov


@pytest.mark.parametrize("kind, start", [("spike", 7), ("step", 6), ("trend", 5), ("transient", 4)])
def test_planted_interventions(spark, kind, start):
    rnd = np.random.default_rng(start)
    periods, rows = 14, 40
    noise, _ = correlated(rnd, rows, periods, 5.0, 0.3)
    x, named = shapes.patterns(periods)
    size = {"spike": 60, "step": 40, "trend": 20, "transient": 70}[kind]
    y = 100 + noise + size * x[:, named.index((kind, start))]
    data = [(i, list(range(2000, 2000 + periods)), y[i].tolist(), [100.0] * periods, [25.0] * periods, 0.3) for i in range(rows)]
    df = spark.createDataFrame(data, "u int, at array<bigint>, y array<double>, mu array<double>, var array<double>, rho double")
    got = shapes.attributed(df, window=(2000 + start - 1, 2000 + start + 1)).collect()
    assert np.mean([r.shape == kind for r in got]) > 0.85
    assert np.mean([any(e.shape == kind and e.start == 2000 + start and abs(e.excess - size) < 15 for e in r.effects) for r in got]) > 0.8
    none = shapes.attributed(df, window=(1990, 1991)).collect()
    assert {r.shape for r in none} == {"none"}


def test_quiet_series_and_joint_fit():
    rnd = np.random.default_rng(0)
    periods = 12
    noise, cov = correlated(rnd, 400, periods, 4.0, 0.4)
    covs = np.repeat(cov[None], 400, 0)
    found, need = shapes.interventions(noise, np.zeros_like(noise), covs)
    assert need == 3 and np.mean([bool(f) for f in found]) < 0.12
    # two interventions: the joint fit is generalised least squares on exactly the chosen set
    x, named = shapes.patterns(periods)
    y = noise[:3] + 40 * x[:, named.index(("spike", 2))] + 30 * x[:, named.index(("step", 7))]
    p = np.linalg.inv(cov)
    for row, effects in zip(y, shapes.interventions(y, np.zeros_like(y), covs[:3])[0]):
        cols = x[:, [named.index((k, t)) for k, t, _, _ in effects]]
        info = np.linalg.inv(cols.T @ p @ cols)
        size = info @ cols.T @ p @ row
        assert np.allclose(size, [e[2] for e in effects], rtol=1e-4) and np.allclose(size / np.sqrt(np.diag(info)), [e[3] for e in effects], rtol=1e-4)
        assert {(k, t) for k, t, _, _ in effects} == {("spike", 2), ("step", 7)}
        fit = lambda pick: (lambda c: row @ p @ c @ np.linalg.pinv(c.T @ p @ c) @ c.T @ p @ row)(x[:, pick])
        best = max(combinations(range(len(named)), 2), key=fit)  # no pair of candidates explains more
        assert fit([named.index((k, t)) for k, t, _, _ in effects]) >= fit(list(best)) - 4


def test_poisson_fits_and_shapes(spark):
    rnd = np.random.default_rng(2)
    t, e = np.arange(2000, 2014), np.full(14, 1000.0)
    rates = {"step": np.where(t < 2007, 0.1, 0.22), "gradual": 0.1 * np.exp(0.09 * (t - 2000)), "flat": np.full(14, 0.1)}
    data = [(f"{k}{i}", t.tolist(), rnd.poisson(1000 * r).astype(float).tolist(), e.tolist()) for k, r in rates.items() for i in range(30)]
    data += [("few", t.tolist(), [0.0] * 13 + [1.0], e.tolist()), ("gone", t.tolist(), [9.0] * 14, [0.0] + [1.0] * 13), ("short", [1, 2], [5.0, 6.0], [1.0, 1.0])]
    df = spark.createDataFrame(data, "u string, at array<bigint>, y array<double>, exposure array<double>")
    got = {r.u: r for r in shapes.slope_tail(shapes.shaped(df), least=0.0, rising=True, freedom=12).collect()}
    for k, want in (("step", "step"), ("gradual", "gradual"), ("flat", "indeterminate")):
        assert np.mean([got[f"{k}{i}"].shape == want for i in range(30)]) > 0.85
    assert np.mean([got[f"step{i}"].year == 2007 for i in range(30)]) > 0.9 and got["step0"].jump == pytest.approx(2.2, rel=0.1)
    assert all(got[k].shape is None for k in ("few", "gone", "short"))
    assert got["gradual3"].p < 1e-4 and 0 < got["flat1"].p < 1
    # against plain Newton steps on one row
    _, _, y, _ = data[0]
    x, b = shapes.powers(t[None].astype(float), 1)[0], np.zeros(2)
    b[0] = np.log(np.sum(y) / e.sum())
    for _ in range(30):
        m = e * np.exp(x @ b)
        b = b + np.linalg.solve((x.T * m) @ x, x.T @ (np.array(y) - m))
    assert got["step0"].slope == pytest.approx(b[1], rel=1e-6)
    kappa = max((((np.array(y) - m) ** 2) / m).sum() / 12, 1)
    assert got["step0"].slope_se == pytest.approx(np.sqrt(np.linalg.inv((x.T * m) @ x)[1, 1] * kappa), rel=1e-6)


def test_profiles(spark):
    node, rest = [50.0, 30.0, 20.0], [10.0, 20.0, 70.0]
    data = [("node", [26.0, 14.0, 10.0], node, rest), ("rest", [5.0, 10.0, 35.0], node, rest), ("few", [5.0, 5.0, 5.0], node, rest), ("between", [12.0, 10.0, 18.0], node, rest)]
    got = {r.id: r.result for r in shapes.profile_moved(spark.createDataFrame(data, "id string, moved array<double>, node array<double>, rest array<double>")).collect()}
    assert got == {"node": "supports", "rest": "excluded", "few": "open", "between": "open"}
