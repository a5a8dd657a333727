"""Variance by level against a grid search; peaks of planted kernels; diffusion by matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import distributions as d
from cellweave.operators import multiscale as ms, variance as va


def lattice(n):
    at = {(i, j): i * n + j for i in range(n) for j in range(n)}
    return [(a, at[i + x, j + y], 1.0) for (i, j), a in at.items() for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + x, j + y) in at]


def test_variance_like_a_grid_search(spark):
    rnd = np.random.default_rng(3)
    mu = rnd.uniform(20, 200, 1500)
    y = rnd.poisson(mu * rnd.gamma(1 / (1 / 50 + 0.05), 1 / 50 + 0.05, 1500))
    cells = spark.createDataFrame([(i, int(a), float(m), 50.0) for i, (a, m) in enumerate(zip(y, mu))], "u int, y long, mu double, phi double")
    got, _ = va.place_year_variance(cells, trim=0.0)
    fine = np.linspace(np.log(0.01), np.log(0.3), 2000)
    ll = [d.nb_logpmf(y.astype(float), mu, 1 / (1 / 50 + np.exp(k))).sum() for k in fine]
    assert got.first().log_variance == pytest.approx(fine[int(np.argmax(ll))], abs=0.02)
    wild = cells.withColumn("y", F.when(F.col("u") < 15, F.col("y") * 20).otherwise(F.col("y")))
    trimmed = va.place_year_variance(wild)[0].first().log_variance
    assert abs(trimmed - np.log(0.05)) < 0.25 and va.place_year_variance(wild, trim=0.0)[0].first().log_variance > np.log(0.15)


def test_variance_by_level(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for region, k in ((0, 0.02), (1, 0.3)):
        for state in range(3):
            for i in range(4 if (region, state) == (1, 2) else 250):
                m = rnd.uniform(30, 150)
                rows.append((len(rows), region, f"{region}{state}", int(rnd.poisson(m * rnd.gamma(1 / k, k))), m, 1e9))
    cells = spark.createDataFrame(rows, "u int, region int, state string, y long, mu double, phi double")
    groups, table = va.place_year_variance(cells, ["region", "state"], rounds=2)
    got = {(r.region, r.state): r.log_variance for r in groups.collect()}
    assert len(got) == 6
    for (region, _), v in got.items():
        assert abs(v - np.log((0.02, 0.3)[region])) < 0.4
    parent = {r.group: r for r in table.where("level = 'region'").collect()}
    small = table.where("group = '1/12'").first()
    assert abs(small.log_variance - parent["1"].log_variance) < abs(small.own_estimate - parent["1"].log_variance) + 1e-9
    assert va.with_extra(cells.where("u < 3"), groups, ["region", "state"]).where("phi < 200").count() == 3


def test_diffusion_like_matrices(spark):
    edges = lattice(4) + [(0, 15, 3.0), (15, 0, 3.0)]
    a = np.zeros((17, 17))
    for i, j, w in edges:
        a[i, j] += w
    p = np.eye(17)
    p[:16, :16] = 0.5 * np.eye(16) + 0.5 * a[:16, :16] / a[:16, :16].sum(1, keepdims=True)
    x = np.random.default_rng(0).normal(size=17)
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(x)], "u int, k int, x double")
    out = ms.diffused(df, spark.createDataFrame(edges, "a int, b int, weight double"), ["k"], [0, 1, 3]).collect()
    for scale in (0, 1, 3):
        want = np.linalg.matrix_power(p, scale) @ x
        assert np.allclose([r.x for r in sorted(out, key=lambda r: r.u) if r.scale == scale], want)


def test_planted_peaks_and_footprint(spark):
    rnd, n = np.random.default_rng(9), 7
    edges = spark.createDataFrame(lattice(n), "a int, b int, weight double")
    wide = {(2, 2), (2, 3), (3, 2), (1, 2), (2, 1)}
    rows = []
    for i in range(n):
        for j in range(n):
            for t in range(2000, 2006):
                rate = 2.2 if (i, j) in wide and t >= 2004 else 5.0 if (i, j) == (6, 6) and t == 2001 else 1.0
                rows.append((i * n + j, t, int(rnd.poisson(30 * rate)), 30.0, 1e9))
    cells = spark.createDataFrame(rows, "u int, year int, y long, mu double, phi double")
    got = {r.u: r for r in ms.peaks(cells, edges, scales=[0, 1, 3], replicates=10).collect()}
    spot, area = got[48], got[16]
    assert (spot.scale, spot["first"], spot["last"]) == (0, 2001, 2001) and spot.p < 0.1 and spot.ratio > 3
    assert area.scale >= 1 and area["first"] in (2003, 2004) and area["last"] == 2005 and area.p < 0.2
    quiet = [r.p for r in got.values() if r.u not in (48, 16)]
    assert np.mean(quiet) > 0.25
    found = spark.createDataFrame([(16, area.scale, 2004, 2005)], "u int, scale int, first int, last int")
    carried = {r.u for r in ms.footprints(found, cells, edges, mass=0.6).collect()}
    assert 16 in carried and len(carried & {i * n + j for i, j in wide}) >= 2 and len(carried) <= 8
