from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import departures as dep, expectation as ex, interpret as it, noise as no, relations as rel, waves as wv
from cellweave.streaming import weekly as st


def test_wave_from_a_known_source(spark):
    pts = [(i, i // 5, i % 5) for i in range(25)]
    onset = spark.createDataFrame([(i, 2000 + x + y) for i, x, y in pts], "u int, onset int")
    distance = spark.createDataFrame([(i, j, float(np.hypot(a - c, b - d))) for i, a, b in pts for j, c, d in pts], "source int, u int, d double")
    got = wv.best_wave(onset, distance, surrogates=39).first()
    assert got.source in (0, 1, 5) and got.rho > 0.8 and got.p == pytest.approx(1 / 40)
    speeds = {r.source: r.speed for r in wv.speed(onset, distance).collect()}
    assert 0.5 < speeds[0] <= 1


def test_two_waves_are_found_one_after_the_other(spark):
    pts = [(100 * g + i, 1000 * g + 10 * i) for g in range(2) for i in range(15 + 5 * g)]
    onset = spark.createDataFrame([(u, 2000 + u % 100) for u, _ in pts], "u int, onset int")
    distance = spark.createDataFrame([(a, b, float(abs(x - z))) for a, x in pts for b, z in pts if a // 100 == b // 100], "source int, u int, d double")
    got = wv.waves(onset, distance, most=2).collect()
    # ranks are those among all places, so the group whose years the other one shares throughout is the straighter
    assert [(r.wave, r.source, r.places, r.found) for r in got] == [(1, 0, 15, True), (2, 100, 20, True)]
    assert all(r.p < 0.01 for r in got)


def test_corroboration_has_its_sets(spark):
    values = spark.createDataFrame([(u, u % 2, float(u >= 30)) for u in range(40)], "u int, stratum int, x double")
    assert it.corroborated(values, values.where("u >= 30").select("u")).first().p == pytest.approx(1 / 5000)


def test_sides_add_up_and_are_stable(spark):
    cells = spark.createDataFrame([(u, 50 * u) for u in range(20)], "u int, y int")
    rows = no.event_sides(cells, 0.3, keys=("u",)).collect()
    assert all(r.a + r.b == r.y for r in rows) and sum(r.a for r in rows) == pytest.approx(0.3 * sum(r.y for r in rows), rel=0.1)
    again = no.event_sides(cells.repartition(7), 0.3, keys=("u",)).collect()
    assert {r.u: r.a for r in rows} == {r.u: r.a for r in again}


def test_planted_shapes(spark):
    cells = spark.createDataFrame([(y, 10) for y in range(2000, 2004)], "year int, y long")
    got = lambda s: [r.y for r in no.planted(cells, F.lit(True), 2.0, shape=s, first=2002).orderBy("year").collect()]
    assert got("spike") == [20] * 4 and got("step") == [10, 10, 20, 20] and got("ramp") == [10, 10, 13, 17]


def test_pit_of_the_true_model_is_uniform(spark):
    rng = np.random.default_rng(0)
    mu = rng.uniform(0.5, 40, 4000)
    y = rng.poisson(mu * rng.gamma(5, 1 / 5, 4000))
    cells = spark.createDataFrame([(i, 0, int(a), float(m), 5.0) for i, (a, m) in enumerate(zip(y, mu))], "u int, year int, y int, mu double, phi double")
    s = ex.surprise(cells)
    assert ex.calibration(s).first().ks < 0.03
    assert s.agg(F.stddev("z")).first()[0] == pytest.approx(1, abs=0.05)
    assert no.kappa(s).first().kappa == pytest.approx(1, abs=0.1)


def test_factor_of_related_fields(spark):
    rng = np.random.default_rng(1)
    f = rng.standard_normal(300)
    rows = [(k, u, 2000, float(w * f[u] + 0.5 * rng.standard_normal()), 1.0) for k, w in (("a", 1), ("b", 1), ("c", -1), ("d", 0)) for u in range(300)]
    pairs = rel.weighted_correlations(spark.createDataFrame(rows, "field string, u int, year int, x double, w double"))
    load = rel.factors(pairs, 1)[0]
    assert abs(load["a"]) > 0.7 and load["a"] * load["c"] < 0 and abs(load["d"]) < 0.2
    p = {(r.field, r.leader): r.p for r in rel.pair_test(pairs, delta=0.05).collect()}
    assert p["b", "a"] < 1e-6 and p["d", "a"] > 0.01


def test_poisson_factors_like_numpy(spark):
    rng = np.random.default_rng(4)
    mu = rng.uniform(5, 50, (12, 8))
    y = rng.poisson(mu * (1 + np.outer(rng.gamma(1, 1, 12), rng.uniform(0, 1, 8))))
    a, b = np.full(12, 0.5), np.linspace(0.5, 1, 8)
    for _ in range(20_000):
        a = a * ((y / (1 + np.outer(a, b))) @ b) / (mu @ b)
        b = b * ((y / (1 + np.outer(a, b))).T @ a) / (mu.T @ a)
    want = np.outer(a, b)
    fa, fb = rel.poisson_factors(spark.createDataFrame([(u, t, int(y[u, t]), float(mu[u, t])) for u in range(12) for t in range(8)], "u int, year int, y int, mu double"), 1)
    fa, fb = {(r.u, r.k): r.a for r in fa.collect()}, {(r.year, r.k): r.b for r in fb.collect()}
    got = np.array([[fa[u, 1] * fb[t, 1] for t in range(8)] for u in range(12)])
    dev = lambda m: 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / m), 0) - (y - m)).sum()
    assert dev(mu * (1 + got)) == pytest.approx(dev(mu * (1 + want)), rel=1e-4) and np.abs(got - want).max() < 0.05
    assert max(fb[t, 1] for t in range(8)) == pytest.approx(1) and all(fa[u, 0] == 1 for u in range(12))


def test_poisson_factors_of_two_components_fit_as_well_as_numpy(spark):
    rng = np.random.default_rng(8)
    n = 30
    mu = rng.uniform(5, 50, (n, 6))
    y = rng.poisson(mu * (1 + rng.gamma(1, 1, (n, 2)) @ rng.uniform(0, 1, (2, 6))))
    a, b = np.full((n, 2), 0.5), rng.uniform(0.3, 1, (6, 2))
    for _ in range(5_000):
        a = a * ((y / (1 + a @ b.T)) @ b) / (mu @ b)
        b = b * ((y / (1 + a @ b.T)).T @ a) / (mu.T @ a)
    fa, fb = rel.poisson_factors(spark.createDataFrame([(u, t, int(y[u, t]), float(mu[u, t])) for u in range(n) for t in range(6)], "u int, year int, y int, mu double"), 2)
    fa, fb = {(r.u, r.k): r.a for r in fa.collect()}, {(r.year, r.k): r.b for r in fb.collect()}
    got = np.array([[sum(fa[u, k] * fb[t, k] for k in range(3)) for t in range(6)] for u in range(n)])
    dev = lambda m: 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / m), 0) - (y - m)).sum()
    assert min(fa.values()) >= 0 and min(fb.values()) >= 0 and dev(mu * got) <= 1.01 * dev(mu * (1 + a @ b.T))


def test_distributed_lag_finds_the_lag(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u in range(60):
        x = rng.standard_normal(20)
        for t in range(20):
            rows.append((u, t, int(rng.poisson(50 * np.exp(0.3 * (x[t - 1] if t else 0)))), 50.0, float(x[t])))
    got = {r.lag: r for r in rel.distributed_lag(spark.createDataFrame(rows, "u int, year int, y int, mu double, x double"), 2, penalty=0.01).collect()}
    assert got[1].beta == pytest.approx(0.3, abs=0.02) and abs(got[0].beta) < 0.02 and abs(got[2].beta) < 0.02


def test_stream_drops_repeats_and_closes_weeks(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-06 23:59:59", "a"), (3, "2024-01-07 00:00:00", "a"), (4, "2024-03-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = st.drained(st.weekly(st.without_repeats(stream), late=None), str(tmp_path / "w")).collect()
    assert sorted((str(r.week_start), r.epi_year, r.week, r.y) for r in got) == [("2023-12-31", 2024, 1, 2), ("2024-01-07", 2024, 2, 1)]


def test_season_of_one_unit(spark):
    rng = np.random.default_rng(3)
    rows = [(u, y, float((u == 1) * 0.5 + 0.1 * rng.standard_normal()), float(0.1 * rng.standard_normal())) for u in range(4) for y in range(8)]
    got = {r.u: r for r in dep.season_departure(spark.createDataFrame(rows, "u int, year int, sin double, cos double")).collect()}
    assert got[1].p < 1e-6 and got[1].phase == pytest.approx(3, abs=0.3) and all(got[u].p > 0.001 for u in (0, 2, 3))


def test_every_question_finds_what_is_planted(spark):
    from cellweave.plans import study

    cells = spark.createDataFrame([(u, t, 100.0, 300 if u == 3 and t >= 2004 else 100, 100.0, 1e9) for u in range(12) for t in range(2000, 2008)], "u int, year int, n double, y long, mu double, phi double")
    shares = spark.createDataFrame([(u, t, 60 if (u, t) == (5, 2003) else 20, 100, 0.2) for u in range(12) for t in range(2000, 2008)], "u int, year int, y int, n int, share double")
    facilities = spark.createDataFrame([(f, t, 90.0 if f == 2 and t in (2003, 2004) else 20.0, 20.0) for f in range(6) for t in range(2000, 2008)], "facility int, year int, y double, mu double")
    groups = spark.createDataFrame([(u, g, 90 if (u, g) == (4, 1) else 30, 30.0) for u in range(12) for g in range(5)], "u int, g int, y int, mu double")
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b], "a int, b int")
    x = study.Inputs(cells, edges=edges, shares=shares, facilities=facilities, groups=groups, train_last=2003)
    want = {"excess": {3}, "step": {3}, "trend": {3}, "cluster": {3}, "share": {5}, "institution": {2}, "group": {4}, "prospective": {3}}
    for question, places in want.items():
        assert {r.u for r in study.ask(question, x, 0.05).collect()} == places, question
    assert 3 in {r.u for r in study.ask("divergence", x, 0.05).collect()}
    for question in ("propagation", "seasonality"):
        with pytest.raises(ValueError):
            study.ask(question, x, 0.05)
    assert set(study.METHODS) == set(want) | {"divergence", "propagation", "seasonality"}
