"""Random sets are connected and whole; surrogates hold their size and find planted lags; waves by their statistic."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from cellweave.operators import nulls, waves


def grid(n):
    at = {(i, j): i * n + j for i in range(n) for j in range(n)}
    return at, [(a, at[i + x, j + y]) for (i, j), a in at.items() for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + x, j + y) in at]


def test_random_sets_are_connected_and_matched(spark):
    at, links = grid(12)
    links = [(a, b) for a, b in links if 143 not in (a, b)] + [(500, 501), (501, 500)]
    places = [(u, u // 72, u % 2) for u in at.values()] + [(500, 0, 0), (501, 0, 0)]
    members = [0, 1, 2, 12, 13, 100, 101, 143, 50]
    df = spark.createDataFrame
    p = df(places, "u int, state int, quintile int")
    args = df([(u,) for u in members], "u int"), p, df(links, "a int, b int")
    rows = nulls.random_sets(*args, replicates=60).collect()
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
    state = {u: (s, k) for u, s, k in places}
    sets = defaultdict(list)
    for r in rows:
        sets[r.r, r.cluster].append(r.u)
    assert {r for r, _ in sets} == set(range(1, 61)) and {c for _, c in sets} == {0, 100, None}
    for (_, c), got in sets.items():
        assert len(got) == {0: 5, 100: 2, None: 2}[c]
        if c is None:
            assert sorted(state[u] for u in got) == sorted(state[u] for u in (143, 50))
            continue
        seen, front = {got[0]}, [got[0]]
        while front:
            front = [v for u in front for v in near[u] & set(got) - seen]
            seen |= set(front)
        assert seen == set(got) and len(seen) == len(got)
        assert any(state[u][0] == {0: 0, 100: 1}[c] for u in got)
    assert len({tuple(sorted(v)) for (_, c), v in sets.items() if c == 0}) > 50
    again = nulls.random_sets(*args, replicates=60).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_sets_corroborate_what_is_planted(spark):
    at, links = grid(10)
    rnd = np.random.default_rng(4)
    members = [33, 34, 43, 44]
    cells = [(u, 2000 + t, int(rnd.poisson(20 * (4 if u in members and t >= 8 else 1)))) for u in at.values() for t in range(10)]
    df = spark.createDataFrame
    values = nulls.usual_years(df(cells, "u int, year int, y int"), 2008, 2009)
    places = df([(u, 0, 0) for u in at.values()], "u int, state int, quintile int")
    for who, low, high in ((members, 0, 0.06), ([0, 1, 10, 11], 0.06, 1)):
        m = df([(u,) for u in who], "u int")
        got = nulls.corroborated_by(values, m, nulls.random_sets(m, places, df(links, "a int, b int"), replicates=99)).first()
        assert low < got.p <= high and got.replicates == 99
    nothing = values.selectExpr("u", "0L AS observed", "usual")
    m = df([(0,)], "u int")
    assert nulls.corroborated_by(nothing, m, nulls.random_sets(m, places, df(links, "a int, b int"), replicates=9)).first().p == 1


def test_surrogates_keep_the_spectrum_and_the_size(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=31).cumsum()
    s = nulls.phase_surrogates(x, 50, 3)
    assert np.allclose(np.abs(np.fft.rfft(s - s.mean(1, keepdims=True)))[:, 1:], np.abs(np.fft.rfft(x - x.mean()))[1:])
    rows, fields = [], 16
    for f in range(fields):
        e, v = 0.0, []
        for _ in range(60):
            e = 0.6 * e + rnd.normal()
            v.append(e)
        rows += [("national", f"f{f:02}", "all", t, v[t]) for t in range(60)]
    follow = {t: x for _, f, _, t, x in rows if f == "f00"}
    rows += [("national", "echo", "all", t, follow[t - 2] + 0.3 * rnd.normal() if t >= 2 else 0.0) for t in range(60)]
    got = nulls.lagged_relations(spark.createDataFrame(rows, "support string, field string, region string, at long, x double"), lags=2, replicates=199).collect()
    null = [r.p for r in got if "echo" not in (r.field, r.leader)]
    assert len(null) == fields * (fields - 1) // 2 + 2 * fields * (fields - 1)
    assert 0.01 < np.mean(np.array(null) <= 0.05) < 0.1
    echo = {(r.leader, r.lag): r for r in got if r.field == "echo"}
    assert echo["f00", 2].p == pytest.approx(1 / 200) and echo["f00", 2].rho > 0.8 and echo["f00", 2].p_any == pytest.approx(1 / 200)


def spearman_z(t, d, least):
    """Best Fisher z over discs around a source, ranks with ties, by plain loops."""
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    r, best = rank(t), -np.inf
    for radius in np.unique(d):
        inside = d <= radius
        if (n := inside.sum()) >= max(least, 4):
            a, b = r[inside], rank(d[inside])
            rho = np.corrcoef(a, b)[0, 1] if a.std() * b.std() > 1e-9 else 0
            best = max(best, np.arctanh(np.clip(rho, -waves.NEARLY_ONE, waves.NEARLY_ONE)) * np.sqrt(n - 3))
    return best


def test_wave_scores_like_plain_loops(spark):
    rnd = np.random.default_rng(6)
    n = 24
    t, d = rnd.integers(0, 6, n).astype(float), rnd.integers(0, 9, (n, n)).astype(float)
    onset = spark.createDataFrame([(u, float(t[u])) for u in range(n)], "u int, onset double")
    distance = spark.createDataFrame([(s, u, float(d[s, u])) for s in range(n) for u in range(n)], "source int, u int, d double")
    got = {r.source: r.score for r in waves.wave_scores(onset, distance, least=8).collect()}
    for s in range(n):
        assert got[s] == pytest.approx(spearman_z(t, d[s], 8), abs=1e-6)


def test_waves_hold_their_size(spark):
    rnd = np.random.default_rng(8)
    small = 0
    d = np.abs(np.subtract.outer(np.arange(20), np.arange(20))).astype(float)
    distance = spark.createDataFrame([(s, u, float(d[s, u])) for s in range(20) for u in range(20)], "source int, u int, d double")
    for k in range(8):
        onset = spark.createDataFrame([(u, float(x)) for u, x in enumerate(rnd.integers(0, 10, 20))], "u int, onset double")
        small += waves.best_wave(onset, distance, surrogates=49, seed=str(k)).first().p <= 0.1
    assert small <= 3
