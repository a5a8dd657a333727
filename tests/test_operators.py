from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import counts as c, departures as d, error_control as ec, exposure as x, graphs, interpret as it, persons as pe, surveillance as sv
from cellweave.plans import study
from cellweave.sources import store
from cellweave.sources.records import Roles, canonical


def test_reasons_in_order_and_nothing_lost(spark):
    rows = [(1, "2018-01-02", "A1", "F", 30.0), (9, "2018-01-02", None, None, None), (1, "2018-01-02", "A1", "X", None), (1, "2018-01-02", "A1", "F", 999.0), (1, "2018-01-02", " ", "O", 85.0), (None, "2018-01-02", "A1", "F", 1.0), (1, None, "A1", "F", 1.0)]
    recs = spark.createDataFrame(rows, "p int, d string, c string, s string, a double")
    roles = Roles(place="p", when="d", code="c", sex="s", age="a", missing={"age": (999.0,)})
    cells = canonical(recs, roles)
    places = spark.createDataFrame([(1,), (2,)], "u int")
    got = c.event_counts(cells, places)
    assert got.counts.agg(F.sum("y")).first()[0] == 2
    left = {r.reason: r.y for r in got.unallocated.groupBy("reason").agg(F.sum("y").alias("y")).collect()}
    assert left == {"municipality": 2, "sex": 1, "age": 1, "code": 1}
    dated = c.event_counts(cells, places, by=("month",))
    assert {r.reason for r in dated.unallocated.collect()} == {"municipality", "sex", "age", "code", "date"}
    assert canonical(recs, roles).where("age = 80").count() == 1  # capped, and a missing age stays missing


def test_bh_by_hand(spark):
    p = [0.001, 0.02, 0.02, 0.035, 0.2, 0.5]
    rows = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    assert {r.id for r in ec.bh(rows, 0.05).where("rejected").collect()} == {0, 1, 2}
    q = {r.id: r.q_value for r in ec.adjusted(rows).collect()}
    assert q[0] == pytest.approx(0.006) and q[1] == q[2] == pytest.approx(0.04) and q[5] == 0.5


def test_tree_bh_keeps_only_children_of_chosen(spark):
    rows = [(i, "a", "x", 0.001) for i in range(3)] + [(i + 10, "b", "y", 0.6) for i in range(3)] + [(20, "a", "z", 0.9)]
    got = ec.tree_bh(spark.createDataFrame(rows, "id int, g string, h string, p double"), ["g", "h"], 0.1)
    assert {r.id for r in got.where("rejected").collect()} == {0, 1, 2} and got.count() == len(rows)


def test_lond_levels_rise_after_rejections(spark):
    rows = spark.createDataFrame([(1, "s", 1, 0.0), (2, "s", 2, 0.9), (3, "t", 1, 0.9), (4, "t", 2, 0.9)], "id int, k string, at int, p double")
    got = {r.id: r for r in ec.lond(rows, 0.1, order="at", by="k").collect()}
    assert got[1].rejected and got[2].level == pytest.approx(2 * got[4].level)


def test_path_graph(spark):
    e = [(i, i + 1) for i in range(1, 6)]
    edges = spark.createDataFrame(e + [(b, a) for a, b in e], "a int, b int")
    hops = {(r.source, r.u): r.hops for r in graphs.hops(edges, spark.createDataFrame([(1,)], "u int"), most=3).collect()}
    assert hops == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}
    near = defaultdict(list)
    for r in graphs.neighbourhoods(edges, 3).collect():
        near[r.centre].append(r.u)
    assert sorted(near[1]) == [1, 2, 3] and sorted(near[3]) == [2, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_components_like_union_find(spark, seed):
    rnd = random.Random(seed)
    e = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in e if a != b for v in (a, b)}


def test_nearest_points(spark):
    rnd = np.random.default_rng(0)
    pts = rnd.uniform(0, 4, (40, 2))
    got = {(r.a, r.b) for r in graphs.nearest(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "u int, x double, y double"), 2, cell=2.0).collect()}
    want = set()
    for i in range(40):
        for j in np.argsort(((pts - pts[i]) ** 2).sum(1))[1:3]:
            want |= {(i, int(j)), (int(j), i)}
    assert got == want


def test_sparse_points_have_all_their_neighbours(spark):
    pts = [(i, float(i % 5), float(i // 5)) for i in range(25)] + [(100, 500.0, 500.0), (101, -900.0, 40.0)]
    got = {(r.a, r.b) for r in graphs.nearest(spark.createDataFrame(pts, "u int, x double, y double"), 3, cell=1.0).collect()}
    xy = np.array([(x, y) for _, x, y in pts])
    want = set()
    for i, p in enumerate(xy):
        far = np.sqrt(((xy - p) ** 2).sum(1))
        far[i] = np.inf
        for j in sorted(range(len(pts)), key=lambda j: (far[j], pts[j][0]))[:3]:
            want |= {(pts[i][0], pts[j][0]), (pts[j][0], pts[i][0])}
    assert got == want


def test_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(30)]
    got = graphs.closure(spark.createDataFrame(chain, "code int, parent int"))
    assert got.count() == 30 * 31 // 2 and got.agg(F.max("distance")).first()[0] == 29
    with pytest.raises(ValueError):
        graphs.closure(spark.createDataFrame([(1, 2), (2, 1)], "code int, parent int"))


def test_running_sums_over_parts(spark):
    from cellweave.operators import ranking

    rnd = np.random.default_rng(1)
    rows = [(int(i), float(rnd.integers(0, 20)), float(rnd.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double, w double").repartition(7)
    got = {r.id: r for r in ranking.running(df, ["v", "id"], {"k": F.lit(1), "s": F.col("w")}).collect()}
    total = 0.0
    for k, (i, v, w) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += w
        assert got[i].k == k and got[i].s == pytest.approx(total) and set(got[i].asDict()) == {"id", "v", "w", "k", "s"}
    least = {r.id: r.m for r in ranking.least_from(df, ["v", "id"], "m", F.col("w")).collect()}
    best = 9.0
    for i, v, w in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        best = min(best, w)
        assert least[i] == best
    share = {r.id: r.percentile for r in ranking.share_not_above(df, "v").collect()}
    assert all(share[i] == pytest.approx(sum(x[1] <= v for x in rows) / 300) for i, v, _ in rows)


def test_planted_cluster_is_found(spark):
    rows = [(u, y, 30 if u in (3, 4) and y >= 2004 else 10, 10.0, 1e9) for u in range(1, 9) for y in range(2000, 2006)]
    cells = spark.createDataFrame(rows, "u int, year int, y int, mu double, phi double")
    e = [(i, i + 1) for i in range(1, 8)]
    near = graphs.neighbourhoods(spark.createDataFrame(e + [(b, a) for a, b in e], "a int, b int"), 3)
    best = d.space_time(cells, near, longest=3, replicates=19).orderBy(F.desc("score"), "centre").first()
    assert best.places == [3, 4] and (best["first"], best["last"]) == (2004, 2005) and best.p < 0.001
    assert {r.u for r in d.outbreak(cells, 0.05).where("rejected").collect()} == {3, 4}
    assert {r.u for r in d.change_point(cells, 0.05).where("rejected").collect()} == {3, 4}


def test_every_planted_cluster_is_reported(spark):
    high = lambda u, y: u in (2, 3) and y >= 2004 or 10 <= u <= 17 and 2000 <= y <= 2003
    cells = spark.createDataFrame([(u, y, 30 if high(u, y) else 10, 10.0, 1e9) for u in range(1, 21) for y in range(2000, 2006)], "u int, year int, y int, mu double, phi double")
    e = [(i, i + 1) for i in range(1, 20)]
    near = graphs.neighbourhoods(spark.createDataFrame(e + [(b, a) for a, b in e], "a int, b int"), 30)
    assert near.count() == 400
    got = d.space_time(cells, near).where("reported is not null").orderBy("reported").collect()
    assert [(r.places, r["first"], r["last"]) for r in got] == [(list(range(10, 18)), 2000, 2003), ([2, 3], 2004, 2005)]
    assert all(r.p < 0.001 for r in got)


def test_gumbel_of_largest_likelihood():
    x = np.random.default_rng(0).gumbel(3, 2, 4000)
    assert d.gumbel_fit(x) == pytest.approx((3, 2), abs=0.1)


def test_decomposition_adds_up(spark):
    rnd = np.random.default_rng(1)
    rows = [(u, g, float(rnd.integers(50, 90)), float(rnd.integers(1, 9)), float(rnd.integers(50, 90)), float(rnd.integers(1, 9))) for u in range(3) for g in range(4)]
    r = it.decomposition(spark.createDataFrame(rows, "u int, g int, n0 double, y0 double, n1 double, y1 double")).first()
    assert r["size"] + r.place + r.composition + r.risk == pytest.approx(r.change)


def test_two_systems_give_the_classic_estimate(spark):
    flags = [(1, 1)] * 20 + [(1, 0)] * 30 + [(0, 1)] * 40
    df = pe.capture_patterns(spark.createDataFrame(flags, "a int, b int"), ["a", "b"])
    # three parameters for three patterns: the pair's effect isn't identified, the two systems' own give the classic estimate
    assert pe.multiple_systems(df, ["a", "b"])[0] == pytest.approx(50 * 60 / 20, rel=1e-6)
    four = [(a, b, c, e) for a in (0, 1) for b in (0, 1) for c in (0, 1) for e in (0, 1) if a + b + c + e for _ in range(40 if a + b + c + e == 2 else 60)]
    total, sd = pe.multiple_systems(pe.capture_patterns(spark.createDataFrame(four, "a int, b int, c int, e int"), list("abce")), list("abce"))
    assert total > len(four) and sd > 0
    mean, sd = pe.over_draws([(1.0, 0.1), (1.2, 0.1)])
    assert mean == pytest.approx(1.1) and sd > 0.1


def test_cohort_finds_the_rate_ratio(spark):
    rows = [(u, float(a), 100.0 * (2 if a else 1) * (1 + u % 2), 100.0) for u in range(40) for a in (0, 1)]
    fit = pe.cohort_fit(spark.createDataFrame(rows, "u int, x double, y double, t double"), ["x"], rounds=30).set_index("attribute")
    assert fit.loc["x", "log_rr"] == pytest.approx(np.log(2), abs=0.02) and fit.loc["x", "p"] < 1e-6


def test_alarm_when_known_counts_reach_the_threshold(spark):
    rows = [(1, 40, 0.9, 5.0, 20.0), (2, 5, 0.9, 5.0, 20.0)]
    got = {r.u: r for r in sv.alarms(spark.createDataFrame(rows, "u int, y long, f double, mu double, phi double")).collect()}
    assert got[1].alarm and not got[2].alarm and got[1].probability == 1.0


def test_exposure_laws(spark):
    with pytest.raises(ValueError):
        x.lift("none")
    n = x.events_population(spark.createDataFrame([(1, 2000, 5)], "u int, year int, y long"), spark.createDataFrame([(1,), (2,)], "u int"), spark.createDataFrame([(2001,), (2002,)], "year int"), lag=1)
    assert {(r.u, r.year): r.n for r in n.collect()} == {(1, 2001): 5, (1, 2002): 0, (2, 2001): 0, (2, 2002): 0}


def test_store_and_ledger(spark, tmp_path):
    df = spark.range(5)
    decl = {"reader": "counts", "year": 2001}
    assert store.get(spark, str(tmp_path), "fields", decl) is None
    store.put(df, str(tmp_path), "fields", decl)
    assert store.get(spark, str(tmp_path), "fields", decl).count() == 5
    assert store.get(spark, str(tmp_path), "fields", decl | {"year": 2002}) is None
    rows = [("a", "pending"), ("a", "result"), ("b", "pending")]
    led = spark.createDataFrame(rows, "id string, kind string").withColumns({"family": F.lit("f"), "actor": F.lit("x")})
    store.append(led, str(tmp_path / "ledger"))
    r = store.ledger_status(spark.read.parquet(str(tmp_path / "ledger"))).first()
    assert (r.tests, r.results) == (2, 1)
    store.export({"t": df}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/t")).count() == 5


def test_study_declarations(spark):
    with pytest.raises(ValueError, match="seeds is missing.*unknown"):
        study.load({"study": "x", "period": "2000..2001", "questions": ["why"]})
    s = study.load({"study": "x", "seeds": ["A"], "period": "2000-01..2003-06"})
    assert s.period == (2000, 2003)
    found = spark.createDataFrame([(1, 2000, 2001, "a", 0.1, 1.0), (1, 2001, 2002, "b", 0.01, 2.0), (1, 2005, 2005, "a", 0.2, 1.0)], "u int, first int, last int, method string, p double, effect double")
    got = sorted((r["first"], r["last"], r.p, r.effect, tuple(r.methods)) for r in study.merged(found).collect())
    assert got == [(2000, 2002, 0.01, 2.0, ("a", "b")), (2005, 2005, 0.2, 1.0, ("a",))]


def test_stories_join_leads_of_several_places(spark):
    rows = [(1, "p", 1, 2), (2, "p", 2, 3), (2, "q", 2, 3), (3, "q", 3, 3), (4, "q", 9, 9)]
    got = {r.id: r.story for r in it.stories(spark.createDataFrame(rows, "id long, place string, first int, last int"), graphs.components).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
