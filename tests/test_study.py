"""Questions find what is planted, at their level, and say whose finding it is."""

from __future__ import annotations

import time

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellweave.operators.ranking import least_from
from cellweave.plans import study
from cellweave.queries import analysis, base, reading


@pytest.fixture(scope="module")
def inputs(spark):
    rnd = np.random.default_rng(7)
    n = 6
    at = {(i, j): i * n + j for i in range(n) for j in range(n)}
    raised = {at[2, 2], at[2, 3], at[3, 2], at[3, 3]}
    rows = []
    for u in at.values():
        for t in range(1995, 2005):
            rate = 1.5 if u in raised else 1.0
            rate *= 3.0 if u == at[5, 5] and t >= 2000 else 1.0
            rows.append((u, t, 1000.0, int(rnd.poisson(60 * rate)), 60.0, 200.0))
    edges = [(a, at[i + x, j + y], 1.0) for (i, j), a in at.items() for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + x, j + y) in at]
    facilities = [(u, t, int(rnd.poisson(40 * (6 if u == 3 and t >= 2001 else 1))), 40.0) for u in range(5) for t in range(1995, 2005)]
    df = spark.createDataFrame
    return study.Inputs(df(rows, "u int, year int, n double, y long, mu double, phi double"), edges=df(edges, "a int, b int, weight double"), facilities=df(facilities, "facility int, year int, y long, mu double"), train_last=2000), raised, at[5, 5]


def test_cluster_finds_the_set(inputs):
    x, raised, stepped = inputs
    rows = study.ask("cluster", x, 0.1).collect()
    scanned = {r.u for r in rows if "cluster" in r.methods}
    assert raised <= scanned | {stepped} and raised <= scanned and len(scanned - raised - {stepped}) <= 2
    assert all(r.q_value <= 0.1 and r.locus == "place" for r in rows)


def test_steps_and_facilities(inputs):
    x, raised, stepped = inputs
    rows = {r.u: r for r in study.ask("step", x, 0.1).collect()}
    assert stepped in rows and rows[stepped]["first"] == 2000 and 0 < rows[stepped].p < 1e-3
    made = study.run(study.Study("s", [""], (1995, 2004), questions=("step", "institution", "prospective"), q=0.1), x).collect()
    assert all(r.q <= 0.1 + 1e-12 for r in made)
    assert {(r.locus, r.u) for r in made if r.question == "institution"} == {("facility", 3)}
    assert ("place", stepped) in {(r.locus, r.u) for r in made if r.question == "step"}


def test_quiet_cells_give_little(spark):
    rnd = np.random.default_rng(1)
    rows = [(u, t, 100.0, int(rnd.poisson(50 * rnd.gamma(100, 0.01))), 50.0, 100.0) for u in range(60) for t in range(2000, 2010)]
    cells = spark.createDataFrame(rows, "u int, year int, n double, y long, mu double, phi double")
    made = study.run(study.Study("s", [""], (2000, 2009), q=0.05), cells).collect()
    assert len(made) <= 2


def test_inputs_read_the_lines_once(spark, monkeypatch):
    reads, lines = [], base.order_lines
    monkeypatch.setattr(base, "order_lines", lambda *a: reads.append(a) or lines(*a))
    x = reading._inputs(spark, SF)
    assert len(reads) == 1
    made = [x.cells, x.edges, x.shares, x.facilities, x.groups, x.months]
    assert not [f for df in made for f in df.inputFiles() if "lineitem" in f]
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    assert rows(x.cells, "u", "year", "n", "y", "mu", "phi") == rows(base.expected(spark, SF), "u", "year", "n", "y", "mu", "phi")
    assert rows(x.edges, "a", "b", F.round("weight", 12)) == rows(analysis._flow(spark, SF), "a", "b", F.round("weight", 12))
    y, n = analysis._groups(spark, SF)
    assert rows(x.groups, "u", "g", "y", "n") == rows(n.join(y, ["u", "g"], "left").fillna(0, "y"), "u", "g", "y", "n")


def test_least_of_all_after_it_in_one_large_part(spark):
    n = 60_000
    df = spark.range(n).select("id", ((F.col("id") * 7919) % n).alias("v"), F.lit(1).alias("one"))
    start = time.monotonic()
    got = least_from(df.coalesce(1), ["one", "id"], "least", F.col("v")).orderBy("id").toPandas()
    assert time.monotonic() - start < 60  # minutes, where each row goes through all after it
    assert (got["least"].to_numpy() == np.minimum.accumulate(got["v"].to_numpy()[::-1])[::-1]).all()
