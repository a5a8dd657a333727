"""Planted mechanisms of a change are read as what they are."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cellweave.operators import institutions as ins


def test_planted_mechanisms(spark):
    rows = []

    def put(u, facility, lead, block, total, lead2=None, block2=None, total2=None):
        for t in range(2000, 2008):
            late = t >= 2006
            rows.append((u, facility, t, lead2 if late and lead2 is not None else lead, block2 if late and block2 is not None else block, total2 if late and total2 is not None else total))

    for f in range(8):  # facility 0 codes anew for all it serves; 1 opens; 2 serves others who don't move
        put(1, f"a{f}", 5, 50, 100, 60 if f == 0 else 5, 105 if f == 0 else 50)
        put(2, f"a{f}", 5, 50, 100, 60 if f == 0 else 5, 105 if f == 0 else 50)
        put(3, f"b{f}", 5, 50, 100, 60 if f == 1 else 5, 105 if f == 1 else 50, 400 if f == 1 else 100)
        put(4, f"c{f}", 5, 50, 100, 60 if f == 2 else 5, 105 if f == 2 else 50, 155 if f == 2 else 100)
        put(5, f"c{f}", 5, 50, 100)
        put(6, f"d{f}", 5, 50, 100, 25)
        put(7, f"e{f}", 5, 50, 100)
    put(8, "only", 20, 100, 200, 60, 140, 240)
    put(9, None, 5, 50, 100, 60, 105)
    put(9, "z", 5, 50, 100)
    df = spark.createDataFrame(rows, "u int, facility string, year int, lead long, block long, total long")
    got = {r.u: r for r in ins.mechanism(df, F.col("year") >= 2006).collect()}
    want = {1: "catchment", 2: "catchment", 3: "volume", 4: "place", 5: "small", 6: "spread", 7: "small", 8: "open", 9: "spread"}
    assert {u: r.reading for u, r in got.items()} == want
    assert got[1].facilities == ["a0"] and got[1].k == 1 and got[1].share == pytest.approx(1) and got[1].ref_share == pytest.approx(1 / 8)
    n, p = 110, 1 / 8
    assert got[1].p == pytest.approx(p**n) or got[1].p < 1e-9
    assert got[8].sole and got[8].p is None
    assert got[1].inside == pytest.approx(math.log((120 + 0.5) / (210 + 1) * (300 + 1) / (30 + 0.5)))
    assert ins.mechanism(df.limit(0), F.col("year") >= 2006).count() == 0


def test_size_alone(spark):
    rows = [(1, f, t, 10 + (w if t >= 2005 else 0), 100 * w, 200 * w) for f, w in (("big", 30), ("mid", 8), ("low", 2)) for t in range(2000, 2010)]
    got = ins.mechanism(spark.createDataFrame(rows, "u int, facility string, year int, lead long, block long, total long"), F.col("year") >= 2005).first()
    assert got.reading == "size" and got.p > 0.1
