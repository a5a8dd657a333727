"""Readings of findings where there are none, and of registers at their bounds."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import same_rows

from cellweave.operators import interpret as it
from cellweave.registry import QUERIES

_RECOVERY = """WITH b AS (SELECT count(*) AS m FROM f JOIN d USING (u, year)), n AS (SELECT m, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM d) AS d FROM b)
SELECT m / (f + d - m) AS jaccard, m / f AS precision, m / d AS recall FROM n"""


@pytest.mark.parametrize("found, documented", [([], [(1, 1998)]), ([(1, 1998)], []), ([], []), ([(1, 1998), (2, 1999)], [(2, 1999), (3, 2000)])])
def test_recovery_of_empty_sets_like_sql(spark, duck, found, documented):
    frames = []
    for name, rows in (("f", found), ("d", documented)):
        duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} (u INT, year INT)")
        if rows:
            duck.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        frames.append(spark.createDataFrame(rows, "u int, year int"))
    same_rows(it.recovery(*frames), duck, _RECOVERY)


@pytest.fixture(scope="module")
def bound(spark, tmp_path_factory):
    """Suppliers whose mean discount is the bound of a signal (0 and 1, the same lines in two orders) or beside it (2 and 3)."""
    top = str(tmp_path_factory.mktemp("bound"))
    up = [0.0] * 2 + [0.01] + [0.03] * 4 + [0.06] * 8 + [0.08] * 5
    lines = {0: up, 1: up[::-1], 2: [*up[:-1], 0.080001], 3: [*up[:-1], 0.079999]}
    rows = [(s, i % 7 + 1, 10.0, x, datetime(1997 + i % 3, 1, 1)) for s, xs in lines.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp").coalesce(1).write.parquet(f"{top}/lineitem.parquet")
    spark.createDataFrame([(s, s % 2) for s in lines], "s_suppkey long, s_nationkey int").write.parquet(f"{top}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{top}/nation.parquet")
    return top


def test_leads_at_the_bound_whatever_the_order(spark, bound):
    assert [r.id for r in QUERIES["find_leads"](spark, bound).collect()] == [2]
    assert {r.id: r["class"] for r in QUERIES["explain_leads"](spark, bound).collect()} == {0: "noise", 1: "noise", 2: "signal", 3: "noise"}


def test_triage_counts_at_the_bound(spark, bound):
    got = {(r["class"], r.region): (r.leads, r.replicated) for r in QUERIES["triage_counts"](spark, bound).collect()}
    assert got == {("noise", 0): (1, 1), ("signal", 0): (1, 1), ("noise", 1): (2, 2)}
