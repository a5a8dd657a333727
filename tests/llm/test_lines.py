"""Lines against SQL and plain Python; runs and levels; odd rows."""

from __future__ import annotations

import random

import pytest
from conftest import SF, same_rows

from cellweave.llm import lines, queries


def brute(rows, shortest=10):
    """(n_lines, n_dropped, kept) of each row; null ids come last."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= shortest:
                held.setdefault(key(x), set()).add((i is None, i))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (i is None, i)]
        out.append((i, t, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out


def test_query_like_sql(spark, duck):
    same_rows(queries.op13_lines(spark, SF), duck, lines.SQL)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (6, 2), (5, 3)])
def test_like_brute_force(spark, batches, fanout):
    rnd = random.Random(batches)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["short", "", "  Line Number 1 of the POOL\t", "ÀÉ line of ten", "àé line of ten"]
    rows = [(rnd.choice([None, *range(-5, 25)]), "\n".join(rnd.choice(["a licence line that is everywhere", *pool]) for _ in range(rnd.randint(0, 6)))) for _ in range(60)]
    rows += [rows[0], (3, None), (4, ""), (5, "\n\n"), (6, "x" * 50_000 + "\n" + "y\n" * 2000), (7, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kept string, other int").repartition(3)
    out = lines.deduplicated(df, keep=["doc_id", "text", "kept", "other"], batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "other", "n_lines", "n_dropped", "kept"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept) for r in out.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_runs_on_levels(spark):
    store = lines.Runs(spark, fanout=2, buckets=2)
    for b in range(5):
        batch = spark.createDataFrame([(10 * b + i, k, 0) for i, k in enumerate([b, b + 1, 100])], "id long, k1 long, k2 long")
        found = {r.k1: (r.owner, r.lines) for r in store.add(batch).collect()}
        assert found == ({} if b == 0 else {b: (10 * (b - 1) + 1, 1), 100: (2, 1)})
        assert [len(x) for x in store.levels] == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]][b]
    assert sorted(r.k1 for level in store.levels for run in level for r in run.collect()) == [0, 1, 2, 3, 4, 5, 100]
    with pytest.raises(ValueError):
        lines.Runs(spark, fanout=1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicated(df, keep=["doc_id"]).count() == 0


def test_no_python_in_plan(spark):
    plan = queries.op13_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
