"""Streams with own state give what one batch gives, resumed from their checkpoint."""

from __future__ import annotations

import random

from cellweave.operators import error_control as ec
from cellweave.streaming import online


def test_lond_over_three_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, f"s{i % 3}", i, rnd.choice([1e-6, 0.001, 0.2, 0.9])) for i in range(150)]
    schema = "id long, k string, at long, p double"
    whole = {r.id: (r.level, r.rejected) for r in ec.lond(spark.createDataFrame(rows, schema), 0.2, order="at", by="k").collect()}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low in (0, 60, 61):
        spark.createDataFrame(rows[low : {0: 60, 60: 61, 61: 150}[low]], schema).write.mode("append").parquet(source)
        online.drained(online.lond_stream(spark.readStream.schema(schema).parquet(source), 0.2, by="k", order="at"), out, check)
    got = spark.read.parquet(out).collect()
    assert len(got) == 150 and {r.number for r in got if r.k == "s0"} == set(range(1, 51))
    for r in got:
        level, rejected = whole[r.id]
        assert abs(r.level - level) < 1e-12 and r.rejected == rejected


def test_alarms_over_batches(spark, tmp_path):
    y = {1: [5, 5, 20, 20, 20, 5, 20, 20], 2: [20, 5, 20, 5, 20, 5, 20, 5]}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "u int, week long, y long, threshold long"
    for low, high in ((0, 3), (3, 4), (2, 8)):  # the last batch brings one week again
        spark.createDataFrame([(u, t, y[u][t], 10) for u in y for t in range(low, high)], schema).write.mode("append").parquet(source)
        online.drained(online.alarm_stream(spark.readStream.schema(schema).parquet(source)), out, check)
    assert sorted((r.u, r.week) for r in spark.read.parquet(out).collect()) == [(1, 3), (1, 7)]
