"""Online error control over streams of tests, with a stream's state kept by Spark: resumed from its checkpoint, never folded anew."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The shares of q that successive tests get, in proportion to 1 / (i ln(i + 1)**2), over as many tests.
HORIZON = 100_000
_SCALE = 1 / math.fsum(1 / (i * math.log(i + 1) ** 2) for i in range(1, HORIZON + 1))


def level(i: int, rejected: int, q: float) -> float:
    """The level of a stream's i-th test after so many rejections."""
    return q * _SCALE * (rejected + 1) / (i * math.log(i + 1) ** 2)


class Lond(StatefulProcessor):
    """Tests of a stream in order of arrival; within a batch in order of ``order``. State: tests and rejections so far."""

    def __init__(self, q: float, by: str, order: str, id: str, p: str):
        self.q, self.by, self.order, self.id, self.p = q, by, order, id, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "tests bigint, rejections bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.order, self.id], kind="stable")
        tests, hits = self.past.get() if self.past.exists() else (0, 0)
        made = []
        for i, p in zip(frame[self.id], frame[self.p]):
            tests += 1
            at = level(tests, hits, self.q)
            hits += bool(p <= at)
            made.append((key[0], i, p, tests, at, bool(p <= at)))
        self.past.update((tests, hits))
        yield pd.DataFrame(made, columns=[self.by, self.id, self.p, "number", "level", "rejected"])

    def close(self) -> None:
        pass


class Alarms(StatefulProcessor):
    """Running counts of a place against its thresholds: an alarm where ``run`` successive periods exceed theirs, one alarm an episode."""

    def __init__(self, by: str, at: str, run: int):
        self.by, self.at, self.run = by, at, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "last bigint, above bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        last, above = self.past.get() if self.past.exists() else (None, 0)
        made = []
        for t, y, threshold in zip(frame[self.at].tolist(), frame["y"].tolist(), frame["threshold"].tolist()):
            if last is not None and t <= last:
                continue  # a period that was read already
            above = (above if last is None or t == last + 1 else 0) + 1 if y > threshold else 0
            last = t
            if above == self.run:
                made.append((key[0], t, y, threshold))
        self.past.update((last, above))
        yield pd.DataFrame(made, columns=[self.by, self.at, "y", "threshold"])

    def close(self) -> None:
        pass


def lond_stream(tests: DataFrame, q: float, *, by: str, order: str, id: str = "id", p: str = "p") -> DataFrame:
    """(by, id, p, number, level, rejected) of a stream of tests (by, order, id, p), each stream's rejections bounded at q.

    A test's level depends on how many tests and rejections its stream had before; these two numbers are all that is
    kept. Batches must come in order; within one, tests are taken by ``order``, then ``id``. Tests beyond HORIZON go
    on with ever smaller levels. Needs a state store that keeps columns apart (RocksDB).
    """
    kinds = dict(tests.dtypes)
    schema = f"{by} {kinds[by]}, {id} {kinds[id]}, {p} double, number bigint, level double, rejected boolean"
    rows = tests.select(by, order, id, F.col(p).cast("double").alias(p))
    return rows.groupBy(by).transformWithStateInPandas(Lond(q, by, order, id, p), schema, "Append", "None")


def alarm_stream(counts: DataFrame, *, by: str = "u", at: str = "week", run: int = 2) -> DataFrame:
    """(by, at, y, threshold) where ``run`` successive periods of a stream (by, at, y, threshold) exceeded their thresholds, once an episode.

    A gap in the periods ends a run; a period that comes again or late is passed over.
    """
    kinds = dict(counts.dtypes)
    rows = counts.select(by, F.col(at).cast("bigint").alias(at), F.col("y").cast("double").alias("y"), F.col("threshold").cast("double").alias("threshold"))
    return rows.groupBy(by).transformWithStateInPandas(Alarms(by, at, run), f"{by} {kinds[by]}, {at} bigint, y double, threshold double", "Append", "None")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that has arrived, appended to Parquet at ``path``; the next call goes on from the checkpoint."""
    spark = stream.sparkSession
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
