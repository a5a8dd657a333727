"""Links between rows: hot groups cut into blocks, pairs compared in numpy, connected components on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import staged


def in_blocks(rows: DataFrame, group: str, size: str, block: int, spread: str) -> DataFrame:
    """Each row once for every pair of blocks that holds it; a group of ``size`` rows has ceil(size / block) blocks.

    Adds block_i, block_j (i <= j) and own (the row's block). No task sees more than about two blocks of a group,
    and every pair of a group's rows meets in at least one of them.
    """
    n = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(17)), n.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1)).alias("_other")
    out = rows.withColumn("own", own).select("*", other)
    return out.select(
        *rows.columns,
        "own",
        F.least("own", "_other").alias("block_i"),
        F.greatest("own", "_other").alias("block_j"),
    )


def together(rows: DataFrame, keys: list[str], then: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The rows dealt by ``keys`` and sorted by them (and ``then``) within partitions, ready for ``whole_groups``."""
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *then)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], most: int = 4096) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of about ``most`` rows or more that end where a group ends, with each row's group number, in order.

    Groups are bounded by ``in_blocks``; a frame holds at most ``most`` rows beyond one group.
    """
    held: list[pd.DataFrame] = []
    count = 0

    def numbered(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), bool)
        for k in keys:
            values = frame[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    for batch in batches:
        for at in range(0, len(batch), most):
            held.append(batch.iloc[at : at + most])
            count += len(held[-1])
            if count < most:
                continue
            frame = pd.concat(held, ignore_index=True)
            number = numbered(frame)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield frame.iloc[:cut], number[:cut]
            held, count = [frame.iloc[cut:]], len(frame) - cut
    if count:
        frame = pd.concat(held, ignore_index=True)
        yield frame, numbered(frame)


def meeting(group: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group (rows are sorted by it), a bounded number at a time, never all of them.

    Where ``cross`` holds, the group is a pair of different blocks and only rows of different ``side`` meet.
    """
    at, shift = np.arange(len(group)), 1
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while len(at):
        at = at[at + shift < len(group)]
        at = at[group[at] == group[at + shift]]
        a = at[~cross[at] | (side[at] != side[at + shift])]
        parts.append((a, a + shift))
        held += len(a)
        if held >= most:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, held = [], 0
        shift += 1
    if held:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def least_reachable(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n rows the least row that the links reach, starting from ``label`` of earlier links."""
    label = np.arange(n) if label is None else label
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node that its links reach.

    Alternates the large-star and small-star steps of connected components until nothing changes. Every step is
    two aggregated joins over the edges, written to the shared folder; a hub's edges are never gathered in a list.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = staged(pairs, "links")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = staged(moved.where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
