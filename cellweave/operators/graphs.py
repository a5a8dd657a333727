"""Places as graphs, supports and classification trees, as edge and membership tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.sources.scratch import staged


def care_flow(flows: DataFrame) -> DataFrame:
    """Edges (a, b, weight) of both directions: F_ab / F_a + F_ba / F_b for a <> b. flows: a (residence), b (care), n."""
    total = flows.groupBy("a").agg(F.sum("n").alias("t"))
    share = flows.groupBy("a", "b").agg(F.sum("n").alias("n")).join(total, "a").where("a <> b").select("a", "b", (F.col("n") / F.col("t")).alias("w"))
    back = share.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return share.union(back).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def nearest(points: DataFrame, k: int, *, cell: float) -> DataFrame:
    """Symmetric edges between each point and its k nearest points (all others if there are fewer).

    points: u, x, y. A point looks in the grid cells around its own, and in twice as many each way round after round until
    it has k points no farther than those cells reach for certain; only points that are still short look again. Choose
    ``cell`` so that a cell holds about k points; sparse points then take a few rounds more.
    """
    p = staged(points.select("u", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), "points")
    size = p.agg(F.count("*").alias("n"), F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    other = p.select(F.col("u").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"), "cx", "cy")
    most, far, radius, found = min(k, size["n"] - 1), max(size[1] or 0, size[2] or 0), 1, None
    short = p
    while True:
        shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
        around = short.withColumn("dx", shift).withColumn("dy", shift).select("u", "x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        near = around.join(other, ["cx", "cy"]).where("u <> v").withColumn("d", F.sqrt((F.col("x") - F.col("xv")) ** 2 + (F.col("y") - F.col("yv")) ** 2))
        ranked = near.withColumn("_n", F.row_number().over(W.partitionBy("u").orderBy("d", "v"))).where(F.col("_n") <= most)
        ranked = staged(ranked.select("u", "v", "d", "_n"), "near")
        # what lies within ``radius`` cells of a point's own is all there is within radius * cell
        sure = ranked.where((F.col("_n") == most) & ((F.col("d") <= radius * cell) | F.lit(radius > far))).select("u")
        kept = ranked.join(sure, "u", "left_semi").select(F.col("u").alias("a"), F.col("v").alias("b"), "d")
        found = kept if found is None else found.union(kept)
        short = staged(short.join(sure, "u", "left_anti"), "short")
        if most < 1 or radius > far or short.isEmpty():
            break
        radius *= 2
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()


def neighbour_mean(values: DataFrame, edges: DataFrame, *, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Weighted mean of the neighbours' values. values: u, value; edges: a, b, weight."""
    v = values.withColumnRenamed("u", "b")
    return edges.join(v, "b").groupBy(F.col("a").alias("u"), *by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("near"))


def hops(edges: DataFrame, sources: DataFrame, *, most: int | None = None, enough: int | None = None) -> DataFrame:
    """(source, u, hops) for every place that steps reach (within ``most`` of them, if given); each step is one join with the edges.

    A source that has ``enough`` places is not carried on, and keeps no more than the nearest ``enough``, ties by place.
    """
    e = edges.select("a", "b").distinct()
    seen = sources.select(F.col("u").alias("source"), "u", F.lit(0).alias("hops"))
    front, n = seen, 0
    while most is None or n < most:
        n += 1
        step = front.join(e, F.col("u") == F.col("a")).select("source", F.col("b").alias("u"), F.lit(n).alias("hops")).distinct()
        front = step.join(seen.select("source", "u"), ["source", "u"], "left_anti")
        if enough:
            have = seen.groupBy("source").agg(F.count("*").alias("_n"))
            rank = F.row_number().over(W.partitionBy("source").orderBy("u"))
            front = front.withColumn("_k", rank).join(have, "source").where(F.col("_n") + F.col("_k") <= enough).drop("_k", "_n")
        front = staged(front, "front")
        if front.isEmpty():
            break
        seen = staged(seen.union(front), "seen")
    return seen


def neighbourhoods(edges: DataFrame, k: int) -> DataFrame:
    """(centre, u): the k nearest places by steps, the centre first, ties by place; all that can be reached if they are fewer."""
    places = edges.select(F.col("a").alias("u")).union(edges.select("b")).distinct()
    return hops(edges, places, enough=k).select(F.col("source").alias("centre"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that links reach, by alternating large-star and small-star steps over the edges."""
    pairs = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = staged(moved.where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(), "pairs")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


def closure(tree: DataFrame) -> DataFrame:
    """(node, leaf) with the node's distance, for every node and all below it, itself included. tree: code, parent.

    A tree of any depth: a step for each of its levels. A code that is among its own ancestors is an error.
    """
    pairs = tree.select(F.col("code").alias("node"), F.col("code").alias("leaf"), F.lit(0).alias("distance"))
    front = pairs
    up = tree.where("parent is not null").select(F.col("code").alias("node"), F.col("parent").alias("above"))
    n = 0
    while True:
        n += 1
        front = staged(front.join(up, "node").select(F.col("above").alias("node"), "leaf", F.lit(n).alias("distance")), "tree")
        if front.isEmpty():
            return pairs
        if not front.where("node = leaf").isEmpty():
            raise ValueError("the tree has a circle")
        pairs = pairs.union(front)


def admissible_walk(tree: DataFrame, totals: DataFrame, least: Column) -> DataFrame:
    """Nodes reached top-down through nodes that pass ``least``: those that pass and all of whose ancestors do. totals: node, y."""
    pairs = closure(tree)
    failing = totals.where(~least).select("node")
    blocked = pairs.join(failing, "node").select(F.col("leaf").alias("node")).distinct()
    return totals.join(blocked, "node", "left_anti")


def overlap(members: DataFrame, a: Column, b: Column) -> DataFrame:
    """Share of the smaller field's events that both fields hold."""
    return members.agg((F.sum(F.when(a & b, 1).otherwise(0)) / F.least(F.sum(F.when(a, 1).otherwise(0)), F.sum(F.when(b, 1).otherwise(0)))).alias("overlap"))
