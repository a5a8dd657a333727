"""Near-duplicate vectors by p-stable hashing of normalised vectors, with exact cosine checks.

Vectors of one label are hashed in several tables: each table quantises ``k`` random Gaussian projections, shifted
and cut in steps of ``width``. For normalised vectors a cosine is a Euclidean distance, so the chance that a pair at
the threshold meets in a table is known, and there are as many tables as ``recall`` asks for. The number of
projections grows with the logarithm of the number of vectors, so that buckets stay small, as long as that takes no
more than ``most_tables`` tables (rows a vector); from there on it is fixed and larger buckets are cut into blocks,
which loses nothing. Vectors that share a bucket are compared exactly; found links join components, in which all pairs are compared again to count links, so
links between members that never shared a bucket count too. Hot buckets and components are cut into blocks.

Vectors that are null, zero, or hold nulls or non-finite numbers link with nothing, nor do vectors with a null label
or vectors of different lengths. Rows with a null id get a null component. Repeated rows count as one vector; rows of one
id with different vectors or labels each take part. Equal vectors link with cosine 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import staged
from cellweave.llm.linking import components, in_blocks, least_reachable, meeting, together, whole_groups


def meeting_chance(distance: float, width: float) -> float:
    """Chance that one quantised projection is equal for two vectors at this Euclidean distance."""
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, *, cosine: float, width: float, recall: float, most_tables: int = 64) -> tuple[int, int]:
    """(projections a table, tables) for n vectors: random vectors (at distance sqrt 2) seldom meet, near ones surely do."""
    near, far = meeting_chance(math.sqrt(2 - 2 * cosine), width), meeting_chance(math.sqrt(2), width)

    def tables(k: int) -> int:
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))

    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    while k > 1 and tables(k) > most_tables:
        k -= 1
    return k, tables(k)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that neither squares nor sums overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucketed(vectors: DataFrame, *, k: int, tables: int, width: float, seed: int = 11) -> DataFrame:
    """(key, node): each vector's bucket in each table; ``vectors``: node, label, vec."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, frame in batch.groupby(batch["vec"].map(len)):
                rng = np.random.default_rng([seed, dim])
                directions, shifts = rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)
                multiply = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
                for at in range(0, len(frame), 2048):
                    part = frame.iloc[at : at + 2048]
                    cells = np.floor((_unit(part["vec"]) @ directions + shifts) / width).astype(np.int64).view(np.uint64)
                    mixed = (cells.reshape(len(part), tables, k) * multiply).sum(2, dtype=np.uint64)
                    mixed ^= mixed >> np.uint64(29)
                    label = part["label"].to_numpy().astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    key = (mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ label ^ (np.arange(tables, dtype=np.uint64) << np.uint64(48)) ^ np.uint64(dim)
                    yield pd.DataFrame({"key": key.view(np.int64).ravel(), "node": np.repeat(part["node"].to_numpy(), tables)})

    return vectors.select("node", "label", "vec").mapInPandas(keys, "key long, node long")


def found_edges(rows: DataFrame, *, cosine: float) -> DataFrame:
    """Links (a, b) that span what is linked within each bucket; rows: key, block_i, block_j, own, node, label, vec."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in whole_groups(batches, ["key", "block_i", "block_j"], 4096):
            node, lab, label = frame["node"].to_numpy(), frame["label"].to_numpy(), np.arange(len(frame))
            dims = frame["vec"].map(len).to_numpy()
            cross, own = (frame["block_i"] != frame["block_j"]).to_numpy(), frame["own"].to_numpy()
            x = np.zeros((len(frame), dims.max()))
            for dim in np.unique(dims):
                x[dims == dim, :dim] = _unit(frame["vec"][dims == dim])
            for a, b in meeting(group, own, cross):
                at = np.flatnonzero((label[a] != label[b]) & (lab[a] == lab[b]) & (dims[a] == dims[b]))
                for low in range(0, len(at), 1 << 14):
                    p, q = a[at[low : low + (1 << 14)]], b[at[low : low + (1 << 14)]]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    if near.any():
                        label = least_reachable(p[near], q[near], len(frame), label)
            moved = np.flatnonzero(label != np.arange(len(frame)))
            yield pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return rows.mapInPandas(link, "a long, b long").where("a <> b").distinct()


def link_counts(members: DataFrame, *, cosine: float, block: int) -> DataFrame:
    """(node, n): the weight of the nodes linked with each node; ``members``: component, size, node, weight, vec."""
    dealt = together(in_blocks(members, "component", "size", block, "node"), ["component", "block_i", "block_j"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in whole_groups(batches, ["component", "block_i", "block_j"], 2048):
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            out = []
            for start, end in zip(edges[:-1], edges[1:]):
                part = frame.iloc[start:end]
                x, own, weight = _unit(part["vec"]), part["own"].to_numpy(), part["weight"].to_numpy()
                linked = x @ x.T >= cosine
                np.fill_diagonal(linked, False)
                if part["block_i"].iat[0] != part["block_j"].iat[0]:
                    linked &= own[:, None] != own[None, :]
                out.append(pd.DataFrame({"node": part["node"].to_numpy(), "n": linked @ weight}))
            yield pd.concat(out)

    return dealt.mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, width: float = 2.0, recall: float = 0.999, most_tables: int = 64, block: int = 1000) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    vec = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.col(id).isNotNull() & F.col(label).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    every = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.when(fine, vec).alias("vec"))
    # equal vectors of a label are one node that stands for several ids
    rows = staged(every.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))), "vectors")
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("least"), F.count_distinct("id").alias("weight")), "distinct")
    k, tables = tables_for(nodes.count(), cosine=cosine, width=width, recall=recall, most_tables=most_tables)
    keys = staged(bucketed(nodes, k=k, tables=tables, width=width), "buckets")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(shared, "key").join(nodes.select("node", "label", "vec"), "node")
    dealt = together(in_blocks(met, "key", "n", block, "node"), ["key", "block_i", "block_j"])
    comp = components(found_edges(dealt, cosine=cosine))
    sized = comp.join(comp.groupBy("root").agg(F.count("*").alias("size")), "root")
    members = sized.join(nodes, "node").select(F.col("root").alias("component"), "size", "node", "weight", "vec")
    counts = link_counts(members, cosine=cosine, block=block)
    all = nodes.select("node", "least", "weight").join(comp, "node", "left").join(counts, "node", "left")
    all = all.select("node", "least", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    all = all.join(all.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(all, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: The same in SQL, every pair of a label compared; components by walking the links.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, w.c AS component_id, e.vec_id = w.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON e.vec_id = n.a
JOIN (SELECT a, min(b) AS c FROM walk GROUP BY a) w ON e.vec_id = w.a
"""
