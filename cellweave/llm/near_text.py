"""N-gram Jaccard join of whole texts by a MinHash LSH forest, with exact verification.

Texts are known by the hash of their word sequence, so copies meet once. Each distinct text gets ``trees`` x ``depth``
MinHash values of its word shingles. A tree is the trie of the texts' value sequences: Spark deals the texts by tree and
prefix and sorts them by their whole sequence, so the longest common prefixes stand together. The join begins with the
longest prefix, ``depth`` values. Texts that share one in some tree are compared by all their values, and pairs that
look similar (far below the threshold, so that chance loses none) join candidate components. The links found, weighted
by the inverse of the chance that a pair of their similarity meets at this prefix, tell how many there are in all, and
so the recall; while it is below the target, the prefix is shortened to the longest that promises it, and texts that
share a prefix but not yet a component are compared. One link at the threshold is always added to the estimate, so
that few links, or none, shorten the prefix to what the target asks for at the threshold. Within each component all
pairs are then verified exactly on their shingle sets. A group or component with many texts is cut into blocks, and
every pair of blocks is a task's work of its own, so no task holds more than two blocks and no pair is lost.

Words are runs of letters, digits, apostrophes and characters beyond ASCII, in lower case. A text of fewer words than
a shingle has one shingle of all of them. Texts without words (null, empty, only signs) link with nothing. Rows with a
null id are returned with a null class and take part in nobody's links. Repeated rows of one id count once as a
document; if their texts differ, each takes part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import chunks, staged, texts
from cellweave.llm.linking import components, in_blocks, least_reachable, meeting, together, whole_groups
from cellweave.llm.words import mix, runs, words

SHINGLE, SIMILARITY = 5, 0.8
#: Trees, values of a tree's longest prefix, and the share of links that the forest is to find.
TREES, DEPTH, RECALL = 16, 6, 0.9995
#: How far below the threshold an estimate from all MinHash values may fall before a pair is passed over, in standard deviations.
SIGMAS = 5.0


def meeting_chance(similarity: float, prefix: int, trees: int) -> float:
    """Chance that two texts of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def estimated_recall(links: dict[float, int], found_at: int, prefix: int, *, trees: int, similarity: float) -> float:
    """The share of all links that a prefix finds, from the numbers of links by similarity that ``found_at`` has found.

    A link stands for as many as the inverse of its chance; one link at the threshold is added to those found.
    """
    total = met = 0.0
    for s, n in [*links.items(), (similarity, 1)]:
        stands_for = n / meeting_chance(s, found_at, trees)
        total += stands_for
        met += stands_for * meeting_chance(s, prefix, trees)
    return met / total


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (s[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhashes(shingles: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (uint32) of each text; texts without shingles get the largest value."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(begin))
    out = np.full((len(begin) - 1, n), np.uint32(0xFFFFFFFF))
    if not len(some):
        return out
    first, second = _salts(n)
    for k in range(n):
        x = low * first[k]
        x ^= x >> np.uint32(15)
        x *= second[k]
        x ^= x >> np.uint32(13)
        out[some, k] = np.minimum.reduceat(x, begin[some])
    return out


def text_keys(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    of = w.text_of()
    place = (np.arange(len(of)) - w.first[:-1][of]).astype(np.uint64)
    out = []
    for salt in (0x51, 0xA7):
        each = mix(w.hash + mix(place + np.uint64(salt << 40)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        out.append(mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row; maps have none and are left out."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def signed(docs: DataFrame, *, id: str, text: str, trees: int, depth: int, shingle: int, most_chars: int = 1_000_000) -> DataFrame:
    """(id, row, h1, h2, n_words, sig): each document's id, row hash, text keys and MinHash values."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "text", most_chars):
            w = words(texts(frame["text"]))
            h1, h2 = text_keys(w, len(frame))
            sig = minhashes(*runs(w.hash, w.first, shingle), trees * depth)
            width = sig.shape[1] * 4
            raw = sig.tobytes()
            yield pd.DataFrame({"id": frame["id"], "row": frame["row"], "h1": h1, "h2": h2, "n_words": np.diff(w.first), "sig": [raw[i * width : (i + 1) * width] for i in range(len(frame))]})

    rows = docs.select(F.col(id).cast("long").alias("id"), row_hash(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(sign, "id long, row long, h1 long, h2 long, n_words long, sig binary")


def candidate_links(nodes: DataFrame, *, trees: int, depth: int, prefix: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b, alike) between roots of texts that share a prefix in some tree and look similar by all their values.

    nodes: h1, root (what the text is already linked with), sig. alike: the share of equal values.
    """
    width = 4 * depth
    tree = [F.xxhash64(F.lit(t), F.substring("sig", t * width + 1, 4 * prefix)) for t in range(trees)]
    keys = nodes.select("h1", "root", F.posexplode(F.array(*tree)).alias("tree", "key"))
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    shared = met.where("_low < _high").select("key", "n")  # else all is linked already
    rows = keys.join(shared, "key").join(nodes.select("h1", "sig"), "h1")
    rows = rows.withColumn("sequence", F.expr(f"substring(sig, tree * {width} + 1, {width})"))
    dealt = together(in_blocks(rows, "key", "n", block, "h1"), ["key", "block_i", "block_j"], then=["sequence"])
    n = trees * depth
    floor = n * max(0.0, similarity - SIGMAS * (similarity * (1 - similarity) / n) ** 0.5)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in whole_groups(batches, ["key", "block_i", "block_j"], 4096):
            root = frame["root"].to_numpy()
            sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), n)
            cross = (frame["block_i"] != frame["block_j"]).to_numpy()
            _, first, which = np.unique(root, return_index=True, return_inverse=True)
            label, best = first[which], np.zeros(len(frame))
            for a, b in meeting(group, frame["own"].to_numpy(), cross):
                apart = np.flatnonzero(label[a] != label[b])  # what is linked already need not be compared
                a, b = a[apart], b[apart]
                for at in range(0, len(a), 1 << 15):
                    x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                    same = (sig[x] == sig[y]).sum(1)
                    alike = np.flatnonzero(same >= floor)
                    if len(alike):
                        np.maximum.at(best, x[alike], same[alike] / n)
                        np.maximum.at(best, y[alike], same[alike] / n)
                        label = least_reachable(x[alike], y[alike], len(frame), label)
            moved = np.flatnonzero(root != root[label])
            yield pd.DataFrame({"a": root[moved], "b": root[label[moved]], "alike": best[moved]})

    return dealt.mapInPandas(link, "a long, b long, alike double").groupBy("a", "b").agg(F.max("alike").alias("alike"))


#: A round that found too little shortens the prefix by so many values at least: every round reads all texts' keys.
STRIDE = 2


def candidate_components(distinct: DataFrame, *, trees: int, depth: int, similarity: float, recall: float, block: int) -> DataFrame:
    """(node, root) of texts that candidate links reach, the prefix shortened until the links found promise ``recall``."""
    comp, found, prefix = None, {}, depth
    while True:
        nodes = distinct.select("h1", F.col("h1").alias("root"), "sig")
        if comp is not None:
            nodes = distinct.select("h1", "sig").join(comp.withColumnRenamed("node", "h1"), "h1", "left").select("h1", F.coalesce("root", "h1").alias("root"), "sig")
        links = staged(candidate_links(nodes, trees=trees, depth=depth, prefix=prefix, similarity=similarity, block=block), "links")
        for r in links.where(F.col("alike") >= similarity).groupBy(F.round("alike", 2).alias("s")).agg(F.count("*").alias("n")).collect():  # at most 100 rows
            found[r.s] = found.get(r.s, 0) + r.n
        made = components(links.select("a", "b"))
        if comp is not None:  # the new components are of roots
            above = made.select(F.col("node").alias("root"), F.col("root").alias("_above"))
            old = comp.join(above, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
            made = staged(old.union(made.join(comp.select("node"), "node", "left_anti")), "components")
        comp = made
        at = prefix
        while prefix > 1 and estimated_recall(found, at, prefix, trees=trees, similarity=similarity) < recall:
            prefix -= 1
        if prefix == at:
            return comp
        prefix = max(1, min(prefix, at - STRIDE))  # a shorter prefix finds all that a longer one does


def verified(members: DataFrame, *, shingle: int, similarity: float, block: int) -> DataFrame:
    """Exact links within components: rows (a, b, n). With b = a, text a is linked with n documents of other texts.

    ``members``: component, size, h1, h2, copies and text of each distinct text. Rows with other b are spanning links.
    """
    dealt = together(in_blocks(members, "component", "size", block, "h1"), ["component", "block_i", "block_j"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in whole_groups(batches, ["component", "block_i", "block_j"], 256):
            w = words(texts(frame["text"]))
            h1, h2 = text_keys(w, len(frame))
            # an id may stand for several texts; only the text that the key names is this member
            right = (h1 == frame["h1"].to_numpy()) & (h2 == frame["h2"].to_numpy())
            shingles, begin = runs(w.hash, w.first, shingle)
            sets = [np.unique(shingles[begin[i] : begin[i + 1]]) if right[i] else None for i in range(len(frame))]
            node, copies, own = frame["h1"].to_numpy(), frame["copies"].to_numpy(), frame["own"].to_numpy()
            cross = (frame["block_i"] != frame["block_j"]).to_numpy()
            out: list[tuple] = []
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for start, end in zip(edges[:-1], edges[1:]):
                at = {node[i]: i for i in range(start, end) if sets[i] is not None}
                if len(at) > 1:
                    at = np.array(sorted(at.values()))
                    out += _links([sets[i] for i in at], node[at], copies[at], own[at], cross[start], similarity)
            yield pd.DataFrame(out, columns=["a", "b", "n"], dtype="int64")

    return dealt.mapInPandas(verify, "a long, b long, n long")


def _links(sets: list[np.ndarray], node: np.ndarray, copies: np.ndarray, own: np.ndarray, cross: bool, similarity: float) -> list[tuple]:
    """Counts and spanning links among sets, all pairs compared through their shared elements a slice at a time."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = np.array([[size[0], len(np.intersect1d(*sets, assume_unique=True))], [0, size[1]]], float)
        both[1, 0] = both[0, 1]
    else:
        key, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(key), -1)
        place[shared] = np.arange(len(shared))
        column = place[index]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), np.float32)
        step = max(256, (1 << 22) // m)
        for low in range(0, len(shared), step):
            part = slice(*np.searchsorted(column, [low, low + step]))
            grid = np.zeros((m, min(step, len(shared) - low)), np.float32)
            grid[row[part], column[part] - low] = 1
            both += grid @ grid.T
    linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    linked &= ~np.eye(m, dtype=bool)
    if cross:
        linked &= own[:, None] != own[None, :]
    total = linked @ copies
    out = [(int(node[i]), int(node[i]), int(total[i])) for i in np.flatnonzero(total)]
    a, b = np.nonzero(np.triu(linked))
    label = least_reachable(a, b, m)
    return out + [(int(node[i]), int(node[label[i]]), 0) for i in range(m) if label[i] != i]


def _classed(docs: DataFrame, *, id: str, text: str, shingle: int, similarity: float, trees: int, depth: int, recall: float, block: int, words_each: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row, h1, h2) of ``docs`` and distinct texts (h1, h2, root, class_id, n_links) of those with words and an id."""
    rows = staged(signed(docs, id=id, text=text, trees=trees, depth=depth, shingle=shingle), "signed")
    worded = rows.where("n_words > 0 and id is not null")
    once = worded.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count_distinct("id").alias("copies"), F.first("n_words").alias("n_words"), F.first("sig").alias("sig"))
    distinct = staged(once, "distinct")
    comp = candidate_components(distinct, trees=trees, depth=depth, similarity=similarity, recall=recall, block=block)
    texts_of = comp.withColumnRenamed("node", "h1").join(distinct.drop("sig"), "h1")
    # long texts count for several, so that a block's words are bounded as well
    size = F.greatest(F.count("*"), F.ceil(F.sum("n_words") / F.lit(words_each)).cast("long"))
    sized = texts_of.join(texts_of.groupBy("root").agg(size.alias("size")), "root")
    members = sized.select(F.col("root").alias("component"), "size", "h1", "h2", "copies", "least")
    bodies = docs.select(F.col(id).cast("long").alias("least"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = staged(verified(members.join(bodies, "least"), shingle=shingle, similarity=similarity, block=block), "verified")
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("others"))
    comp = components(found.select("a", "b"))
    node = distinct.select("h1", "h2", "least", "copies").join(counts.withColumnRenamed("a", "h1"), "h1", "left").join(comp.withColumnRenamed("node", "h1"), "h1", "left")
    node = node.select("h1", "h2", "least", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "h1").alias("root"))
    least = node.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.select("id", "row", "h1", "h2"), node.join(least, "root").select("h1", "h2", "root", "class_id", (F.col("copies") - 1 + F.col("others")).alias("n_links"))


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = 1000, words_each: int = 1000) -> DataFrame:
    """(id, class_id, n_links) for each row of ``docs``.

    class_id: the least id that links reach, itself included; n_links: the documents that it is linked with directly.
    A block of a component holds about ``block`` texts, and about ``block`` times ``words_each`` words; a longer text counts
    for as many texts, so a very long one is a block with few others. Null and empty texts are linked with nothing.
    """
    rows, node = _classed(docs, id=id, text=text, shingle=shingle, similarity=similarity, trees=trees, depth=depth, recall=recall, block=block, words_each=words_each)
    out = rows.select("id", "h1", "h2").join(node, ["h1", "h2"], "left")
    alone = F.col("class_id").isNull() | F.col("id").isNull()
    return out.select(F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = 1000, words_each: int = 1000) -> DataFrame:
    """The rows of ``docs`` without all but one of each class of near copies: that of least id, text hash and row hash.

    Classes are of texts, so an id with two different texts keeps both unless they are near copies. A text without
    words is alone; of its repeated rows of one id one stays. Rows without an id all stay.
    """
    rows, node = _classed(docs, id=id, text=text, shingle=shingle, similarity=similarity, trees=trees, depth=depth, recall=recall, block=block, words_each=words_each)
    own = rows.where("id is not null").join(node.select("h1", "h2", "root"), ["h1", "h2"], "left")
    kept = own.groupBy("root", F.when(F.col("root").isNull(), F.struct("id", "h1", "h2")).alias("_alone")).agg(F.min(F.struct("id", "h1", "h2", "row")).alias("k"))
    kept = kept.select(F.col("k.id").alias("_kept"), F.col("k.row").alias("_row"))
    named = docs.withColumns({"_kept": F.col(id).cast("long"), "_row": row_hash(docs)})
    # rows alike in every column have the same hash; one of them stays
    some = named.join(kept, ["_kept", "_row"], "left_semi").dropDuplicates(["_kept", "_row"])
    return some.select(*docs.columns).union(docs.where(F.col(id).isNull()))
