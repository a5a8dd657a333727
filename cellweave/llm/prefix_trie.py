"""Conversations as a trie of shared turns: adaptive radix trees over blocks of sorted keys, merged level by level.

A turn is 16 bytes of a hash of its role and text, a conversation the bytes of its turns in order; that is its key. Keys
are range-sorted with their ids, so a crowd of equal keys is spread over tasks. Every task puts blocks of successive keys
into an adaptive radix tree (``art``); walking it gives the keys in order and the depths at which they part, and only
depths that are whole turns become nodes. Nodes that neither the first nor the last key of a block passes through
lie in no other block: they are finished on the spot, with everything below them. What is left of a block are the
two paths of its first and last key with partial sums at each depth. These paths are keys again and go through the
same work in larger blocks until few enough are left for a single one. Ids of members that end at a node
are hashed where the node's whole group is seen, and otherwise sent on as joined text in pieces, in order.

A task holds one block, and a conversation's turns as one row (about 200 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm import art
from cellweave.llm.common import staged

WIDTH = 16
#: Fixed value of the contract: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys or path depths of a block, ids of a piece of text, and paths that a single task can merge at any length.
BLOCK, PIECE, FEW = 20_000, 50_000, 64
_EMPTY = hashlib.sha256(b"").hexdigest()
_OPEN = "?"
_LISTS = ("n", "low", "children", "leaves", "saved")
_SCHEMA = pa.schema(
    [("kind", pa.int8()), ("id", pa.binary()), ("parent", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("text", pa.string()), ("key", pa.binary()), ("words", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in _LISTS]
    + [("ends", pa.list_(pa.string()))]
)
_DDL = (
    "kind tinyint, id binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "text string, key binary, words array<bigint>, n array<bigint>, low array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
)
_NODE, _PATH, _PIECE = 0, 1, 2


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of a hash of both, as hex."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * WIDTH)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, an array of (turn, id, words).

    Turns are ordered by ``turn``, null first, then by their hash. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation and are passed over.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), turn_id(F.col("role"), F.col("text")).alias("id"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


class _Path:
    """A key with what is known at each of its depths; low is None where nothing is known there."""

    __slots__ = ("children", "ends", "key", "leaves", "low", "n", "saved", "words")

    def __init__(self, key: bytes, words: list[int]):
        size = len(words) + 1
        self.key, self.words = key, words
        self.n, self.low, self.children, self.leaves, self.saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
        self.ends: list[str | None] = [None] * size

    def add(self, d: int, other: Any, e: int) -> None:
        """What ``other`` knows at its depth e, added at depth d."""
        self.n[d] += other.n[e]
        if other.low[e] is not None:
            self.low[d] = other.low[e] if self.low[d] is None else min(self.low[d], other.low[e])
        self.children[d] += other.children[e]
        self.leaves[d] += other.leaves[e]
        self.saved[d] += other.saved[e]
        if other.ends[e] is not None:
            self.ends[d] = other.ends[e]


class _Sink:
    """Rows as record batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def batches(self, least: int = 5000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=_SCHEMA)
            self.rows = []


def _digests(key: bytes) -> list[bytes]:
    """A name for the node at each depth of a key."""
    out = [hashlib.blake2b(b"", digest_size=16).digest()]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=16).digest())
    return out


def _block(items: list[_Path], out: list[dict], *, named: bool, last: bool) -> None:
    """The nodes that a block finishes, and the paths of its first and last key; ``last``: no other block is left.

    named: whether nodes carry their names, as those must that other blocks may have left children for.
    """
    root = art.Node(b"")
    for item in items:
        node = art.insert(root, item.key)
        if node.value is None:
            node.value = item
        else:
            for d in range(len(item.n)):
                node.value.add(d, item, d)
    first: _Path | None = None
    first_live = -1 if last else 0
    path = _Path(b"", [])  # the nodes from the root to where the walk is
    below: list[list[dict]] = [[]]  # finished children that wait for their parent's least member
    keys = path.words = [0]

    def opened(d: int, known: _Path, names: list[bytes]) -> None:
        known.add(d, path, d)
        for row in below[d]:
            row["parent"] = names[d]
            out.append(row)

    def close(d: int, names: list[bytes] | None) -> None:
        leaf = path.children[d] == 0
        saved = path.saved[d] + (path.n[d] - 1) * keys[d]
        ends = path.ends[d] or _EMPTY
        row = {"kind": _NODE, "conv_id": path.low[d], "depth": d, "n_convs": path.n[d], "n_children": path.children[d], "n_leaves": path.leaves[d] + leaf, "saved_tokens": saved, "text": ends}
        if names:
            row["id"] = names[d]
        for child in below[d]:
            child["parent_conv_id"] = path.low[d]
            out.append(child)
        if d:
            below[d - 1].append(row)
            path.children[d - 1] += 1
            path.leaves[d - 1] += row["n_leaves"]
            path.saved[d - 1] += saved
        else:
            out.append(row)

    def pop_to(depth: int, names: list[bytes] | None) -> None:
        nonlocal first_live
        while len(path.n) - 1 > depth:
            d = len(path.n) - 1
            if d <= first_live:
                opened(d, first, _digests(first.key))
                first_live = d - 1
            else:
                close(d, names)
            for values in (path.n, path.low, path.children, path.leaves, path.saved, path.ends, below, keys):
                values.pop()

    item, names = None, None
    for shared, node in art.walk(root):
        depth = shared // WIDTH
        if item is not None:
            pop_to(depth, names)
        item = node.value
        names = _digests(item.key) if named else None
        while len(path.n) < len(item.n):
            keys.append(item.words[len(path.n) - 1])
            for values, start in ((path.n, 0), (path.low, None), (path.children, 0), (path.leaves, 0), (path.saved, 0), (path.ends, None)):
                values.append(start)
            below.append([])
        for d in range(len(item.n)):
            path.add(d, item, d)
        if first is None and not last:
            first, first_live = _Path(item.key, item.words), len(item.n) - 1
    if last:
        pop_to(0, names)
        close(0, names)
        return
    final, names = _Path(item.key, item.words), _digests(item.key)
    for d in range(len(item.n)):
        opened(d, final, names)
    for known in (first, final) if first.key != final.key else (final,):
        out.append({"kind": _PATH, "key": known.key, "words": known.words, "ends": known.ends, **{c: getattr(known, c) for c in _LISTS}})


def _conversations(batches: Iterator[pa.RecordBatch], block: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations (key, conv_id, words), sorted by key and id."""
    sink, items, bulk = _Sink(), [], 0
    key, words, ids, count, low, cut = None, None, [], 0, None, True

    def send(name: bytes) -> None:
        nonlocal ids
        if ids:
            sink.rows.append({"kind": _PIECE, "id": name, "conv_id": ids[0], "text": ",".join(map(str, ids))})
        ids = []

    def finish(whole: bool) -> None:
        """The group of equal keys so far becomes an item; its ids are hashed here only if all of them were seen."""
        path = _Path(key, words)
        size = len(words) + 1
        path.n, path.low = [count] * size, [low] * size
        if whole:
            path.ends[-1] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        else:
            path.ends[-1] = _OPEN
            send(_digests(key)[-1])
        items.append(path)

    for batch in batches:
        for k, c, w in zip(*(batch.column(x).to_pylist() for x in ("key", "conv_id", "words"))):
            if k != key:
                if key is not None:
                    finish(not cut)
                    bulk += len(words) + 1
                    # A group that was sent on in pieces ends its block: its node stays open until the pieces are joined.
                    if bulk >= block or cut:
                        _block(items, sink.rows, named=False, last=False)
                        items, bulk = [], 0
                        yield from sink.batches()
                    cut = False
                key, words, ids, count, low = k, w, [], 0, c
            ids.append(c)
            count += 1
            low = min(low, c)
            if len(ids) >= piece:
                cut = True
                send(_digests(key)[-1])
    if key is not None:
        finish(False)
        _block(items, sink.rows, named=False, last=False)
    yield from sink.batches(1)


def _paths(batches: Iterator[pa.RecordBatch], block: int, few: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of paths, sorted by key."""
    sink, items, bulk = _Sink(), [], 0
    for batch in batches:
        for row in batch.select(["key", "words", *_LISTS, "ends"]).to_pylist():
            path = _Path(row["key"], row["words"])
            for c in (*_LISTS, "ends"):
                setattr(path, c, row[c])
            if not last and bulk >= block and len(items) >= few and path.key != items[-1].key:
                _block(items, sink.rows, named=True, last=False)
                items, bulk = [], 0
                yield from sink.batches()
            items.append(path)
            bulk += len(path.n)
    if items:
        _block(items, sink.rows, named=True, last=last)
    yield from sink.batches(1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces joined by commas; pieces come sorted, one group after the other."""
    name, sha, done = None, None, []
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if i != name:
                if sha:
                    done.append((name, sha.hexdigest()))
                name, sha = i, hashlib.sha256()
                sha.update(t.encode())
            else:
                sha.update(b"," + t.encode())
    if sha:
        done.append((name, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["_id", "_ends"])


def _mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
    return staged(rows.mapInArrow(work, _DDL), name)


def trie(sequences: DataFrame, *, block: int = BLOCK, piece: int = PIECE, few: int = FEW) -> DataFrame:
    """A row for each distinct sequence of first turns, from the empty one on, of (conv_id, turns: array of id, words).

    conv_id: the smallest member; depth; parent_conv_id: the smallest member of the node one turn shorter (null at the
    root); n_convs: members; n_children; n_leaves: nodes without children in its subtree, itself included;
    saved_tokens: over its subtree, (members - 1) times the words of a node's last turn; ends_sha256: of the ids of members
    that end there, ascending, joined by commas. Ids of turns are hex of 16 bytes. A conversation without turns ends
    at the root. Conversations of one id are members side by side. No conversations, no rows.
    """
    if few < 4:
        raise ValueError("a part must take in more paths than it leaves")
    id = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key")
    keyed = staged(sequences.select(id, "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")), "trie-keys")
    keyed = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    levels = [_mapped(keyed, lambda b: _conversations(b, block, piece), "trie-blocks")]
    while True:
        paths = levels[-1].where(F.col("kind") == _PATH)
        count, bulk = paths.agg(F.count("*"), F.sum(F.size("n"))).first()
        last = count <= few or bulk <= block
        if not count:
            break
        parts = max(1, count // few)  # a part leaves two paths at most, so every level has at most 2 / few as many
        paths = (paths.coalesce(1) if last else paths.repartitionByRange(parts, "key")).sortWithinPartitions("key")
        levels.append(_mapped(paths, lambda b, last=last: _paths(b, block, few, last), "trie-paths"))
        if last:
            break
    rows = reduce(DataFrame.unionByName, levels)
    nodes = rows.where(F.col("kind") == _NODE)
    pieces = levels[0].where(F.col("kind") == _PIECE).select("id", "conv_id", "text")
    ends = pieces.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(_hashed, "_id binary, _ends string")
    named = nodes.where(F.col("id").isNotNull())
    open_ends = named.where(F.col("text") == _OPEN).join(ends, F.col("id") == F.col("_id")).withColumn("text", F.col("_ends")).select(*nodes.columns)
    whole = nodes.where(F.col("text") != _OPEN).unionByName(open_ends)
    parents = named.select(F.col("id").alias("_parent"), F.col("conv_id").alias("_parent_conv"))
    # Most rows know their parent; the others are joined to the few nodes that blocks left open.
    waiting = whole.where(F.col("parent").isNotNull()).join(parents, F.col("parent") == F.col("_parent")).withColumn("parent_conv_id", F.col("_parent_conv"))
    whole = whole.where(F.col("parent").isNull()).unionByName(waiting.select(*whole.columns))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("text").alias("ends_sha256"))


#: The query's rows in SQL, where no two rows share a conversation and turn: rebuilt conversations, all their prefixes
#: grouped, and each node's figures summed over its ancestors. The unsigned CRC32 of an id is worked out bit by bit.
SQL = r"""
WITH t AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST) AS own, conv_id::VARCHAR AS s FROM t GROUP BY conv_id),
h AS (SELECT *, (xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(len(s)), lambda i: list_concat([ascii(s[i + 1])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4)::INT AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, d, array_to_string(list_transform(turns[1:d], lambda x: x.k), '') AS id, CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), '') END AS up, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
g AS (SELECT id, d, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY id, d),
k AS (SELECT up AS id, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT left(g.id, 32 * e) AS id, (k.n IS NULL)::INT AS leaf, (n_convs - 1) * w AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM g) g LEFT JOIN k ON k.id = g.id),
s AS (SELECT id, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY id)
SELECT g.conv_id, g.d::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN g u ON u.id = g.up LEFT JOIN k ON k.id = g.id JOIN s ON s.id = g.id
"""
