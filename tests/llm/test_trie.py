"""Radix trees against a dictionary, the trie against brute force, with blocks of all sizes; odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import SF, same_rows

from cellweave.llm import art, prefix_trie, queries


def brute(sequences):
    """Contract rows of [(conv_id, [(role, text), ...])]."""
    members, ends, nodes = defaultdict(list), defaultdict(list), set()
    for c, turns in sequences:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    nodes = sorted(members, key=len, reverse=True)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    out = []
    for p in nodes:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] += below[p] == 0
        saved[p] += (len(members[p]) - 1) * words
        if p:
            below[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), below[p], leaves[p], saved[p], sha))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rebuilt(table):
    own = defaultdict(list)
    for r in table:
        own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out.append((c, own.get(c - c % 20, [])[:h] + turns[h:]))
    return out


@pytest.mark.parametrize("letters, n", [(2, 300), (30, 500), (256, 3000)])
def test_radix_tree(letters, n):
    rnd = random.Random(letters)
    keys = {bytes(rnd.randrange(letters) for _ in range(rnd.choice([0, 1, 2, 5, 9]))) for _ in range(n)} | {b"\0" * 40, b"\0" * 39 + b"\1"}
    root = art.Node(b"")
    for k in rnd.sample(sorted(keys), len(keys)):
        art.insert(root, k).value = k
    walked = list(art.walk(root))
    assert [node.value for _, node in walked] == sorted(keys)
    for (_, a), (shared, b) in zip(walked, walked[1:]):
        want = next((i for i, (x, y) in enumerate(zip(a.value, b.value)) if x != y), min(len(a.value), len(b.value)))
        assert shared == want
    stack = [root]
    while stack:
        node = stack.pop()
        below = list(node.in_order())
        stack += below
        assert node.layout == next(size for size in (4, 16, 48, 256) if len(below) <= size)
        assert node is root or (node.prefix and (node.value is not None or len(below) > 1))


def test_query_like_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert rows(queries.op12_trie(spark, SF)) == brute(rebuilt(table))


def test_query_like_sql(spark, duck):
    same_rows(queries.op12_trie(spark, SF), duck, prefix_trie.SQL)


@pytest.mark.parametrize("block, piece, few", [(1, 1, 4), (7, 3, 5), (20_000, 50_000, 64)])
def test_trie_in_blocks(spark, block, piece, few):
    rnd = random.Random(block)
    talk = [(("user", "assistant")[d % 2], f"t{rnd.randrange(3)} " * rnd.randint(0, 3)) for d in range(12)]
    made = [(c, [rnd.choice(talk) for _ in range(rnd.choice([0, 1, 2, 3, 8]))]) for c in rnd.sample(range(-50, 400), 120)]
    made += [(1000 + c, talk) for c in range(40)] + [(2000, talk * 20), (2001, talk * 20), (2001, talk[:3])]
    table = [(c, d, *t) for c, turns in made[:-1] for d, t in enumerate(turns)]
    base = prefix_trie.sequences(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5))
    empty = base.limit(1).selectExpr("explode(array(0, 0)) AS x", "slice(turns, 1, 0) AS turns")
    empty = empty.selectExpr("cast(5000 + x AS bigint) AS conv_id", "turns").limit(1)
    three = base.where("conv_id = 2001").selectExpr("conv_id", "slice(turns, 1, 3) AS turns")
    got = rows(prefix_trie.trie(base.unionByName(empty).unionByName(three), block=block, piece=piece, few=few))
    assert got == brute([m for m in made if m[1]] + [(5000, [])])


def test_odd_rows(spark):
    table = [(20, 0, None, None), (20, 1, "user", ""), (21, None, "user", "a b"), (21, 5, "user", "c"), (22, 0, "", ""), (22, 0, "", ""), (None, 0, "user", "lost"), (7, 3, "user", "w " * 60_000), (-3, 0, "user", "neg")]
    df = spark.createDataFrame([(*r, "x") for r in table], "conv_id long, turn long, role string, text string, n_convs string")
    got = rows(prefix_trie.trie(prefix_trie.sequences(df)))
    turns = defaultdict(list)
    for c, t, r, x in sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in table if c is not None)):
        turns[c].append((r, x))
    assert got == brute(list(turns.items()))
    assert rows(prefix_trie.trie(prefix_trie.sequences(df.limit(0)))) == []
