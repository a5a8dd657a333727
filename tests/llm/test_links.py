"""Near copies of texts and vectors against brute force, and odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest import SF, same_rows

from cellweave.llm import linking, near_text, near_vectors, queries


def brute(rows, n=5, similarity=0.8):
    """class_id and n_links by comparing every pair of sets of word n-grams."""
    texts = {}
    for i, t in rows:
        w = re.findall(r"(?:[A-Za-z0-9']|[^\x00-\x7f])+", (t or "").lower())
        texts[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    ids = sorted(texts)
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if texts[a] and texts[b] and len(texts[a] & texts[b]) >= similarity * len(texts[a] | texts[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}


def near(rnd, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rnd.randrange(len(w))] = rnd.choice("qrstuv") * 3 + str(rnd.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(1, 6)))
    rows = [(None, "no id at all in this row")]
    for g in range(12):
        base = [word() for _ in range(rnd.choice([4, 6, 60, 200]))]
        for _ in range(rnd.randint(1, 9)):
            rows.append((len(rows), near(rnd, base, rnd.choice([0, 0, 1, 2, 3]))))
    base = [word() for _ in range(150)]
    rows += [(1000 + k, near(rnd, base, k % 3)) for k in range(60)]  # a group larger than a block below
    rows += [(2000, None), (2001, ""), (2002, " ?!"), (2003, "one"), (2004, "ONE!"), (2005, "x " * 30_000), (2006, "x " * 29_000)]
    return rows


def test_jaccard_classes_like_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in texts], "doc_id long, text string, key string, h1 int").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_text.classes(df, block=16).collect()}
    assert got.pop(None) == (None, 0)
    assert got == brute([x for x in texts if x[0] is not None])


def test_jaccard_repeated_and_empty(spark):
    df = spark.createDataFrame([(7, "a b c d e f g"), (7, "a b c d e f g"), (3, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_text.classes(df).collect()) == [(3, 3, 1), (7, 3, 1), (7, 3, 1)]
    assert near_text.classes(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "nothing alike here at all"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_text.classes(alone).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_recall_is_estimated_from_the_links_found():
    chance = near_text.meeting_chance
    # links of one similarity, found in proportion to their chance, are estimated at that chance
    got = near_text.estimated_recall({0.9: 10**9}, 6, 4, trees=16, similarity=0.8)
    assert got == pytest.approx(chance(0.9, 4, 16), abs=1e-6)
    # without links the threshold decides
    assert near_text.estimated_recall({}, 6, 5, trees=16, similarity=0.8) == pytest.approx(chance(0.8, 5, 16))
    assert chance(0.8, 4, 16) >= near_text.RECALL > chance(0.8, 5, 16)


def test_prefix_is_shortened_while_links_are_missed(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(60):
        base = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(100)]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, near(rnd, base, 2)), (3 * g + 2, near(rnd, base, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    # one tree of long prefixes misses links unless it is shortened
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_text.classes(df, trees=4, depth=8, recall=0.999).collect()}
    assert got == want and sum(n for _, n in want.values()) > 60


def test_one_of_each_keeps_different_texts_of_an_id(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "one two three four five six"
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, c, "x"), (3, c, "y"), (3, c, "y"), (4, None, "x"), (4, None, "x"), (4, "", "z"), (None, a, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = near_text.one_of_each(df.withColumnRenamed("_row", "lang"))
    assert got.columns == ["doc_id", "text", "lang"]
    out = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert out == sorted([(1, a), (1, b), (3, c), (4, out[[x[0] for x in out].index(4)][1]), (None, a), (None, a)], key=str)
    again = near_text.one_of_each(df.withColumnRenamed("_row", "lang").repartition(7))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert near_text.one_of_each(df.withColumnRenamed("_row", "lang").limit(0)).count() == 0


def test_groups_that_span_batches_stay_whole():
    frame = pd.DataFrame({"k": np.repeat(np.arange(30), np.arange(30) % 7 + 1)})
    batches = [frame.iloc[a : a + 9] for a in range(0, len(frame), 9)]
    seen = [f["k"].to_numpy()[g == n] for f, g in linking.whole_groups(iter(batches), ["k"], 10) for n in np.unique(g)]
    assert [len(x) for x in seen] == [n % 7 + 1 for n in range(30)] and all(len(set(x)) == 1 for x in seen)


def test_every_pair_of_blocks_meets(spark):
    rows = spark.createDataFrame([(1, i, 40) for i in range(40)], "g int, i long, n long")
    met = set()
    for (_, a, b), part in linking.in_blocks(rows, "g", "n", 7, "i").toPandas().groupby(["g", "block_i", "block_j"]):
        for x in part.itertuples():
            for y in part.itertuples():
                if x.i < y.i and (a == b or x.own != y.own):
                    assert (x.i, y.i) not in met
                    met.add((x.i, y.i))
    assert len(met) == 40 * 39 // 2


def test_vectors_like_sql(spark, duck):
    same_rows(queries.op5_vectors(spark, SF), duck, near_vectors.SQL)


def test_vectors_odd_rows_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    rows = [(int(i), (base[i % 6] + 0.12 * rng.standard_normal(16)).tolist(), int(i % 2), "x") for i in range(120)]
    rows += [(200, None, 1, "x"), (201, [0.0] * 16, 1, "x"), (202, [float("nan")] + [1.0] * 15, 1, "x"), (203, [None] + [1.0] * 15, 1, "x"), (204, [float("inf")] * 16, 1, "x"), (205, rows[1][1], None, "x"), (206, rows[1][1], 1, "x"), (207, [1e300] * 16, 1, "x"), (208, [1.0] * 16, 1, "x"), (209, [1.0] * 3, 1, "x"), (210, [], 1, "x"), (None, rows[1][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df, block=10).collect()}
    parent, links = {r[0]: r[0] for r in rows if r[0] is not None}, dict.fromkeys((r[0] for r in rows), 0)

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    fine = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    for x, a in enumerate(fine):
        for b in fine[:x]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = (np.array(z[1]) / max(map(abs, z[1])) for z in (a, b))
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    parent[max(p, q)] = min(p, q)
    for i in parent:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(i), find(i) == i), i
    assert got[None].component_id is None and not got[None].kept
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
