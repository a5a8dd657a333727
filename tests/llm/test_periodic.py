"""Runs of words and their extensions against brute force; odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from cellweave.llm import periodic, queries
from cellweave.llm.lce import Extensions


def brute_runs(words, shortest=6, exponent=4):
    """Every maximal stretch with its smallest period, by looking at each period in turn."""
    n, seen = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, exponent * p):
                seen.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in seen.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(doc_id, text):
    """The contract's row, from the given text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{k},{p}\n" for s, k, p in found)), sha(collapsed(words, found)))


@pytest.mark.parametrize("seed", range(4))
def test_extensions_like_brute_force(seed):
    rnd = random.Random(seed)
    values, segment, wall = [], [], 10
    for s in range(rnd.randint(1, 5)):
        unit = [rnd.randrange(rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 40))]
        part = (unit * 12)[: rnd.randint(1, 300)] + [rnd.randrange(3) for _ in range(rnd.randint(0, 50))]
        values += [*part, wall]
        segment += [s] * (len(part) + 1)
        wall += 1
    values, segment = np.array(values), np.array(segment)
    e = Extensions(values, segment)
    a, b = np.array([(i, j) for i in range(len(values)) for j in rnd.sample(range(len(values)), 12) if i != j and segment[i] == segment[j]]).T
    got = e.of(a, b)
    for i, j, k in zip(a.tolist(), b.tolist(), got.tolist()):
        want = 0
        while max(i, j) + want < len(values) and values[i + want] == values[j + want]:
            want += 1
        assert k == want, (i, j)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_find_like_brute_force(seed, exponent):
    rnd = random.Random(seed)
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rnd.randint(0, 6)):
            unit = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randint(1, 9))]
            words += (unit * 30)[: rnd.randint(1, 90)]
        texts.append(words)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periodic.find(np.array([w for t in texts for w in t], int), first, shortest=6, exponent=exponent)
    for k, words in enumerate(texts):
        mine = [tuple(int(x[i]) for x in got[1:]) for i in np.flatnonzero(got[0] == k)]
        assert mine == brute_runs(words, 6, exponent), words


def test_query_like_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id] == digest(r.doc_id, r.text), r.doc_id


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 40_000), (5, "x y " * 5), (5, "x y " * 5), (None, "w w w w w w"), (6, "é é é é " * 3), (7, "b " * 5), (8, "c " * 6 + "d " * 7)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, runs string").repartition(3)
    for chunk in (10, periodic.CHUNK):
        out = periodic.runs(df, keep=df.columns, chunk=chunk)
        assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
        for r in out.collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            want = brute_runs(words) if r.doc_id != 4 else [(0, 40_000, 1)]
            assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, collapsed(words, want)), r
    assert periodic.runs(df.limit(0), keep=["doc_id"]).count() == 0
