"""Toxicity and quality: held-out accuracy and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellweave.llm import ftrl, quality, queries, toxicity

SCHEMA = "doc_id long, text string, score string, _text string, key string"


def odd(spark):
    rows = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (None, "some words here", None, None, None), (4, "word " * 60_000, "a", "b", "c"), (5, "same", "a", "b", "c"), (5, "same", "a", "b", "c"), (6, "\x00 ñ 漢字 🙂 ퟿", "a", None, "c")]
    return spark.createDataFrame(rows, SCHEMA)


def labelled(spark, n=1600):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rnd.choices(vocabulary, k=rnd.randint(5, 60))
        if i % 5 == 0:
            for _ in range(2):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["vile", "nasty", "foul"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(300), 5)
    key = rng.integers(10, 60, 1500).astype(np.uint64)
    y = (np.arange(300) % 3 == 0).astype(float)
    key[::5] = np.where(y > 0, 1, 2)
    order = np.lexsort((key, row))
    w = ftrl.train(ftrl.Sparse(row[order], key[order], np.ones(1500), 300), y, epochs=5, alpha=0.5, beta=1, l1=4, l2=0, least_rows=3)
    assert len(w.key) < 20 and dict(zip(w.key.tolist(), w.weight))[1] > 1


def test_toxicity_held_out(spark):
    rows = labelled(spark)
    w = toxicity.fit(rows.where("id % 2 = 0"))
    got = toxicity.score(rows.where("id % 2 = 1").withColumnRenamed("id", "doc_id"), w, keep=["doc_id", "label"]).collect()
    assert np.mean([(r.score >= 0.7) == (r.label == 1) for r in got]) > 0.97
    again = toxicity.fit(rows.where("id % 2 = 0").repartition(3))
    assert np.array_equal(again.key, w.key) and np.allclose(again.weight, w.weight)


def test_toxicity_odd_rows(spark):
    w = toxicity.fit(labelled(spark))
    got = toxicity.score(odd(spark), w, keep=odd(spark).columns)
    rows = got.collect()
    assert len(rows) == 7 and got.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in rows)
    empty = {r.doc_id: r.score for r in rows}
    assert empty[1] == empty[2]
    assert toxicity.score(odd(spark).limit(0), w, keep=["doc_id"]).count() == 0
    none = toxicity.fit(labelled(spark).limit(0))
    assert {r.score for r in toxicity.score(odd(spark), none, keep=["doc_id"]).collect()} == {0.5}
    assert toxicity.fit(labelled(spark).withColumn("label", F.lit(None).cast("int"))).bias == 0


def test_op1_contract(spark):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_em_separates_junk_patterns():
    silent = 3**6 - 1
    good = silent - 2  # the last labeller says good
    junk = silent - 3**5  # the first says junk
    p = quality.posterior({silent: 50, good: 900, junk: 50})
    assert p[junk] > 0.9 and p[good] < 0.1
    assert quality.posterior({}) == {}


def test_quality_on_labelled_documents(spark):
    got = queries.op10_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97


def test_quality_odd_rows(spark):
    w = quality.fit(odd(spark))
    rows = quality.score(odd(spark), w, keep=odd(spark).columns).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd(spark).limit(0), quality.fit(odd(spark).limit(0)), keep=["doc_id"]).count() == 0


def test_samples_with_repeated_ids(spark):
    """One id with many rows is one row of the quality sample; ties of the toxicity sample don't depend on the order of rows."""
    rows = [(1, f"text number {i} with some words.") for i in range(300)] + [(i, f"A line, and another {i}. The end!") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.fit(d, max_rows=20) for d in (docs.repartition(3), docs.orderBy("text").coalesce(1)))
    assert (a.key == b.key).all() and np.allclose(a.weight, b.weight) and a.bias == pytest.approx(b.bias)
    labelled = docs.selectExpr("doc_id AS id", "text", "cast(doc_id = 1 AS int) AS label")
    a, b = (toxicity.fit(d, max_rows=40, l1=0.1) for d in (labelled.repartition(3), labelled.orderBy("text").coalesce(1)))
    assert (a.key == b.key).all() and np.allclose(a.weight, b.weight)
