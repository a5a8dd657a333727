"""Mixing against SQL and by hand; the pipeline stage by stage against plain Python."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from test_bytes import check_packing
from test_links import brute
from test_spans import base_secrets

import corpus_pipeline
from cellweave.llm import mixing, quality, queries
from cellweave.llm.common import staged


def test_mixing_like_sql(spark, duck):
    same_rows(queries.op6_mixing(spark, SF), duck, mixing.SQL)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3, 1 over 1115 words: a and the null source stop at three times their size, then b, the rest is c's
    assert got["a"] == 30 and got[None] == 15 and got["b"] == 300 and got["c"] == pytest.approx(770)


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", "s"), (2, None, None), (3, "", "t"), (4, "w " * 50_000, "t"), (5, "one two", None), (-7, "neg", "s")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size int, place string")
    for per_bucket in (1, 100):
        got = mixing.mixed(df, per_bucket=per_bucket).collect()
        assert len(got) == len(rows)
        per = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1 and len(r.positions) == r.copies
            per.setdefault((r.source, r.target), []).append(r.taken)
        assert all(abs(sum(v) - t) <= 0.5 for (_, t), v in per.items())
        assert sum(t for _, t in per) == pytest.approx(sum(len((r[1] or "").split()) for r in rows))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_stage_with_repeated_ids(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "d e f g", "en", "s", 7), (2, "h i", "en", "s", 3), (2, "h i", "en", "s", 3), (3, "j " * 9, "en", "t", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter()
    for r in mixing.mixed(docs, keep=("text",)).collect():
        copies[r.doc_id, r.text] += r.copies
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({k: n for k, n in copies.items() if n})


def test_positions_follow_the_schedules(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    got = mixing.mixed(df)
    mean = {r.source: r.m for r in got.select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p").alias("m")).collect()}
    assert mean["0"] < mean["1"] < mean["2"]
    order = [r.position for r in got.collect()]
    assert order == sorted(order)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            keep = {r.doc_id for r in quality.score(docs, quality.fit(docs), keep=["doc_id"]).where("score >= 0.5").collect()}
            assert Counter(after) == Counter(r for r in before if r.doc_id in keep) and 0 < len(after) < len(before)
        elif name == "near_copies":
            classes = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {c for c, _ in classes.values()} and len(after) == len({r.doc_id for r in after})
        elif name == "secrets":
            texts = {r.doc_id: r.text for r in after}
            assert len(after) == len(before)
            for r in before:
                want, at = [], 0
                for _, s, e in base_secrets(r.text or ""):
                    if s >= at:
                        want += [(r.text or "")[at:s], "[SECRET]"]
                    at = max(at, e)
                assert texts[r.doc_id] == "".join(want) + (r.text or "")[at:]
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: c for i, c in copies.items() if c})
        else:
            check_packing(after, [(r.doc_id, r.text) for r in before])
        docs = out


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(i, f"The cat number {i} sat on the mat and it was a good day for all of them in the town of {i * 7}.", "en", "s", 90) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "A row without an id, and it is as good as the others are.", "en", "s", 50), (7, rows[7][1], "en", "s", 90), (102, rows[7][1], "fr", "t", 90), *((103 + k, "### $$$ &&& " * (20 + k), "en", "t", 200) for k in range(15))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("label", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert None in ids and 102 not in ids and 103 not in ids and len(ids) > 50
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
