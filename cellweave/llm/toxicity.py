"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs one or two words apart are hashed to 64 bits; a text has a feature or not.
Training takes at most ``max_rows`` labelled texts (those with the least hashes of their ids), dealt to ``shards``
tasks of equal expected size (one by default, as the sample is small); each runs FTRL over its texts and Spark
averages the shards' sparse weights. Features that more than exp(-``common``) of the sample have count nothing. The
result, which is sent to every task that scores, is bounded by the sample, whatever the corpus: only features that
``least_rows`` of its texts share can have a weight, and L1 leaves a few hundred of them.

Null texts count as empty; an empty text gets the intercept's probability. Rows whose label is null are not used.
Repeated rows get equal scores. If there are no labelled texts, every score is 0.5. Columns beyond the named ones
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import chunks, sealed, texts
from cellweave.llm.ftrl import Sparse, Weights, train
from cellweave.llm.words import mix, words

#: No more labelled texts than this are learnt from.
MAX_ROWS = 4096


def features(items: list[str]) -> Sparse:
    """The hashed words, word pairs and skip-grams that each text has, each once."""
    w = words(items)
    of = w.text_of()
    keys, rows = [w.hash], [of]
    for gap in (1, 2, 3):
        same = np.flatnonzero(of[gap:] == of[:-gap])
        keys.append(mix(w.hash[same] * np.uint64(2 * gap + 1) + w.hash[same + gap]))
        rows.append(of[same])
    key, row = np.concatenate(keys), np.concatenate(rows)
    return Sparse(row, key, np.ones(len(key)), len(items))


def _once(x: Sparse) -> Sparse:
    order = np.lexsort((x.key, x.row))
    key, row = x.key[order], x.row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return Sparse(row[new], key[new], np.ones(int(new.sum())), x.n)


def fit(labelled: DataFrame, *, max_rows: int = MAX_ROWS, shards: int = 1, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, common: float = 1.5, l2: float = 0.0, least_rows: int = 3) -> Weights:
    """Weights from ``labelled`` (id, text, label 0 or 1): a bounded sample of ``max_rows`` by the hash of id.

    Rows of one id are told apart by label, then by text, so reruns learn from the same rows. A task holds its whole
    texts, long ones included (max_rows / shards of them).
    """
    rows = labelled.where("label is not null").select("id", "text", "label")
    sample = rows.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text"), "text").limit(max_rows)
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))

    def shard_weights(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "label", "text"], kind="stable")
        w = train(_once(features(texts(frame["text"]))), frame["label"].to_numpy(float), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, least_rows=least_rows, common=common)
        return pd.DataFrame({"key": np.append(w.key.view(np.int64), 0), "weight": np.append(w.weight, w.bias), "bias": [False] * len(w.key) + [True]})

    made = dealt.groupBy("shard").applyInPandas(shard_weights, "key long, weight double, bias boolean")
    total = made.groupBy("key", "bias").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    found = total.collect()  # features of the bounded sample
    n = max([r.n for r in found if r.bias], default=1)
    keys = np.array([r.key for r in found if not r.bias], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], np.array([r.weight / n for r in found if not r.bias])[order], sum(r.weight / n for r in found if r.bias))


def score(docs: DataFrame, weights: Weights, *, keep: list[str], text: str = "text", most_chars: int = 1_000_000) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``score``, the probability that the whole text is toxic.

    Null and empty texts score what the bias alone says. Repeated rows have equal scores. A long text is scored whole; one beyond
    ``most_chars`` is a slice of its own, whose task holds about 60 bytes a word for it. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    hidden, shown, schema = sealed(docs, keep, ("score",))
    names = [f"_k{i}" for i in range(len(keep))]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for frame in chunks(batches, "_text", most_chars):
            x = features(texts(frame["_text"]))
            known = np.isin(x.key & np.uint64(0xFFFF), np.unique(w.key & np.uint64(0xFFFF)), kind="table") if len(w.key) else np.zeros(len(x.key), bool)
            hits = _once(Sparse(x.row[known], x.key[known], x.value[known], x.n))
            yield frame[names].assign(score=w.scores(hits))

    rows = docs.select(*hidden, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInPandas(scored, f"{schema}, score double").select(*shown, "score")
