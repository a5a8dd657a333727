"""Quality classifier: a weak-label model over overlapping heuristic labellers trains a hashed linear scorer.

Each labeller looks at the tokens (between white space) of a whole text and votes junk, good or not at all.
Spark counts the vote patterns of all texts (at most 3 ** 6 of them); expectation-maximisation over these counts
estimates how each labeller votes on junk and on good texts, and so the posterior of every pattern. Posterior
labels of at most ``max_rows`` texts (those with the least hashes of their ids) train a logistic scorer over
hashed token shapes by FTRL, and the scorer judges every text.

Null texts count as empty; texts without tokens get the intercept's score and are kept or not by it like any other.
Repeated rows get equal scores; an empty table gives an empty result; further columns are passed on by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import chunks, sealed, texts
from cellweave.llm.ftrl import Sparse, Weights, train
from cellweave.llm.words import joined, mix, prefix_sums, stretch

JUNK, GOOD, SILENT = 1, 0, 2
LABELLERS = ("symbols", "capitals", "repeats", "separators", "doubled ends", "function words")
#: Very common short words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "a an and are as at be by for from had has have he in is it of on or that the this to was were with "
    "au aux de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als an auf das dem den der des die ein eine es ist im in mit nicht sich und von zu "
    "al con del el es esta lo los las no para por que se su una y"
).split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Tokens:
    of: np.ndarray
    n: int
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    last: np.ndarray
    doubled: np.ndarray
    same: np.ndarray
    shape: np.ndarray
    lone: np.ndarray


def tokens(items: list[str]) -> Tokens:
    data, starts = joined([x.encode("utf-8", "surrogatepass") for x in items])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data > 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    of = np.searchsorted(starts, start, side="right") - 1
    hashes = stretch(prefix_sums(_FOLD[data]), start, end)
    sums = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LOWER, _PUNCT)]
    upper, lower, punct = (s[end] - s[start] for s in sums)
    last = np.where(_PUNCT[data[end - 1]], data[end - 1], 0) if len(end) else np.zeros(0, np.uint8)
    doubled = (last > 0) & (end - start > 1) & (data[end - 2] == data[end - 1]) if len(end) else np.zeros(0, bool)
    same = np.zeros(len(start), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    shape = np.where(upper + lower == 0, 0, np.where((upper > 1) & (lower == 0), 1, np.where(upper > 0, 2, 3)))
    return Tokens(of, len(items), start, end, hashes, last, doubled, same, shape, punct == end - start)


_data, _starts = joined([w.encode() for w in sorted(set(FUNCTION_WORDS))])
_FUNCTION_HASHES = np.sort(stretch(prefix_sums(_data), _starts[:-1], _starts[1:] - 1))


def votes(t: Tokens) -> np.ndarray:
    """Each text's votes as one number in base 3, the first labeller first. A text of under 5 tokens gets no vote but of good form."""
    n = np.maximum(np.bincount(t.of, minlength=t.n), 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(t.of[flag], minlength=t.n) / n

    at = np.minimum(np.searchsorted(_FUNCTION_HASHES, t.hash), len(_FUNCTION_HASHES) - 1)
    function = share(_FUNCTION_HASHES[at] == t.hash)
    symbol = share(np.isin(t.last, np.frombuffer(b"#$%&*|<>=~^@\\{}", np.uint8)))
    capital, repeat, lone, doubled = share(t.shape == 1), share(t.same), share(t.lone), share(t.doubled)
    long = np.bincount(t.of, minlength=t.n) >= 5
    cast = [
        np.where(symbol > 0.3, JUNK, SILENT),
        np.where(capital > 0.5, JUNK, SILENT),
        np.where(repeat > 0.3, JUNK, SILENT),
        np.where(lone > 0.25, JUNK, SILENT),
        np.where(doubled > 0.3, JUNK, SILENT),
        np.where((function > 0.1) & (repeat < 0.1) & (symbol + lone + doubled < 0.2) & (capital < 0.2), GOOD, np.where(function < 0.01, JUNK, SILENT)),
    ]
    code = np.zeros(t.n, np.int64)
    for c in cast:
        code = code * 3 + np.where(long, c, SILENT)
    return code


def posterior(patterns: dict[int, int], *, rounds: int = 100, start: float = 0.9, smooth: float = 1.0) -> dict[int, float]:
    """Probability of junk for each vote pattern, by expectation-maximisation over the counts of all patterns.

    Begins from ``start`` where any labeller says junk, 1 - ``start`` elsewhere; votes are independent given the class.
    """
    if not patterns:
        return {}
    codes = np.array(sorted(patterns))
    count = np.array([patterns[c] for c in codes], float)
    cast = np.stack([codes // 3**k % 3 for k in reversed(range(len(LABELLERS)))], 1)
    p = np.where((cast == JUNK).any(1), start, 1 - start)
    for _ in range(rounds):
        log = np.zeros((2, len(codes)))
        for c, share in enumerate((1 - p, p)):
            log[c] = np.log((share @ count + smooth) / (count.sum() + 2 * smooth))
            for k in range(cast.shape[1]):
                seen = np.array([(share * count)[cast[:, k] == v].sum() + smooth for v in range(3)])
                log[c] += np.log(seen / seen.sum())[cast[:, k]]
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return dict(zip(codes.tolist(), p.tolist()))


def features(t: Tokens, bits: int = 18) -> Sparse:
    """Shares of each text's tokens by hashed shape and by pair of successive shapes."""
    code = ((t.last.astype(np.uint64) * np.uint64(2) + t.doubled) * np.uint64(4) + t.shape.astype(np.uint64)) * np.uint64(2) + t.same
    next_to = np.flatnonzero(t.of[1:] == t.of[:-1])
    pair = mix(code[next_to] * np.uint64(65537) + code[next_to + 1] + np.uint64(1 << 40))
    key = np.concatenate([mix(code), pair]) >> np.uint64(64 - bits)
    row = np.concatenate([t.of, t.of[next_to]])
    both, count = np.unique((row.astype(np.uint64) << np.uint64(bits)) | key, return_counts=True)
    row = (both >> np.uint64(bits)).astype(np.int64)
    n = np.maximum(np.bincount(t.of, minlength=t.n), 1)
    return Sparse(row, both & np.uint64((1 << bits) - 1), count / n[row], t.n)


def fit(docs: DataFrame, *, id: str = "doc_id", text: str = "text", max_rows: int = 8192, shards: int = 8, most_chars: int = 400_000) -> Weights:
    """The scorer of ``docs``: votes of all texts are counted, a bounded sample with posterior labels is fitted.

    The sample has one row for each of ``max_rows`` ids, by hash: of rows with one id the least text, chosen before the
    rows are dealt to ``shards`` tasks. A task holds its whole texts, long ones included (max_rows / shards of them).
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "text", most_chars):
            code, n = np.unique(votes(tokens(texts(frame["text"]))), return_counts=True)
            yield pd.DataFrame({"code": code, "n": n})

    counted = rows.select("text").mapInPandas(cast, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    junk = posterior({r.code: r.n for r in counted.collect()})
    ids = rows.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    dealt = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))

    def shard_weights(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        t = tokens(texts(frame["text"]))
        y = 1 - np.array([junk.get(c, 0.5) for c in votes(t).tolist()])
        w = train(features(t), y, epochs=8, alpha=1.0, beta=1.0, l1=0.2, l2=0.0, least_rows=3)
        return pd.DataFrame({"key": np.append(w.key.view(np.int64), -1), "weight": np.append(w.weight, w.bias)})

    made = dealt.groupBy("shard").applyInPandas(shard_weights, "key long, weight double")
    total = made.groupBy("key").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).orderBy("key").collect()
    n = max([r.n for r in total if r.key < 0], default=1)
    found = [r for r in total if r.key >= 0]
    return Weights(np.array([r.key for r in found], np.int64).view(np.uint64), np.array([r.weight / n for r in found]), sum(r.weight / n for r in total if r.key < 0))


def score(docs: DataFrame, weights: Weights, *, keep: list[str], text: str = "text", most_chars: int = 400_000) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``score``, the probability that the whole text is good.

    Null and empty texts score what the bias alone says. Repeated rows have equal scores. A long text is scored whole; one beyond
    ``most_chars`` is a slice of its own, whose task holds about 100 bytes a token for it. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    hidden, shown, schema = sealed(docs, keep, ("score",))
    names = [f"_k{i}" for i in range(len(keep))]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "_text", most_chars):
            yield frame[names].assign(score=sent.value.scores(features(tokens(texts(frame["_text"])))))

    rows = docs.select(*hidden, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInPandas(scored, f"{schema}, score double").select(*shown, "score")
