"""Periodic stretches of words in whole texts: harmonic grids of candidates, extended by difference-cover LCE.

A run is a stretch of consecutive words with a smallest period p (words p apart are identical), at least ``exponent``
times as long as p and at least ``shortest`` words long, that no neighbouring word extends. For each p only the places
0, p, 2p, ... are looked at: inside a run, ``exponent`` - 1 successive ones agree with the words p later. The grids of all
periods have n * log(n) places together. Where that many agree, the stretch of agreement is extended to both sides by
longest common extensions (``lce``) over the texts that have such a place, forwards and on the reversed words. A stretch
found under several periods keeps the least.

Texts are worked in slices of about ``CHUNK`` characters by Arrow's kernels and numpy; nothing is shuffled, so a lost
executor costs its tasks alone. A text that alone is longer is a slice of its own: its task needs about 60 bytes a word
there, and 200 a word if it has runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import sealed
from cellweave.llm.lce import Extensions

CHUNK = 1_500_000
#: Fixed value of the contract: what separates words.
BETWEEN = r"[\x20\x09-\x0D]+"
MADE = ("n_words", "runs", "collapsed")


def find(words: np.ndarray, first: np.ndarray, *, shortest: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs as (text, start, length, period) arrays, ordered so; starts count from the text's first word.

    words: the texts' words as whole numbers from 0 on, end to end; first: where each text begins, and the end.
    """
    n = np.diff(first)
    texts, top = len(n), int(words.max(initial=-1)) + 1
    begin = first[:-1] + np.arange(texts) + 1  # one value that occurs nowhere else before each text and at the end
    flat = np.empty(len(words) + texts + 1, np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(texts), n) + 1
    flat[place] = words
    walls = np.append(begin - 1, len(flat) - 1)
    flat[walls] = top + np.arange(texts + 1)
    narrow, at, period = flat.astype(np.int32), [], []
    for p in range(1, int(n.max(initial=0)) // exponent + 1):
        agree = narrow[:-p:p] == narrow[p::p]
        full = len(agree) - exponent + 2
        if full <= 0:
            continue
        series = agree[:full].copy()
        for k in range(1, exponent - 1):
            series &= agree[k : full + k]
        found = np.flatnonzero(series)
        if len(found):
            at.append(found * p)
            period.append(np.full(len(found), p))
    none = np.zeros(0, np.int64)
    if not at:
        return none, none, none, none  # no text has a candidate
    x, p = np.concatenate(at), np.concatenate(period)
    text = np.searchsorted(begin - 1, x, side="right") - 1
    inside = x + p < walls[text + 1]
    x, p, text = x[inside], p[inside], text[inside]
    # The texts with candidates alone, each between its walls; the closing wall of one is the opening one of the next.
    used, text = np.unique(text, return_inverse=True)
    size = n[used] + 1
    start = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(start[-1]) - np.repeat(start[:-1], size)
    small = np.append(flat[np.repeat(begin[used] - 1, size) + within], top + texts + 1)
    small[start[1:-1]] = top + texts + 2 + np.arange(len(used) - 1)
    _, small = np.unique(small, return_inverse=True)
    x = x - (begin[used] - 1)[text] + start[:-1][text]
    # Forwards a segment ends with the wall after its text, backwards with the wall before it.
    segment = np.searchsorted(start[:-1], np.arange(len(small)) - 1, side="right")
    ahead = Extensions(small, segment).of(x, x + p)
    last = len(small) - 1
    back = Extensions(small[::-1].copy(), len(used) - np.searchsorted(start[:-1], np.arange(len(small)), side="right")[::-1]).of(last - x - p, last - x)
    low, high = x - back + 1, x + ahead + p
    long = high - low >= np.maximum(shortest, exponent * p)
    text, low, high, p = text[long], low[long], high[long], p[long]
    by = np.lexsort((p, high, low, text))
    text, low, high, p = text[by], low[by], high[by], p[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    text, low, high, p = text[new], low[new], high[new], p[new]
    by = np.lexsort((p, low, text))
    text, low, high, p = text[by], low[by], high[by], p[by]
    return used[text], low - start[:-1][text] - 1, high - low, p


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words end to end and where each text's begin (one more at the end)."""
    lists = pc.split_pattern_regex(texts, BETWEEN)
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    words, of = words.filter(real), of.filter(real).to_numpy(zero_copy_only=False)
    return words, np.searchsorted(of, np.arange(len(texts) + 1))


def _worked(texts: pa.Array, shortest: int, exponent: int) -> list[pa.Array]:
    words, first = _split(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = find(codes, first, shortest=shortest, exponent=exponent)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, first[text] + start + period, 1)
    np.add.at(gone, first[text] + start + length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), found)
    return [pa.array(np.diff(first), pa.int64()), runs, pc.binary_join(lists, " ")]


def runs(docs: DataFrame, *, text: str = "text", keep: list[str], shortest: int = 6, exponent: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Each row's n_words, runs (array of start, length, period by start, then period) and collapsed text, with the kept columns.

    ``collapsed`` holds the words that lie in no run beyond its first period, joined by one space. Null and empty texts
    have no words, no runs and an empty collapsed text; so have texts of blanks alone. A run beside another one of the
    same period is told apart by the words between; equal texts give equal results, row by row. Kept columns that have
    the name of a made one give way to it. An empty table gives an empty result. ``exponent`` is a whole number from 2 on.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    hidden, shown, kept = sealed(docs, keep, MADE)
    names = [f"_k{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pc.fill_null(batch.column("_text"), "")
            sizes = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(whole):
                end = max(at + 1, int(sizes.searchsorted((sizes[at - 1] if at else 0) + chunk, side="right")))
                made = _worked(whole.slice(at, end - at), shortest, exponent)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, end - at) for k in names], *made], [*names, *MADE])
                at = end

    schema = ", ".join(x for x in (kept, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string") if x)
    return docs.select(*hidden, F.col(text).alias("_text")).mapInArrow(work, schema).select(*shown, *MADE)
