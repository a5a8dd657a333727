"""Long repeats in a corpus of whole texts, by prefix-free parsing: dictionary, parse, and their suffix order.

Rolling-hash triggers cut each text into phrases: a position is a trigger if its hash is the least of some ``reach``
successive positions, so triggers depend on nearby bytes alone and are never far apart. Any string of ``shortest`` bytes
then has a trigger whose surroundings lie inside it, at the same place wherever the string occurs. Every window (a
place where a match of a given length may start) belongs to the first such trigger; what all windows of a trigger share
is its phrase, and what they cover together, up to the longer length, its context.

* Dictionary: Spark counts the phrases. Only windows of phrases that occur twice can repeat.
* Parse: where a whole context occurs twice, successive phrases are equal to the depth of the match, and all windows of
  the trigger repeat. What is left are the ends of repeats.
* Suffix order: the distinct contexts of phrases with such an end are sorted by phrase and by their bytes from the
  trigger on (the order of the parse's suffixes), and by phrase and by their bytes before the trigger, read backwards
  (the order of the dictionary's suffixes that end there). Bytes are compared between neighbours. A window that begins
  d bytes before the trigger repeats if some context has d bytes before and length - d after the trigger in common with
  it. Neighbours in either order have the longest common bytes on that side, so no window outside their bounds repeats,
  and where one neighbour reaches both bounds, all windows within do. Both sorts are range sorts of Spark, so a phrase
  that is everywhere is spread over tasks. Windows that this leaves open (bounds from different neighbours, neighbours
  in another task) are put together by the hash of their bytes. Texts are parsed twice, to count phrases and to find
those that occur twice: that takes less of disks than to keep all of them.

Phrases, contexts and open windows are told apart by 64-bit hashes; what is sorted and compared are a context's bytes
beyond its phrase. Texts are known by their hash, so equal rows get
equal results. Null texts count as empty; texts shorter than a match hold no repeat. Matches never cross texts, since
windows don't. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import chunks, sealed, staged, texts
from cellweave.llm.words import joined, mix, prefix_sums, stretch

#: Bytes of a repeat that is removed, of a passage that is counted, and the words that a passage has more than.
LENGTH, PASSAGE, WORDS = 400, 280, 50
#: Bytes of a rolling hash.
GRAM = 16


def reach(shortest: int) -> int:
    """The positions of which a trigger is the least: every ``shortest`` bytes hold a trigger with its surroundings."""
    return (shortest - GRAM) // 3


@dataclass
class Anchors:
    """text, trigger, first window (places in the joined bytes), windows of both lengths, end of the context; sums for hashing."""

    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    short: np.ndarray
    long: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    sums: np.ndarray


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """For each place the least (or greatest) of the n values from it on; places near the end see fewer."""
    op = np.minimum if least else np.maximum
    fill = np.uint64(2**64 - 1) if least else np.uint64(0)
    padded = np.concatenate([x, np.full(-len(x) % n + n, fill, np.uint64)]).reshape(-1, n)
    ahead = op.accumulate(padded, 1).ravel()
    back = np.ascontiguousarray(op.accumulate(padded[:, ::-1], 1)[:, ::-1]).ravel()
    return op(back[: len(x)], ahead[n - 1 : n - 1 + len(x)])


def anchors(items: list[bytes], shortest: int, length: int) -> Anchors:
    data, starts = joined(items)
    sums, n, r = prefix_sums(data), len(data), reach(shortest)
    text = np.repeat(np.arange(len(items)), np.diff(starts))
    end = starts[1:][text] - 1  # each place's end of text
    place = np.arange(n)
    gram = np.full(n, np.uint64(2**64 - 1))
    inside = np.flatnonzero(place + GRAM <= end)
    gram[inside] = stretch(sums, inside, inside + GRAM) >> np.uint64(1)
    least = _sliding(gram, r, True)
    least[place + r - 1 + GRAM > end] = 0
    # the greatest of the last r window minima
    best = _sliding(np.concatenate([np.zeros(r - 1, np.uint64), least]), r, False)[:n]
    at = np.flatnonzero((gram == best) & (place + GRAM <= end))
    of = text[at]
    before = np.full(len(at), -length)
    before[1:] = np.where(of[1:] == of[:-1], at[:-1], -length)
    first = np.maximum(starts[of], before - r + 2)
    last = starts[of + 1] - 1
    some = np.flatnonzero(np.minimum(at - r + 1, last - shortest) >= first)
    of, at, first, last = of[some], at[some], first[some], last[some]
    count = [np.maximum(np.minimum(at - r + 1, last - n) - first + 1, 0) for n in (shortest, length)]
    return Anchors(of, at, first, *count, np.minimum(at - r + 1 + length, last), starts, sums)


# A trigger's place in its text is one number: first window, and a byte each for the bytes from there to the trigger
# and the numbers of its windows of the shorter and of the longer length.
def _packed(a: Anchors) -> np.ndarray:
    return (a.first - a.starts[a.text]) << 24 | (a.at - a.first) << 16 | a.short << 8 | a.long


def _first(place: Column) -> Column:
    return F.shiftright(place, 24)


def _byte(place: Column, k: int) -> Column:
    return F.shiftright(place, 8 * k).bitwiseAND(F.lit(255))


def parsed(rows: DataFrame, shortest: int, length: int, most_chars: int) -> DataFrame:
    """(core, context, key, place) of every trigger of every text."""
    r = reach(shortest)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "text", most_chars):
            a = anchors([x.encode("utf-8", "replace") for x in texts(frame["text"])], shortest, length)
            core = stretch(a.sums, a.at - r + 1, a.at + shortest - 2 * r + 2)
            # contexts are equal if their bytes and the trigger's place in them are
            context = stretch(a.sums, a.first, a.end) + (a.at - a.first).astype(np.uint64)
            yield pd.DataFrame({"core": core.view(np.int64), "context": context.view(np.int64), "key": frame["key"].to_numpy()[a.text], "place": _packed(a)})

    return rows.mapInPandas(parse, "core long, context long, key long, place long")


def contexts(triggers: DataFrame) -> DataFrame:
    """(core, context, n, other, key, place): contexts of phrases that occur twice, how often each occurs, whether in
    two texts, and one of its places. ``triggers`` holds such phrases only."""
    return triggers.groupBy("core", "context").agg(
        F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("other"), F.min(F.struct("key", "place")).alias("_one")
    ).select("core", "context", "n", "other", "_one.*")


def _inside(shortest: int) -> tuple[int, int]:
    """The bytes of a phrase before its trigger and from it on."""
    return reach(shortest) - 1, shortest - 2 * reach(shortest) + 2


def border_contexts(rows: DataFrame, look: DataFrame, length: int, shortest: int, most_chars: int) -> DataFrame:
    """(core, key, place, after, before): the bytes beyond the phrase, those before it read backwards."""
    r, (left, right) = reach(shortest), _inside(shortest)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "text", most_chars):
            out = []
            for key, text, cores, places in zip(frame["key"], texts(frame["text"]), frame["cores"], frame["places"]):
                data = text.encode("utf-8", "replace")
                for core, place in zip(cores.tolist(), places.tolist()):
                    first, at = place >> 24, (place >> 24) + (place >> 16 & 255)
                    out.append((core, key, place, data[at + right : at - r + 1 + length], data[first : at - left][::-1]))
            yield pd.DataFrame(out, columns=["core", "key", "place", "after", "before"])

    some = look.groupBy("key").agg(F.collect_set(F.struct("core", "place")).alias("some"))
    some = some.select("key", F.col("some.core").alias("cores"), F.col("some.place").alias("places"))
    return rows.dropDuplicates(["key"]).join(some, "key").select("key", "text", "cores", "places").mapInPandas(cut, "core long, key long, place long, after binary, before binary")


def _common(x: pd.Series, skip: np.ndarray) -> np.ndarray:
    """The number of first bytes that each value has in common with the next one; 0 where ``skip`` holds."""
    size = x.str.len().to_numpy()
    # what lies beyond a value's end never equals the next value's
    grid = np.repeat((-1 - np.arange(len(x)) % 2).astype(np.int16)[:, None], int(size.max()) + 1, 1)
    grid[np.arange(grid.shape[1]) < size[:, None]] = np.frombuffer(b"".join(x), np.uint8)
    return np.where(skip, 0, (grid[:-1] != grid[1:]).argmax(1))


def neighbours(borders: DataFrame, order: list[str], shortest: int) -> DataFrame:
    """(core, key, place, before, after, other, open): what contexts have in common with their neighbours in an order.

    before, after: the bytes before the trigger and from it on, those of the phrase included; other: the neighbour is of another text; open: the neighbour
    is in another task, and nothing is known of it.
    """
    names, (left, right) = ["core", "key", "place"], _inside(shortest)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                if held is None:
                    yield part.iloc[:1][names].assign(before=0, after=0, other=False, open=True)
                frame = part if held is None else pd.concat([held, part], ignore_index=True)
                held = frame.iloc[-1:]
                if len(frame) < 2:
                    continue
                core, key = frame["core"].to_numpy(), frame["key"].to_numpy()
                apart = core[1:] != core[:-1]
                both = {"before": left + _common(frame["before"], apart), "after": right + _common(frame["after"], apart), "other": key[1:] != key[:-1], "open": False}
                for side in (frame.iloc[:-1], frame.iloc[1:]):
                    yield side[names].reset_index(drop=True).assign(**both)[~apart]
        if held is not None:
            yield held[names].assign(before=0, after=0, other=False, open=True)

    dealt = borders.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInPandas(compare, "core long, key long, place long, before int, after int, other boolean, open boolean")


def _bounds(length: int, which: int, before: Column, after: Column) -> tuple[Column, Column]:
    """The least and greatest distance from window to trigger of windows that these common bytes allow."""
    own = _byte(F.col("place"), 2)
    least = F.greatest(F.lit(length) - after, own - _byte(F.col("place"), which) + 1)
    return least, F.least(before, own)


def matched(pairs: DataFrame, length: int, which: int) -> DataFrame:
    """(key, start, end) of what neighbours have in common; which: the byte of ``place`` that counts the windows."""
    low, high = _bounds(length, which, F.col("before"), F.col("after"))
    rows = pairs.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    at = _first(F.col("place")) + _byte(F.col("place"), 2)
    return rows.select("key", (at - F.col("_high")).alias("start"), (at - F.col("_low") + length).alias("end"))


def undecided(pairs: DataFrame, length: int, which: int, only_other: bool) -> DataFrame:
    """(core, distances): distances from window to trigger that neighbours leave open for some context of a phrase."""
    each = pairs.groupBy("core", "key", "place").agg(
        F.max("before").alias("_b"), F.max("after").alias("_a"), F.max("open").alias("_open"), F.collect_list(F.struct("before", "after", "other")).alias("_pairs")
    )  # at most four pairs
    low, high = _bounds(length, which, F.col("_b"), F.col("_a"))
    # a neighbour in another task may have any bytes in common
    low, high = (F.when(F.col("_open"), x).otherwise(y) for x, y in zip(_bounds(length, which, F.lit(1 << 20), F.lit(length)), (low, high)))
    rows = each.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    own = lambda at: F.exists("_pairs", lambda p: (F.lit(length) - p["after"] <= at) & (p["before"] >= at) & (p["other"] if only_other else F.lit(True)))
    left = rows.select("core", F.explode(F.filter(F.sequence("_low", "_high"), lambda at: ~own(at))).alias("distance"))
    return left.groupBy("core").agg(F.collect_set("distance").alias("distances"))  # as many as a phrase has windows


def windows(borders: DataFrame, distances: DataFrame, length: int, shortest: int, which: int) -> DataFrame:
    """(key, start, end, other) of the windows at these distances that occur twice, told apart by a hash of their bytes.

    A window is known by its phrase, its distance, and its bytes beyond the phrase.
    """
    left, right = _inside(shortest)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                frame = batch.iloc[low : low + 1000]
                data, starts = joined([b[::-1] + a for b, a in zip(frame["before"], frame["after"])])
                place, core = frame["place"].to_numpy(), frame["core"].to_numpy().view(np.uint64)
                of = np.repeat(np.arange(len(frame)), frame["distances"].map(len))
                d = np.concatenate([np.asarray(x, np.int64) for x in frame["distances"]])
                most = place >> 16 & 255
                ours = np.flatnonzero((d <= most[of]) & (d > (most - (place >> 8 * which & 255))[of]))
                of, d = of[ours], d[ours]
                trigger = starts[of] + frame["before"].str.len().to_numpy()[of]
                hashes = stretch(prefix_sums(data), trigger - (d - left), trigger + (length - d - right))
                hashes = mix(hashes ^ mix(core[of] + d.astype(np.uint64)))
                yield pd.DataFrame({"hash": hashes.view(np.int64), "key": frame["key"].to_numpy()[of], "start": (place >> 24)[of] + most[of] - d})

    rows = borders.join(distances, "core").select("core", "key", "place", "before", "after", "distances")
    rows = staged(rows.mapInPandas(each, "hash long, key long, start long"), "windows")
    seen = rows.groupBy("hash").agg(F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("other")).where("n > 1")
    return rows.join(seen.select("hash", "other"), "hash").select("key", "start", (F.col("start") + length).alias("end"), "other")


def covered(rows: DataFrame, *, length: int, shortest: int, most_chars: int) -> DataFrame:
    """(key, kind, start, end): stretches of texts (key, text) that repeated strings cover.

    kind "removed": strings of ``length`` bytes that start anywhere else; "passage": of ``shortest`` bytes that are in
    another text; "whole": start is the place of a trigger whose windows all repeat, end whether in another text (0, 1).
    """
    triggers = parsed(rows, shortest, length, most_chars)
    twice = triggers.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    found = staged(triggers.join(twice, "core"), "phrases")
    known = staged(contexts(found), "contexts")
    # ends of repeats: a context that occurs once, or in one text alone; all contexts of its phrase are compared
    ends = known.groupBy("core").agg(F.count("*").alias("contexts"), F.max((F.col("n") == 1) | ~F.col("other")).alias("ends")).where("contexts > 1 and ends").select("core")
    look = known.join(ends, "core", "left_semi").select("core", "key", "place")
    borders = staged(border_contexts(rows, look, length, shortest, most_chars), "borders")
    pairs = staged(neighbours(borders, ["core", "after", "before"], shortest).union(neighbours(borders, ["core", "before", "after"], shortest)), "neighbours")
    whole = found.join(known.where("n > 1").select("core", "context", "other"), ["core", "context"])
    out = [whole.select("key", F.lit("whole").alias("kind"), F.col("place").alias("start"), F.col("other").cast("long").alias("end"))]
    for kind, size, which in (("removed", length, 0), ("passage", shortest, 1)):
        passage = kind == "passage"
        open_windows = windows(borders, undecided(pairs, size, which, passage), size, shortest, which)
        parts = [
            matched(pairs.where("other") if passage else pairs, size, which),
            (open_windows.where("other") if passage else open_windows).select("key", "start", "end"),
        ]
        out += [p.select("key", F.lit(kind).alias("kind"), "start", "end") for p in parts]
    total = out[0]
    for p in out[1:]:
        total = total.union(p)
    return total


def _gone(n: int, spans: np.ndarray | None, places: np.ndarray, which: int, length: int) -> np.ndarray:
    """Which of n bytes are covered by spans (start and, in the last 16 bits, length), or by all windows of triggers at these places."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        np.add.at(step, spans >> 16, 1)
        np.add.at(step, (spans >> 16) + (spans & 0xFFFF), -1)
    count = places >> 8 * which & 255
    first, count = (places >> 24)[count > 0], count[count > 0]
    np.add.at(step, first, 1)
    np.add.at(step, first + count - 1 + length, -1)
    return np.cumsum(step[:-1]) > 0


def removed(docs: DataFrame, *, text: str = "text", keep: list[str], length: int = LENGTH, passage: int = PASSAGE, passage_words: int = WORDS, most_chars: int = 400_000) -> DataFrame:
    """``keep``, ``kept`` (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs) and n_passages of each text.

    n_passages: maximal runs of more than ``passage_words`` words in which every byte is of a string of ``passage`` bytes
    (at most ``length``, 64 at least) that another row's text holds too. Of rows with one text, the whole text is a passage.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans", "n_passages")
    hidden, shown, schema = sealed(docs, keep, made)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*hidden, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    long = rows.where(F.octet_length("text") >= passage).select("key", "text")
    copies = long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("copies").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    spans = covered(long, length=length, shortest=passage, most_chars=most_chars).union(copies)
    span = F.shiftleft("start", 16).bitwiseOR(F.col("end") - F.col("start"))  # a span is shorter than two matches
    of = lambda kind, x=span: F.collect_set(F.when(F.col("kind") == kind, x))
    cover = staged(spans.groupBy("key").agg(of("removed").alias("gone"), of("passage").alias("passages"), of("whole", F.shiftleft("start", 1).bitwiseOR(F.col("end"))).alias("whole"), F.max(F.col("kind") == "copies").alias("copied")), "repeats")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "text", most_chars):
            out = []
            for t, spans, passages, whole, copied in zip(texts(frame["text"]), frame["gone"], frame["passages"], frame["whole"], frame["copied"]):
                data = t.encode("utf-8", "replace")
                at = whole if whole is not None else np.zeros(0, np.int64)
                gone = _gone(len(data), spans, at >> 1, 0, length)
                n = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
                edges = np.flatnonzero(np.diff(_gone(len(data), passages, (at >> 1)[at & 1 == 1], 1, passage).astype(np.int8), prepend=0, append=0))
                runs = [(0, len(data))] if copied is True else zip(edges[::2], edges[1::2])
                out.append((kept, len(data), len(data) - len(kept), n, sum(len(data[a:b].split()) > passage_words for a, b in runs)))
            yield pd.concat([frame[names], pd.DataFrame(out, columns=made, index=frame.index)], axis=1)

    joined_rows = rows.join(cover, "key", "left").select(*names, "text", "gone", "passages", "whole", "copied")
    out = joined_rows.mapInPandas(cut, schema + ", kept binary, n_bytes long, n_removed long, n_spans long, n_passages long")
    return out.select(*shown, *made)
