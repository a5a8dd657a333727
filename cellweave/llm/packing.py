"""Best-fit packing of documents into sequences of a token capacity, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length matters for where
lengths go, and there are at most ``capacity`` lengths, so the plan is made from that histogram whatever the corpus's
size: the reduction permanently fixes sets (a piece alone, with one, or with two others) that provably dominate every
other set holding the piece, the rest is packed best-fit in order of decreasing length, many equal pieces at a time.
The plan says, for each length, which runs of ranks go to which runs of sequences and at which offset. Spark ranks
the pieces of each length within buckets and adds up the buckets' counts, so a length that holds a third of all
pieces is spread over tasks, and every piece then finds its place by its rank.

Null texts count as empty and hold the end token alone. Repeated rows are documents of their own; ties in length are
ordered by id, piece and hash, so equal rows may trade places. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.llm.common import chunks, staged, texts
from cellweave.llm.words import prefix_sums, stretch

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins what white space parts, nor a word of plain letters and the stops after it, so texts are
    cut there. Segments are told apart by a 64-bit hash of their bytes; those not met before are encoded, words of plain
    letters many at a time (their last tokens have a mark), and the ids of all are kept in arrays sorted by hash. When
    there are more than ``most``, all are forgotten. ASCII letters are folded first (the tokenizer folds all letters),
    but not in texts that may hold a special token.
    """

    _SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    _STOP = np.isin(np.arange(256), np.frombuffer(b".,!?;:#$%&*|", np.uint8))
    _LETTER = np.isin(np.arange(256), np.frombuffer(bytes(range(65, 91)) + bytes(range(97, 123)), np.uint8))
    #: The second bytes of Latin-1 letters, whose lower case is one letter too; the first is 0xC3.
    _SECOND = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _segments(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each segment, and whether it is a word of plain letters."""
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[1:] = ~self._SPACE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        letter = self._LETTER[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & self._SECOND[data[1:]])
        letter[pair] = True
        letter[pair + 1] = True
        # the last place before each that isn't a stop, and how many places so far are no letters
        place = np.arange(1, n + 1, dtype=np.int64)
        body = np.maximum.accumulate(np.where(self._STOP[data], 0, place))[end - 1]
        signs = np.concatenate([[0], np.cumsum(~letter)])
        word_end = np.maximum(body, start)
        plain = (word_end > start) & (signs[word_end] == signs[start])
        cut = np.flatnonzero(plain & (word_end < end))
        count = np.ones(len(start), np.int64)
        count[cut] = 2
        first = np.cumsum(count) - count
        s, e = np.repeat(start, count), np.repeat(end, count)
        e[first[cut]] = word_end[cut]
        s[first[cut] + 1] = word_end[cut]
        word = np.zeros(len(s), bool)
        word[first[plain]] = True
        return s, e, word

    def _learn(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, data: np.ndarray) -> None:
        """Adds the segments of the sorted hashes ``key``."""
        size, ids = np.zeros(len(key), np.int64), [np.zeros(0, "<u4")] * 2
        plain, other = np.flatnonzero(word), np.flatnonzero(~word)
        if len(plain):
            n = end[plain] - start[plain]
            to = np.cumsum(n + 1) - n - 1
            text = np.full(int((n + 1).sum()), 32, np.uint8)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text[np.repeat(to, n) + within] = data[np.repeat(start[plain], n) + within]
            bounds = [*to[::20_000].tolist(), len(text)]
            made = self.tokenizer.encode_batch_fast([text[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])], add_special_tokens=False)
            found = np.concatenate([np.array(e.ids, "<u4") for e in made])
            last = np.flatnonzero(self.ends[found]) + 1
            if len(last) == len(plain):
                size[plain], ids[0] = np.diff(last, prepend=0), found
            else:
                plain, other = plain[:0], np.arange(len(key))
        if len(other):
            made = self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(start[other].tolist(), end[other].tolist())], add_special_tokens=False)
            each = [np.array(e.ids, "<u4") for e in made]
            size[other], ids[1] = [len(x) for x in each], np.concatenate(each)
        at = np.zeros(len(key), np.int32)
        order = np.concatenate([plain, other])
        at[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        to = np.searchsorted(self.key, key)
        self.key, self.at, self.size = (np.insert(old, to, new) for old, new in ((self.key, key), (self.at, at), (self.size, size.astype(np.int32))))
        self.pool = np.concatenate([self.pool, *ids])

    def encode(self, items: list[str]) -> list[bytes]:
        raw = [x if b"<|" in x else x.lower() for x in (t.encode("utf-8", "replace") for t in items)]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        start, end, word = self._segments(data)
        key, first, which = np.unique(stretch(prefix_sums(data), start, end), return_index=True, return_inverse=True)
        if len(self.key) > self.most:
            self._forget()
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        near = np.flatnonzero(place < len(self.key))
        known[near] = self.key[place[near]] == key[near]
        if not known.all():
            fresh = first[~known]
            self._learn(key[~known], start[fresh], end[fresh], word[fresh], data)
            place = np.searchsorted(self.key, key)
        count = self.size[place].astype(np.int64)[which]
        reached = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(self.at[place][which] - reached[:-1], count) + np.arange(reached[-1])]
        texts = np.cumsum([0] + [len(x) + 1 for x in raw])
        bounds = reached[np.searchsorted(start, texts)].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, *, id: str, text: str, capacity: int = CAPACITY, end: int = END, most_chars: int = 1_000_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end token, cut every ``capacity`` tokens."""
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for frame in chunks(batches, "text", most_chars):
            out = []
            for i, ids in zip(frame["id"], _encoders[path].encode(texts(frame["text"]))):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"id {dict(docs.dtypes)[id]}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """Pieces of ``length`` with ranks from ``rank``: ``each`` to a sequence, ``bins`` sequences from ``bin``, at ``offset``."""

    length: int
    rank: int
    each: int
    bins: int
    bin: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int, int]:
    """Where the pieces of each length go; how many sequences there are, and how many of them the reduction fixed."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    bins = 0

    def fix(lengths: list[int], times: int) -> None:
        nonlocal bins
        at = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            runs.append(Run(n, used[n], k, times, bins, at))
            at += k * n
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times

    for long in sorted(left, reverse=True):
        while left.get(long):
            others = dominating(long, left, capacity)
            if others is None:
                break
            need = [long, *others]
            fix(need, min(left[n] // need.count(n) for n in set(need)))
    fixed = bins
    # Best fit: runs of sequences with equal room, by room; equal pieces fill the tightest room that takes them.
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((start, n))

    for n in sorted(left, reverse=True):
        rest, rank = left[n], used[n]
        while rest:
            at = bisect_left(rooms, n)
            if at == len(rooms):  # none fits: new sequences, each filled with as many as go
                most = capacity // n
                put(capacity, bins, max(1, rest // most))
                bins += max(1, rest // most)
                continue
            room = rooms[at]
            start, free = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            each = room // n
            whole = min(free, rest // each)
            if whole:
                runs.append(Run(n, rank, each, whole, start, capacity - room))
                put(room - each * n, start, whole)
                put(room, start + whole, free - whole)
                rank, rest = rank + each * whole, rest - each * whole
            else:
                runs.append(Run(n, rank, rest, 1, start, capacity - room))
                put(room - rest * n, start, 1)
                put(room, start + 1, free - 1)
                rest = 0
    return runs, bins, fixed


def dominating(long: int, left: dict[int, int], capacity: int) -> list[int] | None:
    """The lengths that, put with the longest piece, dominate every other set holding it; None if none is proven.

    A set dominates another if the other's pieces can be parted into groups that each fit in place of one of its pieces.
    """
    room = capacity - long
    sizes = sorted(n for n in left if n <= room and (n != long or left[n] > 1))
    if not sizes:
        return []
    if sizes[-1] == room:  # fills the room: whatever else went there fits in this piece's place
        return [room]
    smallest: list[int] = []
    for n in sizes:
        smallest += [n] * min(3, left[n] - (n == long))
        if len(smallest) >= 3:
            break
    largest = sizes[-1]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:  # one other piece at most: the largest
        return [largest]
    if len(smallest) < 3 or sum(smallest[:3]) > room:  # two others at most
        pairs = [(n, room - n) for n in sizes]
        best = max((n + sizes[k - 1] for n, r in pairs if (k := bisect_left(sizes, r + 1)) and (sizes[k - 1] != n or left[n] - (n == long) > 1)), default=0)
        if best <= largest:  # no pair holds more than the largest alone
            return [largest]
        half = sizes[bisect_left(sizes, room // 2 + 1) - 1] if sizes[0] <= room // 2 else None
        if half is not None and half + largest <= room and (half != largest or left[half] - (half == long) > 1):
            return [largest, half]  # of any two others the smaller is at most half, the larger at most largest
    return None


def packed(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, per_bucket: int = 20_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = staged(pieces(docs, path, id=id, text=text, capacity=capacity, end=end), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // per_bucket))
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("length", "bucket", start.alias("_start"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_within", within).join(starts, ["length", "bucket"]).withColumn("rank", F.col("_start") + F.col("_within"))
    runs.sort(key=lambda r: (r.length, r.rank))
    sent = docs.sparkSession.sparkContext.broadcast(np.array([[r.length, r.rank, r.each, r.bin, r.offset] for r in runs], np.int64).reshape(-1, 5).T)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, each, bin, offset = sent.value
        key = length << 48 | rank  # lengths are small, ranks under 2 ** 48
        for frame in batches:
            n, r = frame["length"].to_numpy(), frame["rank"].to_numpy()
            at = np.searchsorted(key, n << 48 | r, side="right") - 1
            nth = r - rank[at]
            yield frame[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=bin[at] + nth // each[at], offset=offset[at] + nth % each[at] * n)

    kind = dict(docs.dtypes)[id]
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id)
