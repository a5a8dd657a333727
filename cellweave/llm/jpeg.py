"""Progressive JPEG in numpy: many files at a time, losslessly for quantised coefficients.

The writer puts coefficients into spectral-selection and successive-approximation scans with restart intervals; the
reader accumulates any such scans into coefficient arrays. Restart intervals can be read independently, so the
reader decodes one symbol of every interval of every file in each step.

A block is 64 coefficients in zigzag order. Images have three components, luminance at full size and chroma at half
size both ways: six blocks make a unit of 16 x 16 pixels.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

#: Blocks of a scan of one component, or units of an interleaved one, between restart markers.
INTERVAL = 8
#: Point transform of DC: how many low bits its first scan leaves to a refinement.
LOW = 1
#: Spectral bands of each component: first and last coefficient, and the low bits left to a refinement.
BANDS = ((1, 14, 1), (15, 63, 0))


def zigzag() -> np.ndarray:
    """Row-major place of each zigzag index."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([i * 8 + j for i, j in order])


@dataclass
class Huffman:
    """count: codes of each length 1 to 16; symbol: in order of code."""

    count: tuple[int, ...]
    symbol: tuple[int, ...]
    code: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)
    look: np.ndarray = field(init=False)
    whole: np.ndarray = field(init=False)

    def __post_init__(self):
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.int64)  # length * 256 + symbol of what 16 bits begin with
        code, at = 0, 0
        for n, some in enumerate(self.count, 1):
            for s in self.symbol[at : at + some]:
                self.code[s], self.length[s] = code, n
                self.look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code += 1
            at += some
            code <<= 1
        # What 16 bits begin with, when they hold a symbol's value as well: bits used, run, and the value plus 2 ** 15.
        n, run, size = self.look >> 8, self.look >> 4 & 15, self.look & 15
        value = _value(np.arange(1 << 16) << 32 + n & 0xFFFFFFFFFFFF, size)
        fits = (n > 0) & (size > 0) & (n + size <= 16)
        self.whole = np.where(fits, (value + (1 << 15)) << 16 | run << 8 | n + size, 0)


def huffman(weights: dict[int, float]) -> Huffman:
    """A code for these symbols of at most 16 bits that never is all ones (the format forbids it)."""
    groups = [(w, [s]) for s, w in weights.items()] + [(0.0, [-1])]
    length: dict[int, int] = defaultdict(int)
    while len(groups) > 1:
        groups.sort(key=lambda g: (-g[0], g[1]))
        (a, x), (b, y) = groups.pop(), groups.pop()
        for s in x + y:
            length[s] += 1
        groups.append((a + b, x + y))
    count = [0] * 64
    for n in length.values():
        count[n] += 1
    for n in range(63, 16, -1):  # move pairs of codes that are too long up, as the format's standard does
        while count[n]:
            k = n - 2
            while not count[k]:
                k -= 1
            count[n] -= 2
            count[n - 1] += 1
            count[k + 1] += 2
            count[k] -= 1
    count[max(n for n in range(17) if count[n])] -= 1  # the all-ones code
    order = sorted(weights, key=lambda s: (length[s], s))
    return Huffman(tuple(count[1:17]), tuple(order))


@cache
def tables() -> tuple[Huffman, Huffman, Huffman, Huffman]:
    """For DC categories, AC scans that leave a bit to refine, refinements, and AC scans that leave none.

    The weights follow a rule that suits coefficients that are text: small letters mostly, and one space in seven.
    """
    dc = huffman({s: 2.0 ** -abs(s - 4) for s in range(12)})
    ends = {r << 4: 0.05 * 8.0**-r for r in range(15)} | {0xF0: 2.0**-9}
    near = lambda middle, space: {s: 0.5 if s == space else 2.0 ** -abs(s - middle) for s in range(1, 11)}
    first, whole = (huffman({r << 4 | s: 4.0**-r * w for r in range(16) for s, w in near(m, k).items()} | ends) for m, k in ((2.5, 6), (3.5, 7)))
    refine = huffman({r << 4 | 1: 2.0 ** -(r / 2) for r in range(16)} | {r << 4: 0.5 * 8.0**-r for r in range(15)} | {0xF0: 2.0**-7})
    return dc, first, refine, whole


#: Bits of each magnitude.
_SIZE = np.frexp(np.arange(1 << 15, dtype=np.float32))[1].astype(np.int32)


def sizes(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return _SIZE[np.abs(x)]


def extra(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a category: the value, or for negative ones the value less one, cut."""
    return (x - (x < 0)) & ((1 << size) - 1)


# --- writing


def pack(bits: np.ndarray, length: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of n segments of bit strings (each at most 63 long, in order) and each segment's size, ends filled with ones."""
    used = np.flatnonzero(length)
    bits, length, segment = bits[used].astype(np.uint64), length[used], segment[used]
    reached = np.concatenate([[0], np.cumsum(length)])
    total = np.diff(reached[np.searchsorted(segment, np.arange(n + 1))])
    size = (total + 7) >> 3
    base = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=base[1:])
    before = np.zeros(n + 1, np.int64)
    np.cumsum(total, out=before[1:])
    at = reached[:-1] + (base[:-1] * 8 - before[:-1])[segment]
    words = np.zeros((int(base[-1]) >> 3) + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - length
    first = np.flatnonzero(np.diff(word, prepend=-1))
    over = np.flatnonzero(room < 0)
    high = bits << np.maximum(room, 0).astype(np.uint64)
    high[over] = bits[over] >> (-room[over]).astype(np.uint64)
    if len(first):
        words[word[first]] = np.bitwise_or.reduceat(high, first)
    words[word[over] + 1] |= bits[over] << (64 + room[over]).astype(np.uint64)
    end, fill = base[:-1] * 8 + total, size * 8 - total
    some = np.flatnonzero(fill)
    np.bitwise_or.at(words, end[some] >> 6, ((np.uint64(1) << fill[some].astype(np.uint64)) - np.uint64(1)) << (64 - (end[some] & 63) - fill[some]).astype(np.uint64))
    return words.astype(">u8").view(np.uint8)[: base[-1]], size


def dc_first(dc: np.ndarray, segment: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Categories and bits of each block's difference from the last one of its component in its segment."""
    table = tables()[0]
    value = dc >> LOW
    last = np.zeros(len(dc), np.int64)
    for c in range(3):
        own = np.flatnonzero(part == c)
        same = segment[own][1:] == segment[own][:-1]
        last[own[1:][same]] = value[own[:-1][same]]
    diff = value - last
    s = sizes(diff)
    return table.code[s] << s | extra(diff, s), table.length[s] + s


def ac_first(x: np.ndarray, low: int, high: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block (rows) the bit strings of its band: one for each coefficient, and an end where zeros trail."""
    table = tables()[1 if bit else 3]
    band = x[:, low : high + 1]
    t = np.sign(band) * (np.abs(band) >> bit) if bit else band
    some = t != 0
    k = np.arange(t.shape[1], dtype=np.int8)
    seen = np.maximum.accumulate(np.where(some, k, np.int8(-1)), 1)
    run = np.empty_like(seen)
    run[:, 0] = 0
    run[:, 1:] = k[1:] - 1 - seen[:, :-1]
    s = sizes(t)
    symbol = (run & 15) << 4 | s
    bits, length = table.code[symbol] << s | extra(t, s), table.length[symbol] + s
    long = some & (run > 15)
    if long.any():
        zrl, n = int(table.code[0xF0]), int(table.length[0xF0])
        assert 3 * n + 26 < 64
        for k in range(1, 4):
            more = some & (run >= 16 * k)
            bits[more] |= zrl << length[more]
            length[more] += n
    length *= some
    ends = seen[:, -1] < t.shape[1] - 1
    out_bits, out_length = (np.empty((len(t), t.shape[1] + 1), np.int64) for _ in range(2))
    out_bits[:, :-1], out_length[:, :-1] = bits, length
    out_bits[:, -1], out_length[:, -1] = table.code[0], ends * table.length[0]
    return out_bits, out_length


def ac_refine(x: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block the bit strings of its band's last bit: symbols where an interval begins, then corrections."""
    table = tables()[2]
    v = x[:, low : high + 1]
    size = np.abs(v)
    known, new = size > 1, size == 1
    zero = size == 0
    width = v.shape[1]
    k = np.arange(width)
    zeros = np.cumsum(zero, 1)
    at_new = np.maximum.accumulate(np.where(new, zeros, 0), 1)
    later = np.flip(np.maximum.accumulate(np.flip(new, 1), 1), 1)
    skip = zero & later & ((zeros - at_new) % 16 == 0)
    ends = new | skip
    start = np.concatenate([np.ones((len(v), 1), bool), ends[:, :-1]], 1)
    next = np.flip(np.minimum.accumulate(np.flip(np.where(ends, k, width), 1), 1), 1)
    row, at = np.nonzero(start)
    end = next[row, at]
    none = end == width
    end = np.minimum(end, width - 1)
    run = zeros[row, end] - zeros[row, at] + zero[row, at]
    symbol = np.where(none, 0, np.where(skip[row, end], 0xF0, (run << 4 & 0xF0) | 1))
    signed = ~none & new[row, end]
    code, length = table.code[symbol], table.length[symbol]
    code = np.where(signed, code << 1 | (v[row, end] > 0), code)
    bits, lengths = np.zeros(v.shape, np.int64), np.zeros(v.shape, np.int64)
    bits[row, at], lengths[row, at] = code, length + signed
    bits = np.where(known, bits << 1 | (size & 1), bits)
    return bits, lengths + known


def shape_of(blocks: int) -> tuple[int, int]:
    """Rows and columns of units that hold this many blocks."""
    units = max(1, -(-blocks // 6))
    rows = -(-units // max(64, -(-units // 4095)))
    return rows, -(-units // rows)


def _order(shapes: np.ndarray, interleaved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the blocks in order of a scan: row among all blocks, component, segment, and each segment's file.

    A file's blocks are its luminance in rows, then its two chroma components in rows.
    """
    own = [_order_of(int(r), int(c), interleaved) for r, c in shapes]
    blocks, count = np.array([len(x[0]) for x in own]), np.array([x[3] for x in own])
    base, made = np.repeat(np.cumsum(blocks) - blocks, blocks), np.repeat(np.cumsum(count) - count, blocks)
    rows, parts, segments = (np.concatenate([x[k] for x in own]) for k in range(3))
    return rows + base, parts, segments + made, np.repeat(np.arange(len(own)), count)


@lru_cache(4096)
def _order_of(r: int, c: int, interleaved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n = r * c
    u = np.arange(n)
    if interleaved:
        top = (u // c) * 4 * c + u % c * 2
        rows = np.stack([top, top + 1, top + 2 * c, top + 2 * c + 1, 4 * n + u, 5 * n + u], 1).ravel()
        return rows, np.tile([0, 0, 0, 0, 1, 2], n), np.repeat(u // INTERVAL, 6), -(-n // INTERVAL)
    counts = [-(-4 * n // INTERVAL), -(-n // INTERVAL), -(-n // INTERVAL)]
    segments = np.concatenate([sum(counts[:p]) + np.arange(m) // INTERVAL for p, m in enumerate((4 * n, n, n))])
    return np.arange(6 * n), np.repeat([0, 1, 2], [4 * n, n, n]), segments, sum(counts)


def _scans() -> list[tuple[tuple[int, ...], int, int, int, int]]:
    """Components, first and last coefficient, high and low bit of each scan, in order."""
    out = [((0, 1, 2), 0, 0, 0, LOW)]
    out += [((c,), low, high, 0, bit) for low, high, bit in BANDS for c in range(3)]
    return out + [((0, 1, 2), 0, 0, LOW, 0)] + [((c,), low, high, bit, 0) for low, high, bit in BANDS if bit for c in range(3)]


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def write(coefficients: np.ndarray, shapes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of the blocks (zigzag order, one row each) of images with these rows and columns of units."""
    shapes = np.array(shapes)
    x = coefficients.astype(np.int32)
    mixed, single = _order(shapes, True), _order(shapes, False)
    coded = {}

    def scan(key, order, bits, length):
        _, _, segment, file = order
        per = length.shape[1] if length.ndim > 1 else 1
        data, size = pack(bits.ravel(), length.ravel(), np.repeat(segment, per), len(file))
        coded[key] = _stuffed(data, size)

    scan((0, 0), mixed, *dc_first(x[mixed[0], 0], mixed[2], mixed[1]))
    scan((0, LOW), mixed, (x[mixed[0], :1] & 1), np.ones((len(x), 1), np.int64))
    for low, high, bit in BANDS:
        scan((low, 0), single, *ac_first(x, low, high, bit))
        if bit:
            scan((low, bit), single, *ac_refine(x, low, high))
    head = _marker(0xDB, bytes(1) + bytes([1] * 64))
    dht = b"".join(_marker(0xC4, bytes([where]) + bytes(t.count) + bytes(t.symbol)) for where, t in zip((0x00, 0x10, 0x11, 0x12), tables()))
    dri = _marker(0xDD, struct.pack(">H", INTERVAL))
    segments_of = [np.searchsorted(o[3], np.arange(len(shapes) + 1)) for o in (mixed, single)]
    out = []
    for f, (r, c) in enumerate(shapes):
        n = int(r * c)
        counts = [-(-4 * n // INTERVAL), -(-n // INTERVAL), -(-n // INTERVAL)]
        parts = [b"\xff\xd8", _marker(0xFE, comments[f]), head, _marker(0xC2, struct.pack(">BHHB", 8, 16 * int(r), 16 * int(c), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), dht, dri]
        for comps, low, high, hi, lo in _scans():
            pieces = coded[low, hi]
            start = segments_of[0 if not high else 1][f]
            if high:
                start += sum(counts[: comps[0]])
                end = start + counts[comps[0]]
            else:
                end = segments_of[0][f + 1]
            table = 0 if not high else 1 if hi else 0 if lo else 2
            parts.append(_marker(0xDA, bytes([len(comps)]) + b"".join(bytes([k + 1, table]) for k in comps) + bytes([low, high, hi << 4 | lo])))
            for m, piece in enumerate(pieces[start:end]):
                if m:
                    parts.append(bytes([0xFF, 0xD0 + (m - 1) % 8]))
                parts.append(piece)
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _stuffed(data: np.ndarray, size: np.ndarray) -> list[bytes]:
    raw, at, out = data.tobytes(), 0, []
    for n in size.tolist():
        piece = raw[at : at + n]
        out.append(piece.replace(b"\xff", b"\xff\x00") if b"\xff" in piece else piece)
        at += n
    return out


# --- reading

_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.DOTALL)


@dataclass
class Scan:
    parts: tuple[int, ...]
    low: int
    high: int
    hi: int
    lo: int
    dc: tuple[Huffman | None, ...]
    ac: Huffman | None
    interval: int
    data: bytes


@dataclass
class Parsed:
    rows: int
    columns: int
    comment: bytes
    scans: list[Scan]
    quantiser: np.ndarray


@cache
def _table(body: bytes) -> Huffman:
    return Huffman(tuple(body[:16]), tuple(body[16:]))


def parse(raw: bytes) -> Parsed:
    """The headers and scans of a file with three components, luminance at twice the size of chroma."""
    at, interval, comment = 2, 0, b""
    huff: dict[int, Huffman] = {}
    quant = {}
    out = Parsed(0, 0, b"", [], np.ones(64))
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        code = raw[at + 1]
        if code == 0xD9:
            break
        n = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if code == 0xFE:
            comment = body
        elif code == 0xDB:
            for k in range(0, len(body), 65):
                quant[body[k]] = np.frombuffer(body[k + 1 : k + 65], np.uint8).astype(float)
        elif code == 0xC2:
            if body[5:] != bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]):
                raise ValueError("other components or sampling")
            h, w = struct.unpack(">HH", body[1:5])
            out.rows, out.columns = -(-h // 16), -(-w // 16)
        elif code == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                huff[body[k]] = _table(body[k + 1 : k + n])
                k += n
        elif code == 0xDD:
            interval = int.from_bytes(body, "big")
        elif code == 0xDA:
            m = body[0]
            parts = tuple(body[1 + 2 * k] - 1 for k in range(m))
            which = [body[2 + 2 * k] for k in range(m)]
            low, high, bits = body[1 + 2 * m :]
            end = _END.search(raw, at).start()
            out.scans.append(Scan(parts, low, high, bits >> 4, bits & 15, tuple(huff.get(w >> 4) for w in which), huff.get(0x10 | which[0] & 15), interval, raw[at:end]))
            at = end
        elif code in (0xC0, 0xC1):
            raise ValueError("not a progressive file")
    out.comment, out.quantiser = comment, quant[0]
    return out


class Bits:
    """Bit positions in many segments' bytes, read at once."""

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(p + b"\0\0\0\0\0\0\0\0" for p in pieces), np.uint8)
        ends = np.cumsum([len(p) + 8 for p in pieces])
        self.at = np.concatenate([[0], ends[:-1]]).astype(np.int64) * 8
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        n = len(data)
        self.window = sum(wide[k : k + n] << (40 - 8 * k) for k in range(6))  # 48 bits from each byte

    def peek(self, who: np.ndarray) -> np.ndarray:
        at = self.at[who]
        return (self.window[at >> 3] << (at & 7)) & 0xFFFFFFFFFFFF

    def one(self, who: np.ndarray) -> np.ndarray:
        bit = self.peek(who) >> 47
        self.at[who] += 1
        return bit

    def symbols(self, who: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each segment, and the 48-bit window after it."""
        x = self.peek(who)
        found = table.look[x >> 32]
        n = found >> 8
        self.at[who] += n
        return found & 255, (x << n) & 0xFFFFFFFFFFFF


def _value(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    v = x >> (48 - s)
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


def read_dc_first(bits: Bits, blocks: list[np.ndarray], parts: list[np.ndarray], scan: Scan, out: np.ndarray) -> None:
    n = np.array([len(b) for b in blocks])
    last = np.zeros((len(blocks), 3), np.int64)
    flat, flat_part = np.concatenate(blocks), np.concatenate(parts)
    start = np.cumsum(n) - n
    for k in range(n.max()):
        who = np.flatnonzero(n > k)
        part = flat_part[start[who] + k]
        for p in np.unique(part):
            own = who[part == p]
            s, x = bits.symbols(own, scan.dc[scan.parts.index(p)])
            bits.at[own] += s
            last[own, p] += _value(x, s)
            out[flat[start[own] + k], 0] = last[own, p] << scan.lo


def read_dc_refine(bits: Bits, blocks: list[np.ndarray], scan: Scan, out: np.ndarray) -> None:
    n = np.array([len(b) for b in blocks])
    flat, start = np.concatenate(blocks), np.cumsum(n) - n
    for k in range(n.max()):
        who = np.flatnonzero(n > k)
        out[flat[start[who] + k], 0] |= (bits.one(who) << scan.lo).astype(np.int16)


def read_ac_first(bits: Bits, first: np.ndarray, count: np.ndarray, scan: Scan, out: np.ndarray) -> None:
    """first: each segment's first block (they are contiguous); count: how many it has."""
    flat = out.reshape(-1)
    who = np.flatnonzero(count)
    block, end = first.copy(), first + count
    k = np.full(len(first), scan.low)
    while len(who):
        found = scan.ac.whole[bits.peek(who) >> 32]
        if found.all():  # each has a coefficient next, value and all
            place = k[who] + (found >> 8 & 15)
            blk = block[who]
            flat[blk * 64 + place] = ((found >> 16) - (1 << 15)) << scan.lo
            bits.at[who] += found & 255
            place += 1
            over = place > scan.high
            k[who] = place
            if over.any():
                who_over = who[over]
                block[who_over] += 1
                k[who_over] = scan.low
                who = who[block[who] < end[who]]
            continue
        symbol, x = bits.symbols(who, scan.ac)
        r, s = symbol >> 4, symbol & 15
        at, blk = k[who], block[who]
        coded = s > 0
        place = at + r
        flat[(blk * 64 + place)[coded]] = (_value(x, s) << scan.lo)[coded]
        bits.at[who] += s
        at = place + 1  # also after 16 zeros
        ends = ~coded & (r < 15)
        if ends.any():
            run = (1 << r[ends]) - 1 + (x[ends] >> (48 - r[ends]))
            bits.at[who[ends]] += r[ends]
            blk[ends] += run
            at[ends] = scan.high + 1
        over = at > scan.high
        blk[over] += 1
        at[over] = scan.low
        k[who], block[who] = at, blk
        if over.any():
            who = who[blk < end[who]]


def read_ac_refine(bits: Bits, first: np.ndarray, count: np.ndarray, scan: Scan, out: np.ndarray) -> None:
    flat, plus = out.reshape(-1), 1 << scan.lo
    skip = np.zeros(len(first), np.int64)  # blocks to end, this one included
    for b in range(count.max(initial=0)):
        who = np.flatnonzero(count > b)
        base = (first[who] + b) * 64
        left, fresh, new = np.zeros(len(who), np.int64), np.ones(len(who), bool), np.zeros(len(who), np.int64)
        ended = skip[who] > 0
        for k in range(scan.low, scan.high + 1):
            ask = np.flatnonzero(fresh & ~ended)
            if len(ask):
                symbol, x = bits.symbols(who[ask], scan.ac)
                r, s = symbol >> 4, symbol & 15
                sign = s > 0
                new[ask] = np.where(sign, np.where(x >> 47 > 0, plus, -plus), 0)
                bits.at[who[ask]] += sign
                left[ask] = r
                fresh[ask] = False
                stop = ~sign & (r < 15)
                if stop.any():
                    ends = ask[stop]
                    skip[who[ends]] = (1 << r[stop]) + (x[stop] >> (48 - r[stop]))
                    bits.at[who[ends]] += r[stop]
                    ended[ends] = True
            value = flat[base + k]
            known = np.flatnonzero(value)
            if len(known) == len(who):
                up = (bits.one(who) > 0) & ((np.abs(value) & plus) == 0)
                flat[base + k] = value + np.sign(value) * (up * plus).astype(np.int16)
                continue
            if len(known):
                fix = bits.one(who[known]) > 0
                v = value[known]
                flat[(base + k)[known]] = np.where(fix & ((np.abs(v) & plus) == 0), v + np.sign(v) * plus, v)
            zero = np.flatnonzero((value == 0) & ~ended)
            here = zero[left[zero] == 0]
            flat[(base + k)[here]] = new[here]
            fresh[here] = True
            left[zero] -= 1
        skip[who[skip[who] > 0]] -= 1


@lru_cache(256)
def _rounds(script: tuple) -> list[int]:
    """For each scan (components, first and last coefficient) one more than the last round that touched its coefficients."""
    done: dict[tuple[int, int], int] = {}
    out = []
    for parts, low, high in script:
        own = [(c, k) for c in parts for k in range(low, high + 1)]
        out.append(1 + max(done.get(x, 0) for x in own))
        done |= dict.fromkeys(own, out[-1])
    return out


def read(files: list[bytes]) -> tuple[np.ndarray, list[Parsed]]:
    """Coefficients (zigzag order, a row for each block) of all files, and what their headers say.

    Scans with equal parameters and tables are decoded together, each after the scans of its coefficients before it.
    """
    parsed = [parse(x) for x in files]
    base = np.cumsum([0] + [6 * p.rows * p.columns for p in parsed])
    out = np.zeros((int(base[-1]), 64), np.int16)
    rounds: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for f, p in enumerate(parsed):
        for step, s in zip(_rounds(tuple((s.parts, s.low, s.high) for s in p.scans)), p.scans):
            tables = tuple(map(id, s.dc)) + s.parts if not s.high else id(s.ac)
            rounds[step][s.low, s.high, s.hi, s.lo, tables].append((f, s))
    for step in sorted(rounds):
        groups = rounds[step]
        for (low, high, hi, lo, _), members in groups.items():
            pieces, blocks, parts = [], [], []
            for f, s in members:
                r, c = parsed[f].rows, parsed[f].columns
                if not high:
                    order, part, _, _ = _order_of(r, c, True)
                    n, per = r * c, s.interval or r * c
                    for u in range(0, n, per):
                        blocks.append(base[f] + order[6 * u : 6 * (u + per)])
                        parts.append(part[6 * u : 6 * (u + per)])
                else:
                    begin = base[f] + (0, 4 * r * c, 5 * r * c)[s.parts[0]]
                    n = 4 * r * c if s.parts[0] == 0 else r * c
                    per = s.interval or n
                    blocks += [(begin + u, min(per, n - u)) for u in range(0, n, per)]
                some = _RESTART.split(s.data)
                pieces += [x.replace(b"\xff\x00", b"\xff") for x in some]
            bits, scan = Bits(pieces), members[0][1]
            if not high:
                read_dc_refine(bits, blocks, scan, out) if hi else read_dc_first(bits, blocks, parts, scan, out)
            else:
                first, count = np.array(blocks, np.int64).T.copy()
                (read_ac_refine if hi else read_ac_first)(bits, first, count, scan, out)
    return out, parsed


@cache
def basis() -> np.ndarray:
    """Pixels (row-major) of each zigzag coefficient."""
    n = np.arange(8)
    one = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


def rgb(coefficients: np.ndarray, parsed: Parsed) -> np.ndarray:
    """The full-resolution image (3, height, width) of one file: inverse transform, chroma upsampled, clipped."""
    x = coefficients.astype(np.float32)
    if (parsed.quantiser != 1).any():
        x *= parsed.quantiser.astype(np.float32)
    # the small shift rounds exact halves alike whatever the order of summation
    pixels = x @ basis()
    pixels += np.float32(128.501)
    np.floor(pixels, out=pixels)
    r, c = parsed.rows, parsed.columns
    plane = lambda b, r, c: b.reshape(r, c, 8, 8).swapaxes(1, 2).reshape(8 * r, 8 * c)
    y = plane(pixels[: 4 * r * c], 2 * r, 2 * c).reshape(8 * r, 2, 8 * c, 2)
    y += np.float32(0.501)
    cb, cr = (plane(pixels[k * r * c : (k + 1) * r * c], r, c) - np.float32(128) for k in (4, 5))
    out = np.empty((3, 16 * r, 16 * c), np.uint8)
    for k, more in enumerate((np.float32(1.402) * cr, np.float32(-0.344136) * cb - np.float32(0.714136) * cr, np.float32(1.772) * cb)):
        channel = y + more[:, None, :, None]
        np.clip(channel, 0, 255, out=channel)
        out[k] = channel.reshape(16 * r, 16 * c)
    return out
