"""Long repeats, media and packing: brute force, exact round trips, and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from cellweave.llm import jpeg, media, packing, queries, repeats

ODD = [(1, None), (2, ""), (3, "é" * 500), (4, "x" * 90_000), (5, "ab" * 400), (5, "ab" * 400), (None, "short"), (6, "<|endoftext|> don't ΣΑΣ \x1c 🙂")]


def removed(texts):
    """n_removed, n_spans and hash of what remains of each text, every window counted."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in raw for p in range(len(b) - 399))
    out = []
    for b in raw:
        step = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                step[p] += 1
                step[p + 400] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), len(b) - len(kept), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repeats_like_brute_force(spark, seed):
    rnd = random.Random(seed)
    free = lambda n: "".join(rnd.choices("abcdefgh é\n", k=n))
    passages = [free(n) for n in (380, 399, 400, 401, 700, 1500)] + ["z" * 450, "lorem " * 90]
    texts = [free(rnd.randint(0, 600)) + "".join(rnd.choice(passages) + free(rnd.choice([0, 1, 40])) for _ in range(rnd.randint(0, 3))) for _ in range(50)]
    texts += [texts[3], None, "", "q" * 1200, "ab" * 205, passages[2], passages[2]]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_bytes int").repartition(4)
    got = {r.doc_id: r for r in repeats.removed(df, keep=df.columns).collect()}
    for i, want in enumerate(removed(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want, i


def test_repeats_odd_rows(spark):
    df = spark.createDataFrame([(5, "ab" * 400), (5, "ab" * 400), (None, "short"), (1, None)], "doc_id long, text string")
    rows = repeats.removed(df, keep=["doc_id"]).collect()
    got = sorted((r.n_bytes, r.n_removed) for r in rows)
    assert all(r.n_passages == 0 for r in rows)  # one word
    assert got == [(0, 0), (5, 0), (800, 800), (800, 800)]
    assert repeats.removed(df.limit(0), keep=["doc_id"]).count() == 0


def test_long_texts_and_passages(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, own = prose(70), prose(70)
    texts = [prose(60_000) + " " + shared + " " + prose(1000), prose(300) + " " + shared, prose(90) + " " + own + " " + prose(90) + " " + own, prose(500), "é" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.removed(df, keep=["doc_id"], most_chars=1000).collect()}
    for i, want in enumerate(removed(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, hashlib.sha256(got[i].kept).hexdigest()) == want
    # a passage is in another text; one that a text repeats within itself isn't
    assert [got[i].n_passages for i in range(5)] == [1, 1, 0, 0, 0]


def test_jpeg_round_trip_of_any_coefficients():
    rng = np.random.default_rng(0)
    for kind in range(3):
        shapes, blocks = [], []
        for _ in range(4):
            r, c = jpeg.shape_of(int(rng.integers(1, 150)))
            x = rng.integers(-147, 148, (6 * r * c, 64))
            x *= rng.random(x.shape) < (1, 0.3, 0.03)[kind]
            shapes.append((r, c))
            blocks.append(x)
        files = jpeg.write(np.concatenate(blocks), shapes, [b"%d" % k for k in range(4)])
        read, parsed = jpeg.read(files)
        assert (read == np.concatenate(blocks)).all() and [p.comment for p in parsed] == [b"0", b"1", b"2", b"3"]
        # one file alone gives the same bytes
        assert jpeg.write(blocks[2], shapes[2:3], [b"2"])[0] == files[2]


def test_inverse_transform_of_a_flat_block():
    x = np.zeros((6, 64), int)
    x[:4, 0] = 80  # luminance 10 above the middle
    _, parsed = jpeg.read(jpeg.write(x, [(1, 1)], [b""]))
    image = jpeg.rgb(x, parsed[0])
    assert image.shape == (3, 16, 16) and (image == 138).all()
    cosine = np.zeros((6, 64), int)
    cosine[0, 1] = 64  # first horizontal wave
    want = np.floor(128.5 + 64 / 8 * np.sqrt(2) * np.cos((2 * np.arange(8) + 1) * np.pi / 16))
    assert (jpeg.rgb(cosine, parsed[0])[1, 0, :8] == want).all()


def test_media_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "m", "p") for i, t in ODD], "doc_id long, text string, media string, payload string")
    got = media.stored(df, keep=df.columns)
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns.count("media") == 1
    by = Counter()
    for r in rows:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert len(r.rgb) == 3 * r.height * r.width and r.media[:2] == b"\xff\xd8"
        by[r.text or "", bytes(r.media), r.feature] += 1
    assert len(by) == len({t or "" for _, t in ODD})  # equal texts, equal files
    assert media.stored(df.limit(0), keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        jpeg.read([b"not a file"])


def placed(runs, counts):
    bins, seen = {}, {n: set() for n in counts}
    for r in runs:
        for k in range(r.bins * r.each):
            bins.setdefault(r.bin + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
            assert r.rank + k not in seen[r.length]
            seen[r.length].add(r.rank + k)
    assert all(seen[n] == set(range(c)) for n, c in counts.items())
    for at in bins.values():
        place = 0
        for offset, length in sorted(at):
            assert offset == place
            place += length
    return bins


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_never_loses_a_bin():
    rnd = random.Random(0)
    for _ in range(150):
        sizes = [rnd.randint(1, 20) if rnd.random() < 0.5 else rnd.randint(6, 20) for _ in range(rnd.randint(1, 9))]
        counts = dict(Counter(sizes))
        runs, bins, fixed = packing.plan(counts, 20)
        got = placed(runs, counts)
        assert len(got) == bins
        # what the reduction fixed together with the best packing of the rest is a best packing
        rest = [n for b, at in got.items() if b >= fixed for _, n in at]
        assert fixed + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20), sizes


def test_plan_of_many_pieces():
    rnd = random.Random(1)
    counts = {n: rnd.randint(1, 10**6) for n in rnd.sample(range(1, 4097), 900)}
    runs, bins, _ = packing.plan(counts)
    assert sum(r.bins * r.each for r in runs) == sum(counts.values())
    assert bins <= 1.01 * sum(n * c for n, c in counts.items()) / 4096 + 1 or max(counts) > 2048


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    rnd = random.Random(3)
    al = "abcXYZ .,!?'’sStTdD0123456789#$%&*|<>-_\n\téÉßΣς中文́ \x1c\x85"
    items = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a 'S.s x#'s <|endoftext|> <|ENDOFTEXT|> don't. it's, we'll!", ""]
    want = Tokenizer.from_file(path).encode_batch(items, add_special_tokens=False)
    encoder = packing.Encoder(path, most=50)  # so few that parts are forgotten
    got = [x for k in range(0, len(items), 40) for x in encoder.encode(items[k : k + 40])]
    assert got == [np.array(w.ids, "<u4").tobytes() for w in want]


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in bins.values():
        place = 0
        for offset, length in sorted(at):
            assert offset == place
            place += length
        assert place <= 4096


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, piece int, length int")
    check_packing(packing.packed(df, public_tokenizers.path(packing.VOCABULARY), per_bucket=3).collect(), ODD)
    assert packing.packed(df.limit(0), public_tokenizers.path(packing.VOCABULARY)).count() == 0


def test_op2_contract(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op2_packing(spark, SF).collect(), texts)


def test_op4_and_op7_contracts(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op4_media(spark, SF).collect()}
    for i, t in docs:
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.rgb) == 3 * r.height * r.width
    got = {r.doc_id: r for r in queries.op7_repeats(spark, SF).collect()}
    for (i, _), want in zip(docs, removed([t for _, t in docs])):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
