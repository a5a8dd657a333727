"""Media columns: payloads as progressive JPEG, read back into coefficients and full-resolution RGB tensors.

A text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are the quantised coefficients of a
picture's blocks: one byte is one coefficient, less ``LEVEL``, which keeps letters small. Coefficients survive the
format's entropy coding exactly, so the stored file gives the payload back bit for bit. The file is written with
spectral-selection and successive-approximation scans; reading accumulates them, inverse-transforms the blocks,
upsamples chroma and gives an RGB tensor of which features are computed.

Null texts count as empty, and an empty payload is 64 zero bytes. Repeated rows and equal texts get equal files.
Files that aren't such JPEGs raise an error on reading. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.llm import jpeg
from cellweave.llm.common import chunks, sealed, texts

LEVEL = 108


def payloads(items: list[bytes]) -> list[bytes]:
    return [x + bytes(max(64, -(-len(x) // 64) * 64) - len(x)) for x in items]


def encode(items: list[bytes]) -> list[bytes]:
    """A file for each payload (a positive multiple of 64 bytes)."""
    shapes = [jpeg.shape_of(len(x) // 64) for x in items]
    space = np.array([6 * r * c * 64 for r, c in shapes])
    start = np.cumsum(space) - space
    flat = np.full(int(space.sum()), LEVEL, np.int64)
    for at, x in zip(start, items):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
    return jpeg.write((flat - LEVEL).reshape(-1, 64), shapes, [struct.pack(">Q", len(x)) for x in items])


def decode(files: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each file's payload and RGB tensor."""
    coefficients, parsed = jpeg.read(files)
    at = 0
    for p in parsed:
        n = 6 * p.rows * p.columns
        own = coefficients[at : at + n]
        at += n
        (size,) = struct.unpack(">Q", p.comment)
        yield (own.reshape(-1)[:size] + LEVEL).astype(np.uint8).tobytes(), jpeg.rgb(own, p)


def features(tensor: np.ndarray) -> str:
    """Mean of each channel and shares of pixels at or above three levels of green, from whole numbers alone."""
    n = tensor.shape[1] * tensor.shape[2]
    means = tensor.reshape(3, -1).sum(1, dtype=np.int64) / n
    light = [np.count_nonzero(tensor[1] >= level) / n for level in (64, 128, 192)]
    return ":".join(f"{v:.4f}" for v in [*means, *light])


def stored(docs: DataFrame, *, text: str = "text", keep: list[str], most_chars: int = 1_000_000) -> DataFrame:
    """``keep``, ``media`` (the stored file), and what reading it back gives: ``payload``, ``height``, ``width``,
    ``feature`` and ``rgb``, the full-resolution tensor's bytes, channel by channel, row by row."""
    made = ["media", "payload", "height", "width", "feature", "rgb"]
    hidden, shown, schema = sealed(docs, keep, tuple(made))
    names = [f"_k{i}" for i in range(len(keep))]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches, "_text", most_chars):
            files = encode(payloads([x.encode("utf-8", "replace") for x in texts(frame["_text"])]))
            out = [(payload, t.shape[1], t.shape[2], features(t), t.tobytes()) for payload, t in decode(files)]
            yield pd.concat([frame[names].assign(media=files), pd.DataFrame(out, columns=made[1:], index=frame.index)], axis=1)

    rows = docs.select(*hidden, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = rows.mapInPandas(store, schema + ", media binary, payload binary, height int, width int, feature string, rgb binary")
    return out.select(*shown, *made)
