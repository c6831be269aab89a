"""Label rasters and masks in PNG files as runs: decoded where they lie, one file at a time, never collected."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"(?:_s|mask_|/)(\d+)\.png$"


def _unfiltered(how: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bytes of (rows, pixels, bytes of a pixel) from those that the rows' filters have left.

    Where only none, Sub and Up occur, whole rows are summed.  Average and Paeth need the pixels to the left
    and above, so then all pixels of a diagonal, which need none of each other, are done at once."""
    height, width, step = raw.shape
    if not np.isin(how, (3, 4)).any():
        out, above = np.empty_like(raw), np.zeros((width, step), np.uint8)
        for y in range(height):
            row = np.add.accumulate(raw[y], axis=0, dtype=np.uint8) if how[y] == 1 else raw[y]
            out[y] = above = row + above if how[y] == 2 else row
        return out
    # A row above and a pixel before each row are 0.  The pixels of a diagonal lie ``width`` apart.
    padded = np.zeros((height + 1, width + 1, step), np.int16)
    flat, source = padded.reshape(-1, step), raw.reshape(-1, step)
    kinds = [(how == k)[:, None] for k in range(5)]
    for d in range(height + width - 1):
        top, end = max(0, d - width + 1), min(height, d + 1)
        n, first = end - top, (top + 1) * (width + 1) + d - top + 1
        at = lambda k: flat[first - k : first - k + (n - 1) * width + 1 : width]
        a, b, c = at(1), at(width + 1), at(width + 2)
        of = slice(top, end)
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.select([kinds[1][of], kinds[2][of], kinds[3][of], kinds[4][of]], [a, b, (a + b) >> 1, paeth], 0)
        start = top * width + d - top
        left = source[start : start + (n - 1) * (width - 1) + 1 : width - 1] if width > 1 else source[start : start + 1]
        at(0)[:] = (left + guess) & 255
    return padded[1:, 1:].astype(np.uint8)


def decoded(content: bytes) -> np.ndarray:
    """Pixels of a grey or colour PNG of 8 or 16 bits, not interlaced; of colours the first channel."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data, head = 8, [], None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth not in (8, 16) or channels is None or interlaced:
        raise ValueError("a kind of PNG that is not read")
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, step))
    pixels = out.reshape(height, width, channels, depth // 8)[:, :, 0].astype(np.uint16)
    return pixels[..., 0] << 8 | pixels[..., 1] if depth == 16 else pixels[..., 0]


def encoded(pixels: np.ndarray) -> bytes:
    """A grey PNG of 8 bits, or of 16 where the type of the pixels has more."""
    depth = 16 if pixels.dtype.itemsize > 1 else 8
    rows = np.ascontiguousarray(pixels, ">u2" if depth == 16 else "u1").view(np.uint8).reshape(len(pixels), -1)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # no filter
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def runs_of(pixels: np.ndarray) -> np.ndarray:
    """Rows label, y, x0, x1 of equal pixels that are not 0."""
    edge = np.ones((len(pixels), 1), bool)
    change = np.hstack([edge, pixels[:, 1:] != pixels[:, :-1]])
    y, x0 = np.nonzero(change)
    x1 = np.append(x0[1:], 0)
    x1[np.append(y[1:] != y[:-1], True)] = pixels.shape[1]
    label = pixels[y, x0]
    return np.stack([label, y, x0, x1], 1)[label > 0]


#: Runs in a batch that Python gives back.
RUNS_AT_ONCE = 100_000


def label_runs(spark: SparkSession, pattern: str, binary: bool = False) -> DataFrame:
    """slice, label, y, x0, x1 of all files of the pattern; the slice is the number at the end of a file's
    name.  Of masks (``binary``) every pixel above 0 has the label 1.  A file that cannot be read fails its
    task, which Spark tries again.

    Spark reads the files, from any store that it reaches, and sends them to Python in batches; for slices of
    100 MB set ``spark.sql.execution.arrow.maxBytesPerBatch``, or read them one by one (``trees``)."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.regexp_extract("path", _NAME, 1).cast("long").alias("slice"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, z, content in zip(batch["path"], batch["slice"], batch["content"]):
                pixels = decoded(content)
                table = runs_of((pixels > 0).astype(np.uint16) if binary else pixels)
                for k in range(0, len(table), RUNS_AT_ONCE):
                    part = table[k : k + RUNS_AT_ONCE]
                    yield pd.DataFrame(part, columns=["label", "y", "x0", "x1"]).astype("int64").assign(path=path, slice=z)[["path", "slice", "label", "y", "x0", "x1"]]

    return files.mapInPandas(decode, "path string, slice long, label long, y long, x0 long, x1 long")


def mask_tree(spark: SparkSession, root: str) -> DataFrame:
    """Runs of a tree ``<root>/<neuron>/chain_<k>/masks/mask_<z>.png``, or ``<root>/<neuron>/<z>.png`` (chain 0)."""
    deep, flat = (label_runs(spark, f"{root}/{p}", binary=True) for p in ("*/chain_*/masks/mask_*.png", "*/[0-9]*.png"))
    of = lambda d, pattern: d.select(
        F.regexp_extract("path", pattern, 1).alias("neuron"), "path", "slice", "y", "x0", "x1")
    rows = of(deep, r"([^/]+)/chain_\d+/masks/[^/]+$").unionByName(of(flat, r"([^/]+)/[^/]+$"))
    chain = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(path, '/chain_(\\d+)/', 1), '') as bigint)"), F.lit(0))
    return rows.select("neuron", chain.alias("chain_idx"), "slice", "y", "x0", "x1")
