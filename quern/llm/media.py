"""Operator 6: PNG media columns.

A payload becomes the 8-bit grey samples of a PNG of 64 samples a row, each row filtered by what leaves the least differences. The reader walks
the chunks, tests every checksum, inflates the data chunks and undoes the row filters with numpy. A cosine-transform hash of the samples' low frequencies
compares images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.storage import Workspace

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Largest compressed bytes of a data chunk.
CHUNK = 1 << 20


class BadImage(ValueError):
    """The bytes are not a PNG that this module reads."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(samples: np.ndarray, filter_type: int | None = None, level: int = 1) -> bytes:
    """An 8-bit grey PNG of `samples` (rows, columns). `filter_type`: 0 none, 1 left, 2 up; by default each row takes the one whose bytes, read as
    signed, have the least sum without sign, the first of equals."""
    rows, columns = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    bodies = np.stack([samples, left, up])
    if filter_type is None:
        kinds = np.abs(bodies.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0).astype(np.uint8)
    elif filter_type in (0, 1, 2):
        kinds = np.full(rows, filter_type, dtype=np.uint8)
    else:
        raise ValueError("filters to write: 0, 1, 2")
    lines = np.empty((rows, columns + 1), dtype=np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = bodies[kinds, np.arange(rows)]
    packed = zlib.compress(lines.tobytes(), level)
    data = b"".join(_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def _average_or_paeth(kind: int, line: np.ndarray, above: np.ndarray) -> None:
    """In place; these two depend on the sample to the left just restored."""
    left = corner = 0
    for k, up in enumerate(above.tolist()):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
        left = (int(line[k]) + guess) & 255
        line[k] = left
        corner = up


def png_decode(png: bytes) -> np.ndarray:
    """Samples (rows, columns) of an 8-bit grey PNG without interlace. Raises BadImage for anything else or damaged."""
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise BadImage("cut short")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not an 8-bit grey PNG")
    columns, rows = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(lines) != rows * (columns + 1):
        raise BadImage("size")
    lines = lines.reshape(rows, columns + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("filter type")
    if (left := kinds == 1).any():
        out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    at = 0
    while at < rows:  # runs of rows that one filter covers
        kind, end = kinds[at], at + 1
        while end < rows and kinds[end] == kind:
            end += 1
        if kind == 2:
            if at:
                out[at] += out[at - 1]
            out[at:end] = np.cumsum(out[at:end], axis=0, dtype=np.uint8)
        elif kind > 2:
            for k in range(at, end):
                _average_or_paeth(int(kind), out[k], out[k - 1] if k else np.zeros(columns, dtype=np.uint8))
        at = end
    return out


_GRID, _LOW = 32, 8
_COSINES = np.cos(np.pi / _GRID * (np.arange(_GRID) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the samples, averaged over a grid of 32 x 32, exceed their median.

    The mean (frequency 0, 0) counts as 0. An image with fewer rows or columns than the grid repeats them.
    """
    rows, columns = samples.shape
    means = samples.astype(np.float64)
    for axis, n in ((0, rows), (1, columns)):
        if n >= _GRID:
            starts = np.arange(_GRID) * n // _GRID
            sizes = np.diff(np.append(starts, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            means = np.add.reduceat(means, starts, axis=axis) / sizes
        else:
            means = np.take(means, np.arange(_GRID) * n // _GRID, axis=axis)
    low = np.round(_COSINES @ means @ _COSINES.T, 6)
    low[0, 0] = 0
    return np.packbits(low.ravel() > np.median(low)).tobytes()


def payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of the image's width."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


#: Rows, and bytes of their values, that are worked on at a time; one longer value is worked on alone.
SLICE_ROWS, SLICE_BYTES = 256, 32 << 20


def slices(column: pa.Array):
    """(from, size) of runs of a binary column within both bounds."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    at = total = 0
    for k, size in enumerate(sizes):
        if k > at and (k - at >= SLICE_ROWS or total + size > SLICE_BYTES):
            yield at, k - at
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes) - at


def _encode(batches):
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        for at, n in slices(column):
            texts = [t or b"" for t in column.slice(at, n).to_pylist()]
            images = [png_encode(np.frombuffer(payload(t), dtype=np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array([len(t) for t in texts], pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (PNG). A null or empty text is an image of one row of 0. Rows that repeat a document give
    equal rows; other columns are ignored; an empty table gives none."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rows int, columns int, feature_bits binary"


def _features(batches):
    for batch in batches:
        media = batch.column("media")
        for at, n in slices(media):
            rows = []
            for png in media.slice(at, n).to_pylist():
                samples = png_decode(png)
                raw = samples.tobytes()
                bits = cosine_hash(samples)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), *samples.shape, bits))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("n_bytes").slice(at, n), *arrays], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rows", "columns", "feature_bits"])


def features(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of stored media, from the bytes read back. A damaged image stops the job: losing it silently is worse."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = Workspace(spark, "media").table(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "png")
    return features(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
