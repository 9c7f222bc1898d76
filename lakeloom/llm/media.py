"""Binary media columns: PNG written and read chunk by chunk, and a low-frequency cosine-transform hash.

A payload is stored as an 8-bit greyscale PNG of a fixed width. Reading checks the signature, the CRC-32
of every chunk and the zlib stream's Adler-32, and undoes the five row filters with numpy: runs of rows by sums, or,
where averages or Paeth predictors occur, all rows of an image along its diagonals. Stored rows take the filter of the
least sum of differences among none, sub and up. The feature is
a 64-bit hash: the image's 32 x 32 area means, their 8 x 8 lowest cosine coefficients, one bit for each
coefficient above the median. All sums are whole numbers below 2**53, so equal images give equal hashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SIDE, LOW = 576, 32, 8
#: The cosine basis in 12-bit fixed point.
BASIS = np.rint(np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE)) * 4096)
FILTERS = ("none", "sub", "up", "average", "paeth")


class MediaError(ValueError):
    """A stored image is damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def encode_png(pixels: np.ndarray, row_filter: str = "adaptive", level: int = 1) -> bytes:
    """Rows of 8-bit grey samples as PNG; row_filter is one of FILTERS, "mixed" to rotate through them, or "adaptive"."""
    height, width = pixels.shape
    rows = pixels.astype(np.int16)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    raw = np.empty((height, width + 1), np.uint8)
    if row_filter == "adaptive":
        worth = np.stack([np.abs(((rows - guess) & 255).astype(np.uint8).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for guess in (0, left, above)])
        raw[:, 0] = worth.argmin(axis=0)
    else:
        raw[:, 0] = np.arange(height) % 5 if row_filter == "mixed" else FILTERS.index(row_filter)
    for k in np.unique(raw[:, 0]):
        at = raw[:, 0] == k
        guess = (0, left[at], above[at], (left[at] + above[at]) >> 1, None)[k] if k < 4 else _paeth(left[at], above[at], corner[at])
        raw[at, 1:] = (rows[at] - guess) & 255
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray) -> np.ndarray:
    kinds = raw[:, 0]
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    if (kinds > 2).any():
        return _unfilter_diagonals(raw)
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1), np.uint8)  # a zero row above
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(raw)]
    for y, end in zip(cuts, cuts[1:], strict=False):
        block = raw[y:end, 1:]
        if kinds[y] == 0:
            out[y + 1 : end + 1] = block
        elif kinds[y] == 1:
            np.cumsum(block, axis=1, dtype=np.uint8, out=out[y + 1 : end + 1])
        else:
            np.cumsum(np.vstack([out[y : y + 1], block]), axis=0, dtype=np.uint8, out=out[y : end + 1])
    return out[1:]


def _unfilter_diagonals(raw: np.ndarray) -> np.ndarray:
    """A sample needs those to the left, above, and above to the left: all samples of a diagonal are made at once."""
    height, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((height + 1, width + 1), np.int16)  # a zero row above, a zero column at the left
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = np.choose(raw[y, 0], [np.zeros_like(a), a, b, (a + b) >> 1, _paeth(a, b, c)])
        out[y + 1, x + 1] = (raw[y, x + 1] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; raises MediaError where a checksum or a size is wrong."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, width, height, packed, ended = 8, 0, 0, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut off inside a chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise MediaError("cut off inside a chunk")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"wrong checksum in chunk {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise MediaError("wrong size of the header")
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise MediaError("only 8-bit greyscale without interlace")
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or not width or not height:
        raise MediaError("no end, no header or no samples")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise MediaError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def area_means(pixels: np.ndarray) -> np.ndarray:
    """32 x 32 whole-number means in 1/256 steps; smaller sides repeat their samples."""
    out = pixels.astype(np.int64) * 256
    for axis in (0, 1):
        n = out.shape[axis]
        if n < SIDE:
            out = np.take(out, np.arange(SIDE) * n // SIDE, axis=axis)
        else:
            edges = np.arange(SIDE + 1) * n // SIDE
            shape = (SIDE, 1) if axis == 0 else (1, SIDE)
            out = np.add.reduceat(out, edges[:-1], axis=axis) // np.diff(edges).reshape(shape)
    return out


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients lie above their median."""
    low = (BASIS @ area_means(pixels).astype(np.float64) @ BASIS.T).ravel()
    bits = low > np.partition(low[1:], 31)[31]
    return np.packbits(bits).tobytes().hex()


def payload_of(data: bytes, width: int = WIDTH) -> bytes:
    """data, filled with bytes 255 up to a positive multiple of width."""
    return data + b"\xff" * (-len(data) % width if data else width)


def to_media(df: DataFrame, text: str = "text", out: str = "media", row_filter: str = "adaptive") -> DataFrame:
    """Append a binary column with the text's UTF-8 bytes (null: empty) as PNG; a column named `out` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [encode_png(np.frombuffer(payload_of(x or b""), np.uint8).reshape(-1, WIDTH), row_filter) for x in b.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(media, pa.binary())], [*kept, out])

    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).withColumn(out, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Append `samples` (the stored bytes read back), `feature` and `media_error` (null where all checksums hold).

    A null or damaged image has null samples and feature, and the reason in media_error.
    """
    kept = [c for c in df.columns if c not in ("samples", "feature", "media_error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(media).to_pylist():
                try:
                    pixels = decode_png(x or b"")
                    found.append((pixels.tobytes(), cosine_hash(pixels), None))
                except MediaError as e:
                    found.append((None, None, str(e)))
            parts = list(zip(*found, strict=True)) or [(), (), ()]
            more = [pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, "samples", "feature", "media_error"])

    schema = df.select(*kept).withColumns({"samples": F.lit(None).cast("binary"), "feature": F.lit(None).cast("string"), "media_error": F.lit(None).cast("string")}).schema
    return df.mapInArrow(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's digests of every document: stored, read back and hashed in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = x or b""
                stored = encode_png(np.frombuffer(payload_of(data), np.uint8).reshape(-1, WIDTH))
                pixels = decode_png(stored)
                back = pixels.tobytes()
                rows.append((i, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(pixels)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], NAMES)

    NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
