"""Texts as PNG images in binary columns, and perceptual hashes of such images.

Writes 8-bit greyscale PNG, one byte a pixel, and reads 8-bit greyscale PNG of any
filter types: signature, chunks with CRC-32, zlib stream, unfiltering in numpy.
The hash takes a 32 x 32 block mean, its cosine transform, and the signs of the
low frequencies against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, sliced

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, LEVEL, SIDE, LOW = 64, 6, 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(pixels: np.ndarray) -> tuple[int, np.ndarray]:
    """Of none, Sub and Up, the filter with the least sum of absolute signed differences."""
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    sums = [int(np.minimum(x, -x.astype(np.int16) & 255).sum()) for x in (pixels, sub, up)]
    best = int(np.argmin(sums))
    return best, (pixels, sub, up)[best]


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """payload's length must be a positive multiple of width."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    kind, rows = _filtered(pixels)
    scan = np.empty((len(rows), width + 1), np.uint8)
    scan[:, 0], scan[:, 1:] = kind, rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(scan: np.ndarray) -> np.ndarray:
    kinds, rows = scan[:, 0], scan[:, 1:].copy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    zero = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        kind, above = int(kinds[a]), rows[a - 1] if a else zero
        if kind == 1:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=rows[a:b])
        elif kind == 2:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind in (3, 4):
            for y in range(a, b):
                row, up = rows[y].tolist(), (rows[y - 1] if y else zero).tolist()
                left = corner = 0
                for x, value in enumerate(row):
                    if kind == 3:
                        guess = (left + up[x]) // 2
                    else:
                        p = left + up[x] - corner
                        near = (abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner)
                        guess = min(near)[2]
                    left, corner = (value + guess) & 255, up[x]
                    row[x] = left
                rows[y] = row
        elif kind:
            raise ValueError(f"unknown filter type {kind}")
    return rows


def decode_png(media: bytes) -> np.ndarray:
    """The pixels as rows; raises ValueError on a damaged or unsupported file."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, data, kind = 8, b"", [], b""
    while kind != b"IEND":
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk fails its checksum")
        head = body if kind == b"IHDR" else head
        data += [body] * (kind == b"IDAT")
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if (depth, colour, interlaced) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing is read")
    scan = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if scan.size != height * (width + 1):
        raise ValueError("the image data has a wrong length")
    return _unfilter(scan.reshape(height, width + 1))


_COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1)[None, :] * np.arange(LOW)[:, None] / (2 * SIDE))


def _means(x: np.ndarray, side: int) -> np.ndarray:
    """side block means along the first axis; blocks overlap where there are fewer rows than blocks."""
    n = len(x)
    starts = np.arange(side) * n // side
    ends = np.maximum(starts + 1, (np.arange(side) + 1) * n // side)
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return (sums[ends] - sums[starts]) / (ends - starts)[:, None]


def dct_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies exceed their median."""
    small = _means(_means(pixels.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6)
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (its PNG). Null counts as an empty text, of one row of zeros.

    A row for each row, repeated ones too; equal texts give equal images. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            media = [encode_png(p, level=level) for _, p in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Reads the media column back: digests of the stored form and of what it holds, and the cosine hash.

    A row for each row, null ids too; a media value that is null, damaged or of another format is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in range(6)]
            for m in batch.column(2):
                m = m.as_py()
                pixels = decode_png(m)
                payload = pixels.tobytes()
                for out, v in zip(rows, (len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), sha(m).hexdigest(), dct_hash(pixels)), strict=True):
                    out.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, rows, kinds)], [f.split()[0] for f in FEATURE_SCHEMA.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_SCHEMA)
