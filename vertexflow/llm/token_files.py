"""Token ids in binary files of patched frame-of-reference blocks.

A file holds, in this order: a head (magic, number of documents, ids, blocks,
block size), the documents' ids and token counts, the index of block starts, and
the blocks. A block stores its minimum, the bit width that a given share of its
differences fits, the differences packed at that width, and the positions and
values of the others in an exception list.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, new_path, sliced, staged
from .pieces import PieceCache

MAGIC = b"VFPFOR01"
HEAD = struct.Struct("<8sqqqi")
BLOCK = struct.Struct("<IBH")
#: Ids in a block, and the share of them that the packed width must hold.
BLOCK_SIZE, PERCENTILE = 1024, 0.9
#: A file is closed at this many ids, so that reading one takes bounded memory.
FILE_IDS = 1_000_000
#: Up to so many files their list goes to every reader.
BROADCAST_FILES = 200_000


_BIT_LENGTH = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 32-bit values."""
    high = values >> np.uint32(16)
    if not high.any():
        return _BIT_LENGTH[values]
    return np.where(high > 0, _BIT_LENGTH[high] + np.uint8(16), _BIT_LENGTH[values & np.uint32(0xFFFF)]).astype(np.uint8)


def _lanes(width: int) -> list[tuple[int, int, int]]:
    """Eight values of a width fill as many bytes; for each its place, its first byte and its first bit there."""
    return [(j, j * width >> 3, j * width & 7) for j in range(8)]


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of values below 2**width as its own byte string, most significant bits first."""
    n, count = rows.shape
    wide, size = (np.uint32, 32) if width <= 25 else (np.uint64, 40)
    padded = np.zeros((n, -(-count // 8) * 8), wide)
    padded[:, :count] = rows
    lanes = padded.reshape(n, -1, 8)
    out = np.zeros((n, lanes.shape[1], width + 5), np.uint8)
    for j, byte, bit in _lanes(width):
        value = lanes[:, :, j] << wide(size - width - bit)
        for k in range((bit + width + 7) // 8):
            out[:, :, byte + k] |= (value >> wide(size - 8 - 8 * k)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :, :width]).reshape(n, -1)[:, : (width * count + 7) // 8]


def _unpack(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    n, groups = len(rows), -(-count // 8)
    padded = np.zeros((n, groups * width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    data = padded.reshape(n, groups, width)
    out = np.empty((n, groups, 8), np.uint32)
    wide = np.uint64 if width > 25 else np.uint32
    for j, byte, bit in _lanes(width):
        used = (bit + width + 7) // 8
        value = data[:, :, byte].astype(wide)
        for k in range(1, used):
            value = value << wide(8) | data[:, :, byte + k]
        out[:, :, j] = value >> wide(8 * used - width - bit) & wide((1 << width) - 1)
    return out.reshape(n, -1)[:, :count]


def pack_blocks(ids: np.ndarray, size: int = BLOCK_SIZE, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids; the last one may be shorter."""
    out: list[bytes] = []
    ids = ids.astype(np.uint32)
    for at in range(0, len(ids), size * 128):
        part = ids[at : at + size * 128]
        whole = len(part) // size * size
        for rows in (part[:whole].reshape(-1, size), part[whole:].reshape(1, -1)):
            if rows.size:
                out += _pack_rows(rows, percentile)
    return out


def _pack_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    bits = _bits(diff)
    k = min(rows.shape[1] - 1, int(np.ceil(percentile * rows.shape[1])) - 1)
    width = np.partition(bits, k, axis=1)[:, k]
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        sel = np.flatnonzero(width == w)
        if w:
            for i, b in zip(sel, _pack(diff[sel] & np.uint32((1 << int(w)) - 1), int(w)), strict=True):
                packed[i] = b.tobytes()
    for i, (mn, w) in enumerate(zip(low.tolist(), width.tolist(), strict=True)):
        odd = np.flatnonzero(bits[i] > w)
        packed[i] = BLOCK.pack(mn, w, len(odd)) + packed[i] + odd.astype("<u2").tobytes() + diff[i, odd].astype("<u4").tobytes()
    return packed


def unpack_blocks(data: bytes, starts: np.ndarray, n_ids: int, size: int = BLOCK_SIZE) -> np.ndarray:
    out = np.zeros(n_ids, np.uint32)
    heads = [BLOCK.unpack_from(data, s) for s in starts.tolist()]
    raw = np.frombuffer(data, np.uint8)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, _) in enumerate(heads):
        groups.setdefault((w, min(size, n_ids - i * size)), []).append(i)
    for (w, count), members in groups.items():
        nbytes = (w * count + 7) // 8
        for at in range(0, len(members), 128):
            some = np.array(members[at : at + 128])
            first = starts[some] + BLOCK.size
            values = _unpack(raw[first[:, None] + np.arange(nbytes)], w, count) if w else np.zeros((len(some), count), np.uint32)
            for j, i in enumerate(some.tolist()):
                low, _, n_odd = heads[i]
                if n_odd:
                    p = int(first[j]) + nbytes
                    where = np.frombuffer(data, "<u2", n_odd, p)
                    values[j, where] = np.frombuffer(data, "<u4", n_odd, p + 2 * n_odd)
                out[i * size : i * size + count] = values[j] + np.uint32(low)
    return out


def dump_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    at = HEAD.size + len(doc_ids) * 17 + 8 * len(blocks)
    starts = at + np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]) if blocks else np.zeros(0)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), BLOCK_SIZE), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(counts, "<i8").tobytes(), starts.astype("<i8").tobytes(), *blocks])


def load_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids of a file."""
    magic, n_docs, n_ids, n_blocks, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).tolist()
    counts = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
    starts = np.frombuffer(data, "<i8", n_blocks, at + 17 * n_docs)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], counts, unpack_blocks(data, starts, n_ids, size)


_CACHES: dict[tuple[str, str, bool], Callable[[str], bytes]] = {}


def _encoder(tokenizer_path: str, pattern: str, added_tokens: bool) -> Callable[[str], bytes]:
    """One per worker process. The library encodes each distinct match of its own pre-tokeniser's pattern once.

    With added_tokens a text that holds one of the tokenizer's added tokens is encoded whole by the library as loaded.
    """
    key = (tokenizer_path, pattern, added_tokens)
    if key not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        if not added_tokens:
            tok.encode_special_tokens = True

        def encode(match: str) -> bytes:
            return array("I", tok.encode_batch_fast([match], add_special_tokens=False)[0].ids).tobytes()

        pieces = PieceCache(pattern, encode).encoded
        added = [t.content for t in tok.get_added_tokens_decoder().values()] if added_tokens else []
        _CACHES[key] = (lambda text: encode(text) if any(a in text for a in added) else pieces(text)) if added else pieces
    return _CACHES[key]


def _defaults(tokenizer_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, pattern: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, added_tokens: bool = False) -> tuple[str, DataFrame]:
    """Encodes all texts and writes their ids in ascending doc_id order.

    Returns the folder and a table of its files: name, start (number of ids in all files before
    it) and n_ids. A text of null counts as empty; null doc_ids come first; rows of equal doc_id
    are in the order of their text's hash, equal rows are kept. A range exchange sorts the texts,
    so that a task writes a run of neighbouring documents; only a number per task comes to the
    driver. A file is written under a name of its own attempt, and the table lists those of the
    attempts that succeeded. Added tokens of the tokenizer are found in texts with added_tokens,
    as by the library's plain call, and are plain text without.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    tokenizer_path, pattern = _defaults(tokenizer_path, pattern)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encoded, part = _encoder(tokenizer_path, pattern, added_tokens), TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(path)
        doc_ids: list = []
        counts: list[int] = []
        chunks: list[bytes] = []
        total = n_files = before = 0

        def close() -> pa.RecordBatch:
            nonlocal total, n_files, before
            name = f"{part:06d}-{n_files:06d}-{uuid.uuid4().hex}.pfor"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(dump_file(doc_ids, counts, np.frombuffer(b"".join(chunks), "<u4")))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "name": [name], "n_ids": pa.array([total], pa.int64())})
            n_files, before, total = n_files + 1, before + total, 0
            doc_ids.clear()
            counts.clear()
            chunks.clear()
            return row

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encoded(text or "")
                chunks += [data, end]
                doc_ids.append(doc_id)
                counts.append(len(data) // 4 + 1)
                total += counts[-1]
                if total >= file_ids:
                    yield close()
        if doc_ids:
            yield close()

    keyed = id_text(docs).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written, _ = staged(dealt.mapInArrow(run, "part int, before long, name string, n_ids long"), "files")
    at, parts = 0, [(0, 0)]
    for part, n in sorted(tuple(r) for r in written.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row per task
        parts.append((part, at))
        at += n
    offsets = spark.createDataFrame(parts[1:] or parts, "part int, at long")
    files = written.join(F.broadcast(offsets), "part").select("name", (F.col("at") + F.col("before")).alias("start"), "n_ids")
    return path, files


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(path: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    spark = files.sparkSession
    n_files = files.count()
    if not n_files:
        return spark.createDataFrame([], SCHEMA)
    if n_files <= BROADCAST_FILES:
        files = F.broadcast(files)  # else the files' contents are dealt out again
    stored = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = load_file(content.as_py())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.join(files, "name").select("content", "start").mapInArrow(run, SCHEMA)
