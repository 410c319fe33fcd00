"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has exactly one last token in its encoding, and a
token sequence is an encoding exactly if each neighbouring pair encodes to
itself. ``last[i]`` holds that token for the prefix of i bytes: the one suffix
token that pairs validly with ``last`` at its start. Walking back from the end
gives the encoding; appended bytes only extend the table, and after an edit the
table is recomputed until it runs parallel to the old one again.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, sliced
from .pieces import PieceCache

#: Memoised pair verdicts and prefixes per worker, and the length up to which pieces share their prefixes.
MAX_PAIRS, MAX_PREFIXES, MAX_SHARED = 1_000_000, 500_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.suffixes = {b[i:] for b in ranks for i in range(len(b))}
        self._pairs: dict[int, bool] = {}
        self._last: dict[bytes, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain rank-ordered merging, lowest rank first and leftmost among equals; used for pairs only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def pairs_validly(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The longest token that ends here and pairs validly; longer ones than any token's suffix aren't tried."""
        ranks, suffixes = self.ranks, self.suffixes
        start = end - 1
        found = []
        while start >= 0 and (piece := data[start:end]) in suffixes:
            if piece in ranks:
                found.append((start, ranks[piece]))
            start -= 1
        for start, t in reversed(found):
            if not start or self.pairs_validly(last[start], t):
                return t
        raise ValueError("a byte of the text has no token")

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > MAX_SHARED:
            return PrefixTable(self, data).encoding()
        self._store(data)
        known, tokens = self._last, self.tokens
        at, out = len(data), []
        while at:
            out.append(known[data[:at]])
            at -= len(tokens[out[-1]])
        return out[::-1]

    def _store(self, data: bytes) -> None:
        """Makes the last tokens of all prefixes known; pieces with a common beginning share them."""
        known, ranks, suffixes, pairs = self._last, self.ranks, self.suffixes, self._pairs
        if len(known) > MAX_PREFIXES:
            known.clear()
        done = len(data)
        while done and data[:done] not in known:
            done -= 1
        for end in range(done + 1, len(data) + 1):
            start, found = end - 1, []
            while start >= 0 and (piece := data[start:end]) in suffixes:
                if piece in ranks:
                    found.append(start)
                start -= 1
            for start in reversed(found):
                t = ranks[data[start:end]]
                if start:
                    left = known[data[:start]]
                    valid = pairs.get(left << 32 | t)
                    if not (self.pairs_validly(left, t) if valid is None else valid):
                        continue
                known[data[:end]] = t
                break
            else:
                raise ValueError("a byte of the text has no token")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of each prefix of one piece, kept up to date under appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.bpe.last_token(self.data, end, self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start:stop; returns how many prefixes had to be recomputed.

        A prefix depends on the tokens of the ``longest`` prefixes before it, so once that many
        past the edit agree with the old table the remaining ones do, too.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        agree, done = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if agree >= self.bpe.longest:
                self.last.extend(old[end - shift :])
                break
            self.last.append(self.bpe.last_token(self.data, end, self.last))
            done += 1
            past = end > start + len(new)
            agree = agree + 1 if past and self.last[end] == old[end - shift] else 0
        return done

    def encoding(self) -> list[int]:
        at, out = len(self.data), []
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.tokens[out[-1]])
        return out[::-1]


_MODELS: dict[tuple[str, str], tuple[PrefixBPE, PieceCache]] = {}


def _model(ranks_path: str, pattern: str) -> tuple[PrefixBPE, PieceCache]:
    """One per worker process; its caches stay from task to task."""
    key = (ranks_path, pattern)
    if key not in _MODELS:
        bpe = PrefixBPE(load_ranks(ranks_path))

        def encode(match: str) -> bytes:
            return array("I", bpe.encode(match.encode())).tobytes()

        _MODELS[key] = bpe, PieceCache(pattern, encode)
    return _MODELS[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_text(text: str | None, ranks_path: str | None = None, pattern: str | None = None) -> list[int]:
    """The ids of one text; null and empty give none."""
    _, cache = _model(ranks_path or default_ranks_path(), pattern or default_pattern())
    return array("I", cache.encoded(text or "")).tolist()


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes its ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256
    and, if asked for, ids. One row for each row: repeated rows and ids repeat, a null doc_id
    stays null, null and empty texts have no tokens and the hashes of nothing. Texts of any
    length are encoded whole; an empty table gives an empty table. Map-only, no shuffle.
    """
    ranks_path, pattern = ranks_path or default_ranks_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _model(ranks_path, pattern)
        sha, vocab = hashlib.sha256, bpe.tokens
        decimal = {i: str(i) for i in vocab}
        for batch in sliced(batches):
            rows: list[list] = [[], [], []]
            all_ids = []
            for text in batch.column(1).to_pylist():
                data = cache.encoded(text or "")
                if with_ids:
                    all_ids.append(data)
                ids = array("I", data).tolist()
                rows[0].append(len(ids))
                rows[1].append(sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                rows[2].append(sha(b"".join([vocab[i] for i in ids])).hexdigest())
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                starts = pa.array(np.cumsum([0, *rows[0]]), pa.int32())
                columns.append(pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(all_ids), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_text(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
