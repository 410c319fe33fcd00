"""Removal of long repeated byte strings by merging suffix orders of shards.

Sorting every suffix of a corpus is out of reach, but every string of ``length`` bytes
has one anchor: the position whose 8 bytes hash least in its first ``length`` - 50. Equal
strings have it at equal offsets, so only anchored suffixes need an order, a few
in a hundred. Equal windows around anchors are one entry, whose strings are all repeated if it
has two rows. Each map task (a shard) emits the entries whose first 51 bytes other entries
have, too, with the bytes after and, as in a Burrows-Wheeler transform, the bytes before.

The suffixes of all shards are merged by iterative interleave refinement: the first
interleave is by the common 51 bytes; each round looks at the next 8 bytes of intervals
that are still open, orders only within them, and notes the common prefix of two neighbours
when they part. The bytes before are refined the same way, which is what stepping backwards
through the transforms does. A string that begins o bytes before its anchor is repeated
where the interval at depth ``length`` - o after it meets one at depth o before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, free_name, id_text, packed, sliced, staged

LENGTH, GRAM, CORE = 200, 8, 51
#: Bytes that are anchored at once; longer texts are cut with an overlap.
BUFFER = 2_000_000
#: Anchors with the same 51 bytes that one task merges at most; more are counted by string in all tasks.
LONG_GROUP = 50_000
#: Up to so many such groups their list goes to every task.
BROADCAST_ROWS = 100_000
_LOW = np.uint64((1 << 24) - 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Of every width neighbours, at the first one's place."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(buf: bytes, cuts: list[tuple[int, int]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts at (start, end) of buf: index of the text, and each anchor's place in buf and least and greatest offset."""
    window = length - CORE + 1
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    key = np.ndarray((n - GRAM + 1,), "<u8", buf, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    key &= ~_LOW
    key |= np.arange(int(_LOW), int(_LOW) - len(key), -1, dtype=np.uint64)  # of equal hashes the last place
    least = _sliding_min(key, window)
    del key
    least &= _LOW
    found = []
    for i, (a, b) in enumerate(cuts):  # text by text: few numbers for each place are held at a time
        if b - a < length:
            continue
        at = int(_LOW) - least[a : b - length + 1].astype(np.int64)
        new = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        last = np.append(new[1:], len(at)) - 1
        found.append((np.full(len(new), i), at[new], at[new] - last - a, at[new] - new - a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int]], list[int], list[int]]]:
    """Buffers of about BUFFER bytes, with each piece's place in the buffer, text, and place in the text."""
    parts: list[bytes] = []
    cuts, which, begins, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), BUFFER):
            piece = t[at : at + BUFFER + length - 1]
            parts.append(piece)
            cuts.append((total, total + len(piece)))
            which.append(i)
            begins.append(at)
            total += len(piece)
            if total >= BUFFER:
                yield b"".join(parts), cuts, which, begins
                parts, cuts, which, begins, total = [], [], [], [], 0
    if parts:
        yield b"".join(parts), cuts, which, begins


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each anchor: doc_id, th (hash of the text), h (hash of the 51 bytes), c and place.

    c is the hash of all bytes that a string with this anchor can have, and of how many of them
    are before it; place packs position, least and greatest offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, before = xxhash.xxh3_64_intdigest, length - CORE
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found = []
            for buf, cuts, which, begins in _segments(texts, length):
                owner, at, lo, hi = anchors(buf, cuts, length)
                found.append((np.array(which, np.int64)[owner], at + (np.array(begins, np.int64) - np.array([a for a, _ in cuts], np.int64))[owner], lo, hi))
            row, at, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            if not len(row):
                continue
            # An anchor whose offsets a cut divides is one row again.
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]))
            row, at, lo, hi = row[new], at[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new)
            h, c = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
            for i, (r, a) in enumerate(zip(row.tolist(), at.tolist(), strict=True)):
                t = texts[r]
                h[i] = hashed(t[a : a + CORE])
                c[i] = hashed(t[max(0, a - before) : a + length], min(a, before))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at << 24 | lo << 12 | hi)], ["doc_id", "th", "h", "c", "place"])

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, h long, c long, place long")


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def _with_text(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """Rows are found again by id and text's hash; null ids, too."""
    d, p = _keyed(docs), per_doc.withColumnsRenamed({"doc_id": "p_id", "th": "p_th"})
    return d.join(p, d["doc_id"].eqNullSafe(p["p_id"]) & (d["th"] == p["p_th"]), how)


def suffix_table(docs: DataFrame, live: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each live anchor (doc_id, th, h, place, long) also the bytes from length - 51 before it to length after it, and how many are before."""
    per_doc = live.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "place", "long")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = length - CORE
        for batch in sliced(batches):
            heads = batch.column(3)
            counts = np.array([len(x) for x in heads])
            flat = heads.flatten()
            h, place, long = flat.field("h"), flat.field("place").to_numpy(), flat.field("long")
            row = np.repeat(np.arange(batch.num_rows), counts)
            at = (place >> 24).tolist()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for x in range(0, len(row), 20_000):
                some = slice(x, x + 20_000)
                t = [texts[r][max(0, a - before) : a + length] for r, a in zip(row[some].tolist(), at[some], strict=True)]
                left = np.minimum(place[some] >> 24, before)
                take = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), h[some], pa.array(place[some]), pa.array(t, pa.binary()), pa.array(left), long[some]], ["doc_id", "th", "h", "place", "t", "left", "long"])

    joined = _with_text(docs, per_doc, "inner").select("doc_id", "text", "th", "at")
    return joined.mapInArrow(run, "doc_id long, th long, h long, place long, t binary, left long, long boolean")


def interleave(group: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, context), and each one's common context with the row before it, -1 across groups.

    Refined 8 bytes a round; only intervals of two or more rows are looked at again.
    """
    n, depth = context.shape
    padded = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    padded[:, :depth] = context
    by_word = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, depth)
    common[0] = -1
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    for k in range(by_word.shape[1]):
        parted = common < depth
        bucket = np.cumsum(parted)
        still = np.flatnonzero(~parted | np.append(~parted[1:], False))
        if not len(still):
            break
        words, b = by_word[order[still], k], bucket[still]
        turn = np.lexsort((words, b))
        order[still], words = order[still][turn], words[turn]
        differ = words[1:] ^ words[:-1]
        split = (b[1:] == b[:-1]) & (differ > 0)
        size = sum((differ[split] >> np.uint64(8 * j) > 0).astype(np.int64) for j in range(8))
        common[still[1:][split]] = 8 * k + 8 - size
    return order, np.minimum(common, depth)


def repeated_offsets(group: np.ndarray, after: np.ndarray, before: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each anchored suffix (rows), which offsets begin a string that another row of its group has, too.

    ``after`` are the bytes past the common 51, ``before`` those to the left, nearest first; both as
    many as there are offsets beyond 0. Rows take part at offsets lo to hi.
    """
    n, depth = after.shape
    ranks = []
    for context in (after, before):
        order, common = interleave(group, context)
        ranks.append((order, common))
    out = np.zeros((n, depth + 1), bool)
    for o in range(depth + 1):
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if len(rows) < 2:
            continue
        ids = []
        for (order, common), d in zip(ranks, (depth - o, o), strict=True):
            interval = np.empty(n, np.int64)
            interval[order] = np.cumsum(common < d)  # across groups common is -1
            ids.append(interval[rows])
        _, inverse, count = np.unique(ids[0] * (n + 1) + ids[1], return_inverse=True, return_counts=True)
        out[rows, o] = count[inverse] > 1
    return out


def _merge(suffixes: DataFrame, length: int) -> DataFrame:
    """doc_id, th, first and past of covered runs; a task merges its groups, some of them at a time."""
    depth = length - CORE

    def solve(h, place, t, left):
        n = len(h)
        after, before = np.zeros((n, depth), np.uint8), np.zeros((n, depth), np.uint8)
        for i, (x, k) in enumerate(zip(t, left.tolist(), strict=True)):
            raw = np.frombuffer(x, np.uint8)
            tail = raw[k + CORE :]
            after[i, : len(tail)] = tail
            before[i, :k] = raw[:k][::-1]
        hit = repeated_offsets(h, after, before, place >> 12 & 0xFFF, place & 0xFFF)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        at = place[row] >> 24
        return row, at - high, at - low + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 4_000):
            row, first, past = solve(rows["h"].to_numpy(), rows["place"].to_numpy(), rows["t"].to_pylist(), rows["left"].to_numpy())
            take = pa.array(row)
            cols = [rows[c].take(take).combine_chunks() for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first), pa.array(past)], ["doc_id", "th", "first", "past"])

    dealt = suffixes.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, th long, first long, past long")


def _count(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for groups too long for a task: strings are counted one by one, in each task first."""
    depth = length - CORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, first, a, b = [], [], [], []
            for i, (place, t, left) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                for o in range(place >> 12 & 0xFFF, (place & 0xFFF) + 1):
                    s = t[left - o : left - o + length]
                    row.append(i)
                    first.append((place >> 24) - o)
                    a.append(_signed(xxhash.xxh3_64_intdigest(s)))
                    b.append(_signed(xxhash.xxh64_intdigest(s, 1)))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "th", "first", "a", "b"])

    assert depth <= 0xFFF
    strings, _ = staged(suffixes.mapInArrow(run, "doc_id long, th long, first long, a long, b long"), "strings")
    twice = strings.groupBy("a", "b").count().where("count > 1").select("a", "b")
    return strings.join(twice, ["a", "b"], "left_semi").select("doc_id", "th", "first", (F.col("first") + length).alias("past"))


def _classes(marks: DataFrame, length: int) -> DataFrame:
    """Decides what equal windows decide, and names what has to be merged.

    Rows kind 0 (doc_id, th, first, past) are runs: anchors whose whole windows are equal have
    all their strings repeated. Rows of kind 1 (doc_id, th, h, place) stand for the classes of
    equal windows of anchors that share their 51 bytes with another class.
    """
    names = ["kind", "doc_id", "th", "x", "y"]

    def done(rows: pa.Table) -> pa.RecordBatch:
        h, c, place = (rows[x].to_numpy() for x in ("h", "c", "place"))
        order = np.lexsort((c, h))
        h, c, place = h[order], c[order], place[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        in_c, in_h = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
        twice = np.bincount(in_c)[in_c] > 1
        mixed = np.bincount(in_h[new_c])[in_h] > 1
        runs, asked = np.flatnonzero(twice), np.flatnonzero(new_c & mixed)
        at, lo, hi = place[runs] >> 24, place[runs] >> 12 & 0xFFF, place[runs] & 0xFFF
        x, y = np.concatenate([at - hi, h[asked]]), np.concatenate([at - lo + length, place[asked]])
        take = pa.array(order[np.concatenate([runs, asked])])
        kind = np.concatenate([np.zeros(len(runs), np.int8), np.ones(len(asked), np.int8)])
        ids = [rows[n].take(take).combine_chunks() for n in ("doc_id", "th")]
        return pa.RecordBatch.from_arrays([pa.array(kind), *ids, pa.array(x), pa.array(y)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 100_000):
            yield done(rows)

    dealt = marks.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "kind byte, doc_id long, th long, x long, y long")


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows of a stream sorted by h; they never divide rows of equal h."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.num_rows
        if total >= least:
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            if h[0] != h[-1]:
                whole = int(np.flatnonzero(h != h[-1])[-1]) + 1  # the last group may go on
                yield rows.slice(0, whole)
                held = rows.slice(whole).combine_chunks().to_batches()
                total -= whole
    if held:
        yield pa.Table.from_batches(held)


def covered_runs(docs: DataFrame, length: int = LENGTH, long_group: int = LONG_GROUP) -> DataFrame:
    """doc_id, th and runs (first, past) of bytes covered by strings that start more than once; runs may overlap."""
    if not CORE + GRAM < length <= CORE + 0xFFF:
        raise ValueError("length is out of range")
    spark = docs.sparkSession
    marks, marks_path = staged(anchor_table(docs, length), "anchors")
    long, _ = staged(marks.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > long_group).select("h"), "long")
    n_long = long.count()
    if n_long:
        long = F.broadcast(long) if n_long <= BROADCAST_ROWS else long
    told, told_path = staged(_classes(marks.join(long, "h", "left_anti") if n_long else marks, length), "classes")
    runs = told.where("kind = 0").select("doc_id", "th", F.col("x").alias("first"), F.col("y").alias("past"))
    asked = told.where("kind = 1").select("doc_id", "th", F.col("x").alias("h"), F.col("y").alias("place"), F.lit(False).alias("long"))
    if n_long:  # the same in all tasks: classes by count, their strings one by one
        hot, _ = staged(marks.join(long, "h", "left_semi"), "hot")
        classes, _ = staged(hot.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("one")), "classes")
        at, lo, hi = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(0xFFF), F.col("place").bitwiseAND(0xFFF)
        equal = hot.join(classes.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
        runs = runs.unionByName(equal.select("doc_id", "th", (at - hi).alias("first"), (at - lo + length).alias("past")))
        asked = asked.unionByName(classes.select("one.doc_id", "one.th", "h", "one.place", F.lit(True).alias("long")))
    drop_path(spark, marks_path)
    suffixes = suffix_table(docs, asked, length)
    if n_long:
        suffixes, suffixes_path = staged(suffixes, "suffixes")
        more, _ = staged(_count(suffixes.where("long"), length), "runs")
        runs = runs.unionByName(more)
    merged, _ = staged(_merge(suffixes.where("not long"), length), "runs")
    if n_long:
        drop_path(spark, suffixes_path)
    runs = runs.unionByName(merged)
    return runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "past")).alias("runs"))


def merged_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_runs(text: str | None, runs: list[dict] | None) -> tuple[bytes, bytes, int]:
    """The text's bytes, those that stay, and the number of maximal removed runs."""
    data = (text or "").encode()
    spans = merged_runs([(r["first"], r["past"]) for r in runs or []])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return data, b"".join([*kept, data[at:]]), len(spans)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, long_group: int = LONG_GROUP) -> DataFrame:
    """What each row keeps without the bytes covered by a string of ``length`` bytes that starts more than once.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256. All
    occurrences go, the first one too. Null texts count as empty; texts shorter than length stay.
    Rows that repeat count as occurrences of each other, null ids are allowed, matches never
    cross rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in range(4)]
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, left, n = without_runs(text, runs)
                for out, v in zip(rows, (len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest()), strict=True):
                    out.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    joined = _with_text(docs, covered_runs(docs, length, long_group), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, SCHEMA)


def deduplicate(docs: DataFrame, length: int = LENGTH, long_group: int = LONG_GROUP) -> DataFrame:
    """The rows of docs with such bytes removed from text; n_chars, if there, is counted anew.

    A character that lost some of its bytes goes whole. Null texts stay null; repeated rows and
    ids, and null ids, are rows of their own; extra columns may have any name.
    """
    runs = covered_runs(docs, length, long_group).withColumnsRenamed({"doc_id": "run_id", "th": "run_th"})
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    keyed, found = packed(docs), free_name("runs", names)
    joined = keyed.join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("th") == F.col("run_th")), "left").select("row", F.col("runs").alias(found)).select("row.*", F.col(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(batch.columns[:-1])
            texts = [t if t is None or not r else without_runs(t, r)[1].decode("utf-8", "ignore") for t, r in zip(batch.column(text_at).to_pylist(), batch.columns[-1].to_pylist(), strict=True)]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
