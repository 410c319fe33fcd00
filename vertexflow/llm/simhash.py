"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints that differ in at most k of 64 bits share at least 8 - k of their 8
positional bytes, and at least 4 of any 7 of them if k is 3. The index is therefore
keyed by four positional bytes at once: of the first seven, each subset has a posting
list by value. For the pairs of a posting list the shared positional bytes are tallied;
those that reach the guaranteed number are verified by counting differing bits.

Equal fingerprints are one entry. A posting list gives a spanning forest of its links,
never all pairs. Long lists are split by five of the eight half bytes outside the
key, which leaves at most 4096 different fingerprints to a list, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import heavy_keys, join_keyed
from .common import drop_path, id_text, packed, sliced, staged
from .components import components

BITS, BYTES, SEED = 64, 8, 42
SHINGLE, DISTANCE = 3, 3
#: Length from which a posting list is split.
LONG_LIST = 256


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Runs of words after A-Z became a-z, words being runs of anything but ASCII white space; a shorter text is one."""
    w = text.encode().lower().split() if text else []
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = (np.cumsum([len(x) + 1 for x in w]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the shingles' hashes; 0 without words."""
    hashed = xxhash.xxh64_intdigest
    parts = shingles(text, size)
    if not parts:
        return 0
    h = np.array([hashed(s, SEED) for s in parts], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp, the fingerprint as a signed long, of each row. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "th", "fp"])

    return id_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def index_masks(distance: int = DISTANCE) -> list[int]:
    """The byte subsets that key the index: of the first 4 + distance bytes, any four."""
    if not 0 <= distance <= 4:
        raise ValueError("the index holds for distances of 0 to 4")
    return [sum(0xFF << 8 * i for i in c) for c in combinations(range(4 + distance), 4)]


def split_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """For a long list: the key with 8 - distance of the half bytes outside it."""
    outside = [i for i in range(16) if not mask >> 4 * i & 15]
    return [mask | sum(15 << 4 * i for i in c) for c in combinations(outside, 8 - distance)]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (least first) that connect what a posting list's links connect, one fewer than nodes per component."""
    fps = np.unique(fps)
    bits = fps.view(np.uint64)
    parts = fps.view(np.uint8).reshape(-1, BYTES)
    root = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        shared = (parts[i + 1 :] == parts[i]).sum(axis=1)  # the tally of shared positional bytes
        near = np.flatnonzero(shared >= BYTES - distance) + i + 1
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= distance]
        near = near[root[near] != root[i]]
        for j in near.tolist():
            a, b = root[i], root[j]
            if a != b:
                out.append((int(fps[i]), int(fps[j])))
                root[root == max(a, b)] = min(a, b)
    return out


def _forests(lists: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = [], []
            for fps in batch.column(0):
                for x, y in forest(fps.values.to_numpy(zero_copy_only=False), distance):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.select("fps").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, long_list: int = LONG_LIST) -> DataFrame:
    """Links a, b between different fingerprints, connecting exactly those that chains of links within the distance connect."""
    spark = fps.sparkSession
    masks = index_masks(distance)
    entry = F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])
    postings = fps.select("fp", F.explode(entry).alias("e")).select("fp", "e.k", "e.v")
    lengths = postings.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes postings as if explode made one row of each, and would broadcast them from a small file of fingerprints.
    live, path = staged(postings.join(lengths.hint("merge"), ["k", "v"]), "postings")
    short = live.where(F.col("n") <= long_list).groupBy("k", "v").agg(F.collect_list("fp").alias("fps"))
    splits = spark.createDataFrame([(i, j, _signed(s)) for i, m in enumerate(masks) for j, s in enumerate(split_masks(m, distance))], "k byte, j int, s long")
    by_key = splits.groupBy("k").agg(F.collect_list("s").alias("s"))  # as many rows as masks
    many = live.where(F.col("n") > long_list).join(F.broadcast(by_key), "k")
    many = many.select("fp", "k", F.explode("s").alias("s")).groupBy("k", "s", F.col("fp").bitwiseAND(F.col("s")).alias("v")).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    out, _ = staged(_forests(short.select("fps").unionByName(many.select("fps")), distance).distinct(), "forest")
    drop_path(spark, path)
    return out


def _grouped(docs: DataFrame, size: int, distance: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and of each fingerprint its number of rows, group (a fingerprint) and the group's least doc_id."""
    rows, _ = staged(fingerprints(docs, size), "fingerprints")
    each, _ = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fps")
    found = components(links(each.select("fp"), distance, long_list))
    of = found.join(each, found["node"] == each["fp"]).select("node", "root", "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    ids = each.join(of, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    return rows, staged(ids, "groups")[0]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of each row.

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any
    other. Repeated rows and ids repeat; a null id takes no part in the least id, so a
    component of null ids alone has a null one. Texts of any length are read whole.
    """
    rows, ids = _grouped(docs, size, distance, long_list)
    found = join_keyed(rows.select("doc_id", "fp"), ids.drop("n"), ["fp"], heavy_keys(ids, ["fp"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, long_list: int = LONG_LIST) -> DataFrame:
    """The rows of docs, with all their columns, that have the least id of their group; of groups without ids, one row.

    Null, empty and blank texts are one group. Of rows with the least id in common the one of
    least text hash stays, repeated rows are one document; extra columns may have any name.
    """
    rows, ids = _grouped(docs, size, distance, long_list)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m")
    by_fp = rows.groupBy("fp").agg(first).join(ids.select("fp", "group"), "fp")
    kept = by_fp.groupBy("group").agg(F.min("m").alias("m")).select(F.col("m.doc_id").alias("kept_id"), F.col("m.th").alias("kept_th"))
    keyed = packed(docs)
    out = keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left_semi")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():  # repeated rows are one document
        out = out.dropDuplicates(["id", "th"])
    return out.select("row.*")
