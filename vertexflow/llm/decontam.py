"""Benchmark decontamination by Wu-Manber search over words.

The patterns are windows of benchmark words. For each pattern length there is one
matcher: a shift table by block of two words tells how far the window can move on,
a bucket by suffix block lists the patterns that may end here, sorted by the hash of
their first block, and a direct comparison confirms. Patterns are places in one list of words.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ship, sliced, staged, words

WINDOW = 10
#: Benchmark text searched for in one pass over the documents; more is dealt into passes. A text of n bytes has at most n / 2 + 1 words, so this bounds the tables.
PASS_BYTES = 3_000_000
#: Windows that stay together; longer items are cut into overlapping segments, so that no item is too large for a pass.
SEGMENT = 20_000


class WuManber:
    """All occurrences of patterns of one length in a list of words. places are the patterns' starts in text, values what they stand for."""

    def __init__(self, m: int, text: list[bytes], places: list[int], values: list):
        self.m, self.text, self.block = m, text, min(2, m)
        self.default = m - self.block + 1
        by_end: dict = defaultdict(list)
        self.shift: dict = {}  # a block's shift; of one that ends a pattern the bucket's number - 1 below zero
        for i, p in enumerate(places):
            for end in range(self.block, m):
                b = self._block(text, p + end - 1)
                self.shift[b] = min(self.shift.get(b, self.default), m - end)
            by_end[self._block(text, p + m - 1)].append(i)
        self.edges, self.prefix, self.places, self.values = array("I", [0]), array("q"), array("I"), []
        for k, (b, own) in enumerate(by_end.items()):
            self.shift[b] = -1 - k
            for h, i in sorted((self._prefix(text, places[i]), i) for i in own):
                self.prefix.append(h)
                self.places.append(places[i])
                self.values.append(values[i])
            self.edges.append(len(self.places))

    def _block(self, w: list[bytes], last: int):
        return w[last] if self.block == 1 else (w[last - 1], w[last])

    def _prefix(self, w: list[bytes], first: int) -> int:
        return hash((w[first], w[first + self.block - 1]))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, object]]:
        """(start, the pattern's value) of each occurrence, by start."""
        m, shift, default, n, one = self.m, self.shift.get, self.default, len(w), self.block == 1
        at = m - 1
        while at < n:
            step = shift(w[at] if one else (w[at - 1], w[at]), default)
            if step > 0:
                at += step
                continue
            start, past = at - m + 1, self.edges[-step]
            h = self._prefix(w, start)
            i = bisect_left(self.prefix, h, self.edges[-1 - step], past)
            while i < past and self.prefix[i] == h:
                p = self.places[i]
                if self.text[p : p + m] == w[start : at + 1]:
                    yield start, self.values[i]
                i += 1
            at += 1


def matchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One for each length; equal windows are one pattern with the tuple of their items."""
    same: dict[bytes, bytes] = {}
    text: list[bytes] = []
    found: dict[int, dict[int, list[int]]] = defaultdict(dict)  # by length and hash: places of different windows
    owners: dict[int, tuple] = {}
    for item_id, t in items:
        w = [same.setdefault(x, x) for x in words(t)]
        size, base = min(window, len(w)), len(text)
        text += w
        for i in range(base, len(text) - size + 1 if w else base):
            places = found[size].setdefault(hash(tuple(text[i : i + size])), [])
            p = next((p for p in places if text[p : p + size] == text[i : i + size]), None)
            if p is None:
                places.append(i)
                owners[i] = (item_id,)
            elif item_id not in owners[p]:
                owners[p] += (item_id,)
    out = []
    for size in sorted(found):
        places = [p for same_hash in found[size].values() for p in same_hash]
        out.append(WuManber(size, text, places, [owners[p] for p in places]))
    return out


_BUILT: dict[str, list[WuManber]] = {}


def _matchers_once(key: str, items: list[tuple], window: int) -> list[WuManber]:
    """Built once in a worker process; only the last ones are kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = matchers(items, window)
    return _BUILT[key]


def find_hits(text: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Runs of hit words as (first, past the last), overlapping ones merged, and the items that occur."""
    places, items = [], set()
    for matcher in found:
        for start, ids in matcher.search(text):
            places.append((start, start + matcher.m))
            items.update(ids)
    runs: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs, items


def _item_passes(benchmark: DataFrame, window: int, pass_bytes: int) -> tuple[int, DataFrame]:
    """Number of passes, and segments of the items (item_id, text, pass), of about pass_bytes a pass; a pass at a time comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = [], []
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                for at in range(0, max(1, len(w) - window + 1), SEGMENT):
                    ids.append(item_id)
                    texts.append(b" ".join(w[at : at + SEGMENT + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = total // pass_bytes + 1
    if passes == 1:
        return 1, items.withColumn("pass", F.lit(0))
    return passes, items.mapInArrow(run, "item_id string, text string").withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))


def _pass_items(items: DataFrame, i: int) -> list[tuple]:
    return [tuple(r) for r in items.where(F.col("pass") == i).select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, hits array<struct<first, past>> and items array<string> of each row.

    Null and empty texts have no words and no hits, items without words no windows; an item whose id is null
    can't be named and is left out. Repeated rows are each reported, items of one id are one;
    an empty benchmark hits nothing; whole texts of any length are searched, extra columns may have
    any name. Documents are read once and not shuffled while the benchmark has at most pass_bytes of
    text; beyond that, once for each block of it, and the passes' results are joined by row.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_words long, hits array<struct<first:int,past:int>>, items array<string>"
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def one(items) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _matchers_once(key, shared.value, window)
            for batch in sliced(batches):
                n, hits, got = [], [], []
                for text in batch.column(1).to_pylist():
                    w = words(text)
                    runs, items_here = find_hits(w, found)
                    n.append(len(w))
                    hits.append([{"first": a, "past": b} for a, b in runs])
                    got.append(sorted(items_here))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, hit_type), pa.array(got, pa.list_(pa.string())), *batch.columns[2:]], ["doc_id", "n_words", "hits", "items", *batch.schema.names[2:]])

        return source.mapInArrow(run, schema + extra)

    source, extra = id_text(docs), ""
    passes, items = _item_passes(benchmark, window, pass_bytes)
    if passes == 1:
        return one(_pass_items(items, 0))
    # A document's rows of several passes meet by its id and text's hash; equal rows by their number of copies.
    source, extra = source.withColumn("h", F.xxhash64("text")), ", h long"
    source = source.select("doc_id", "text", "h")
    parts = [staged(one(_pass_items(items, i)).withColumn("pass", F.lit(i)), "hits")[0] for i in range(passes)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    merged = rows.groupBy("doc_id", "h", "n_words").agg(F.sum(F.when(F.col("pass") == 0, 1)).alias("copies"), F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.withColumn("hits", _merge_runs(F.array_sort("hits")))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "hits", "items")


def _merge_runs(runs):
    """Overlapping and touching runs of a sorted array as one."""
    kind = "array<struct<first:int,past:int>>"

    def step(done, run):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.array(F.struct(last["first"].alias("first"), F.greatest(last["past"], run["past"]).alias("past")))
        kept = F.filter(done, lambda x: x["first"] != last["first"])
        return F.when(run["first"] <= last["past"], F.concat(kept, joined)).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast(kind), step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (sorted ids joined by commas) and contaminated (n_hit > 0)."""
    rows = scan(docs, benchmark, window, pass_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + (r["past"] - r["first"]))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs; one pass for each block of the benchmark.

    Rows without words stay, repeated rows stay or go together; extra columns may have any name.
    """
    spark = ship(docs.sparkSession)
    at = docs.columns.index("text")

    def without(source: DataFrame, items) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _matchers_once(key, shared.value, window)
            for batch in sliced(batches):
                clean = [not any(True for m in found for _ in m.search(w)) for w in map(words, batch.column(at).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return source.mapInArrow(run, docs.schema)

    passes, items = _item_passes(benchmark, window, pass_bytes)
    for i in range(passes):
        docs = without(docs, _pass_items(items, i))
        if i + 1 < passes:  # a worker holds the tables of one pass
            docs, _ = staged(docs, "clean")
    return docs
