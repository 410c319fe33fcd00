"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of words in context. A word is drawn given the word before it;
a pair that says nothing of its own falls back to the word alone, which is drawn as a
chain of ever longer prefixes and its end, so that rare forms share the evidence of
their stems. Words and prefixes are counted by their distinct histories (the words before
them), as Kneser and Ney do. Every step subtracts an absolute discount and gives the mass
to a lower distribution; the lowest is shared by both classes and counts the distinct
histories in all documents of the corpus, labelled or not. Expressions whose counts do not
differ significantly between the classes are pruned, given what they extend: what they had goes back
to the shared distribution, so that the probabilities of a class still add up to one.
The score is a logistic function of the difference of the two log-likelihoods divided by
the number of words.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, id_text, ship, sliced, staged, table, words

#: Byte lengths of the prefixes that a word's chain goes through, and the absolute discount.
STEPS, DISCOUNT = (3, 5, 7, 9), 0.75
#: Labelled rows used at most (those of least hash of their id). The model is no larger than what they hold.
MAX_TRAIN = 20_000
#: Likelihood-ratio statistic from which an expression is kept.
SIGNIFICANT = 15.0
FOLDS, CALIBRATION = 5, 4
#: Words remembered by a scorer, and words (with their repeats) held before a task passes its counts on.
_CACHE, _FLUSH = 100_000, 1_200_000
#: A word with this share of all words has its histories dealt to many tasks.
HOT_SHARE = 0.001
_CONTEXT = "bucket int, words binary, counts binary, histories binary"


def chain(word: bytes) -> list[bytes]:
    """The prefixes of a word and, marked by a zero byte, its end."""
    return [word[:n] for n in STEPS if n < len(word)] + [word + b"\0"]


def parent(event: bytes) -> bytes:
    n = len(event) - event.endswith(b"\0")
    return event[: max((s for s in STEPS if s < n), default=0)]


def _chain_column(word: Column) -> Column:
    prefixes = [F.when(F.octet_length(word) > n, F.substring(word, 1, n)) for n in STEPS]
    return F.array_compact(F.array(*prefixes, F.concat(word, F.lit(b"\0"))))


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


Two = tuple[int, int]  # ordinary, toxic


@dataclass
class KneserNey:
    """The two models, from counts of the labelled rows (ordinary, toxic) and of the whole corpus."""

    steps: dict[bytes, Two]  # distinct (history, word) pairs below a step; at b"" all of them
    kinds: dict[bytes, Two]  # distinct steps that follow a prefix
    shared: dict[bytes, int]  # distinct (history, word) pairs below a step in the corpus
    kept: set[bytes]
    pairs: dict[tuple[bytes, bytes], Two] = field(default_factory=dict)  # kept ones: occurrences
    firsts: dict[bytes, tuple[int, int, int, int]] = field(default_factory=dict)  # of their first words: occurrences of all pairs, distinct ones
    prior: float = 0.0  # share of toxic rows

    def __post_init__(self):
        self.children: dict[bytes, list[bytes]] = defaultdict(list)
        for e in sorted(self.kept):
            self.children[parent(e)].append(e)
        self.inner = set()
        for e in self.kept:
            while e := parent(e):
                self.inner.add(e)
        self.seconds: dict[bytes, list[bytes]] = defaultdict(list)
        for v, w in sorted(self.pairs):
            self.seconds[v].append(w)

    def share(self, e: bytes) -> float:
        """Of a step after its prefix, in the distribution that both classes share."""
        return self.shared[e] / self.shared[parent(e)]

    def step(self, y: int, e: bytes) -> float:
        """Of a kept step after its prefix."""
        n, k = self.steps.get(parent(e), (0, 0))[y], self.kinds.get(parent(e), (0, 0))[y]
        if not n:
            return self.share(e)
        return (max(self.steps.get(e, (0, 0))[y] - DISCOUNT, 0) + DISCOUNT * k * self.share(e)) / n

    def rest(self, y: int, p: bytes) -> float:
        """By what the shared probability of any other step after the prefix is multiplied."""
        others = 1 - sum(self.share(e) for e in self.children[p]) if p in self.children else 1.0
        return (1 - sum(self.step(y, e) for e in self.children[p])) / others if p in self.children and others > 1e-9 else 1.0

    def word(self, y: int, w: bytes) -> float:
        out = 1.0
        for e in chain(w):
            out *= self.step(y, e) if e in self.kept else self.rest(y, parent(e)) * self.share(e)
        return out

    def pair(self, y: int, v: bytes, w: bytes) -> float:
        """Of a kept pair's second word after its first."""
        n, k = self.firsts[v][y], self.firsts[v][2 + y]
        return (max(self.pairs[v, w][y] - DISCOUNT, 0) + DISCOUNT * k * self.word(y, w)) / n if n else self.word(y, w)

    def rest_after(self, y: int, v: bytes) -> float:
        """By what the probability of any other word is multiplied after the first word of kept pairs."""
        others = 1 - sum(self.word(y, w) for w in self.seconds[v]) if v in self.seconds else 1.0
        return (1 - sum(self.pair(y, v, w) for w in self.seconds[v])) / others if v in self.seconds and others > 1e-9 else 1.0

    def probability(self, y: int, v: bytes, w: bytes) -> float:
        return self.pair(y, v, w) if (v, w) in self.pairs else self.rest_after(y, v) * self.word(y, w)

    def model(self) -> Model:
        def log_ratio(of, *args) -> float:
            return math.log(max(of(1, *args), 1e-12) / max(of(0, *args), 1e-12))

        return Model({e: log_ratio(self.step, e) for e in self.kept}, {p: log_ratio(self.rest, p) for p in self.children}, self.inner, {p: log_ratio(self.pair, *p) for p in self.pairs}, {v: log_ratio(self.rest_after, v) for v in self.seconds}, self.prior)


@dataclass
class Model:
    """What workers get: logarithms of the ratios of the two models. Bounded by what MAX_TRAIN rows hold."""

    steps: dict[bytes, float]
    rest: dict[bytes, float]
    inner: set[bytes]
    pairs: dict[tuple[bytes, bytes], float]
    after: dict[bytes, float]
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def word(self, w: bytes) -> float:
        total, at = 0.0, b""
        for e in chain(w):
            got = self.steps.get(e)
            total += self.rest.get(at, 0.0) if got is None else got
            if e not in self.inner:
                break
            at = e
        return total


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def ratio(self, text: str | None) -> float:
        """Difference of the log-likelihoods per word; 0 for texts without words."""
        return self._ratio(words(text))

    def _ratio(self, w: list[bytes]) -> float:
        if not w:
            return 0.0
        known, one, after, pairs = self.known, self.model.word, self.model.after, self.model.pairs
        if len(known) > _CACHE:
            known.clear()
        try:
            total = sum([known[x] for x in w])
        except KeyError:
            for x in set(w):
                if x not in known:
                    known[x] = one(x)
            total = sum([known[x] for x in w])
        if after:
            begun = [b"", *w]
            for at in [i for i, v in enumerate(begun[:-1]) if v in after]:
                v, x = begun[at], w[at]
                kept = pairs.get((v, x))
                total += after[v] if kept is None else kept - known[x]
        return total / len(w)

    def score(self, text: str | None) -> float:
        """The share of toxic training rows for texts without words."""
        w = words(text)
        if not w:
            return self.model.prior
        z = self.model.shift + self.model.slope * self._ratio(w)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text, y and part of labelled rows: ids whose checksum leaves no zero, at most max_train of them.

    The chosen ids are a bounded table, so joining them needs no exchange of texts. An id that
    labels has twice counts as toxic if any of its rows says so; nulls are left out.
    """
    key = F.col("doc_id").cast("string")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(F.crc32(key.cast("binary")) % FOLDS != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATION))
    return id_text(docs).join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "y", part.alias("part"))


class _Numbers(dict):
    """Numbers words in the order of their appearance."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def _numbered(texts: list[str | None], ids: _Numbers) -> list[np.ndarray]:
    """The words of each text as numbers."""
    return [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]


def _step_documents(rows: DataFrame) -> DataFrame:
    """event, wh (the word's hash where it ends one), docs_t and docs: the training documents that hold a step, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, steps = _Numbers(), _Numbers()
        chains = np.zeros((0, len(STEPS) + 1), np.int64)  # the numbers of each word's steps, the last one repeated
        n = np.zeros((2, 0), np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal chains, n
            events = list(steps)
            hashes = [word_hash(e[:-1]) if e.endswith(b"\0") else None for e in events]
            out = pa.RecordBatch.from_arrays([pa.array(events, pa.binary()), pa.array(hashes, pa.int64()), pa.array(n[1]), pa.array(n[0] + n[1])], ["event", "wh", "docs_t", "docs"])
            ids.clear()
            steps.clear()
            chains, n = chains[:0], n[:, :0]
            return out

        for batch in sliced(batches):
            texts = _numbered(batch.column(0).to_pylist(), ids)
            new = [[steps[e] for e in chain(x)] for x in list(ids)[len(chains) :]]
            if new:
                chains = np.concatenate([chains, np.array([c + c[-1:] * (len(STEPS) + 1 - len(c)) for c in new])])
            n = np.pad(n, ((0, 0), (0, len(steps) - n.shape[1])))
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for y in (0, 1):
                own = [t for t, z in zip(texts, toxic.tolist(), strict=True) if z == y]
                if own:
                    here = np.unique(np.repeat(np.arange(len(own)), [len(t) for t in own]) << 32 | np.concatenate(own))
                    here = np.unique(((here >> 32)[:, None] << 32 | chains[here & 0xFFFFFFFF]).ravel())
                    n[y] += np.bincount(here & 0xFFFFFFFF, minlength=len(steps))
            if len(ids) > _CACHE:
                yield flush()
        yield flush()

    counted = rows.select("text", "y").mapInArrow(run, "event binary, wh long, docs_t long, docs long")
    return counted.groupBy("event", "wh").agg(F.sum("docs_t").alias("docs_t"), F.sum("docs").alias("docs"))


def _train_pairs(rows: DataFrame) -> DataFrame:
    """vh and wh (hashes of two words in a row), o and t (occurrences by class), ko and kt (distinct words before the pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = _Numbers({b"": 0})
            texts = [np.concatenate([[0, 0], t]) for t in _numbered(batch.column(0).to_pylist(), ids)]
            if not texts:
                continue
            hashes = np.array([word_hash(x) for x in ids], np.int64)
            y = np.repeat(batch.column(1).to_numpy(zero_copy_only=False) > 0, [len(t) - 2 for t in texts])
            u, v, w = (np.concatenate([t[i : len(t) - 2 + i] for t in texts]) for i in range(3))
            pairs, at = np.unique(v << 32 | w, return_inverse=True)
            three, at = np.unique(at << 32 | u, return_inverse=True)
            pair = pairs[three >> 32]
            counts = [np.bincount(at[y == k], minlength=len(three)) for k in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[pair >> 32], hashes[pair & 0xFFFFFFFF], hashes[three & 0xFFFFFFFF], *counts)], ["vh", "wh", "uh", "o", "t"])

    three = rows.select("text", "y").mapInArrow(run, "vh long, wh long, uh long, o long, t long").repartition("vh", "wh")
    three = three.groupBy("vh", "wh", "uh").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    return three.groupBy("vh", "wh").agg(F.sum("o").alias("o"), F.sum("t").alias("t"), F.count_if(F.col("o") > 0).alias("ko"), F.count_if(F.col("t") > 0).alias("kt"))


def corpus_contexts(docs: DataFrame, hot: list[int] | None = None, flush: int = _FLUSH) -> DataFrame:
    """word and n: the distinct words before it (the beginning of a text is one) in all documents.

    Each task passes its own distinct pairs on, packed by bucket: a word's pairs share a bucket, those
    of the words whose hashes ``hot`` lists are dealt out by history and counted in parts, so a
    word may have several rows. Histories are told apart by 32-bit hashes.
    """
    frequent = np.sort(np.array(hot or [], np.int64))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = _Numbers({b"": 0}), [], 0

        def passed() -> Iterator[pa.RecordBatch]:
            known = list(ids)
            hashes = np.array([word_hash(x) for x in known], np.int64)
            codes = np.concatenate(held)
            codes = np.unique((codes & 0xFFFFFFFF) << 32 | (hashes & 0xFFFFFFFF)[codes >> 32])
            w, history = codes >> 32, codes & 0xFFFFFFFF
            bucket = np.mod(hashes, buckets)[w]
            split = np.isin(hashes, frequent)[w]
            bucket[split] = (hashes[w[split]] + history[split]) % buckets
            order = np.argsort(bucket, kind="stable")
            w, history, bucket = w[order], history[order].astype("<u4"), bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])]))
            counts = np.diff(np.append(first, len(w))).astype("<u4")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[first]) != 0]))
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(first)], strict=True):
                past = int(first[b]) if b < len(first) else len(w)
                rows.append((int(bucket[first[a]]), b" ".join([known[i] for i in w[first[a:b]].tolist()]), counts[a:b].tobytes(), history[first[a] : past].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "words", "counts", "histories"])

        for batch in sliced(batches):
            for t in _numbered(batch.column(0).to_pylist(), ids):
                if len(t):
                    held.append(np.concatenate([[0], t[:-1]]) << 32 | t)
                    size += len(t)
            if size >= flush:
                yield from passed()
                ids, held, size = _Numbers({b"": 0}), [], 0
        if size:
            yield from passed()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        ids, codes = _Numbers(), []

        def counted() -> pa.RecordBatch:
            distinct = np.unique(np.concatenate(codes))
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(np.bincount(distinct >> 32, minlength=len(ids)))], ["word", "n"])

        for batch in batches:
            for bucket, names, counts, histories in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and codes:
                    yield counted()
                    ids, codes = _Numbers(), []
                at = bucket
                own = np.fromiter(map(ids.__getitem__, names.split(b" ")), np.int64)
                codes.append(np.repeat(own, np.frombuffer(counts, "<u4")) << 32 | np.frombuffer(histories, "<u4"))
        if codes:
            yield counted()

    parts = docs.select("text").where("text is not null").mapInArrow(mapped, _CONTEXT)
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduced, "word binary, n long")


def significance(t: Column, n: Column, all_t: Column, all_n: Column) -> Column:
    """Likelihood-ratio statistic of a two-by-two table: n of all_n have something, t of all_t toxic ones."""

    def weight(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells, sums = [t, n - t, all_t - t, all_n - n - all_t + t], [n, all_n - n, all_t, all_n - all_t]
    return 2 * (sum(map(weight, cells), weight(all_n)) - sum(map(weight, sums), F.lit(0.0)))


def _rows(df: DataFrame) -> list[dict]:
    return df.toArrow().to_pylist()


def kneser_ney(docs: DataFrame, fit: DataFrame, significant: float = SIGNIFICANT) -> KneserNey:
    """Counts the labelled rows of ``fit`` (text, y), prunes, and takes the shared counts from all of docs.

    A step is tested among the documents that hold its prefix, a pair among the histories of
    its second word, where copies of one passage count once. What
    comes to the driver is the kept expressions and the sums that they need, no more than fit holds.
    """
    spark = docs.sparkSession
    n_docs, n_t = fit.agg(F.count("y"), F.sum("y")).first()
    if not n_t or n_t == n_docs:
        return KneserNey({}, {}, {}, set(), prior=(n_t or 0) / max(n_docs, 1))
    pairs, pairs_path = staged(_train_pairs(fit), "pairs")
    by_word = pairs.groupBy("wh").agg(*[F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in ("o", "t")], F.sum("ko").alias("all_o"), F.sum("kt").alias("all_t"))
    by_word, by_word_path = staged(by_word, "words")
    seen = _step_documents(fit)
    ended = seen.where("wh is not null").select(F.expr("substring(event, 1, octet_length(event) - 1)").alias("word"), "wh").join(by_word, "wh")
    below = ended.select(F.explode(_chain_column(F.col("word"))).alias("event"), "k_o", "k_t").groupBy("event").agg(F.sum("k_o").alias("k_o"), F.sum("k_t").alias("k_t"))
    long = F.octet_length("event") - F.when(F.substring("event", -1, 1) == b"\0", 1).otherwise(0)
    up = F.coalesce(*[F.when(long > n, F.substring("event", 1, n)) for n in reversed(STEPS)], F.lit(b""))
    steps, steps_path = staged(seen.join(below, "event").withColumn("up", up), "steps")
    top = spark.createDataFrame([(b"", n_t, n_docs)], "up binary, up_t long, up_docs long")
    over = steps.select(F.col("event").alias("up"), F.col("docs_t").alias("up_t"), F.col("docs").alias("up_docs")).unionByName(top)
    tested = steps.join(over, "up").where(significance(*map(F.col, ("docs_t", "docs", "up_t", "up_docs"))) >= significant)
    kept = {r["event"] for r in _rows(tested.select("event"))}
    two = pairs.join(by_word.select("wh", "all_o", "all_t"), "wh")
    two = two.where(significance(F.col("kt"), F.col("kt") + F.col("ko"), F.col("all_t"), F.col("all_t") + F.col("all_o")) >= significant).select("vh", "wh", "o", "t")
    names = steps.where("wh is not null").select("wh", F.expr("substring(event, 1, octet_length(event) - 1)").alias("w"))
    names = names.unionByName(spark.createDataFrame([(word_hash(b""), b"")], "wh long, w binary"))
    two = two.join(names, "wh").join(names.withColumnsRenamed({"wh": "vh", "w": "v"}), "vh")
    found = {(r["v"], r["w"]): (r["o"], r["t"]) for r in _rows(two.select("v", "w", "o", "t"))}
    sums = pairs.groupBy("vh").agg(F.sum("o").alias("o"), F.sum("t").alias("t"), F.count_if(F.col("o") > 0).alias("do"), F.count_if(F.col("t") > 0).alias("dt"))
    sums, sums_path = staged(sums, "firsts")
    total = sums.agg(F.sum(F.col("o") + F.col("t"))).first()[0]
    hot = [r["vh"] for r in _rows(sums.where(F.col("o") + F.col("t") >= HOT_SHARE * total).select("vh"))]  # at most 1 / HOT_SHARE
    first_of = {word_hash(v): v for v, _ in found}
    wanted = spark.createDataFrame([(h,) for h in first_of], "vh long")
    firsts = {first_of[r["vh"]]: (r["o"], r["t"], r["do"], r["dt"]) for r in _rows(sums.join(F.broadcast(wanted), "vh"))}
    need = set(kept)
    for e in [*kept, *(w + b"\0" for _, w in found)]:
        need.add(e)
        while e := parent(e):
            need.add(e)
    asked = spark.createDataFrame([(e,) for e in need], "event binary")
    counts = {r["event"]: (r["k_o"], r["k_t"]) for r in _rows(steps.join(F.broadcast(asked), "event").select("event", "k_o", "k_t"))}
    ups = spark.createDataFrame([(e,) for e in {parent(e) for e in need}], "up binary")
    kinds = steps.join(F.broadcast(ups), "up").groupBy("up").agg(F.count_if(F.col("k_o") > 0).alias("o"), F.count_if(F.col("k_t") > 0).alias("t"))
    kinds = {r["up"]: (r["o"], r["t"]) for r in _rows(kinds)}
    counts[b""] = tuple(by_word.agg(F.sum("k_o"), F.sum("k_t")).first())
    for path in (pairs_path, by_word_path, steps_path, sums_path):
        drop_path(spark, path)
    contexts, path = staged(corpus_contexts(id_text(docs), hot), "contexts")
    shared = contexts.select(F.explode(_chain_column(F.col("word"))).alias("event"), "n").join(F.broadcast(asked), "event").groupBy("event").agg(F.sum("n").alias("n"))
    shared = {r["event"]: r["n"] for r in _rows(shared)}
    shared[b""] = contexts.agg(F.sum("n")).first()[0]
    drop_path(spark, path)
    return KneserNey(counts, kinds, shared, kept, found, firsts, n_t / n_docs)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a slight penalty; x is scaled first."""
    if not len(x) or y.min() == y.max():
        return 1.0, -0.5 if not len(x) or not y.max() else 0.5
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Counts on three quarters of the training rows and fits the logistic function on the last.

    Labels are read only of the rows that training_rows picks. Without any label of either
    class the model is neutral.
    """
    spark = docs.sparkSession
    rows, path = staged(training_rows(docs, labels, max_train), "sample")
    model = kneser_ney(docs, rows.where("part > 0")).model()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.ratio(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "y"])

    held = rows.where("part = 0").select("text", "y").mapInArrow(run, "x double, y int").toArrow()
    model.slope, model.shift = _logistic(held.column(0).to_numpy(), held.column(1).to_numpy().astype(float))
    drop_path(spark, path)
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: int | None) -> bool:
    """Null ids are held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of each row.

    Null and empty texts and those without words get the share of toxic training rows; equal texts
    score equally; whole texts are read. Map-only but for the broadcast model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            out = [held_out(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores all documents by the model that their labelled rows give; see train and score_documents for nulls, ties and repeated rows."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
