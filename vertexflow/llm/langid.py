"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text, weighted by
TF-IDF and scaled to unit length. Weights are trained with follow-the-regularised-leader
under an elastic net, which leaves most of them zero; a temperature, fitted on
rows that the weights haven't seen, calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ship, sliced

BITS = 15
SIZE = 1 << BITS
#: Labelled rows used at most (those of least hash of their id), and how many in so many parts are for calibration.
MAX_TRAIN, PARTS = 3_000, 5
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 4
FOLDS = 5
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    one = (c + np.uint32(1)) * _MULTIPLIERS[0]
    hashes = [one]
    if len(c) > 1:
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * _MULTIPLIERS[1] + c[1:] * _MULTIPLIERS[2]
        hashes.append(two)
        if len(c) > 2:
            hashes.append((two[:-1] ^ (two[:-1] >> np.uint32(15))) * _MULTIPLIERS[0] + c[2:] * _MULTIPLIERS[1])
    counts = np.zeros(SIZE, np.int64)
    for h in hashes:
        counts += np.bincount(((h ^ (h >> np.uint32(13))) * _MULTIPLIERS[2]) >> np.uint32(32 - BITS), minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE x langs
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((self.vector(at, counts) @ self.weights[at] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = self.probabilities(*grams(text))
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (features, values, class) rows, in the given order, epochs times."""
    z, n = np.zeros((SIZE + 1, n_langs)), np.zeros((SIZE + 1, n_langs))

    def solved(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = solved(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = solved(z, n)
    return w[:SIZE], w[SIZE]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Least negative log-likelihood over a grid of temperatures, refined once."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    best = min(np.geomspace(0.02, 10, 60), key=loss)
    return float(min(np.geomspace(best * 0.9, best * 1.1, 41), key=loss))


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and of those with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                at, _ = grams(text)
                df[at] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.arange(SIZE + 1, dtype=np.int32)), "n": pa.array(np.append(df, n))})

    found = rows.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE + 1, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return int(out[SIZE]), out[:SIZE]


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learns from text and lang of rows whose id's checksum leaves no zero; nulls are left out.

    Document frequencies are of all such rows, weights of at most max_train of them. Of rows with
    an id in common all are used; of equal probabilities the first language by name wins.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    picked = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang")  # a bounded table of ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [grams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], ["doc_id", "lang", "f", "c"])

    n_docs, df = _document_frequencies(rows)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    sample = picked.mapInArrow(run, "doc_id long, lang string, f array<int>, c array<int>").toArrow()
    order = sorted(range(sample.num_rows), key=lambda i: (zlib.crc32(str(sample["doc_id"][i].as_py()).encode()), sample["lang"][i].as_py()))
    langs = sorted(set(sample["lang"].to_pylist()))
    model = Model(langs, idf, np.zeros((SIZE, len(langs))), np.zeros(len(langs)))
    fit, held = [], []
    for k, i in enumerate(order):
        at, counts = np.array(sample["f"][i].as_py(), np.int64), np.array(sample["c"][i].as_py(), float)
        (held if k % PARTS == 0 else fit).append((at, model.vector(at, counts), langs.index(sample["lang"][i].as_py())))
    if len(langs) > 1:
        model.weights, model.bias = ftrl(fit, len(langs))
        logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in held])
        model.temperature = _temperature(logits, np.array([y for *_, y in held]))
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the calibrated probability) of each row.

    Texts that are null or have no letter are und with score 0. Null ids count as held out;
    repeated rows repeat, equal texts get equal results; whole texts are read. Map-only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            out = [i is None or zlib.crc32(str(i).encode()) % FOLDS == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Trains on docs and predicts each row: null texts and those without a letter are und; an empty table gives an empty one."""
    return predict_documents(docs, train(docs, max_train))
