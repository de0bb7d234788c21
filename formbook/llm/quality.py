"""Hashed word n-gram logistic regression, trained along the regularised leader.

A text's words and runs of signs, and neighbouring pairs of them, are hashed into
2^18 slots; so are n-grams of the form "x ... x" (a word that comes back within four
words), whatever x is. Counts, scaled to length one, are the features. Weights follow
the regularised leader (per-slot step sizes, L1 and L2), so slots that tell nothing
stay exactly zero and a score is a short sparse dot product.

Training sees at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
their id: a stated bound, so one task can follow the leader in a fixed order. Only
the weights (at most 2^18) pass through the driver. Scoring covers every whole text.

Labels other than 0 and 1 are ignored; of several labels for an id the majority
counts, a draw is ignored. Null text counts as empty; an empty text has no feature
but the constant and gets its score. Without labelled rows every score is 0.5.
Repeated rows are scored alike; columns that clash with results are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.arrow import append_columns

SLOTS = 1 << 18
# Labelled rows that training sees at most.
TRAIN_ROWS = 15_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1.0
# Distances at which a word that comes back is an n-gram of its own.
REPEAT_LAGS = (1, 2, 3, 4)
# Word hashes that a worker remembers.
KNOWN_WORDS = 150_000

_WORDS = re.compile(r"\w+|[^\w\s]+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = code = zlib.crc32(word.encode())
        return code


class Features:
    """Slots and values of a text; the slot ``SLOTS`` is the constant."""

    def __init__(self):
        self.codes = _WordHashes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _WORDS.findall(text)
        one = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
        again = [np.full(int((one[:-k] == one[k:]).sum()), k, np.uint64) for k in REPEAT_LAGS]
        both = np.concatenate([one, two, *again])
        both ^= both >> np.uint64(29)
        both *= np.uint64(0xBF58476D1CE4E5B9)
        slots, counts = np.unique((both >> np.uint64(40)) % np.uint64(SLOTS), return_counts=True)
        values = counts / max(1.0, float(np.sqrt((counts.astype(float) ** 2).sum())))
        return np.append(slots.astype(np.int64), SLOTS), np.append(values, 1.0)


def follow_leader(rows, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passing ``epochs`` times over ``rows`` of (slots, values, label)."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    for _ in range(epochs):
        for slots, values, label in rows:
            w = weights(slots)
            slope = (sigmoid(float(w @ values)) - label) * values
            step = (np.sqrt(n[slots] + slope**2) - np.sqrt(n[slots])) / ALPHA
            z[slots] += slope - step * w
            n[slots] += slope**2
    return weights(np.arange(SLOTS + 1))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def is_held_out(doc_id: str = "doc_id"):
    """Rows whose labels training never sees."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows: int = TRAIN_ROWS):
    """The weights, from the labelled rows of ``docs`` that aren't held out."""
    one = (
        labels.where(F.col(label).isin(0, 1) & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.avg(label).alias("_mean"))
        .where("_mean <> 0.5")
        .select("doc_id", (F.col("_mean") > 0.5).cast("double").alias("_label"), F.xxhash64("doc_id").alias("_order"))
        .orderBy("_order", "doc_id")
        .limit(rows)
    )
    # At most ``rows`` ids.
    rated = docs.select("doc_id", text).join(F.broadcast(one), "doc_id")
    rated = rated.repartition(1).sortWithinPartitions("_order", "doc_id", text).limit(rows)

    def fit(batches):
        features, seen = Features(), []
        for batch in batches:
            for words, mark in zip(batch.column(text).to_pylist(), batch.column("_label").to_pylist()):
                slots, values = features(words or "")
                seen.append((slots.astype(np.int32), values.astype(np.float32), mark))
        w = follow_leader(seen)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])

    found = rated.mapInArrow(fit, "slot long, weight double").toPandas()
    weights = np.zeros(SLOTS + 1)
    weights[found["slot"].to_numpy(np.int64)] = found["weight"].to_numpy(float)
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), shared.value

        def run(texts):
            found = map(features, texts)
            scores = sigmoid(np.array([float(w[slots] @ values) for slots, values in found]))
            return [scores, (scores >= 0.5).astype(np.int32)]

        return run

    return append_columns(docs, text, list(docs.columns), {"score": "double", "predicted": "int"}, make)
