"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Each coordinate has its own learning rate, and L1 keeps most weights at zero. Shards of the training rows are
fitted in parallel, round after round from the shards' mean state. As is usual for FTRL, a feature takes part only
once enough training rows have it, or rare words would be learned by heart. What is broadcast for scoring is one
table of 2**20 floats, whatever the size of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts
from .quality import labelled

#: Labelled rows that the model learns from, at most. A documented bound.
TRAIN_ROWS = 20_000
BITS, SHARDS, ROUNDS = 20, 4, 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.1
#: Training rows that must have a feature, however many rows there are; the weight of a toxic row.
LEAST_ROWS, TOXIC_WEIGHT = 4, 2.0
#: Places of the state whose changes the shards send as one row.
BLOCK = 1 << 14
MIN_SCORE = 0.5
_EDGES = re.compile(rb"[^0-9a-z\x80-\xff]+")


class Hasher:
    """Features of a text: distinct words, neighbouring words, and words with one word between, as table places."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _EDGES.split(text.lower().encode())
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > 400_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        h = h[h != EMPTY]
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        parts = [h, h[:-1] * a + h[1:], h[:-2] * b + h[2:]]
        return np.unique(np.concatenate([(p * a) >> np.uint64(64 - BITS) for p in parts]).astype(np.int64))


EMPTY = np.uint64(xxhash.xxh3_64_intdigest(b""))


class State:
    """z and n of FTRL-proximal; the last place is the bias, which L1 leaves alone."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def learn(self, at: np.ndarray, y: float) -> None:
        w, bias = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
        g = (p - y) * (TOXIC_WEIGHT if y else 1.0)
        for i, old in ((at, w), (-1, bias)):
            n = self.n[i]
            self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * old
            self.n[i] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias). The bounded sample is dealt to shards once and kept there; a round has each shard learn from
    the mean state; what changed, over the features that enough rows have, is added up on the executors, block by block
    of the state, so the driver gets the state once a round and not once a shard."""
    spark, size = docs.sparkSession, 1 << BITS
    sample, ys = labelled(docs, labels, label, rows)
    if len(set(ys.values())) < 2:
        share = (sum(ys.values()) + 1) / (len(ys) + 2)
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))

    def make():
        hasher = Hasher()
        return lambda ids, texts: (ids, [hasher(t).astype(np.int32).tobytes() for t in texts])

    hashed = map_texts(sample.repartition(SHARDS, "doc_id"), make, "doc_id long, places binary").persist()

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int32)
        for frame in frames:
            for x in frame["places"]:
                total[np.frombuffer(x, np.int32)] += 1
        yield pd.DataFrame({"n": [zlib.compress(total.tobytes(), 1)]})

    total = np.zeros(size, np.int64)
    for r in hashed.mapInPandas(counts, "n binary").collect():  # one table a shard
        total += np.frombuffer(zlib.decompress(r.n), np.int32)
    often = np.flatnonzero(total >= LEAST_ROWS)
    place = np.full(size, -1, np.int32)
    place[often] = np.arange(len(often))
    sent_place, sent_labels = spark.sparkContext.broadcast(place), spark.sparkContext.broadcast(ys)

    def narrowed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [sent_place.value[np.frombuffer(x, np.int32)] for x in frame["places"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "places": [x[x >= 0].tobytes() for x in kept], "y": frame["doc_id"].map(sent_labels.value)})

    narrow = hashed.mapInPandas(narrowed, "doc_id long, places binary, y int").persist()
    state = State(np.zeros(len(often) + 1), np.zeros(len(often) + 1))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((state.z, state.n))

        def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = State(*(x.copy() for x in sent.value))
            whole = sorted((r for frame in frames for r in zip(frame["doc_id"], frame["places"], frame["y"])), key=lambda r: r[:2])
            for i in np.random.default_rng(seed).permutation(len(whole)):
                own.learn(np.frombuffer(whole[i][1], np.int32), whole[i][2])
            moved, own_shard = (own.z - sent.value[0], own.n - sent.value[1]), TaskContext.get().partitionId()
            for at in range(0, len(own.n), BLOCK):
                if moved[1][at : at + BLOCK].any():
                    yield pd.DataFrame({"block": [at], "shard": [own_shard], **{k: [m[at : at + BLOCK].astype(np.float32).tobytes()] for k, m in zip("zn", moved)}})

        def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("shard")  # sums of floats depend on the order
            return pd.DataFrame({"block": [key[0]], **{k: [sum(np.frombuffer(x, np.float32).astype(float) for x in frame[k]).astype(np.float32).tobytes()] for k in "zn"}})

        sums = narrow.mapInPandas(shard, "block long, shard int, z binary, n binary").groupBy("block").applyInPandas(added, "block long, z binary, n binary")
        for r in sums.collect():  # the state itself, at most 2 ** BITS places
            z, n = (np.frombuffer(x, np.float32) for x in (r.z, r.n))
            state.z[r.block : r.block + len(z)] += z / SHARDS
            state.n[r.block : r.block + len(n)] += n / SHARDS
        sent.destroy()
    for df in (hashed, narrow):
        df.unpersist()
    sent_place.destroy()
    sent_labels.destroy()
    weights = np.zeros(size, np.float32)
    weights[often] = state.weights(slice(0, len(often)))
    return weights, state.bias()


def score(docs: DataFrame, weights: np.ndarray, bias: float, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs; empty and null texts get the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, w = Hasher(), sent.value

        def f(ids, texts):
            z = np.array([w[hasher(t)].sum(dtype=float) + bias for t in texts], float)
            s = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            return ids, s, (s >= min_score).astype(np.int32)

        return f

    return map_texts(docs, make, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_score: float = MIN_SCORE) -> DataFrame:
    """Learn from the labelled rows and score all. Without labels of both kinds every text gets the labels' share."""
    return score(docs, *train(docs, labels, rows=rows), min_score)
