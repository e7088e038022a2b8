"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting adds shallow trees to one feature's lookup table after another, then to the tables of the few pairs
of features that explain most of what is left. Bags of the training rows are fitted in parallel and averaged. A
score is a sum of table entries: texts are turned into features, features into bins, and bins are looked up.
"""

from __future__ import annotations

import math
import pickle
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_texts, map_texts, texts_of

#: Labelled rows that the model learns from, at most: those of least hash. A documented bound.
TRAIN_ROWS = 20_000
BAGS, BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 4, 48, 8, 120, 60, 6, 0.15
MIN_SCORE = 0.3
#: Bytes that are compressed at a time, so that a long text's share is comparable with a short one's.
PRESSED = 8192
#: Frequent function words.
COMMON = frozenset("the of and to in is that for it was on with as be at by this are or de la le les des et en un une est que pour dans el los las del y por con para der die das und ist von zu den mit auf ein eine nicht".split())
FEATURES = (
    "log_words", "mean_word", "sd_word", "space", "upper", "digit", "symbol", "exclaim", "stop", "pipe", "high", "distinct", "top_word", "common",
    "repeat_pairs", "repeat_triples", "dup_lines", "line_words", "odd_end", "same_as_before", "squeezed", "short_words", "long_words", "capital_words",
)


def features(text: str) -> list[float]:
    """Figures of a whole text, all defined for empty ones."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lens = np.fromiter(map(len, words), np.int32, n)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    v = np.int64(len(number))
    pairs = ids[:-1] * v + ids[1:]
    p, back = np.unique(pairs, return_inverse=True) if n > 1 else (pairs, pairs)
    triples = np.unique(back[:-1] * v + ids[2:]) if n > 2 else pairs[:0]
    kinds = np.array([(w.lower().decode() in COMMON, not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,"), w[:1].isupper()) for w in number], np.int64).reshape(-1, 3)
    common, odd, capital = (counts @ kinds) / n
    lines = [x for x in raw.split(b"\n") if x]
    m = max(len(lines), 1)
    return [
        math.log1p(n), lens.mean(), lens.std(), 1 - lens.sum() / size, b[65:91].sum() / size, b[48:58].sum() / size,
        b[[35, 36, 37, 38, 42, 60, 62]].sum() / n, b[33] / n, b[46] / n, b[124] / n, b[128:].sum() / size,
        len(number) / math.sqrt(n), counts.max() / n, common, 1 - len(p) / max(n - 1, 1), 1 - len(triples) / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / m, math.log1p(n / m), odd, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        sum(len(zlib.compress(raw[at : at + PRESSED], 1)) for at in range(0, size, PRESSED)) / size, (lens <= 2).mean(), (lens >= 14).mean(), capital,
    ]


class Model:
    """Bin edges, a table for each feature, and a table for each chosen pair of features."""

    def __init__(self, edges, coarse, base, tables, pairs, pair_tables):
        self.edges, self.coarse, self.base, self.tables, self.pairs, self.pair_tables = edges, coarse, base, tables, pairs, pair_tables

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[small[f], small[g]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts, one at a time; what each leaf adds, by bin."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                gain[(hs[k] - hs[a] < 1) | (hs[b] - hs[k] < 1)] = -1
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(k[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of two cuts, one on each axis, over a grid of bins: its gain, and what it adds to each cell."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = g.shape
    i, j = np.arange(1, a)[:, None], np.arange(1, b)[None]
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    part = lambda s: (s[i, j], s[i, b] - s[i, j], s[a, j] - s[i, j], s[a, b] - s[i, b] - s[a, j] + s[i, j])
    gain = sum(x * x / (y + 1) for x, y in zip(part(gs), part(hs)))
    at = np.unravel_index(gain.argmax(), gain.shape)
    values = [float(np.broadcast_to(x, gain.shape)[at] / (np.broadcast_to(y, gain.shape)[at] + 1)) for x, y in zip(part(gs), part(hs))]
    out, (r, c) = np.empty_like(g), (at[0] + 1, at[1] + 1)
    out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:] = values
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray, edges: list, coarse: list, pairs: list | None) -> dict:
    """Fit the tables of one bag; with ``pairs`` None, choose them by what two cuts explain of the residuals."""
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, tables = np.full(len(y), base), [np.zeros(len(e) + 1) for e in edges]

    def grid(f, g, p):
        cell, n = small[f] * sizes[g] + small[g], sizes[f] * sizes[g]
        return cell, *(np.bincount(cell, w, n).reshape(sizes[f], sizes[g]) for w in (y - p, p * (1 - p)))

    for _ in range(ROUNDS):
        for f, t in enumerate(tables):
            p = 1 / (1 + np.exp(-z))
            add = RATE * np.clip(_tree(np.bincount(bins[f], y - p, len(t)), np.bincount(bins[f], p * (1 - p), len(t))), -4, 4)
            t += add
            z += add[bins[f]]
    if pairs is None:
        p = 1 / (1 + np.exp(-z))
        gains = [(_quarters(*grid(f, g, p)[1:])[0], (f, g)) for f, g in combinations(range(x.shape[1]), 2)]
        pairs = [fg for _, fg in sorted(gains, key=lambda k: (-k[0], k[1]))[:PAIRS]]
    pair_tables = [np.zeros((sizes[f], sizes[g])) for f, g in pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), t in zip(pairs, pair_tables):
            p = 1 / (1 + np.exp(-z))
            cell, a, b = grid(f, g, p)
            add = RATE * np.clip(_quarters(a, b)[1], -4, 4)
            t += add
            z += add.ravel()[cell]
    return {"base": base, "tables": tables, "pairs": pairs, "pair_tables": pair_tables}


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The texts of at most ``rows`` labelled documents that may be learned from, and their labels by id.

    Labels are averaged by id, those above a half count as 1, and null ones as none; the least hashes are taken. Each
    id gives one text, the smallest, so repeated rows stay within the bound too.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = {r.doc_id: r.y for r in chosen.collect()}  # bounded by rows
    ids = docs.sparkSession.createDataFrame([(i,) for i in known], "doc_id long")
    return texts_of(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), known


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    sample, ys = labelled(docs, labels, label, rows)
    known = map_texts(sample, lambda: lambda i, t: (i, [features(x) for x in t]), "doc_id long, x array<double>")
    got = [(r.doc_id, r.x) for r in known.collect()]  # two dozen figures for each of the bounded rows
    got.sort(key=lambda r: (r[0], r[1]))
    y = np.array([ys[i] for i, _ in got], float)
    x = np.array([v for _, v in got], float).reshape(len(got), len(FEATURES))
    if len(got) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([np.zeros(0)] * len(FEATURES), [np.zeros(0)] * len(FEATURES), math.log(share / (1 - share)), [np.zeros(1)] * len(FEATURES), [], [])
    edges, coarse = ([_edges(x[:, f], k) for f in range(x.shape[1])] for k in (BINS, COARSE))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((x, y, edges, coarse))

    def bag(pairs):
        def run(batches):
            for b in batches:
                for k in b["id"].tolist():
                    x, y, edges, coarse = sent.value
                    mine = np.arange(len(y)) % BAGS != k if pairs is not None else slice(None)
                    yield pd.DataFrame({"fit": [pickle.dumps(fit(x[mine], y[mine], edges, coarse, pairs))]})

        return run

    def fitted(pairs, n):
        return [pickle.loads(r.fit) for r in spark.range(n, numPartitions=n).mapInPandas(bag(pairs), "fit binary").collect()]

    first = fitted(None, 1)[0]
    bags = fitted(first["pairs"], BAGS)
    sent.destroy()  # both fits have ended
    mean = lambda k: [np.mean(t, 0) for t in zip(*(b[k] for b in bags))]
    return Model(edges, coarse, float(np.mean([b["base"] for b in bags])), mean("tables"), first["pairs"], mean("pair_tables"))


def score(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs; empty and null texts are scored too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(ids, texts):
        s = sent.value.score(np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES)))
        return ids, s, (s >= min_score).astype(np.int32)

    return map_texts(docs, lambda: f, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_score: float = MIN_SCORE) -> DataFrame:
    """Learn from the labelled rows and score all. Without labels of both kinds every text gets the labels' share."""
    return score(docs, train(docs, labels, rows=rows), min_score)


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose texts score enough, with all their columns; nothing is joined.

    Null and empty texts are scored as empty ones, repeated rows alike; without labels of both kinds every text has the
    labels' share as its score. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))
    return keep_texts(docs, lambda: lambda texts: sent.value.score(np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))) >= min_score)
