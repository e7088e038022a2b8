"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors, with document frequencies counted over all documents. A randomised SVD,
whose products Spark computes over the passages' partitions, gives a latent space. Windows of documents are projected
into it and compared with the passages by cosine and by how much of a passage they hold. No window holds much of a
passage longer than itself, so such a passage stands in the space as overlapping segments, and a hit on any of them
makes it a candidate. Candidates are confirmed by the longest common subsequence of words of the whole passage and by
its answer, its last words.

The benchmark is the query set: it passes through in groups of at most GROUP segments, each held against all documents,
so what the driver holds and what is broadcast have a bound whatever the size of either table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_texts, map_texts, stage

#: Segments of a block, which has a latent space of its own, and of the blocks that one scan of the documents serves.
BLOCK, GROUP = 256, 2048
#: Dimensions of a latent space: half of what would hold every segment of a full block by itself.
LATENT, OVERSAMPLED, POWERS = 128, 16, 2
#: Taken from every inverse document frequency, or half the largest one if that is less: words in more than a thirtieth
#: of the documents weigh nothing, but for the rarest words of each segment.
COMMON, RAREST = 3.4, 6
WINDOW, STRIDE = 64, 16
#: Words of a segment, and from one segment's start to the next; passages of at most WINDOW words are one segment. A
#: segment lies whole in some window wherever it stands.
SEGMENT, STEP = WINDOW - STRIDE, (WINDOW - STRIDE) // 2
#: Of a segment's squared weight, the share that a candidate window must hold; the cosine that it must have.
MIN_HELD, MIN_COSINE = 0.35, 0.3
#: Longest common subsequence by the passage's length: enough alone, or enough with the answer.
SURE, LIKELY, MIN_ANSWER = 0.75, 0.6, 0.6
ANSWER_SHARE = 0.25
_APART = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower case, split at everything that is no ASCII letter or digit and no other character."""
    return text.lower().encode().translate(_APART).split()


def segments(words: list[bytes]) -> list[list[bytes]]:
    """The passage in overlapping parts, each short enough for a window."""
    return [words] if len(words) <= WINDOW else [words[at : at + SEGMENT] for at in range(0, len(words) - STEP, STEP)]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        if m := where.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """(documents with words, documents with each word of the vocabulary), in one pass over all of them.

    The vocabulary is the benchmark's, so what is sent and gathered doesn't grow with the documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        mine = sent.value

        def f(_, texts):
            seen: Counter = Counter()
            n = 0
            for t in texts:
                if words := words_of(t):
                    n += 1
                    seen.update(mine.intersection(words))
            return [None, *seen], [n, *seen.values()]

        return f

    counted = map_texts(docs, make, "word binary, n long", rows=10_000, size=32 << 20).groupBy("word").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    n = {None if r.word is None else bytes(r.word): r.n for r in counted}
    return n.pop(None, 0), n


def randomised_svd(rows: DataFrame, widths: list[int], rank: int, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, vectors as width x rank) of several matrices, one a block, whose sparse rows are
    (block int, at array<int>, weight array<double>). A job serves all blocks.

    The range of the rows is found by multiplying a random matrix by A'A a few times. Each task multiplies its own
    rows, and Spark adds what the tasks send; the driver holds matrices of width x rank, never the rows.
    """
    spark = rows.sparkSession
    k = rank + OVERSAMPLED

    def product(ms: list[np.ndarray]) -> list[np.ndarray]:
        """A' A m, by block"""
        sent = spark.sparkContext.broadcast(ms)

        def run(batches):
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for block, at, w in zip(b["block"], b["at"], b["weight"]):
                    m = sent.value[block]
                    sums = out.setdefault(block, np.zeros_like(m))
                    sums[at] += np.outer(w, w @ m[at])
            for block, sums in out.items():
                near = np.flatnonzero(sums.any(1))
                yield pd.DataFrame({"block": block, "row": near, "sums": list(sums[near])})

        summed = [np.zeros_like(m) for m in ms]
        for r in rows.mapInPandas(run, "block int, row long, sums array<double>").collect():
            summed[r.block][r.row] += np.array(r.sums)
        sent.destroy()
        return summed

    rng = np.random.default_rng(seed)
    qs = [rng.standard_normal((width, min(k, width))) for width in widths]
    for _ in range(POWERS):
        qs = [np.linalg.qr(p)[0] for p in product(qs)]
    out = []
    for q, p in zip(qs, product(qs)):
        small = q.T @ p  # (A q)' (A q)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[: min(rank, len(values))]
        best = best[values[best] > 1e-9 * max(values.max(), 1e-30)]
        out.append((np.sqrt(values[best]), q @ turn[:, best]))
    return out


class Index:
    """A block of segments: vocabulary, weights, latent vectors, and the passages' words for the exact check.

    ``words`` are the segments', ``wholes`` the words of the passage that each belongs to.
    """

    def __init__(self, ids: list[int], words: list[list[bytes]], wholes: list[list[bytes]], vocabulary: dict[bytes, int], weights: np.ndarray, vectors: np.ndarray):
        self.ids, self.wholes = ids, wholes
        self.vocabulary = {w: i for w, i in vocabulary.items() if weights[i] > 0}
        self.mass = weights**2
        self.basis = (weights[:, None] * vectors).astype(np.float32)  # what a word adds to a window's latent vector
        self.latent = np.array([self.basis[sorted({vocabulary[w] for w in ws})].sum(0) for ws in words], np.float32)
        self.norm = (self.latent**2).sum(1)
        first: dict[int, int] = {}
        self.passage = [first.setdefault(id(ws), i) for i, ws in enumerate(wholes)]  # one segment for all of a passage's
        # segments of like weight are compared together, with the windows that weigh enough for them
        tier = np.floor(np.log2(np.maximum(self.norm, 1e-9)))
        self.tiers = [(MIN_HELD * float(self.norm[tier == t].min()) * 0.98, np.flatnonzero(tier == t)) for t in np.unique(tier)]

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(window start, segment) pairs that hold and resemble enough.

        A window can't hold more of a segment than the weight of all its words, so light windows are not projected.
        """
        n = len(words)
        at = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        place = np.flatnonzero(at >= 0)
        if not len(place):
            return []
        at = at[place].astype(np.int64)
        mass = np.concatenate([[0.0], self.mass[at].cumsum()])
        starts = np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, np.int64)
        low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + WINDOW)
        weight = mass[high] - mass[low]
        heavy = np.flatnonzero(weight >= self.tiers[0][0])
        out = []
        for part in (heavy[i : i + 1024] for i in range(0, len(heavy), 1024)):
            size = high[part] - low[part]
            row = np.repeat(np.arange(len(part)), size)
            flat = np.arange(len(row)) - np.repeat(size.cumsum() - size, size) + np.repeat(low[part], size)
            keys = np.unique(row * len(self.mass) + at[flat])  # a word counts once in a window
            row, word = keys // len(self.mass), keys % len(self.mass)
            q = np.add.reduceat(self.basis[word], np.searchsorted(row, np.arange(len(part))))
            length = (q * q).sum(1)
            for least, which in self.tiers:
                if not len(some := np.flatnonzero(weight[part] >= least)):
                    break
                dots, norm = q[some] @ self.latent[which].T, self.norm[which]
                near = (dots >= MIN_HELD * norm) & (dots >= MIN_COSINE * np.sqrt(norm * length[some, None]))
                out += [(int(starts[part[some[i]]]), int(which[p])) for i, p in zip(*np.nonzero(near))]
        return out

    def leaks(self, text: str) -> dict[int, float]:
        """The passages that a text holds, with the largest share of their words in order."""
        words = words_of(text)
        found: dict[int, float] = {}
        near = set()
        for start, s in self.candidates(words) if words else ():
            # neighbouring windows of a long passage have nearly the same region, which is compared once
            grid = max(STRIDE, len(self.wholes[s]) // 8 // STRIDE * STRIDE)
            near.add((start // grid * grid, grid, self.passage[s]))
        for start, grid, p in sorted(near):
            own = self.wholes[p]
            margin = len(own)
            region = words[max(0, start - margin) : start + grid - STRIDE + WINDOW + margin]
            share = common_subsequence(own, region) / len(own)
            if share >= LIKELY:
                answer = own[-max(3, round(len(own) * ANSWER_SHARE)) :]
                if share >= SURE or common_subsequence(answer, region) >= MIN_ANSWER * len(answer):
                    found[self.ids[p]] = max(found.get(self.ids[p], 0), share)
        return found


def _weighed(words: list[list[bytes]], total: int, frequencies: dict[bytes, int]) -> tuple[dict[bytes, int], np.ndarray, list[tuple[list[int], list[float]]]]:
    """(vocabulary, weights, sparse rows) of a block of segments."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    idf = np.log((total + 1) / (np.array([frequencies.get(w, 0) for w in vocabulary]) + 1)) + 0.05
    own = [np.array(sorted({vocabulary[w] for w in ws})) for ws in words]
    weights = np.maximum(idf - min(COMMON, np.log(total + 1) / 2), 0)
    for o in own:
        rarest = o[np.argsort(-idf[o], kind="stable")[:RAREST]]
        weights[rarest] = np.maximum(weights[rarest], 0.3)
    return vocabulary, weights, [(o[weights[o] > 0].tolist(), weights[o[weights[o] > 0]].tolist()) for o in own]


def build_indexes(spark: SparkSession, blocks: list[list[tuple[int, list[bytes], list[bytes]]]], total: int, frequencies: dict[bytes, int]) -> list[Index]:
    """An index for each block of (id, segment, passage)."""
    parts = [tuple(map(list, zip(*rows))) for rows in blocks]
    weighed = [_weighed(words, total, frequencies) for _, words, _ in parts]
    sparse = [(k, *row) for k, (_, _, rows) in enumerate(weighed) for row in rows]
    rows = spark.createDataFrame(sparse, "block int, at array<int>, weight array<double>").repartition(max(1, min(8, len(sparse) // 64)))
    spaces = randomised_svd(rows, [len(v) for v, _, _ in weighed], LATENT)
    return [Index(ids, words, wholes, vocabulary, weights, vectors) for (ids, words, wholes), (vocabulary, weights, _), (_, vectors) in zip(parts, weighed, spaces)]


def groups(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes], list[bytes]]]]:
    """(id, segment, passage) rows, at most GROUP at a time but for a passage that has more by itself.

    Passages without words or id are left out. The driver holds a group, not the benchmark.
    """
    rows: list = []
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for r in known.orderBy("item_id", "text").toLocalIterator():
        if words := words_of(r.text):
            own = [(r.item_id, part, words) for part in segments(words)]
            if rows and len(rows) + len(own) > GROUP:
                yield rows
                rows = []
            rows += own
    if rows:
        yield rows


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """For each group of segments, its blocks' indexes, broadcast together. The caller destroys them when it is done."""
    for rows in groups(benchmark):
        total, frequencies = document_frequencies(docs, frozenset(w for _, ws, _ in rows for w in ws))
        blocks = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
        yield docs.sparkSession.sparkContext.broadcast(build_indexes(docs.sparkSession, blocks, total, frequencies))


def _leaks(blocks: list[Index], text: str) -> dict[int, float]:
    found: dict[int, float] = {}
    for b in blocks:
        for k, v in b.leaks(text).items():
            found[k] = max(found.get(k, 0.0), v)
    return found


def _held(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, items, share) for each row of docs, by one group of segments."""

    def f(ids, texts):
        found = [_leaks(sent.value, t) for t in texts] if sent else [{} for _ in texts]
        return ids, [sorted(x) for x in found], [max(x.values(), default=0.0) for x in found]

    return map_texts(docs, lambda: f, "doc_id long, items array<long>, share double")


def _held_by_row(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, own, items, share) of the texts that hold something; ``own`` is the text's hash."""

    def f(ids, texts):
        found = [(i, xxhash.xxh3_64_intdigest(t.encode()) - 2**63, x) for i, t in zip(ids, texts) if (x := _leaks(sent.value, t))]
        return [i for i, _, _ in found], [o for _, o, _ in found], [sorted(x) for _, _, x in found], [max(x.values()) for _, _, x in found]

    return map_texts(docs, lambda: f, "doc_id long, own long, items array<long>, share double")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items, share): a row for each row of docs.

    ``items`` are the ids of the passages found, in order, and ``share`` the largest share of a passage's words that
    stands in the text in order (0 if none was found). Passages without words or id are never found; passages under
    one id are separate, and either counts. Null and empty texts hold none.
    """
    out = ("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "share")
    every = indexes(docs, benchmark)
    first, second = next(every, None), next(every, None)
    if second is None:  # one scan serves all
        return _held(docs, first).select(*out)
    hits = None
    for sent in (first, second, *every):
        found = stage(_held_by_row(docs, sent), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.dropDuplicates(["doc_id", "own", "items"]).groupBy("doc_id", "own").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("share").alias("share"))
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "own": "hit_own"})
    texts = map_texts(docs, lambda: lambda ids, texts: (ids, [xxhash.xxh3_64_intdigest(t.encode()) - 2**63 for t in texts]), "doc_id long, own long")
    joined = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit_own")), "left")
    return joined.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share")).select(*out)


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose texts hold no passage, with all their columns; nothing is joined.

    Null and empty texts stay as they are, repeated rows are judged alike, and an empty benchmark keeps every row.
    """
    kept, before = docs, None
    for sent in indexes(docs, benchmark):
        if before is not None:  # what an earlier group has left is written, so its indexes can go
            kept = stage(kept, "cleaned")
            before.destroy()
        kept, before = keep_texts(kept, lambda s=sent: lambda texts: [not _leaks(s.value, t) for t in texts]), sent
    return kept
