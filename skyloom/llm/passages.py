"""Substring deduplication by sliding sentence spans.

Every sentence starts a span: it and the following ones, at least SENTENCES of them and at least MIN_WORDS words.
So a span depends on nothing but what it holds, and a repeated passage gives equal spans wherever it stands. Spans
are hashed and counted over all documents (a sentence of more than LONG words counts as several, cut after the word of
least hash, the last one if several have it, of any CUT_ONE_IN in a row, so that it doesn't matter what else stands
around); the first occurrence is that in the smallest id, and there the foremost.
Sentences that any other occurrence covers are removed.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts_of

#: A span has several sentences and enough words that clean texts don't share it by chance; a passage of 51 words still holds some.
SENTENCES, MIN_WORDS = 2, 20
#: Cuts of a long sentence are at most CUT_ONE_IN words apart, and those whose CUT_ONE_IN - 1 neighbours on both sides
#: lie in a passage are the same wherever it stands: 48 words without punctuation always hold a span.
LONG, CUT_ONE_IN = 20, 8
_END = re.compile(r"[.!?]\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_PLACE = np.random.default_rng(20240301).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _cuts(text: str, start: int, end: int) -> list[int]:
    """Ends of the words that are least in any CUT_ONE_IN in a row; behind one comes the first lesser word, or else the
    least of the next CUT_ONE_IN."""
    sizes = list(map(len, _WORD.findall(text, start, end)))
    ends, last = list(accumulate(sizes, initial=end - sum(sizes))), len(sizes) - 1
    hashes = map(zlib.crc32, map(str.encode, text[start:end].lower().split()))
    key = [h << 32 | i for h, i in zip(hashes, range(last, -1, -1))]  # of equals, the last is least
    out, k = [], min(key[:CUT_ONE_IN])
    while True:
        i = last - (k & 0xFFFFFFFF) + 1
        if ends[i] < end:
            out.append(ends[i])
        after = key[i : i + CUT_ONE_IN]
        least = min(after, default=k)
        if least < k:
            k = next(x for x in after if x < k)
        elif len(after) == CUT_ONE_IN:
            k = least
        else:
            return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, with the white space after them: together they are the text."""
    out, start = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end - start > 2 * LONG and len(text[start:end].split(None, LONG)) > LONG:
            for at in _cuts(text, start, end):
                out.append((start, at))
                start = at
        if start < end:
            out.append((start, end))
            start = end
    return out


def spans(text: str, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, end sentence) of every span of the text; sentences without words are passed over."""
    words = [text[a:b].lower().split() for a, b in cuts]
    real = [i for i, w in enumerate(words) if w]
    n = len(real)
    if n < SENTENCES:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i])) for i in real), np.uint64, n)
    total = np.concatenate([[0], np.cumsum([len(words[i]) for i in real])])
    start = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), start + SENTENCES)
    start, end = start[end <= n], end[end <= n]
    made = np.zeros(len(start), np.uint64)
    live, t = np.arange(len(start)), 0
    while len(live):  # as many turns as the longest span has sentences
        made[live] += h[start[live] + t] * _PLACE[t % 64]
        t += 1
        live = live[start[live] + t < end[live]]
    made = (made ^ (made >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    at = np.array([*real, len(cuts)])
    return (made ^ (made >> np.uint64(29))).view(np.int64), at[start], at[end - 1] + 1


def _known_spans(docs: DataFrame) -> DataFrame:
    """(h, doc_id): the distinct spans of each row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                found = [np.unique(spans(t, sentences(t))[0]) for t in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return texts_of(docs).where("doc_id IS NOT NULL").mapInArrow(run, "h long, doc_id long")


def cut(text: str, later: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """The sentences, and which of them are covered: by spans in ``later``, or by spans seen before in this text."""
    cuts = sentences(text)
    h, start, end = spans(text, cuts)
    if not len(h):
        return cuts, []
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    gone = ~first
    if later:
        gone |= np.isin(h, np.fromiter(later, np.int64, len(later)))
    if not gone.any():
        return cuts, []
    edge = np.zeros(len(cuts) + 1, np.int64)
    np.add.at(edge, start[gone], 1)
    np.add.at(edge, end[gone], -1)
    return cuts, np.flatnonzero(edge.cumsum()[:-1] > 0).tolist()


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed_chars, removed, text): a row for each row of docs.

    ``text`` lacks the removed sentences; ``removed`` lists their spans as start:end, comma-joined, in code points.
    Null texts become empty. Rows of equal id count as one document, so repeated rows don't empty each other. Rows
    without an id are only held against themselves.
    """
    known = stage(_known_spans(docs), "spans")
    repeated = known.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    later = known.join(repeated, "h").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("h").alias("later"))  # bounded by the document's own spans
    joined = texts_of(docs).join(later, "doc_id", "left")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                out = []
                for i, text, later in zip(*(c.to_pylist() for c in part.columns)):
                    cuts, gone = cut(text, set(later or ()))
                    dropped = set(gone)
                    spans_ = [cuts[k] for k in gone]
                    out.append((i, len(cuts), len(gone), sum(b - a for a, b in spans_), ",".join(f"{a}:{b}" for a, b in spans_), "".join([text[a:b] for k, (a, b) in enumerate(cuts) if k not in dropped]) if gone else text))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_sentences", "n_removed", "removed_chars", "removed", "text"])

    return joined.select("doc_id", "text", "later").mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed_chars long, removed string, text string")
