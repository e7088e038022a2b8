"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint holds, for each bit, whether more than half of its shingles' hashes have it set. Fingerprints
within RADIUS bits of each other are linked. Every bit place gets a nonzero vector of RADIUS + 1 binary digits, and
mask v holds the places whose vector has an odd inner product with v. RADIUS places span at most RADIUS dimensions, so
some v is orthogonal to all of their vectors: its mask leaves these places out. So two fingerprints that differ in no
more places are equal under at least one of the 2^(RADIUS+1) - 1 masks, whatever the places are: no link is lost.

A bucket (mask, masked fingerprint) holds distinct fingerprints, so exact copies weigh nothing. Buckets of at most
BLOCK are searched in memory, and a spanning forest leaves them, never their pairs. A larger one is split by covering
masks over the places that its mask leaves free, and again; at the third mask fewer fingerprints than BLOCK are possible.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stage, unstage
from .neardup import components, words_of

WORDS, BITS, RADIUS, SEED = 4, 64, 4, 42
#: x^5 + x^2 + 1, primitive over two elements; its degree is RADIUS + 1.
PRIMITIVE = 0b100101
#: Distinct fingerprints of a bucket that are searched together; so many comparisons cost about what a split does.
BLOCK = 1 << 14
#: Shingles whose bits are counted at a time.
STEP = 1 << 15


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of a whole text; without words it is zero."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, stops = np.concatenate([[0], ends[:-WORDS] + 1]).tolist(), ends[WORDS - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP])), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) for each row, the print as a signed number; null texts count as empty ones."""
    return map_texts(docs, lambda: lambda ids, texts: (ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()), "doc_id long, print long")


@functools.cache
def masks(held: int = 0) -> tuple[int, ...]:
    """The masks that cover the places which ``held`` leaves free, each with ``held`` itself; unsigned.

    The places' vectors are the powers of a primitive element, so that of any few in a row every mask holds some.
    """
    top, free, vectors = 2 ** (RADIUS + 1), [b for b in range(BITS) if not held >> b & 1], [1]
    while len(vectors) < len(free):
        x = vectors[-1] << 1
        vectors.append(x ^ PRIMITIVE if x & top else x)
    return tuple(dict.fromkeys(held | sum(1 << b for b, x in zip(free, vectors) if (x & v).bit_count() & 1) for v in range(1, top)))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """(root, other) for every fingerprint that links, over any number of others, connect with an earlier one."""
    left, roots, others = np.unique(prints.view(np.uint64)), [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= RADIUS
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                roots += [int(root.view(np.int64))] * len(found)
                others += found.view(np.int64).tolist()
    return roots, others


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket, from rows (mask, key, print) that are sorted by bucket."""
    held, now = [], None

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate(held)) if held else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        mask, key, prints = (batch.column(k).to_numpy() for k in range(3))
        edges = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(mask)]):
            if start == end:
                continue
            if now != (mask[start], key[start]):
                yield out()
                held, now = [], (mask[start], key[start])
            held.append(prints[start:end])
    yield out()


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (mask, print) with every mask that covers what its own leaves free."""
    for batch in batches:
        for held, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            finer = [_signed(m) for m in masks(held % (1 << BITS))]
            yield pa.RecordBatch.from_arrays([pa.array(finer, pa.int64()), pa.array([prints] * len(finer), pa.int64())], ["mask", "print"])


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints of one component, enough to connect all of it, from distinct rows (print)."""
    rows = prints.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks()])).alias("mask"), "print")
    found = None
    while True:
        rows = rows.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        # Spark sizes the rows as what they are made of, 31 times too low, and would broadcast them
        held = stage(rows.hint("merge").join(sizes, ["mask", "key"]), "buckets")
        small = held.where(F.col("n") <= block).select("mask", "key", "print").repartition("mask", "key").sortWithinPartitions("mask", "key")
        more = stage(small.mapInArrow(_forests, "a long, b long").distinct(), "links")
        found = more if found is None else found.unionByName(more)
        large = held.where(F.col("n") > block)
        if large.isEmpty():
            unstage(held)
            return found
        rows = large.select("mask", "print").mapInArrow(_refined, "mask long, print long").distinct()


def classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of docs.

    ``fingerprint`` has 16 lower-case hex digits. ``component_id`` is the smallest id reachable over links, the row's
    own included. Null and empty texts have fingerprint zero and are linked like any other. Every row counts by its own
    fingerprint: repeated rows get equal results, rows of one id with different texts are linked only if their
    fingerprints are. A row without an id links others; its component is null if nothing in it has an id.
    """
    known = stage(fingerprints(docs), "prints")
    firsts = stage(known.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    found = links(firsts.select("print"), block)
    if found.isEmpty():
        placed = firsts.select("print", F.col("first").alias("component_id"))
    else:
        labelled = firsts.join(components(found).withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("comp", "print"))
        least = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
        placed = labelled.join(least, "comp").select("print", "component_id")
    return known.join(placed, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
