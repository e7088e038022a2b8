"""Near-duplicates by MinHash bands, with odd sketches between candidates and exact checks.

Texts become sets of five-word shingles; equal word sequences are one class with one representative. MinHash bands
put representatives into buckets. Candidates are compared first by odd sketches: the MinHash samples folded into
parity bitmaps, whose XOR's population count estimates a high similarity precisely. What remains is confirmed on the
full sets. A bucket is not expanded into all its pairs: its members are held against a hub, components are formed,
and only what still lies in different components is compared again, with other hubs and at last pair by pair. So no
candidate pair is left out but those within a component, which cannot change the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stage, texts_of, unstage

WORDS, PERCENT = 5, 75
#: 32 bands of 4: a pair of similarity 0.75 shares no band once in 200,000 times.
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Differing bits above which a pair is no candidate: similarity 0.75 gives 57 with a deviation of 9.
MAX_BITS = 106
#: The finer sketch of what is compared pair by pair: similarity 0.75 gives 906 with a deviation of 36.
FINE_SAMPLES, FINE_BITS, FINE_MAX = 2048, 8192, 1070
STAR_ROUNDS = 2
#: Rows of a bucket that are compared with as many others at a time.
BLOCK = 1024
#: Members of a hub that are checked in one group.
GROUP = 256

_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE = _RNG.integers(1, 2**63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 2**63, FINE_SAMPLES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return text.encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; fewer words than a shingle has count as one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return _mixed((h * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    x = h[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        x += h[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mixed(x))


def signature(s: np.ndarray, functions: np.ndarray = _HASH) -> np.ndarray:
    """The least value of each hash function over the set."""
    out = np.full(len(functions), np.iinfo(np.uint64).max, np.uint64)
    step = 65536 // len(functions)
    for at in range(0, len(s), step):
        np.minimum(out, _mixed_high(np.multiply.outer(functions, s[at : at + step])).min(1), out=out)
    return out


def _mixed_high(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def bands(sig: np.ndarray) -> np.ndarray:
    return _mixed((sig.reshape(BANDS, ROWS) * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Each sample flips one bit, chosen by its value and its place."""
    bit = (_mixed(sig ^ _FOLD[: len(sig)]) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def similarity(differing: int, bits: int = SKETCH_BITS, samples: int = BANDS * ROWS) -> float:
    """What a count of differing bits says of the similarity of the sets."""
    return 1 + bits / (4 * samples) * np.log(max(1 - 2 * differing / bits, 1e-9))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, class, n, bands, odd) for each row; without words there is no class, and n is 0."""

    def f(ids, texts):
        kinds, ns, keys, odds = [], [], [], []
        for t in texts:
            words = words_of(t)
            s = shingles(words)
            ns.append(len(s))
            if len(s):
                sig = signature(s)
                kinds.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(bands(sig))
                odds.append(odd_sketch(sig))
            else:
                kinds.append(None)
                keys.append(np.zeros(0, np.int64))
                odds.append(np.zeros(0, np.int64))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return ids, kinds, ns, lists(keys), lists(odds)

    return map_texts(docs, lambda: f, "doc_id long, class binary, n long, bands array<long>, odd array<long>")


def differing(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _alike(na: Column, nb: Column) -> Column:
    """Sizes that a similarity of 0.75 allows."""
    return (100 * F.least(na, nb)) >= (PERCENT * F.greatest(na, nb))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) reaches.

    Nodes hear their neighbours' labels and jump to their label's label, until nothing changes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = labels.join(heard, "node").select("node", "comp", F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        after = stage(moved.join(jump, "to", "left").select("node", F.coalesce(F.least("to", "far"), "to").alias("comp"), (F.coalesce(F.least("to", "far"), "to") != F.col("comp")).alias("changed")), "labels")
        unstage(labels)
        labels = after.select("node", "comp")
        if after.where("changed").isEmpty():
            unstage(both)
            return labels


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. The members of a hub a are dealt to groups of bounded size."""
    width = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    whose = texts.select(F.col("doc_id").alias("b"), "text")
    members = pairs.join(width, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups"))).join(whose, "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    hubs = width.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")).join(whose.withColumnRenamed("b", "a"), "a")
    rows = members.unionByName(hubs.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text")).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = whole = None
        for batch in batches:
            a_ids, b_ids = [], []
            for a, part, role, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if role == 0:
                    held, whole = (a, part), shingles(words_of(text))
                elif held == (a, part) and linked(whole, shingles(words_of(text))):
                    a_ids.append(a)
                    b_ids.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _close_pairs(members: DataFrame, texts: DataFrame, most: int = FINE_MAX) -> DataFrame:
    """(a, b): pairs of one bucket but different components whose fine sketches are close, each from its first bucket.

    Large buckets are dealt to blocks, and each pair of blocks is a group of bounded size. Sketches of a group are
    compared in memory; only close pairs leave it.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(words_of(t)) for t in part.column(1).to_pylist()]
                keys = [bands(signature(s)).tobytes() for s in sets]
                fine = [odd_sketch(signature(s, _FINE), FINE_BITS).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "bands", "fine"])

    here = texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    fine = stage(here.select("doc_id", "text").mapInArrow(sketched, "doc_id long, bands binary, fine binary"), "fine")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "doc_id", "n", "comp")
    rows = dealt.join(fine, "doc_id").select("key", "i", "j", "left", "doc_id", "n", "comp", "bands", "fine").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(group: tuple, held: list[tuple]) -> tuple[list, list]:
        key, i, j = group
        ids, n, comp = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        keys = np.frombuffer(b"".join(r[4] for r in held), np.int64).reshape(len(held), -1)
        fine = np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1)  # of signed numbers, bits of the absolute value would be counted
        left = np.flatnonzero([r[0] for r in held])
        right = left if i == j else np.flatnonzero([not r[0] for r in held])
        out_a, out_b = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= PERCENT * np.maximum(n[right], n[x]))]
            y = y[ids[y] > ids[x]] if i == j else y
            if not len(y):
                continue
            y = y[np.bitwise_count(fine[y] ^ fine[x]).sum(1) <= most]
            first = np.argmax(keys[y] == keys[x], 1)  # the first band that they share
            y = y[keys[x][first] == key]
            lo, hi = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            out_a += lo.tolist()
            out_b += hi.tolist()
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            a, b = [], []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != now:
                    if len(held) > 1:
                        more = compared(now, held)
                        a += more[0]
                        b += more[1]
                    now, held = (key, i, j), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(held) > 1:
            a, b = compared(now, held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _links(docs: DataFrame, reps: DataFrame, cut: bool = True) -> DataFrame | None:
    """(node, comp) of the representatives that have links, or None if there are none."""
    most, fine_most = (MAX_BITS, FINE_MAX) if cut else (SKETCH_BITS, FINE_BITS)
    in_bands = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    shared = in_bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    members = stage(in_bands.join(shared, "key").withColumn("comp", F.col("doc_id")), "members")
    if members.isEmpty():
        return None
    texts = stage(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    odd = reps.select("doc_id", "odd")
    comps = links = seen = None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            order = F.xxhash64("doc_id", F.lit(turn)) if turn == 0 else F.xxhash64("doc_id", F.pmod("key", F.lit(4)))
            hubs = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "doc_id", "n", "comp")).alias("hub"))
            pairs = members.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & _alike(F.col("n"), F.col("hub.n"))).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
            pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
            pairs = stage(pairs if seen is None else pairs.join(seen, ["low", "high"], "left_anti"), "pairs")
            seen = pairs.select("low", "high") if seen is None else seen.unionByName(pairs.select("low", "high"))
            close = pairs.join(odd.withColumnRenamed("doc_id", "a"), "a").join(odd.select(F.col("doc_id").alias("b"), F.col("odd").alias("odd_b")), "b")
            near = close.where(differing(F.col("odd"), F.col("odd_b")) <= most).select("a", "b")
        else:
            near = _close_pairs(members, texts, fine_most).join(seen.toDF("a", "b"), ["a", "b"], "left_anti")
        near = stage(near.distinct(), "candidates")
        if not near.isEmpty():
            found = stage(_verified(near, texts), "links")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                comps = components(links)
        if turn < STAR_ROUNDS:  # what is left: buckets whose members lie in different components
            now = members.select("key", "doc_id", "n").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")) if comps else members.select("key", "doc_id", "n", "comp")
            split = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high").select("key", "blocks")
            members = stage(now.join(split, "key"), "members")
            if members.isEmpty():
                break
    return comps


def classes(docs: DataFrame, cut: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of docs.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``kept`` is true for it.
    Texts without words, null texts among them, have no shingles and are linked with nothing. Repeated rows are one
    node; if texts differ under one id, the smallest text decides on links. Rows without an id are linked with
    nothing and kept.

    Without ``cut`` sketches leave no candidate out: every pair that a bucket still holds apart is checked on its full
    sets. That is far more work, and the way to measure on given texts whether the sketches lose a link.
    """
    docs = texts_of(docs)
    known = stage(sketches(docs), "sketches")
    usable = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    firsts = stage(usable.groupBy("class").agg(F.min("doc_id").alias("first")), "classes")
    reps = usable.join(firsts.withColumnRenamed("first", "doc_id"), ["doc_id", "class"]).dropDuplicates(["doc_id", "class"])
    comps = _links(docs, stage(reps.select("doc_id", "n", "bands", "odd"), "representatives"), cut)
    placed = firsts.select("class", F.col("first").alias("comp")) if comps is None else firsts.join(comps, F.col("first") == F.col("node"), "left").select("class", F.coalesce("comp", "first").alias("comp"))
    out = known.select("doc_id", "n", "class").join(placed, "class", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, one for each component, with all their columns; of rows of equal id one stays."""
    keep = classes(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    mine = docs.join(keep, docs["doc_id"].cast("long") == keep["kept_id"], "left_semi")
    return mine.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))


def oracle_sql() -> str:
    """The same classes by all pairs that share a shingle, and all that each document reaches."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.near = e.a),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
