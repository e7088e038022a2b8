"""Vector code compression: product quantisation by Lloyd's rounds with the filtering of candidates in kd-trees.

Vectors become integers and are cut into PARTS; each part position has a codebook. Vectors are dealt once to blocks,
and each block gets a kd-tree for each part position: nodes with bounding boxes, counts and sums, written as a table,
so no round builds one again and a lost executor costs a block's work. A round sends the candidate entries down each
tree. Of a node's candidates, the one nearest to the middle of its box beats every other that is farther from all of
the box, which its most favourable corner tells. A node with one candidate left is assigned whole, from its cached
count and sum; only leaves with several look at their points. Task results are sums by part and entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stage, unstage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers in a block, and points in a leaf.
BLOCK, LEAF = 1 << 18, 16
#: Integers of a component beyond this could make an error that no long holds.
MOST = 1 << 27


def _bound(width: int) -> int:
    return min(MOST, math.isqrt((1 << 59) // width))


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>): rows whose vector has only finite components, scaled and rounded down.

    Vectors without components can't be cut and are dropped like null ones.
    """
    x = F.col("embedding")
    sound = F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A kd-tree: ``order`` of the points, and for each node its span, left child (-1: leaf; the right one follows), box and sum."""
    order, spans, left, lo, hi, sums = np.arange(len(points)), [(0, len(points))], [], [], [], []
    for start, end in spans:  # grows as nodes are split
        p = points[order[start:end]]
        low, high = p.min(0), p.max(0)
        lo.append(low), hi.append(high), sums.append(p.sum(0))
        if end - start > LEAF and (low < high).any():
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(p[:, (high - low).argmax()], middle)]
            left.append(len(spans))
            spans += [(start, start + middle), (start + middle, end)]
        else:
            left.append(-1)
    return {"order": order.astype(np.int32), "spans": np.array(spans, np.int32), "left": np.array(left, np.int32), "lo": np.array(lo), "hi": np.array(hi), "sums": np.array(sums)}


def assigned(t: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(count, sum) of each entry's points and, for ``each``, the entry of every point. ``points`` stand in the tree's order."""
    size, spans = (book**2).sum(1), t["spans"]
    counts, sums = np.zeros(len(book), np.int64), np.zeros_like(book)
    entry = np.zeros(len(points), np.int64) if each else None
    node, cand = np.zeros(len(book), np.int64), np.arange(len(book))  # pairs, by node and then by entry
    while len(node):
        firsts = np.flatnonzero(np.diff(node, prepend=-1))
        away = ((2 * book[cand] - t["lo"][node] - t["hi"][node]) ** 2).sum(1)
        best = cand[np.lexsort((cand, away, node))[firsts]]
        best = np.repeat(best, np.diff([*firsts, len(node)]))
        u = book[cand] - book[best]
        lead = size[cand] - size[best] - 2 * (u * np.where(u > 0, t["hi"][node], t["lo"][node])).sum(1)  # how much nearer, at most, than the best
        stay = (lead < 0) | ((lead == 0) & (cand <= best))
        node, cand = node[stay], cand[stay]
        firsts = np.flatnonzero(np.diff(node, prepend=-1))
        many = np.diff([*firsts, len(node)])
        here, alone, leaf = node[firsts], many == 1, t["left"][node[firsts]] < 0
        one, owner = here[alone], cand[firsts[alone]]
        np.add.at(counts, owner, spans[one, 1] - spans[one, 0])
        np.add.at(sums, owner, t["sums"][one])
        if each:
            for k, e in zip(one, owner):
                entry[spans[k, 0] : spans[k, 1]] = e
        for k, at, n in zip(here[leaf & ~alone], firsts[leaf & ~alone], many[leaf & ~alone]):
            p, among = points[spans[k, 0] : spans[k, 1]], cand[at : at + n]
            mine = among[(size[among] - 2 * (p @ book[among].T)).argmin(1)]
            np.add.at(counts, mine, 1)
            np.add.at(sums, mine, p)
            if each:
                entry[spans[k, 0] : spans[k, 1]] = mine
        inner = np.repeat(~leaf & ~alone, many)
        node, cand = np.concatenate([t["left"][node[inner]], t["left"][node[inner]] + 1]), np.tile(cand[inner], 2)
        order = np.lexsort((cand, node))
        node, cand = node[order], cand[order]
    return counts, sums, entry


_FIELDS = {"order": np.int32, "spans": np.int32, "left": np.int32, "lo": np.int64, "hi": np.int64, "sums": np.int64}


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors with a tree for each part; rows whose length is not ``PARTS * width`` fail."""
    label = vectors.schema["label"].dataType
    made = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("points", T.ArrayType(T.BinaryType())), *[T.StructField(f, T.ArrayType(T.BinaryType())) for f in _FIELDS]])
    rows = max(1, BLOCK // (PARTS * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, count = to_arrow_schema(made), [], 0

        def block(whole: pa.Table) -> pa.RecordBatch:
            v = whole.column("v").combine_chunks()
            if (np.diff(v.offsets) != PARTS * width).any():
                raise ValueError(f"all vectors must have {PARTS * width} components, as the first one")
            v = v.flatten().to_numpy().reshape(len(whole), PARTS * width)
            if max(v.max(), -v.min()) > _bound(width):
                raise ValueError(f"components beyond {_bound(width) // SCALE} make errors that no long holds")
            trees = [tree(v[:, k * width : (k + 1) * width]) for k in range(PARTS)]
            points = [np.ascontiguousarray(v[t["order"], k * width : (k + 1) * width], np.int32).tobytes() for k, t in enumerate(trees)]
            cells = [whole.column("vec_id").to_pylist(), whole.column("label").to_pylist(), points, *[[t[f].astype(kind).tobytes() for t in trees] for f, kind in _FIELDS.items()]]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                held, count = [*held, part], count + part.num_rows
                while count >= rows:
                    whole = pa.Table.from_batches(held)
                    yield block(whole.slice(0, rows))
                    held, count = whole.slice(rows).to_batches(), count - rows
        if count:
            yield block(pa.Table.from_batches(held))

    return vectors.select("vec_id", "label", "v").mapInArrow(run, made)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, dict[str, np.ndarray]]]:
    """(row, part, points, tree) of every block in a batch."""
    columns = {n: batch.column(n) for n in ("points", *_FIELDS)}
    for row in range(batch.num_rows):
        cells = {n: c[row].as_py() for n, c in columns.items()}
        for k in range(PARTS):
            t = {f: np.frombuffer(cells[f][k], kind) for f, kind in _FIELDS.items()}
            t |= {f: t[f].reshape(-1, w) for f, w in (("spans", 2), ("lo", width), ("hi", width), ("sums", width))}
            yield row, k, np.frombuffer(cells["points"][k], np.int32).reshape(-1, width).astype(np.int64), t


def learned(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after all rounds. A round's sums come to the driver: a row for each entry."""
    n, width = books.shape[1:]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, width), np.int64)
        for batch in batches:
            for _, k, points, t in _trees(batch, width):
                c, s, _ = assigned(t, points, books[k])
                counts[k] += c
                sums[k] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, counts[part, entry], *sums[part, entry].T)], ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    for _ in range(ROUNDS):
        parts = blocks.mapInArrow(summed, f"part long, entry long, n long, {', '.join(f's{i} long' for i in range(width))}")
        moved = books.copy()
        for part, entry, count, *total in parts.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(width)]).collect():
            moved[part, entry] = np.array(total, np.int64) // count
        books = moved
    return books


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (None if no row is kept).

    ``code`` has two hex digits a part, ``error`` is the squared distance to what the code stands for. Dropped: rows
    whose vector is null, empty, or holds null or non-finite components. Repeated rows and rows without an id are rows
    like any other; of equal ids the lesser vector starts a codebook first, rows without an id come last. Fewer than
    ENTRIES rows make codebooks of as many entries. All vectors must have the length of the first one, a multiple of PARTS.
    """
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width, odd = divmod(len(first[0].v), PARTS)
    if odd:
        raise ValueError(f"vectors of {len(first[0].v)} components can't be cut into {PARTS} equal parts")
    start = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    blocks = stage(_blocks(rows, width), "trees")
    books = learned(blocks, start)
    made = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", vectors.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for batch in batches:
            n = [len(x) for x in batch.column("ids")]
            codes, errors = [np.zeros((m, PARTS), np.uint8) for m in n], [np.zeros(m, np.int64) for m in n]
            for row, k, points, t in _trees(batch, width):
                _, _, entry = assigned(t, points, books[k], each=True)
                codes[row][t["order"], k] = entry
                errors[row][t["order"]] += ((points - books[k][entry]) ** 2).sum(1)
            for row in range(batch.num_rows):
                text = codes[row].tobytes().hex()
                cells = [batch.column("ids")[row].values, batch.column("labels")[row].values, [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], errors[row]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)

    out = stage(blocks.mapInArrow(coded, made), "codes")
    unstage(blocks)
    return out, books


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with ``vector``: what each code stands for, in the units of the original vectors."""
    entries = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in book]) for book in books]
    places = [F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") + 1 for k in range(PARTS)]
    return coded.withColumn("vector", F.concat(*[F.element_at(e, p) for e, p in zip(entries, places)]))


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): ``label_error`` sums the errors of equal labels, nulls together."""
    out, books = compress(vectors)
    totals = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return out.join(totals, out["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rounds with every distance."""
    near = """a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM (
  SELECT p.rid, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM p JOIN c{r} AS c USING (part)) GROUP BY 1, 2)"""
    move = """c{s} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
  SELECT part, entry, list(z ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS z FROM (
    SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS i FROM a{r} AS a JOIN p USING (rid, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) AS m USING (part, entry))"""
    rounds = ",\n".join(x for r in range(ROUNDS) for x in (near.format(r=r), move.format(r=r, s=r + 1)))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM k),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM n, range({PARTS}) AS t(part)),
c0 AS (SELECT part, rid AS entry, v FROM p WHERE rid < {ENTRIES}),
{rounds},
{near.format(r=ROUNDS)},
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT n.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY n.label))::BIGINT AS label_error, codebooks_sha256 FROM n JOIN e USING (rid), s"""
