"""What the corpus operators share: the shape of their input, staging, and Arrow batches.

Every operator reads only ``doc_id`` and ``text`` of its input, so extra columns, of whatever name, never
clash with what it computes. A null text counts as an empty one. Rows with equal ids are separate rows.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space as the contracts of the word-based operators define it.
SPACES = " \t\n\v\f\r"
#: Bytes of text that a worker takes apart at a time, where no single text is longer.
SLICE = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), null texts made empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(doc_id="doc_id"):
    """True for the rows that no model learns from: crc32 of the id as text is divisible by 5 (or the id is null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine is taken, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/skyloom-stages"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skyloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: later stages don't depend on lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing will read again."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, at: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of column ``at``, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        stop = max(start + 1, min(start + rows, fit, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def in_slices(batches: Iterator[pa.RecordBatch], at: int, one: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``one`` of each slice. Workers outlive their tasks, so what a task has freed goes back to the system at its end."""
    try:
        for whole in batches:
            for part in slices(whole, at, rows, size):
                yield one(part)
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def map_texts(docs: DataFrame, make: Callable[[], Callable], schema: str | T.StructType, rows: int = 1000, size: int = SLICE) -> DataFrame:
    """Apply a function on (ids, texts) to every row, in slices of at most ``rows`` rows and about ``size`` bytes.

    ``make()`` runs once a task and returns the function; it returns a list or array for each column of the schema.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, arrow = make(), to_arrow_schema(schema)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            out = f(part.column(0).to_pylist(), part.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind.type) for x, kind in zip(out, arrow, strict=True)], schema=arrow)

        yield from in_slices(batches, 1, one, rows, size)

    return texts_of(docs).mapInArrow(run, schema)


def keep_texts(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """The rows of docs, with all their columns, whose texts pass: ``make()`` gives a function from texts to booleans.

    A null text is judged as an empty one and stays null if it is kept; repeated rows are judged alike.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        yield from in_slices(batches, at, lambda part: part.filter(pa.array(f([t or "" for t in part.column(at).to_pylist()]), pa.bool_())))

    return docs.mapInArrow(run, docs.schema)


def change_texts(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """The same rows and columns with every text changed; a null text is changed as an empty one."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_slices(batches, at, lambda part: part.set_column(at, "text", pa.array([change(t or "") for t in part.column(at).to_pylist()], pa.string())))

    return docs.mapInArrow(run, docs.schema)
