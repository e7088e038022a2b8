"""Topics of packets in a shared folder: a sink that commits whole batches, and a source that knows its positions.

Tasks of the sink stage their rows; the driver commits them with one record, which names the staged files and the
offsets that their rows take. What no record names does not exist for readers, so a batch is there whole, in all its
topics, or not at all, and a batch that comes twice is recorded once. The source's position is an offset for each topic
and partition; a batch admits so many messages, oldest nights first, and nights that are too old are left behind.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

PACKETS = "topic string, partition int, offset long, key string, value binary"
_FILE = pa.schema([("key", pa.string()), ("value", pa.binary())])
#: Tasks that a batch's messages are dealt to, at most about.
TASKS = 64
#: Rows and bytes that a task holds for all its topics before it writes them.
HELD_ROWS, HELD_BYTES = 10_000, 32 << 20
_NIGHT = re.compile("[0-9]{8}")
_RECORD = re.compile(r"(\d{12})-(.+)-(\d+)\.json")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _put(fs: pafs.FileSystem, path: str, value: dict) -> None:
    """A small file that is there whole or not at all."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        out.write(json.dumps(value).encode())
    fs.move(f"{path}.part", path)


def _get(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Slice:
    """Rows of one staged file: the first one's place in it, how many, and the offset that the first one has."""

    topic: str
    partition: int
    path: str
    skip: int
    rows: int
    offset: int


@dataclass
class Part(InputPartition):
    """What one task reads."""

    slices: list[Slice]


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, int, str, int]]


class Log:
    """The records of a folder. They don't change, so each is read once."""

    def __init__(self, folder: str):
        self.fs, self.path = _open(folder.rstrip("/"))
        self.records: dict[str, dict] = {}

    def refresh(self) -> list[dict]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/log", allow_not_found=True))
        for name in sorted(f.base_name for f in found if _RECORD.fullmatch(f.base_name)):
            if name not in self.records:
                self.records[name] = _get(self.fs, f"{self.path}/log/{name}")
        return [self.records[n] for n in sorted(self.records)]

    def ends(self) -> dict[str, dict[str, int]]:
        """The offset behind the last message of each topic and partition."""
        out: dict[str, dict[str, int]] = {}
        for r in self.refresh():
            for topic, partition, first, rows, _ in r["files"]:
                out.setdefault(topic, {})[str(partition)] = first + rows
        return out

    def slices(self, wanted: dict[tuple[str, int], tuple[int, int]]) -> list[Slice]:
        """The messages from one offset up to another of each topic and partition, in one pass over the records."""
        out: dict[tuple[str, int], list[Slice]] = {k: [] for k in wanted}
        for r in self.refresh():
            for t, p, first, rows, path in r["files"]:
                low, high = wanted.get((t, p), (0, 0))
                a, b = max(first, low), min(first + rows, high)
                if a < b:
                    out[t, p].append(Slice(t, p, path, a - first, b - a, a))
        for (t, p), (low, high) in wanted.items():
            if sum(s.rows for s in out[t, p]) != high - low:
                raise ValueError(f"messages {low} to {high} of {t}, partition {p}, are not all there")
        return [s for found in out.values() for s in found]

    def commit(self, writer: str, batch: int, files: list[tuple[str, int, str, int]]) -> None:
        """Records staged files (topic, partition, path, rows). A batch that is recorded already stays as it is."""
        self.refresh()
        known = {_RECORD.fullmatch(n).groups() for n in self.records}
        if any((w, int(b)) == (writer, batch) for _, w, b in known):
            _drop(self.fs, [f[2] for f in files])
            return
        ends, placed = self.ends(), []
        for topic, partition, path, rows in sorted(files):
            at = ends.setdefault(topic, {})
            first = at.get(str(partition), 0)
            at[str(partition)] = first + rows
            placed.append((topic, partition, first, rows, path))
        number = max((int(n) for n, _, _ in known), default=0) + 1
        _put(self.fs, f"{self.path}/log/{number:012d}-{writer}-{batch}.json", {"files": placed})


def _drop(fs: pafs.FileSystem, paths: list[str]) -> None:
    for p in paths:
        if fs.get_file_info(p).type == pafs.FileType.File:
            fs.delete_file(p)


# ---- the sink ----


def _name(writer: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.]+", writer):
        raise ValueError(f"{writer!r} is no name of a writer")
    return writer


class _Writer:
    """What batch and stream writers share. Rows without a topic are not sent."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.writer = options["path"], _name(options.get("writer", "batch"))
        self.partitions, self.batch = int(options.get("partitions", "4")), options.get("batch")

    def write(self, rows: Iterator) -> Staged:
        fs, path = _open(self.folder.rstrip("/"))
        held: dict[tuple[str, int], list] = {}
        out, n, size = Staged([]), 0, 0

        def flush() -> None:
            for (topic, partition), values in sorted(held.items()):
                where = f"{path}/staged/{topic}/{partition}"
                fs.create_dir(where, recursive=True)
                name = f"{where}/{uuid.uuid4().hex}.parquet"
                columns = [pa.array([v[i] for v in values], t.type) for i, t in enumerate(_FILE)]
                with fs.open_output_stream(name) as f:
                    pq.write_table(pa.Table.from_arrays(columns, schema=_FILE), f, compression="zstd")
                out.files.append((topic, partition, name, len(values)))
            held.clear()

        for r in rows:
            if r["topic"] is None:
                continue
            if not re.fullmatch(r"[A-Za-z0-9._-]+", r["topic"]):
                raise ValueError(f"{r['topic']!r} is no name of a topic")
            value = bytes(r["value"]) if r["value"] is not None else None
            partition = int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, r["key"] or "").bytes[:4]) % self.partitions
            held.setdefault((r["topic"], partition), []).append((r["key"], value))
            n, size = n + 1, size + len(value or b"")
            if n >= HELD_ROWS or size >= HELD_BYTES:
                flush()
                n = size = 0
        flush()
        return out

    def _commit(self, messages: list[Staged | None], batch: int) -> None:
        Log(self.folder).commit(self.writer, batch, [tuple(f) for m in messages if m for f in m.files])

    def _abort(self, messages: list[Staged | None]) -> None:
        _drop(_open(self.folder)[0], [f[2] for m in messages if m for f in m.files])


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages):
        self._commit(messages, int(self.batch))

    def abort(self, messages):
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self._commit(messages, batchId)

    def abort(self, messages, batchId):
        self._abort(messages)


# ---- the source ----


class Reader(DataSourceStreamReader):
    """Positions by topic and partition. Spark's own log says what belongs to a batch; the end of the last planned batch
    is kept beside it, as a source that is started again isn't told where it was when it is asked how far it may go."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.group = options["path"], _name(options["group"])
        self.pattern, self.most = options["topics"], int(options["most"])
        self.first, self.days = options["first"], int(options["days"])
        self.log: Log | None = None

    def _log(self) -> Log:
        self.log = self.log or Log(self.folder)
        return self.log

    def _mark(self) -> str:
        return f"{self._log().path}/positions/{self.group}.json"

    def initialOffset(self) -> dict:
        log = self._log()
        if log.fs.get_file_info(self._mark()).type == pafs.FileType.File:  # Spark starts anew, so the group does too
            log.fs.delete_file(self._mark())
        return {}

    def followed(self, ends: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
        """Topics that are read: of the first night or later, and no more than ``days`` nights before the newest."""
        night = lambda t: (_NIGHT.search(t) or [self.first])[0]
        mine = {t: p for t, p in ends.items() if re.fullmatch(self.pattern, t) and night(t) >= self.first}
        newest = max(map(night, mine), default=self.first)
        oldest = (dt.datetime.strptime(newest, "%Y%m%d") - dt.timedelta(days=self.days)).strftime("%Y%m%d")
        return {t: mine[t] for t in sorted(mine, key=lambda t: (night(t), t)) if night(t) >= oldest}

    def latestOffset(self) -> dict:
        """As far as the next batch may go: ``most`` messages on, of the oldest night first, shared by its partitions."""
        log = self._log()
        at = _get(log.fs, self._mark()) if log.fs.get_file_info(self._mark()).type == pafs.FileType.File else {}
        left, out = self.most, {}
        for topic, ends in self.followed(log.ends()).items():
            here = {p: at.get(topic, {}).get(p, 0) for p in ends}
            waiting = {p: ends[p] - here[p] for p in sorted(ends, key=int)}
            for i, (p, n) in enumerate(sorted(waiting.items(), key=lambda x: x[1])):
                took = min(n, -(-left // (len(waiting) - i)))
                here[p] += took
                left -= took
            if any(here.values()):
                out[topic] = here
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        log, out, held = self._log(), [], 0
        spans = {(t, int(p)): (start.get(t, {}).get(p, 0), high) for t, ps in end.items() for p, high in ps.items()}
        slices = log.slices({k: (low, high) for k, (low, high) in spans.items() if high > low})
        share = -(-sum(s.rows for s in slices) // TASKS)
        for s in slices:
            if not out or held >= share:
                out.append(Part([]))
                held = 0
            out[-1].slices.append(s)
            held += s.rows
        _put(log.fs, self._mark(), end)
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs = _open(self.folder)[0]
        for s in partition.slices:
            with fs.open_input_file(s.path) as f:
                skip, left, offset = s.skip, s.rows, s.offset
                for batch in pq.ParquetFile(f).iter_batches(1024):
                    part = batch.slice(skip, left) if skip < len(batch) else batch.slice(0, 0)
                    skip, n = max(0, skip - len(batch)), len(part)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([s.topic] * n), pa.array([s.partition] * n, pa.int32()), pa.array(range(offset, offset + n), pa.int64()), *part.columns], ["topic", "partition", "offset", "key", "value"])
                    offset, left = offset + n, left - n
                    if not left:
                        break

    def __getstate__(self) -> dict:
        return self.__dict__ | {"log": None}


class Topics(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_topics"

    def schema(self) -> str:
        return PACKETS

    def streamReader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite):
        return StreamWriter(dict(self.options))


def open_topics(spark: SparkSession, folder: str, group: str, pattern: str, first: dt.date, days: int = 7, most: int = 15_000, pinned: bool = False) -> DataFrame:
    """A stream of (topic, partition, offset, key, value) from topics whose names match, from a night on.

    A batch takes no more than ``most`` messages. Topics of coming nights are followed as they appear; those of nights
    more than ``days`` before the newest are left. A pinned stream reads its first night's topics only.
    """
    spark.dataSource.register(Topics)
    night = first.strftime("%Y%m%d")
    which = pattern.replace("[0-9]{8}", night) if pinned else pattern
    return spark.readStream.format("packet_topics").options(path=folder, group=group, topics=which, first=night, days=days, most=most).load()


def send(packets: DataFrame, folder: str, batch: int, writer: str = "batch", partitions: int = 4) -> None:
    """Packets (topic, key, value) of one batch, all or none. A batch that was sent before isn't sent again."""
    packets.sparkSession.dataSource.register(Topics)
    packets.select("topic", "key", "value").write.format("packet_topics").mode("append").options(path=folder, writer=writer, batch=batch, partitions=partitions).save()


def send_stream(packets: DataFrame, folder: str, checkpoint: str, writer: str, partitions: int = 4, **trigger):
    """A stream of packets (topic, key, value) to topics, each batch once. Returns the started query."""
    packets.sparkSession.dataSource.register(Topics)
    out = packets.select("topic", "key", "value").writeStream.format("packet_topics").outputMode("append").options(path=folder, writer=writer, partitions=partitions, checkpointLocation=checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
