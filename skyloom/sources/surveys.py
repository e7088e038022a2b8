"""Where alerts come from: topics, streams, archives, and the tables that they are stored in."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources import tables

#: Topics by survey; {date} is the night as YYYYMMDD, {program} a programme id.
TOPICS = {"ZTF": "ztf_{date}_programid{program}", "DECAM": "decam_{date}_programid1", "WINTER": "winter_{date}", "LSST": "lsst-alerts-v11"}
SIMULATED = "alerts-simulated"
MAX_QUEUED = 15_000


def topics(survey: str, date: dt.date, programs: Iterable[int] = (1,), simulated: bool = False) -> list[str]:
    if survey == "LSST" and simulated:
        return [SIMULATED]
    return sorted({TOPICS[survey].format(date=date.strftime("%Y%m%d"), program=p) for p in programs})


def subscription_topics(survey: str, today: dt.date, days: int, programs: Iterable[int] = (1,)) -> list[str]:
    """The topics of today and the ``days`` before it, each once."""
    return list(dict.fromkeys(t for i in range(days, -1, -1) for t in topics(survey, today - dt.timedelta(days=i), programs)))


def topics_of(days: DataFrame, day: str, survey: str, before: int = 0, programs: Iterable[int] = (1,)) -> DataFrame:
    """The rows of ``days`` with (night, topic): the topics of each day and the ``before`` days ahead of it."""
    nights = days.withColumn("night", F.explode(F.sequence(F.date_sub(day, before), F.col(day))))
    parts = [TOPICS[survey].replace("{program}", str(p)).partition("{date}") for p in sorted(programs)]
    names = F.array_distinct(F.array(*(F.concat(F.lit(a), F.date_format("night", "yyyyMMdd") if date else F.lit(""), F.lit(b)) for a, date, b in parts)))
    return nights.withColumn("topic", F.explode(names))


def topic_pattern(survey: str, programs: Iterable[int] = (1,)) -> str:
    """A pattern of the survey's topics of any night."""
    return TOPICS[survey].replace("{date}", "[0-9]{8}").replace("{program}", "(" + "|".join(map(str, sorted(programs))) + ")")


@dataclass(frozen=True)
class Start:
    """Where reading begins: a pinned date is read whole and not followed further."""

    date: dt.date
    pinned: bool = False

    def options(self) -> dict[str, str]:
        millis = int(dt.datetime(self.date.year, self.date.month, self.date.day, tzinfo=dt.UTC).timestamp() * 1000)
        return {"startingTimestamp": str(millis), "startingOffsetsByTimestampStrategy": "latest"}


def open_stream(spark: SparkSession, survey: str, start: Start, servers: str | None = None, folder: str | None = None, days: int = 1, programs: Iterable[int] = (1,), most: int = MAX_QUEUED) -> DataFrame:
    """A stream of (topic, value): from a broker if servers are given, else from a folder of packet files by topic.

    A batch takes no more than ``most`` packets, so a slow stage holds reading back. A stream that isn't pinned subscribes
    to the survey's topics of every night from its first on, so it passes midnight without being started again.
    """
    wanted = topic_pattern(survey, programs)
    first = None if start.pinned else subscription_topics(survey, start.date, days, programs)
    names = topics(survey, start.date, programs) if start.pinned else None
    if servers:
        which = {"subscribe": ",".join(names)} if names else {"subscribePattern": wanted}
        options = {"kafka.bootstrap.servers": servers, "maxOffsetsPerTrigger": str(most), "failOnDataLoss": "false"} | which | start.options()
        return spark.readStream.format("kafka").options(**options).load().select("topic", "value")
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most).option("pathGlobFilter", "*.avro").option("recursiveFileLookup", "true").load(folder)
    out = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("topic"), F.col("content").alias("value"))
    return out.where(F.col("topic").isin(names)) if names else out.where(F.col("topic").rlike(f"^{wanted}$") & (F.regexp_extract("topic", "[0-9]{8}", 0) >= min(re.findall("[0-9]{8}", " ".join(first)), default="")))


def replay(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """An archive folder of packet files as (path, value), in order of path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").option("recursiveFileLookup", "true").load(folder).select("path", F.col("content").alias("value"))
    return files.orderBy("path").limit(limit) if limit else files


def unsent(archive: DataFrame, sent: DataFrame) -> DataFrame:
    """Packets (path, topic, value) of topics that don't hold as many messages yet as the archive has for them.

    ``sent`` is (topic, messages). Of topics whose counts agree nothing is sent again; the rest are sent whole, as
    packets that come twice are stored once.
    """
    due = archive.groupBy("topic").agg(F.count("*").alias("__due")).join(sent.select("topic", "messages"), "topic", "left").where(F.coalesce("messages", F.lit(0)) != F.col("__due"))
    return archive.join(due.select("topic"), "topic", "left_semi")


def insert_new(table: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """The rows to append: those whose key is not stored, one for each key."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def known_only(rows: DataFrame, objects: DataFrame, key: str = "objectId", max_jd: float | None = None, jd: Column | None = None) -> DataFrame:
    """Rows of a back-fill whose object is known, up to a time."""
    out = rows.join(objects.select(key), key, "left_semi")
    return out.where((F.col("candidate.jd") if jd is None else jd) <= max_jd) if max_jd is not None else out


def by_keys(alerts: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    return alerts.join(keys.select(key), key, "left_semi")


def with_cutouts(alerts: DataFrame, cutouts: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Alerts with their images, and alerts without any."""
    return alerts.join(cutouts, key), alerts.join(cutouts.select(key), key, "left_anti")


def all_with_cutouts(alerts: DataFrame, cutouts: DataFrame, key: str = "_id", images: tuple[str, ...] = ()) -> DataFrame:
    """Alerts with their images, where each must have them (all of ``images``, if they are named): the job fails at the
    first one that hasn't, with its key. Of images stored twice under a key one counts, so no alert is multiplied."""
    held = cutouts.dropDuplicates([key]).select(F.col(key).alias("__key"), *(c for c in cutouts.columns if c != key))
    there = F.col("__key").isNotNull()
    for c in images:
        there = there & F.col(c).isNotNull()
    met = alerts.join(held, F.col(key) == F.col("__key"), "left")
    checked = F.when(there, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no images for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(alerts.schema[key].dataType))
    return met.withColumn(key, checked).drop("__key")


def put_cutouts(rows: DataFrame, folder: str, batch: int, key: str = "_id", buckets: int = 64) -> None:
    """Images of a batch, one row for each key, by buckets of keys in a folder of the batch: one that is written again
    replaces itself."""
    tables.write_by_key(rows.dropDuplicates([key]), f"{folder}/batch={batch}", key, buckets, "overwrite")


def get_cutouts(spark: SparkSession, folder: str, keys: DataFrame | None = None, key: str = "_id", latest: bool = False) -> DataFrame:
    """Stored images, of ``keys`` if they are given; then only the buckets that these lie in are read. Of a key that was
    put more than once the first counts, or with ``latest`` the last; which one it is takes a scan of keys alone, without
    the images."""
    every = spark.read.parquet(folder)
    stored = tables.buckets_of(every, keys, key) if keys is not None else every
    known = stored.select(key, "batch")
    wanted = known.join(keys.select(key), key, "left_semi") if keys is not None else known
    which = wanted.groupBy(key).agg((F.max if latest else F.min)("batch").alias("batch"))
    return stored.join(which, [key, "batch"]).select(*(c for c in every.columns if c != "batch" and not tables.is_layout(c)))


def packed(*images: Column) -> Column:
    """Images in one binary value, each behind its length as four big-endian bytes; a missing one has length 0."""
    some = [F.coalesce(i, F.lit(b"")) for i in images]
    return F.concat(*(part for i in some for part in (F.unhex(F.lpad(F.hex(F.length(i)), 8, "0")), i)))


def write_by_topic(packets: DataFrame, folder: str, topic: str = "topic") -> None:
    """Packets by routed topic, a folder each."""
    packets.where(F.col(topic).isNotNull()).repartition(topic, F.pmod(F.hash("_id"), F.lit(16))).write.mode("append").partitionBy(topic).parquet(folder)


def publish(packets: DataFrame, servers: str | None = None, folder: str | None = None, topic: str = "topic") -> None:
    """Packets (topic, key, value) to a broker if servers are given, else to a folder for each topic."""
    if servers:
        options = {"kafka.bootstrap.servers": servers, "kafka.compression.type": "zstd", "kafka.acks": "1"}
        packets.select(F.col(topic).alias("topic"), "key", "value").write.format("kafka").options(**options).save()
    else:
        packets.where(F.col(topic).isNotNull()).write.mode("append").partitionBy(topic).parquet(folder)


def written_back(alerts: DataFrame, results: DataFrame, now: float, key: str = "_id") -> DataFrame:
    """Alerts with new properties and classifications where there are any, and the time of the change."""
    fields = [c for c in results.columns if c != key]
    joined = alerts.join(results.select(key, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__hit")), key, "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c) if c in alerts.columns else F.col(f"__{c}"))
    changed = F.when(F.col("__hit"), F.lit(now))
    return joined.withColumn("updated_at", F.coalesce(changed, "updated_at") if "updated_at" in alerts.columns else changed).drop("__hit", *(f"__{c}" for c in fields))


class Footprint:
    """Sky coverage as a table of cells; positions are looked up by an equi-join on the cell."""

    def __init__(self, cells: DataFrame, cell: Callable[[Column, Column], Column]):
        self.cells, self.cell = cells, cell

    @staticmethod
    def square_cells(size: float) -> Callable[[Column, Column], Column]:
        return lambda ra, dec: F.struct(F.floor((dec + 90.0) / size).alias("row"), F.floor(F.pmod(ra, F.lit(360.0)) / size).alias("column"))

    def mark(self, df: DataFrame, ra: str = "ra", dec: str = "dec", name: str = "in_footprint") -> DataFrame:
        inside = self.cells.select(F.col("cell").alias("__cell")).distinct().withColumn("__in", F.lit(True))
        out = df.withColumn("__at", self.cell(F.col(ra), F.col(dec))).join(inside, F.col("__at") == F.col("__cell"), "left")
        return out.withColumn(name, F.coalesce("__in", F.lit(False))).drop("__at", "__cell", "__in")
