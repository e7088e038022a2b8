"""Topics in a folder: batches whole or not at all, positions that outlive a reader, nights that come and go."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from skyloom.sources import surveys
from skyloom.streaming import topics

PATTERN = surveys.topic_pattern("ZTF", (1, 2))


def packets(spark, low, high, night="20240101", partitions=3):
    i = F.col("id")
    topic = F.concat(F.lit(f"ztf_{night}_programid"), (i % 2 + 1).cast("string"))
    return spark.range(low, high, 1, partitions).select(topic.alias("topic"), i.cast("string").alias("key"), F.encode(F.concat(F.lit("v"), i.cast("string")), "utf-8").alias("value"))


def drained(spark, stream, folder, checkpoint, until, seconds=60):
    """Rows by batch, read until there are ``until`` of them."""
    got = []

    def each(batch, i):
        got.append((i, [(r.topic, r.partition, r.offset, r.key, bytes(r.value)) for r in batch.collect()]))

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    end = time.time() + seconds
    while sum(len(r) for _, r in got) < until and time.time() < end and q.isActive:
        time.sleep(0.1)
    if q.isActive:
        q.stop()
    return [r for _, r in got]


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    topics.send(packets(spark, 0, 100), folder, 1)
    topics.send(packets(spark, 0, 100), folder, 1)  # the same batch again
    log = topics.Log(folder)
    total = lambda: sum(sum(p.values()) for p in topics.Log(folder).ends().values())
    assert total() == 100 and set(log.ends()) == {"ztf_20240101_programid1", "ztf_20240101_programid2"}
    failing = packets(spark, 100, 200).withColumn("value", F.when(F.col("key") == "190", F.raise_error(F.lit("task lost")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="task lost"):
        topics.send(failing, folder, 2)
    assert total() == 100
    topics.send(packets(spark, 100, 200), folder, 2)
    topics.send(packets(spark, 0, 0), folder, 3)
    odd = spark.createDataFrame([(None, "a", b"x"), ("ztf_20240101_programid1", None, None)], "topic string, key string, value binary")
    topics.send(odd, folder, 4)
    assert total() == 201
    with pytest.raises(Exception, match="no name"):
        topics.send(spark.createDataFrame([("../x", "a", b"x")], "topic string, key string, value binary"), folder, 5)


def test_positions_admission_and_nights(spark, tmp_path):
    folder, checkpoint = f"file://{tmp_path}/t", str(tmp_path / "progress")
    topics.send(packets(spark, 0, 90, "20231201"), folder, 0)  # before the first night
    topics.send(packets(spark, 0, 100), folder, 1)
    stream = lambda most=30: topics.open_topics(spark, folder, "g", PATTERN, dt.date(2024, 1, 1), days=3, most=most)
    first = drained(spark, stream(), folder, checkpoint, 60)
    assert all(len(b) <= 30 for b in first) and sum(map(len, first)) >= 60  # stopped in the middle of topics
    topics.send(packets(spark, 100, 150, "20240102"), folder, 2)  # midnight passes
    second = drained(spark, stream(), folder, checkpoint, 150 - sum(map(len, first)))
    rows = [r for b in first + second for r in b]
    assert len(rows) == len(set(r[:3] for r in rows)) == 150 and {r[4] for r in rows} == {b"v%d" % i for i in range(150)}
    for key in {r[:2] for r in rows}:  # offsets without gaps
        assert sorted(r[2] for r in rows if r[:2] == key) == list(range(sum(r[:2] == key for r in rows)))
    nights = [r[0][4:12] for r in rows]
    assert nights == sorted(nights)  # the older night first
    # a topic of an old night that grows late is left behind
    topics.send(packets(spark, 150, 160, "20240101").unionByName(packets(spark, 160, 170, "20240106")), folder, 3)
    third = [r for b in drained(spark, stream(), folder, checkpoint, 10) for r in b]
    assert {r[3] for r in third} == {str(i) for i in range(160, 170)}
    pinned = topics.open_topics(spark, folder, "p", PATTERN, dt.date(2024, 1, 2), pinned=True)
    assert {r[3] for b in drained(spark, pinned, folder, str(tmp_path / "pinned"), 50) for r in b} == {str(i) for i in range(100, 150)}


def test_a_failed_batch_is_read_again(spark, tmp_path):
    folder, checkpoint, seen = f"file://{tmp_path}/t", str(tmp_path / "progress"), []
    topics.send(packets(spark, 0, 40), folder, 1)
    stream = topics.open_topics(spark, folder, "g", PATTERN, dt.date(2024, 1, 1), most=15)

    def each(batch, i):
        if i == 1 and not any(x == "failed" for x in seen):
            seen.append("failed")
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start().awaitTermination(60)
    rest = drained(spark, topics.open_topics(spark, folder, "g", PATTERN, dt.date(2024, 1, 1), most=15), folder, checkpoint, 25)
    assert [len(b) for b in rest if b] == [15, 10] and len({r[3] for b in rest for r in b}) == 25


def test_streams_send_each_batch_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for i in range(3):
        packets(spark, i * 10, i * 10 + 10).write.mode("append").parquet(source)
    read = spark.readStream.schema("topic string, key string, value binary").option("maxFilesPerTrigger", 2).parquet(source)
    topics.send_stream(read, folder, str(tmp_path / "progress"), "alerts", availableNow=True).awaitTermination(60)
    total = lambda: sum(sum(p.values()) for p in topics.Log(folder).ends().values())
    assert total() == 30
    # the last batch's commit is lost, so Spark runs it again
    last = max((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    topics.send_stream(read, folder, str(tmp_path / "progress"), "alerts", availableNow=True).awaitTermination(60)
    assert total() == 30


def test_a_batch_goes_through_the_records_once(spark, tmp_path, monkeypatch):
    """However many topics and partitions there are, and only for those that have moved."""
    folder = f"file://{tmp_path}/t"
    for i in range(3):
        topics.send(packets(spark, i * 50, i * 50 + 50, f"2024010{i + 1}"), folder, i)
    reader = topics.Reader({"path": folder, "group": "g", "topics": PATTERN, "most": "1000", "first": "20240101", "days": "9"})
    end, passes, refresh = topics.Log(folder).ends(), [], topics.Log.refresh
    monkeypatch.setattr(topics.Log, "refresh", lambda log: passes.append(1) or refresh(log))
    assert sum(s.rows for p in reader.partitions({}, end) for s in p.slices) == 150 and len(passes) == 1
    assert reader.partitions(end, end) == [] and len(passes) == 2
    with pytest.raises(ValueError, match="not all there"):
        reader.partitions({}, end | {"ztf_20240101_programid1": {"0": 999}})
