"""A stored table replayed as a stream through the keyed merge."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import views

from . import state


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/skyloom-streams"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skyloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def in_batches(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The stored events as a stream of ``batches`` micro-batches. Each one spans all times, so points come late."""
    stored, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), shared_folder(spark, "events")
    stored.repartition(batches, "event_id").write.option("maxRecordsPerFile", 0).parquet(folder)
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def merged_objects(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """(objectId, points, first_jd, last_jd): the last state of each object after all micro-batches."""
    folder, checkpoint = shared_folder(spark, "objects"), shared_folder(spark, "progress")
    events = in_batches(spark, sf_dir, batches)
    points = views.as_detections(events).select("objectId", "jd", "mag", "mag_err", "band", "designation")

    def each(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(folder)

    query = state.objects_of(points).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.schema(f"{state.OBJECT}, batch int").parquet(folder)
    last = seen.groupBy("objectId").agg(F.max(F.struct("batch", "version", "points", "first_jd", "last_jd")).alias("s"))
    return last.select("objectId", F.col("s.points").alias("points"), F.round("s.first_jd", 6).alias("first_jd"), F.round("s.last_jd", 6).alias("last_jd"))
