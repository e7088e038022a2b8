"""Survey-shaped views of the benchmark tables, from the same formulas as the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event stands for which band.
BANDS = {"click": "g", "view": "r", "purchase": "i", "signup": "z", "error": "y"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_detections(load(spark, sf_dir, "events"))


def as_detections(e: DataFrame) -> DataFrame:
    """(candid, objectId, jd, mag, mag_err, band, programid, designation): a row for each event."""
    band = F.create_map(*(F.lit(x) for kv in BANDS.items() for x in kv))[F.col("event_type")]
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("candid"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("objectId"), (micros / 86400e6 + 2440587.5).alias("jd"), (15 + F.col("value") / 100).alias("mag"), F.lit(0.05).alias("mag_err"),
        band.alias("band"), (F.col("event_id") % 3 + 1).cast("int").alias("programid"), F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("D"), F.col("user_id").cast("string"))).alias("designation"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with a nested candidate; detections stand on a made-up grid of positions."""
    d = detections(spark, sf_dir)
    candidate = F.struct("jd", F.col("mag").alias("magpsf"), F.col("mag_err").alias("sigmapsf"), "band", "programid", F.col("designation").alias("ssnamenr"), (F.col("candid") % 7 / 7.0).alias("drb"), (F.col("candid") % 11 / 11.0).alias("sgscore1"), (F.col("candid") % 13).cast("double").alias("ssdistnr"))
    return d.select(F.col("candid").alias("_id"), "objectId", candidate.alias("candidate"))


def objects(spark: SparkSession, sf_dir: str, named: Column | None = None) -> DataFrame:
    """Objects with their detections as a sorted array, under their own ids or those that ``named`` makes of them."""
    d = detections(spark, sf_dir)
    d = d if named is None else d.withColumn("objectId", named)
    point = F.struct("jd", F.col("candid").alias("candid"), F.col("mag").alias("magpsf"), F.col("mag_err").alias("sigmapsf"), "band", "programid", (1.0857362 / F.col("mag_err")).alias("snr"))
    return d.groupBy("objectId").agg(F.array_sort(F.collect_list(point)).alias("prv_candidates"), F.lit(1).alias("version"))


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of structs."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_returnflag"))).alias("lines"))
    return load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def sky_positions(spark: SparkSession, sf_dir: str, table: str, key: str, shift: float = 0.0) -> DataFrame:
    """(objectId, ra, dec) spread evenly over the sphere."""
    t = load(spark, sf_dir, table)
    frac = F.pmod(F.col(key) * F.lit(0.6180339887498949), F.lit(1.0))
    return t.select(F.col(key).alias("objectId"), F.pmod(F.col(key) * F.lit(137.50776405003785) + shift, F.lit(360.0)).alias("ra"), F.degrees(F.asin(2 * frac - 1)).alias("dec"))
