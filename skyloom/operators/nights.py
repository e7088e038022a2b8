"""Observing nights, from local noon to local noon, and statistics over them and over stream offsets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours that local standard time is behind UTC.
UTC_OFFSET = {"ZTF": -7, "WINTER": -7, "LSST": -3, "DECAM": -4}


def noon_jd(date: Column, survey: str) -> Column:
    """Julian date of local noon of a date, where its night begins."""
    return F.unix_date(date) + 2440587.5 + (12 - UTC_OFFSET[survey]) / 24.0


def night_of(jd: Column, survey: str) -> Column:
    """The date whose night [noon, next noon) a time lies in."""
    noon = 2440587.5 + (12 - UTC_OFFSET[survey]) / 24.0
    day = F.floor(jd - noon + 1e-6)  # perhaps one too late, as noon itself is rounded
    return F.date_from_unix_date(F.when(day + noon > jd, day - 1).otherwise(day).cast("int"))


def nightly_counts(alerts: DataFrame, survey: str, first: str, last: str, jd: str = "jd") -> DataFrame:
    """(night, n): alerts of each night of a range, nights without any counted as 0."""
    spark = alerts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("night"))
    inside = alerts.where((F.col(jd) >= noon_jd(F.lit(first).cast("date"), survey)) & (F.col(jd) < noon_jd(F.date_add(F.lit(last).cast("date"), 1), survey)))
    counts = inside.groupBy(night_of(F.col(jd), survey).alias("night")).agg(F.count("*").alias("n"))
    return days.join(counts, "night", "left").select("night", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def message_counts(offsets: DataFrame) -> DataFrame:
    """(topic, messages) from (topic, partition, low, high)."""
    return offsets.groupBy("topic").agg(F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("messages"))


def consumption(deltas: DataFrame) -> DataFrame:
    """(owner, consumed, lag, topics, credentials) from samples (owner, topic, credential, delta, high, committed)."""
    return deltas.groupBy("owner").agg(
        F.sum("delta").alias("consumed"), F.sum(F.greatest(F.col("high") - F.col("committed"), F.lit(0))).alias("lag"), F.count_distinct("topic").alias("topics"), F.count_distinct("credential").alias("credentials"),
    )


def owner_of(groups: DataFrame, owners: DataFrame) -> DataFrame:
    """Groups with the owner whose name they are or start with, followed by a hyphen; the longest name wins."""
    names = owners.select(F.col("owner"), F.length("owner").alias("__len"))
    cut = groups.select("*", F.explode(F.transform(F.split("group", "-"), lambda _, i: F.array_join(F.slice(F.split("group", "-"), 1, i + 1), "-"))).alias("__name"))
    met = cut.join(names, F.col("__name") == F.col("owner"))
    best = met.groupBy("group").agg(F.max_by("owner", "__len").alias("owner"))
    return groups.join(best, "group", "left")


def subscription(today: dt.date, days: int) -> list[dt.date]:
    """The dates that a stream reader follows: ``days`` before today, to today."""
    return [today - dt.timedelta(days=i) for i in range(days, -1, -1)]


def cache_seconds_of(age_days: Column) -> Column:
    """The same for a column of ages."""
    return F.when(age_days < 3, cache_seconds(0)).when(age_days <= 7, cache_seconds(7)).otherwise(cache_seconds(8))


def cache_seconds(age_days: int) -> int:
    """How long a night's count stays good."""
    return 1800 if age_days < 3 else 86400 if age_days <= 7 else 31536000
