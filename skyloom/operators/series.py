"""Time series held as arrays of structs with a ``jd``: strictly increasing, finite, one point a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_value(value: Column, body) -> Column:
    """``body`` of a column that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(points: Column) -> Column:
    """Sorted by time, the first of points at one time kept, points without a finite time left out.

    A point's place breaks ties, so of two points at a time the earlier in the array stays.
    """
    numbered = F.transform(F.filter(points, lambda p: finite(p["jd"])), lambda p, i: F.struct((p["jd"] + 0.0).alias("jd"), i.alias("i"), p.alias("p")))
    new = lambda o: F.filter(o, lambda x, i: (i == 0) | (x["jd"] != F.get(o, i - 1)["jd"]))
    return F.transform(with_value(F.array_sort(numbered), new), lambda x: x["p"])


def merge(old: Column, new: Column) -> Column:
    """What is stored wins over what comes; either may be null."""
    return clean(F.concat(F.coalesce(old, F.slice(new, 1, 0)), F.coalesce(new, F.slice(old, 1, 0))))


def is_increasing(points: Column) -> Column:
    """Every time finite and later than the one before; true for empty series."""
    t = F.transform(points, lambda p: p["jd"])
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: b.isNull() | (a < b))
    return F.coalesce(F.forall(t, finite) & F.forall(pairs, lambda x: x), F.lit(True))


def update_of(old: Column, new: Column) -> Column:
    """struct<add, resort>: the points whose times are not stored yet, and whether one of them precedes what is stored."""
    known = F.coalesce(F.transform(old, lambda p: p["jd"]), F.array().cast("array<double>"))
    add = with_value(known, lambda k: F.filter(clean(new), lambda p: ~F.array_contains(k, p["jd"])))
    return F.struct(add.alias("add"), F.coalesce(F.array_min(F.transform(add, lambda p: p["jd"])) < F.array_max(known), F.lit(False)).alias("resort"))


def trailing(points: Column, at: Column, days: float) -> Column:
    """Points up to a time and less than ``days`` before it."""
    return F.filter(points, lambda p: (at - p["jd"] < days) & (p["jd"] <= at))


def up_to(points: Column, at: Column, least_snr: float | None = None) -> Column:
    """All points up to a time, of some signal-to-noise if that is asked for."""
    return F.filter(points, lambda p: (p["jd"] <= at) & ((F.abs(p["snr"]) >= least_snr) if least_snr is not None else F.lit(True)))


def split_detections(points: Column) -> tuple[Column, Column]:
    return F.filter(points, lambda p: p["magpsf"].isNotNull()), F.filter(points, lambda p: p["magpsf"].isNull())


def merged_by_time(*series: Column) -> Column:
    """Several series of one type as one, sorted by time; nothing is left out."""
    return F.array_sort(F.concat(*series), lambda a, b: F.when(a["jd"] < b["jd"], -1).when(a["jd"] > b["jd"], 1).otherwise(0))


def first_of_time(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The flat form of ``clean``: of rows with equal keys and time, that of least ``order``. One shuffle by key."""
    w = Window.partitionBy(*keys, "jd").orderBy(order)
    return points.where(finite(F.col("jd"))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_repeats(points: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows sorted by time within a key, without those whose time and band equal those of the row right before."""
    w = Window.partitionBy(key).orderBy("jd", tie)
    same = (F.lag("jd").over(w) == F.col("jd")) & F.lag("band").over(w).eqNullSafe(F.col("band"))
    return points.withColumn("__same", F.coalesce(same, F.lit(False))).where("NOT __same").drop("__same")


def fast_pairs(points: DataFrame, key: str, least_days: float = 0.02, least_rate: float = 0.2) -> DataFrame:
    """Rows that faded against the point before in the same band, at ``least_rate`` magnitudes a day or faster."""
    w = Window.partitionBy(key, "band").orderBy("jd")
    dt, dm = F.col("jd") - F.lag("jd").over(w), F.col("mag") - F.lag("mag").over(w)
    return points.withColumns({"dt": dt, "rate": F.try_divide(dm, dt)}).where((F.col("dt") >= least_days) & (F.col("rate") >= least_rate))


def deltas(samples: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """What a counter grew by since the sample before; nothing for the first, and nothing after a reset."""
    w = Window.partitionBy(*key).orderBy(order)
    return samples.withColumn("delta", F.greatest(F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)), F.lit(0)))
