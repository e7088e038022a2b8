"""Enrichment: properties of alerts from their objects' histories, the same for stored tables and micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lightcurve, rules, series

LEAST_SNR = 3.0


def forced_points(points: Column, zp: float = 23.9) -> Column:
    """Forced photometry that may be used: status "0" and a flux that is no sentinel, at one zero point."""
    scale = lambda p: F.power(F.lit(10.0), (F.lit(zp) - p["magzpsci"].cast("double")) / 2.5)
    usable = F.filter(points, lambda p: F.coalesce((p["procstatus"] == "0") & (p["forcediffimflux"] != -99999.0) & (p["forcediffimfluxunc"] != -99999.0) & ~F.isnan(p["forcediffimflux"].cast("double")) & (p["forcediffimfluxunc"] > 0), F.lit(False)))
    return F.transform(usable, lambda p: F.struct(p["jd"].alias("jd"), (p["forcediffimflux"] * scale(p)).cast("float").alias("psfFlux"), (p["forcediffimfluxunc"] * scale(p)).cast("float").alias("psfFluxErr"), (p["forcediffimflux"] / p["forcediffimfluxunc"]).cast("float").alias("snr")))


def usable(p: Column, fields: list[str]) -> Column:
    """Whether a stored forced point may be used: status "0", and a zero point and an error that are no sentinels. Points
    of surveys that have no such fields may."""
    if "procstatus" not in fields:
        return F.lit(True)
    sound = p["procstatus"] == "0"
    if "magzpsci" in fields:
        sound = sound & p["magzpsci"].isNotNull()
    for name in ("forcediffimfluxunc", "psfFluxErr"):
        if name in fields:
            sound = sound & (p[name] != -99999.0) & ~F.isnan(p[name].cast("double"))
    return F.coalesce(sound, F.lit(False))


def object_points(objects: DataFrame, arrays: dict[str, float | None], key: str = "objectId") -> DataFrame:
    """(key, jd, mag, mag_err, band): the points of the objects' arrays as rows, each one once; an array may ask for a
    signal-to-noise."""
    parts = []
    for a, least in arrays.items():
        fields = objects.schema[a].dataType.elementType.names
        sound = F.filter(F.col(a), lambda p: usable(p, fields) & ((F.abs(p["snr"]) >= least) if least is not None else F.lit(True)))  # noqa: B023
        parts.append(F.coalesce(F.transform(sound, lambda p: F.struct(p["jd"].alias("jd"), p["magpsf"].cast("float").alias("mag"), p["sigmapsf"].cast("float").alias("mag_err"), p["band"].alias("band"))), F.array().cast("array<struct<jd:double,mag:float,mag_err:float,band:string>>")))
    return objects.select(key, F.explode(F.concat(*parts)).alias("p")).select(key, "p.*").where("mag IS NOT NULL AND mag_err IS NOT NULL")


def alert_bands(alerts: DataFrame, objects: DataFrame, arrays: dict[str, float | None]) -> DataFrame:
    """(_id, band, figures): what each band's points of the alert's object say as of the alert."""
    asked = alerts.select("_id", "objectId", F.col("candidate.jd").alias("at"))
    return lightcurve.as_of(object_points(objects.join(asked.select("objectId").distinct(), "objectId", "left_semi"), arrays), asked)


def properties(alerts: DataFrame, objects: DataFrame, arrays: dict[str, float | None], flags: Callable[[DataFrame], dict[str, Column]] | None = None) -> DataFrame:
    """(_id, properties): flags of the candidate, whether the light curve is stationary, and its statistics.

    An object's points are put in order once, whatever the number of its alerts. An alert without usable points isn't
    stationary and has no statistics.
    """
    stats = lightcurve.over_bands(alert_bands(alerts, objects, arrays), "_id")
    names = [c for c in stats.columns if c != "_id"]
    joined = alerts.join(stats.select("_id", F.struct(*names).alias("__stats")), "_id", "left")
    made = flags(joined) if flags else {}
    return joined.select("_id", F.struct(*(c.alias(k) for k, c in made.items()), F.coalesce("__stats.stationary", F.lit(False)).alias("stationary"), F.col("__stats").alias("photstats")).alias("properties"))


def ztf_properties(alerts: DataFrame, objects: DataFrame) -> DataFrame:
    def flags(df: DataFrame) -> dict[str, Column]:
        have = df.schema["candidate"].dataType.names
        return rules.ztf_flags(lambda n: F.col(f"candidate.{n}") if n in have else F.lit(None).cast("double"))

    return properties(alerts, objects, _arrays(objects), flags)


def lsst_properties(alerts: DataFrame, objects: DataFrame, footprint: Column | None = None) -> DataFrame:
    """Properties of LSST alerts: flags from the candidate's neighbours, and light-curve statistics of both arrays."""

    def flags(df: DataFrame) -> dict[str, Column]:
        have = df.schema["candidate"].dataType.names
        neighbours = F.col("candidate.neighbours") if "neighbours" in have else F.lit(None).cast("array<struct<distance_arcsec:double,score:double,mag_white:double>>")
        return rules.lsst_flags(neighbours, F.lit(True) if footprint is None else footprint, F.col("candidate.ssObjectId") if "ssObjectId" in have else F.lit(None).cast("long"))

    return properties(alerts, objects, _arrays(objects), flags)


def plain_properties(alerts: DataFrame, objects: DataFrame) -> DataFrame:
    """Properties of surveys without rules of their own, DECam and WINTER: stationarity and statistics."""
    return properties(alerts, objects, _arrays(objects))


def _arrays(objects: DataFrame) -> dict[str, float | None]:
    return {a: n for a, n in (("prv_candidates", None), ("fp_hists", LEAST_SNR)) if a in objects.columns}


def multisurvey_photstats(alerts: DataFrame, objects: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(_id, photstats): statistics over the points of an alert's object and of the objects that its aliases name.

    ``alerts`` has ``aliases``, a struct of arrays of ids by survey, of which the first counts. A band's name gets its
    survey's, so equal filters of two surveys stay apart. As figures are of bands, each survey's come from its own pass.
    """
    parts = [alert_bands(alerts, objects, _arrays(objects))]
    for name, other in others.items():
        named = alerts.withColumn("objectId", F.get(F.col(f"aliases.{name}"), F.lit(0))).where("objectId IS NOT NULL")
        parts.append(alert_bands(named, other, _arrays(other)).withColumn("band", F.concat(F.lit(name.lower()), F.col("band"))))
    stats = lightcurve.over_bands(reduce(DataFrame.unionByName, parts), "_id")
    return stats.select("_id", F.struct(*(c for c in stats.columns if c != "_id")).alias("photstats"))


def display_curve(points: DataFrame) -> DataFrame:
    """Points for display: detections above the least signal-to-noise, and limits where there is no magnitude."""
    seen = points.where(series.finite(F.col("jd")) & F.col("mag").isNotNull() & (F.col("snr") > LEAST_SNR)).withColumn("kind", F.lit("detection"))
    limits = points.where(series.finite(F.col("jd")) & F.col("mag").isNull() & F.col("diffmaglim").isNotNull()).withColumn("kind", F.lit("limit"))
    return seen.unionByName(limits)
