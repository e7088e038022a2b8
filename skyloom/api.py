"""What a user can ask of stored tables: find, count, cone search, pipelines, alerts, objects and statistics."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import photometry, sky
from skyloom.operators import crossmatch
from skyloom.plans import pipeline
from skyloom.sources import tables

#: Tables that no query may name.
PROTECTED = ("users", "filters", "user_devices", "tokens")
_SAFE = re.compile(r"[A-Za-z0-9_]+")
#: What object ids of each survey look like.
_ZTF_ID = re.compile(r"ZTF(\d{2}[a-z]{0,7})?", re.I)


class QueryError(ValueError):
    """A question that may not or can't be asked."""


@dataclass
class Store:
    """Tables by name. Names are checked before anything is read."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    admin: bool = False

    def accessible(self, name: str) -> bool:
        return bool(_SAFE.fullmatch(name)) and not name.startswith("system") and (self.admin or name not in PROTECTED)

    def table(self, name: str) -> DataFrame:
        if not self.accessible(name) or name not in self.tables:
            raise QueryError(f"no catalogue {name}")
        return self.tables[name]

    def catalogs(self) -> list[str]:
        return sorted(n for n in self.tables if self.accessible(n))

    def find(self, name: str, query: dict | None = None, projection: dict | None = None, sort: Any = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        df = self.table(name)
        df = df.where(pipeline.match(pipeline.scope_of(df), query)) if query else df
        if sort:
            df = pipeline.sort(df, {k: sort_order(v) for k, v in sort.items()})
        df = df.offset(skip) if skip else df
        df = df.limit(limit) if limit else df
        return pipeline.project(df, projection) if projection else df

    def count(self, name: str, query: dict | None = None) -> int:
        return self.find(name, query).count()

    def estimated_count(self, name: str) -> int:
        """From the files' footers: no column is read."""
        return self.table(name).select().count()

    def pipeline(self, name: str, stages: str | list) -> DataFrame:
        return pipeline.run(self.table(name), stages, {n: self.tables[n] for n in self.catalogs()})

    def sample(self, name: str, n: int) -> DataFrame:
        if not 1 <= n <= 1000:
            raise QueryError("a sample has 1 to 1000 rows")
        return self.table(name).orderBy(F.rand()).limit(n)

    def cone_search(self, name: str, points: dict[str, tuple[float, float]], radius: float, unit: str = "arcsec", query: dict | None = None, projection: dict | None = None, limit: int | None = None) -> DataFrame:
        """(name, matches): for each named point the rows around it, nearest first, or an empty array."""
        if len(points) > 1000:
            raise QueryError("at most 1000 points")
        df = self.find(name, query)
        asked = self.spark.createDataFrame([(k, float(ra), float(dec)) for k, (ra, dec) in points.items()], "name string, ra double, dec double")
        near = crossmatch.cone_search(tables.around(df, asked, sky.to_arcsec(radius, unit)), asked, radius, unit)
        if limit:  # before anything is gathered
            w = Window.partitionBy("name").orderBy("distance_arcsec", F.xxhash64(*df.columns))
            near = near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
        kept = pipeline.project(df.limit(0), projection).columns if projection else df.columns
        rows = near.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("distance_arcsec", *kept))).alias("matches"))
        out = asked.select("name").join(rows, "name", "left")
        return out.withColumn("matches", F.coalesce("matches", F.array().cast(rows.schema["matches"].dataType)))

    def schema(self, name: str) -> str:
        return self.table(name).schema.json()

    def stats(self, name: str) -> dict[str, Any]:
        df = self.table(name)
        files = df.inputFiles()
        sizes = self.spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0  # listed, not read
        return {"count": df.select().count(), "columns": len(df.columns), "files": len(files), "bytes": sizes}


def sort_order(x: Any) -> int:
    """Ascending or descending, by name or number."""
    out = {"1": 1, "-1": -1, "asc": 1, "ascending": 1, "desc": -1, "descending": -1}.get(str(x).strip().lower())
    if out is None:
        raise QueryError(f"no sort order {x}")
    return out


def survey_of(object_id: str) -> tuple[str, str]:
    """(survey, prefix in the survey's own spelling) that an object id, or the start of one, belongs to."""
    text = object_id.strip()
    if text and "ZTF".startswith(text.upper()) or _ZTF_ID.fullmatch(text):
        return "ZTF", text[:3].upper() + text[3:].lower()
    if text.lower().startswith("sso") and (text[3:] == "" or text[3:].isdigit()):
        return "LSST", "sso" + text[3:]
    if text.isdigit():
        return "LSST", text
    raise QueryError(f"no survey has ids like {object_id}")


def surveys_of(ids: Column) -> Column:
    """struct<survey, id> of a column of ids, as ``survey_of`` tells them; both are null where no survey has such ids."""
    t = F.trim(ids)
    ztf = (t != "") & (F.lit("ZTF").startswith(F.upper(t)) | t.rlike("(?i)^ZTF([0-9]{2}[a-z]{0,7})?$"))
    sso, number = t.rlike("(?i)^sso[0-9]*$"), t.rlike("^[0-9]+$")
    spelled = F.when(ztf, F.concat(F.upper(F.substring(t, 1, 3)), F.lower(F.substr(t, F.lit(4))))).when(sso, F.concat(F.lit("sso"), F.substr(t, F.lit(4)))).when(number, t)
    return F.struct(F.when(ztf, "ZTF").when(sso | number, "LSST").alias("survey"), spelled.alias("id"))


def object_page(alerts: DataFrame, objects: DataFrame, others: dict[str, DataFrame], object_id: str, survey: str = "ZTF") -> DataFrame:
    """One object with its alerts' ids in order of time and its nearest counterparts, looked up at the time of reading.

    ``counterparts`` lists (survey, objectId, distance_arcsec), nearest first. An id that isn't stored gives no row.
    """
    one = objects.where(F.col("objectId") == object_id)
    seen = alerts.where(F.col("objectId") == object_id).groupBy("objectId").agg(F.array_sort(F.collect_list(F.struct(F.col("candidate.jd").alias("jd"), "_id"))).alias("alerts"))
    out = one.join(seen, "objectId", "left")
    met = None
    for name, other in others.items():
        near = crossmatch.nearest(one, other.withColumnRenamed("objectId", "match_id"), max(crossmatch.UNCERTAINTY[survey], crossmatch.UNCERTAINTY[name]), covers=crossmatch.COVERAGE[name])
        near = near.select("objectId", F.struct("distance_arcsec", F.lit(name).alias("survey"), F.col("match_id").alias("objectId")).alias("met"))
        met = near if met is None else met.unionByName(near)
    if met is not None:
        out = out.join(met.groupBy("objectId").agg(F.array_sort(F.collect_list("met")).alias("counterparts")), "objectId", "left")
    return out


#: Rows that an answer may bring to the driver; larger results belong in a table.
MOST_ROWS = 100_000


def rows_within(df: DataFrame, seconds: float, most: int = MOST_ROWS) -> list:
    """The rows of a result, or an error if they take longer, when the jobs that still run are cancelled, or if there are
    more of them than ``most``."""
    context = df.sparkSession.sparkContext
    tag, late = f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = df.limit(most + 1).collect()
    except Exception as e:
        if late.is_set():
            raise QueryError(f"took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if len(rows) > most:
        raise QueryError(f"more than {most} rows; write them to a table")
    return rows


def alert_search(alerts: DataFrame, object_id: str | None = None, cone: tuple[float, float, float] | None = None, window: tuple[float, float] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, flags: dict[str, bool] | None = None, isdiffpos: bool | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """Alerts of one object, in one cone (ra, dec, arcseconds) or in one window of a day at most, in order of id."""
    if object_id is None and cone is None and window is None:
        raise QueryError("name an object, a cone or a window")
    if object_id is not None and cone is not None:
        raise QueryError("name an object or a cone")
    if window is not None and not 0 < window[1] - window[0] <= 1 and object_id is None and cone is None:
        raise QueryError("a window lasts a day at most")
    if not 1 <= limit <= 100_000:
        raise QueryError("limit is 1 to 100000")
    out = alerts
    if object_id is not None:
        out = tables.with_key(out, "objectId", object_id)
    if cone is not None:
        ra, dec, radius = cone
        cells = tables.in_cones(alerts.schema, "candidate.ra", [(ra, dec, radius / 3600)])
        out = out if cells is None else out.where(cells)
        out = out.where(sky.near_box(F.col("candidate.ra"), F.col("candidate.dec"), ra, dec, radius / 3600) & (sky.separation_arcsec(F.col("candidate.ra"), F.col("candidate.dec"), F.lit(ra), F.lit(dec)) <= radius))
    if window is not None:
        out = out.where((F.col("candidate.jd") >= window[0]) & (F.col("candidate.jd") <= window[1]))
    for name, (low, high) in (ranges or {}).items():
        out = out.where(F.col(name) >= low) if low is not None else out
        out = out.where(F.col(name) <= high) if high is not None else out
    for name, value in (flags or {}).items():
        out = out.where(F.col(f"properties.{name}") == value)
    if isdiffpos is not None:
        out = out.where(F.col("candidate.isdiffpos") == isdiffpos)
    return out.orderBy("_id").offset(skip).limit(limit)


def representative(alerts: DataFrame, which: str = "brightest", band: str | None = None) -> DataFrame:
    """One alert for each object: the first, last, brightest or faintest; ties go to the smaller id."""
    rows = alerts.where(F.col("candidate.band") == band) if band else alerts
    order = {"first": F.col("candidate.jd"), "last": -F.col("candidate.jd"), "brightest": F.col("candidate.magpsf"), "faintest": -F.col("candidate.magpsf")}[which]
    best = rows.where(order.isNotNull()).groupBy("objectId").agg(F.min_by(F.struct(*rows.columns), F.struct(order.alias("o"), F.col("_id").alias("i"))).alias("row"))
    return best.select("row.*")


def history(alerts: DataFrame) -> DataFrame:
    """(objectId, classifications): scores of each object's alerts in order of time."""
    return alerts.where(F.col("classifications").isNotNull()).groupBy("objectId").agg(F.array_sort(F.collect_list(F.struct(F.col("candidate.jd").alias("jd"), F.col("_id").alias("candid"), "classifications"))).alias("history"))


def missing_catalogs(row: dict, configured: list[str]) -> list[str]:
    """Configured catalogues that an object's matches lack."""
    return sorted(set(configured) - set(row.get("cross_matches") or {}))


def coverage_gaps(objects: DataFrame, configured: list[str], key: str = "objectId", watchlists: str = "watchlist_") -> DataFrame:
    """(catalogue, objects, example): configured catalogues that stored objects were never matched with, how many objects
    those are, and the least of their ids. A catalogue without matches has an empty array, so null means never; tables
    of watchlists aren't expected. One scan of the matches, a count for each catalogue."""
    wanted = [c for c in dict.fromkeys(configured) if not c.startswith(watchlists)]
    held = objects.schema["cross_matches"].dataType.names if "cross_matches" in objects.columns else []
    absent = F.array_compact(F.array(*(F.when(F.col(f"cross_matches.`{c}`").isNull() if c in held else F.lit(True), F.lit(c)) for c in wanted)).cast("array<string>"))
    return objects.select(key, F.explode(absent).alias("catalogue")).groupBy("catalogue").agg(F.count("*").alias("objects"), F.min(key).alias("example"))


def object_search(spark: SparkSession, objects: dict[str, DataFrame], text: str, limit: int = 10) -> DataFrame:
    """Objects whose id starts like the text, in order of id."""
    survey, prefix = survey_of(text)
    return objects[survey].where(F.col("objectId").startswith(prefix)).select("objectId", F.lit(survey).alias("survey")).orderBy("objectId").limit(limit)


def objects_near(objects: dict[str, DataFrame], ra: float, dec: float, radius: float, limit: int = 10) -> DataFrame:
    """Objects of all surveys around a position, nearest first."""
    found = None
    for survey, df in sorted(objects.items()):
        cells = tables.in_cones(df.schema, "ra", [(ra, dec, radius / 3600)])
        df = df if cells is None else df.where(cells)
        d = sky.separation_arcsec(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec))
        here = df.where(sky.near_box(F.col("ra"), F.col("dec"), ra, dec, radius / 3600)).select("objectId", F.lit(survey).alias("survey"), "ra", "dec", d.alias("distance_arcsec")).where(F.col("distance_arcsec") <= radius)
        found = here if found is None else found.unionByName(here)
    return found.orderBy("distance_arcsec", "survey", "objectId").limit(limit)


def rescaled(table: DataFrame, array: str, zp: float = photometry.LSST_ZP_NJY) -> DataFrame:
    """A stored table with signal-to-noise, limits and, above the least signal-to-noise, magnitudes of an array recomputed
    from its fluxes; where points have aperture fluxes, or chi squared and its number of points, signal-to-noise and
    magnitude of the aperture and the reduced chi squared too. Doing it twice changes nothing."""
    fields = table.schema[array].dataType.elementType.names

    def one(p):
        snr = F.try_divide(F.abs(p["psfFlux"]), p["psfFluxErr"])
        m = photometry.flux_to_mag(F.abs(p["psfFlux"]), p["psfFluxErr"], zp)
        good = F.coalesce(snr > photometry.SNT, F.lit(False))
        new = {"snr": snr.cast("float"), "magpsf": F.when(good, m["mag"]), "sigmapsf": F.when(good, m["err"]), "diffmaglim": photometry.flux_err_to_limit(p["psfFluxErr"], zp)}
        if {"apFlux", "apFluxErr"} <= set(fields):
            ap, ap_snr = photometry.flux_to_mag(F.abs(p["apFlux"]), p["apFluxErr"], zp), F.try_divide(F.abs(p["apFlux"]), p["apFluxErr"])
            seen = F.coalesce(ap_snr > photometry.SNT, F.lit(False))
            new |= {"snr_ap": ap_snr.cast("float"), "magap": F.when(seen, ap["mag"]), "sigmagap": F.when(seen, ap["err"])}
        if {"psfChi2", "psfNdata"} <= set(fields):
            new["chipsf"] = F.try_divide(p["psfChi2"].cast("double"), p["psfNdata"].cast("double")).cast("float")
        return reduce(lambda q, kv: q.withField(*kv), new.items(), p)

    return table.withColumn(array, F.transform(array, one))


def tally(checked: DataFrame, ok: str, reason: str) -> DataFrame:
    """(outcome, n): how many rows pass, fail or are skipped, by reason."""
    return checked.groupBy(F.when(F.col(ok), "ok").otherwise(F.coalesce(reason, F.lit("failed"))).alias("outcome")).agg(F.count("*").alias("n"))
