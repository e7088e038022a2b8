"""Light-curve statistics: peaks, rising and fading slopes, by object and band.

Points are rows (object, jd, mag, mag_err, band); every figure is an aggregate or a window over one shuffle by object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import sky

from .series import finite

#: Days that a light curve must span not to be taken for a moving object, and a slope to be fitted.
LEAST_SPAN = 0.01


def prepared(points: DataFrame, key: str = "objectId", tie: str | None = None) -> DataFrame:
    """Finite points in time order, numbered by ``place``; points of the time and band right before are left out."""
    good = points.where(finite(F.col("jd")) & finite(F.col("mag").cast("double")) & finite(F.col("mag_err").cast("double")))
    order = ["jd", *([tie] if tie else ["band", "mag"])]
    w = Window.partitionBy(key).orderBy(*order)
    same = (F.lag("jd").over(w) == F.col("jd")) & (F.lag("band").over(w) == F.col("band"))
    out = good.withColumns({"__same": F.coalesce(same, F.lit(False)), "place": F.row_number().over(w)})
    return out.where("NOT __same").drop("__same")


def slope(x: Column, y: Column, err: Column) -> dict[str, Column]:
    """Sums from which ``fit`` makes a weighted least-squares line; x and y should be centred on one of the points."""
    return moments(x, y, err) | {"dt": F.max(x) - F.min(x)}


def moments(x: Column, y: Column, err: Column) -> dict[str, Column]:
    """The sums alone; each is one aggregate, so it may also run over a growing frame. Rows without errors add nothing."""
    w = F.try_divide(F.lit(1.0), err.cast("double") * err.cast("double"))
    y = y.cast("double")
    return {
        "n": F.count(x), "sw": F.sum(w), "swx": F.sum(w * x), "swy": F.sum(w * y), "swxx": F.sum(w * x * x), "swxy": F.sum(w * x * y), "swyy": F.sum(w * y * y),
        "bad": F.max((~F.coalesce((err > 0) & (err < float("inf")) & (w.cast("float") < float("inf")), err.isNull())).cast("int")),
    }


def fit(sums: Column) -> Column:
    """struct<rate, rate_error, red_chi2, nb_data, dt>, or null: fewer than two points, no span, or errors that aren't
    positive. Two points leave no freedom, so chi squared is NaN."""
    s = {k: sums[k] for k in ("n", "sw", "swx", "swy", "swxx", "swxy", "swyy", "dt", "bad")}
    xx = s["swxx"] - F.try_divide(s["swx"] * s["swx"], s["sw"])
    xy = s["swxy"] - F.try_divide(s["swx"] * s["swy"], s["sw"])
    yy = s["swyy"] - F.try_divide(s["swy"] * s["swy"], s["sw"])
    rate = F.try_divide(xy, xx)
    chi = F.when(s["n"] == 2, F.lit(float("nan"))).otherwise(F.try_divide(F.greatest(yy - rate * xy, F.lit(0.0)), s["n"] - 2))
    ok = (s["n"] > 1) & (s["bad"] == 0) & (xx >= 1e-10)
    return F.when(ok, F.struct(rate.cast("float").alias("rate"), F.sqrt(F.try_divide(F.lit(1.0), xx)).cast("float").alias("rate_error"), chi.cast("float").alias("red_chi2"), s["n"].cast("int").alias("nb_data"), s["dt"].cast("float").alias("dt")))


def band_stats(points: DataFrame, key: str = "objectId") -> DataFrame:
    """(object, band, peak, faintest, dt, rising, fading): the brightest point splits a band; both parts hold it.

    Of equally bright points the first counts. A part is fitted if it has two points, spans LEAST_SPAN days, and its
    brightest and faintest points differ by more than their errors.
    """
    w = Window.partitionBy(key, "band")
    rows = points.withColumn("__peak", F.min(F.struct("mag", "place", "jd", "mag_err")).over(w))
    x, y = F.col("jd") - F.col("__peak.jd"), F.col("mag").cast("double") - F.col("__peak.mag")

    def part(name: str, inside: Column) -> list[Column]:
        own = lambda c: F.when(inside, c)
        sums = slope(own(x), own(y), own(F.col("mag_err")))
        low, high = F.min(own(F.struct("mag", "place", "mag_err"))), F.max(own(F.struct(F.col("mag"), (-F.col("place")).alias("p"), F.col("mag_err"))))
        return [F.struct(*(c.alias(k) for k, c in sums.items()), (low["mag"] + low["mag_err"] < high["mag"] - high["mag_err"]).alias("apart")).alias(name)]

    peak = F.col("__peak")
    agg = rows.groupBy(key, "band").agg(
        F.min(F.struct("mag", "place", "jd", "mag_err")).alias("peak"), F.max(F.struct(F.col("mag"), (-F.col("place")).alias("p"), F.col("jd"), F.col("mag_err"))).alias("faintest"), (F.max("jd") - F.min("jd")).alias("dt"), F.min("jd").alias("first_jd"), F.max("jd").alias("last_jd"),
        *part("before", F.col("place") <= peak["place"]), *part("after", F.col("place") >= peak["place"]),
    )
    gated = lambda n: F.when((F.col(n)["dt"] > LEAST_SPAN) & F.col(n)["apart"], fit(F.col(n)))
    return agg.select(
        key, "band", F.col("peak.jd").alias("peak_jd"), F.col("peak.mag").alias("peak_mag"), F.col("peak.mag_err").alias("peak_mag_err"), F.col("faintest.jd").alias("faintest_jd"), F.col("faintest.mag").alias("faintest_mag"), F.col("faintest.mag_err").alias("faintest_mag_err"),
        F.col("dt").cast("float").alias("dt"), "first_jd", "last_jd", gated("before").alias("rising"), gated("after").alias("fading"),
    )


def as_of(points: DataFrame, asked: DataFrame, key: str = "objectId", id: str = "_id") -> DataFrame:
    """(id, band, and the figures of ``band_stats``): a band's figures as of each asked time, from its points up to then.

    ``points`` has (key, jd, mag, mag_err, band), ``asked`` (id, key, at). Both are put in order once, by object and band,
    and every figure follows from the row before: sums over the frame that grows, the brightest point so far, and sums
    that start anew with each new brightest point. So no point is copied to the times that ask, however many do; an asked
    time costs one row a band. What rises up to a brightest point is known when it comes and is carried on with it.
    Points as ``prepared`` would make them count: of equal times the brightest. Bands without a point by then have no row.
    """
    good = points.where(finite(F.col("jd")) & finite(F.col("mag").cast("double")) & finite(F.col("mag_err").cast("double")))
    seen = good.select(key, "band", F.col("jd").alias("t"), F.lit(0).alias("late"), "mag", "mag_err", F.lit(None).cast(asked.schema[id].dataType).alias(id))
    want = asked.where(F.col("at").isNotNull()).join(good.select(key, "band").distinct(), key)
    want = want.select(key, "band", F.col("at").alias("t"), F.lit(1).alias("late"), *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in ("mag", "mag_err")), id)
    order = ["t", "late", "mag"]
    w = Window.partitionBy(key, "band").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    point = F.col("late") == 0
    of_point = lambda c: F.when(point, c)
    again = point & (F.lag("t").over(w) == F.col("t")) & (F.lag("late").over(w) == 0)
    rows = seen.unionByName(want).withColumn("__again", F.coalesce(again, F.lit(False))).where("NOT __again")
    rows = rows.withColumns({"place": F.count("mag").over(run), "__t0": F.first(of_point(F.col("t")), True).over(run), "__m0": F.first("mag", True).over(run)})
    least, most = of_point(F.struct("mag", "place", "t", "mag_err")), of_point(F.struct(F.col("mag"), (-F.col("place")).alias("p"), F.col("t"), F.col("mag_err")))
    sums = moments(of_point(F.col("t") - F.col("__t0")), F.col("mag").cast("double") - F.col("__m0"), F.col("mag_err"))
    rows = rows.withColumns({"__faint": F.max(most).over(run), "__last": F.max(of_point(F.col("t"))).over(run), **{f"__{k}": c.over(run) for k, c in sums.items()}})

    def gated(prefix: str, dt: Column, bright: Column, faint: Column) -> Column:
        apart = bright["mag"] + bright["mag_err"] < faint["mag"] - faint["mag_err"]
        return F.when((dt > LEAST_SPAN) & apart, fit(F.struct(*(F.col(f"{prefix}{k}").alias(k) for k in sums), dt.alias("dt"))))

    risen = gated("__", F.col("t") - F.col("__t0"), least, F.col("__faint"))
    rows = rows.withColumn("__peak", F.min(of_point(F.struct("mag", "place", "t", "mag_err", risen.alias("rising")))).over(run)).drop(*(f"__{k}" for k in sums))
    rows = rows.withColumn("__part", F.col("__peak.place"))
    since = Window.partitionBy(key, "band", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.col("__peak")
    sums = moments(of_point(F.col("t") - peak["t"]), F.col("mag").cast("double") - peak["mag"], F.col("mag_err"))
    rows = rows.withColumns({"__low": F.max(most).over(since), **{f"__s{k}": c.over(since) for k, c in sums.items()}}).where((F.col("late") == 1) & (F.col("place") > 0))
    return rows.select(
        id, "band", peak["t"].alias("peak_jd"), peak["mag"].alias("peak_mag"), peak["mag_err"].alias("peak_mag_err"), F.col("__faint.t").alias("faintest_jd"), F.col("__faint.mag").alias("faintest_mag"), F.col("__faint.mag_err").alias("faintest_mag_err"),
        (F.col("__last") - F.col("__t0")).cast("float").alias("dt"), F.col("__t0").alias("first_jd"), F.col("__last").alias("last_jd"), peak["rising"].alias("rising"), gated("__s", F.col("__last") - peak["t"], peak, F.col("__low")).alias("fading"),
    )


def photstats(points: DataFrame, key: str = "objectId") -> DataFrame:
    """A row for each object: figures over all bands (ties: the first band by name), ``stationary`` if the light curve
    spans LEAST_SPAN days, and the bands' figures as a map."""
    return over_bands(band_stats(points, key), key)


def over_bands(bands: DataFrame, key: str) -> DataFrame:
    """``photstats`` from the figures of each band."""
    stats = F.struct(*(F.col(c) for c in ("peak_jd", "peak_mag", "peak_mag_err", "dt", "rising", "fading")))
    g = bands.groupBy(key).agg(
        F.min(F.struct("peak_mag", "band", "peak_jd", "peak_mag_err")).alias("peak"), F.max(F.struct(F.col("faintest_mag"), F.col("band"), F.col("faintest_jd"), F.col("faintest_mag_err"))).alias("faintest"),
        F.min("first_jd").alias("first_jd"), F.max("last_jd").alias("last_jd"), F.collect_list(F.struct("band", stats.alias("stats"))).alias("bands"),
    )
    return g.select(
        key, F.col("peak.peak_jd").alias("peak_jd"), F.col("peak.peak_mag").alias("peak_mag"), F.col("peak.peak_mag_err").alias("peak_mag_err"), F.col("peak.band").alias("peak_band"), F.col("faintest.faintest_jd").alias("faintest_jd"), F.col("faintest.faintest_mag").alias("faintest_mag"), F.col("faintest.band").alias("faintest_band"),
        "first_jd", "last_jd", (F.col("last_jd") - F.col("first_jd") > LEAST_SPAN).alias("stationary"), F.map_from_entries("bands").alias("bands"),
    )


def points_of(objects: DataFrame, arrays: list[str], key: str = "objectId", least_snr: float | None = None, at: str | None = None) -> DataFrame:
    """Points of one or several arrays of objects as rows, for the statistics; of some signal-to-noise or time if asked."""
    whole = F.concat(*(F.coalesce(F.transform(F.col(a), lambda p: F.struct(p["jd"].alias("jd"), p["magpsf"].cast("float").alias("mag"), p["sigmapsf"].cast("float").alias("mag_err"), p["band"].alias("band"), (p["snr"] if least_snr is not None else F.lit(None)).cast("float").alias("snr"))), F.array().cast("array<struct<jd:double,mag:float,mag_err:float,band:string,snr:float>>")) for a in arrays))
    rows = objects.select(key, *([at] if at else []), F.explode(whole).alias("p")).select(key, *([at] if at else []), "p.*").where("mag IS NOT NULL AND mag_err IS NOT NULL")
    if least_snr is not None:
        rows = rows.where(F.abs("snr") >= least_snr)
    return (rows.where(F.col("jd") <= F.col(at)).drop(at) if at else rows).drop("snr")


def drift(points: DataFrame, key: str = "objectId", tie: str = "candid") -> DataFrame:
    """Points (object, jd, band, ra, dec) with ``mjd``, their offsets in arcseconds from the object's centroid (``east``,
    ``north``, ``radial``), and of their band up to then the mean offset (``mean_east``, ``mean_north``) and the count.

    The centroid is the direction of the mean unit vector, so objects at a pole or across right ascension 0 have one.
    Points without finite position or time are left out. One shuffle, by object; windows by band sort within it.
    """
    good = points.where(finite(F.col("ra").cast("double")) & finite(F.col("dec").cast("double")) & finite(F.col("jd")))
    own = Window.partitionBy(key)
    a, d = F.radians("ra"), F.radians("dec")
    x, y, z = (F.avg(v).over(own) for v in (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)))
    placed = good.withColumns({"__x": x, "__y": y, "__z": z})
    ra0, dec0 = F.pmod(F.degrees(F.atan2("__y", "__x")), F.lit(360.0)), F.degrees(F.atan2(F.col("__z"), F.hypot("__x", "__y")))
    o = placed.withColumn("__o", sky.offsets(F.col("ra"), F.col("dec"), ra0, dec0)).select(*points.columns, (F.col("jd") - 2400000.5).alias("mjd"), "__o.*")
    so_far = Window.partitionBy(key, "band").orderBy("jd", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return o.withColumns({"mean_east": F.avg("east").over(so_far), "mean_north": F.avg("north").over(so_far), "so_far": F.count("*").over(so_far)})
