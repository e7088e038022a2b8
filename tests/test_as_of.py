"""Statistics as of each alert, in one pass, against the statistics of each prefix."""

import math
import random

from pyspark.sql import functions as F

from skyloom.operators import enrich, lightcurve


def flat(r):
    slope = lambda s: None if s is None else tuple("nan" if math.isnan(x) else round(x, 3) for x in (s.rate, s.rate_error, s.red_chi2)) + (s.nb_data,)
    return (r._id, r.band, round(r.peak_jd, 6), round(r.peak_mag, 4), round(r.faintest_jd, 6), round(r.faintest_mag, 4), round(r.dt, 4), round(r.first_jd, 6), round(r.last_jd, 6), slope(r.rising), slope(r.fading))


def test_one_pass_equals_every_prefix(spark):
    rng = random.Random(8)
    points, asked = [], []
    for o in range(6):
        for _ in range(rng.randrange(1, 40)):
            t = rng.choice([rng.uniform(0, 30), float(rng.randrange(8))])
            mag = rng.choice([rng.uniform(17, 20), 18.0, 19.5])
            points.append((f"o{o}", t, mag, rng.choice([0.05, 0.3]), rng.choice("gri")))
        points += [(f"o{o}", None, 18.0, 0.1, "g"), (f"o{o}", 3.0, float("nan"), 0.1, "g"), (f"o{o}", 2.0, 18.0, None, "r"), (f"o{o}", float("inf"), 18.0, 0.1, "g")]
        asked += [(o * 100 + k, f"o{o}", rng.choice([rng.uniform(-2, 32), float(rng.randrange(8))])) for k in range(25)]
    asked += [(900, "unknown", 5.0), (901, "o1", None), (902, None, 5.0)]
    p = spark.createDataFrame(points, "objectId string, jd double, mag double, mag_err double, band string")
    a = spark.createDataFrame(asked, "_id long, objectId string, at double")
    got = lightcurve.as_of(p, a).collect()
    each = p.join(a, "objectId").where("jd <= at").select("_id", "jd", "mag", "mag_err", "band")
    want = lightcurve.band_stats(lightcurve.prepared(each, "_id"), "_id").collect()
    assert sorted(map(flat, got), key=repr) == sorted(map(flat, want), key=repr) and len(want) > 300
    assert any(r.rising for r in want) and any(r.fading for r in want)
    assert lightcurve.as_of(p.where("false"), a).count() == lightcurve.as_of(p, a.where("false")).count() == 0


def test_slopes_keep_their_digits_far_from_the_first_point(spark):
    # a late pair: raw sums of products over years would leave few digits
    points = [("o", 0.0, 19.0, 1e-3, "g")] + [("o", 4000.0 + k / 50, 15.0 + 0.25 * k / 50, 1e-3, "g") for k in range(20)]
    p = spark.createDataFrame(points, "objectId string, jd double, mag double, mag_err double, band string")
    a = spark.createDataFrame([(1, "o", 5000.0)], "_id long, objectId string, at double")
    (now,), (whole,) = lightcurve.as_of(p, a).collect(), lightcurve.band_stats(lightcurve.prepared(p)).collect()
    for r in (now, whole):
        assert abs(r.fading.rate - 0.25) < 1e-6 and r.fading.red_chi2 < 1e-6 and r.fading.nb_data == 20


def test_many_alerts_of_one_object_are_linear(spark):
    n = 30_000
    objects = spark.range(n).select(F.lit("o").alias("objectId"), F.struct(F.col("id").cast("double").alias("jd"), (18 + F.sin("id")).alias("magpsf"), F.lit(0.1).alias("sigmapsf"), F.lit("g").alias("band"), F.lit(9.0).alias("snr")).alias("p")).groupBy("objectId").agg(F.array_sort(F.collect_list("p")).alias("prv_candidates"))
    alerts = spark.range(n).select(F.col("id").alias("_id"), F.lit("o").alias("objectId"), F.struct(F.col("id").cast("double").alias("jd")).alias("candidate"))
    out = enrich.plain_properties(alerts, objects).select("_id", "properties.photstats.bands.g.peak_mag", "properties.photstats.last_jd").agg(F.count("peak_mag"), F.sum(F.col("last_jd") - F.col("_id"))).first()
    assert tuple(out) == (n, 0.0)


def test_forced_points_need_their_status(spark):
    kind = "array<struct<jd:double,magpsf:double,sigmapsf:double,band:string,snr:double,procstatus:string,magzpsci:double,forcediffimfluxunc:double>>"
    rows = [("a", [(1.0, 18.0, 0.1, "g", 9.0, "0", 26.0, 1.0), (2.0, 17.0, 0.1, "g", 9.0, "61", 26.0, 1.0), (3.0, 16.0, 0.1, "g", 9.0, None, 26.0, 1.0), (4.0, 15.0, 0.1, "g", 9.0, "0", None, 1.0), (5.0, 14.0, 0.1, "g", 9.0, "0", 26.0, -99999.0), (6.0, 13.0, 0.1, "g", 2.0, "0", 26.0, 1.0)]), ("b", None)]
    objects = spark.createDataFrame(rows, f"objectId string, fp_hists {kind}")
    assert [(r.objectId, r.jd) for r in enrich.object_points(objects, {"fp_hists": enrich.LEAST_SNR}).collect()] == [("a", 1.0)]
