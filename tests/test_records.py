"""Alerts with all their images or none, survey scores, and features of odd candidates."""

import pytest
from pyspark.sql import functions as F

from skyloom import api
from skyloom.functions import photometry
from skyloom.operators import models, rules
from skyloom.sources import images, surveys


def test_alerts_without_images_stop_the_job(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "_id long, objectId string")
    c = spark.createDataFrame([(1, b"a", b"b"), (1, b"c", b"d"), (2, b"e", None)], "_id long, science binary, template binary")
    assert sorted(r["_id"] for r in surveys.all_with_cutouts(a, c).collect()) == [1, 2]
    with pytest.raises(Exception, match="no images for _id 2"):
        surveys.all_with_cutouts(a, c, images=("science", "template")).collect()
    with pytest.raises(Exception, match="no images for _id 2"):
        surveys.all_with_cutouts(a, c.where("_id = 1")).collect()
    assert surveys.all_with_cutouts(a.limit(0), c.limit(0)).count() == 0


def test_scores_of_surveys(spark):
    row = spark.createDataFrame([(0.9, None, 0.4, None), (None, 0.7, 0.4, 2.0), (None, None, None, None)], "rb float, drb double, sgscore1 float, distpsnr1 float")
    of = lambda survey, more=None: [[tuple(x) for x in r[0]] for r in row.select(rules.survey_classifications(survey, lambda n: F.col(n) if n != "reliability" else F.lit(0.5), more)).collect()]
    near = lambda got: [[(n, round(s, 6), d) for n, s, d in r] for r in got]
    assert near(of("ZTF")) == [[("rb", 0.9, None)], [("drb", 0.7, None), ("sgscore1", 0.4, 2.0)], []]
    assert near(of("DECAM")) == [[("reliability", 0.5, None)]] * 3
    assert [len(r) for r in of("ZTF", lambda n: F.lit(1.0))] == [7, 8, 6]
    assert [len(r) for r in of("LSST", lambda n: F.lit(1.0))] == [1, 1, 1]


def test_own_points(spark):
    kind = "c struct<jd:double,programid:int,candid:long,fid:int,isdiffpos:string,ssnamenr:string,magpsf:double,sigmapsf:double,magap:double,sigmagap:double,diffmaglim:double,ra:double,dec:double,drb:double>"
    rows = [((1.0, 1, 5, 1, "f", None, 18.0, 0.1, 18.0, 0.1, 20.0, 1.0, 2.0, None),), ((1.0, 1, 6, 9, None, None, 18.0, 0.1, None, None, 20.0, 1.0, 2.0, 0.5),), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, kind).select(photometry.ztf_own_point(F.col("c")).alias("p")).collect()]
    assert got[0].psfFlux < 0 < got[0].snr and got[0].band == "g" and got[0].drb is None and got[1] is None and got[2] is None


def test_features_of_alerts_without_points_are_no_input(spark):
    fields = [f for f in models.BOTH_FEATURES if f not in models.CURVE_FEATURES and f not in ("ncovhist", "ndethist")]
    one = ", ".join(f"'{f}', 1.0D" for f in fields)
    a = spark.range(3).selectExpr("id AS _id", f"named_struct({one}, 'ncovhist', 9, 'ndethist', 4) AS candidate")
    a = a.withColumns({c: F.lit(images.blank()) for c in ("cutoutScience", "cutoutTemplate", "cutoutDifference")})
    stats = spark.createDataFrame([(0, 10.0, 12.0, 11.5, 17.0, 19.0), (1, None, None, None, None, None)], "_id long, first_jd double, last_jd double, peak_jd double, peak_mag double, faintest_mag double")

    class Last:
        def predict(self, features, triplets):
            return features[:, 13] * 100 + features[:, 19] + features[:, 24] / 100

    got = models.scored(models.both_features(a, stats), {"m": (Last(), models.BOTH_FEATURES)})
    assert {r["_id"]: r.classifications and round(r.classifications.m, 6) for r in got.collect()} == {0: -200 + 5 + 0.19, 1: None, 2: None}


def test_gaps_of_tables_without_matches(spark):
    o = spark.range(4).selectExpr("id AS objectId")
    assert [tuple(r) for r in api.coverage_gaps(o, ["A", "A", "watchlist_1"]).collect()] == [("A", 4, 0)]
    assert api.coverage_gaps(o, []).count() == 0 and api.coverage_gaps(o.limit(0), ["A"]).count() == 0


def test_limits_of_odd_images(spark):
    d = spark.createDataFrame([([float(x) for x in range(100, 0, -1)],), ([5.0] * 4,), ([],), (None,)], "v array<float>")
    got = d.select(images.limits(F.col("v"), 0.05, 0.95).alias("e"), images.limits(F.col("v"), 0.0, 1.0).alias("whole"), images.clipped(F.col("v"), 0.05, 0.95).alias("c")).collect()
    assert [tuple(r.e) for r in got] == [(6.0, 96.0), (5.0, 5.0), (None, None), (None, None)]
    assert tuple(got[0].whole) == (0.0, 1.0) and got[0].c[0] == 1.0 and got[0].c[-1] == 0.0 and got[1].c == [0.5] * 4
    assert got[2].c == [] and got[3].c is None
