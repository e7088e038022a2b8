"""Cones as ranges, tables laid out by sky and by key, and tables that are replaced as one step."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import coverage, crossmatch
from skyloom.sources import tables


def numbers(face, x, y, depth):
    return (face << (2 * depth)) | sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(depth))


def test_centres_lie_in_their_cells(spark):
    r, rows = random.Random(1), []
    for depth in (0, 1, 3, 7, 11):
        n = 1 << depth
        for _ in range(200):
            f, x, y = r.randrange(12), r.randrange(n), r.randrange(n)
            rows.append((depth, numbers(f, x, y, depth), *coverage.place(f, (x + 0.5) / n, (y + 0.5) / n)))
    df = spark.createDataFrame(rows, "depth int, cell long, ra double, dec double")
    for depth in (0, 1, 3, 7, 11):
        got = df.where(F.col("depth") == depth).withColumn("at", coverage.pixel(F.col("ra"), F.col("dec"), depth))
        assert got.where("at <> cell").count() == 0


def test_cones_hold_all_that_is_near(spark):
    """Positions near and around cones at the poles, at right ascension 0 and elsewhere, of widths from arcseconds on."""
    r, rows, cones = random.Random(2), [], []
    for i, (ra, dec) in enumerate([(0, 90), (77, -90), (0, 0), (359.9999, 41.81), (45, 41.8103), (180, -41.9), (123.4, 66), (315, 0.0001), (90, 89.5)]):
        for width in (0.0003, 0.05, 2.0, 30.0, 100.0):
            cones.append((len(cones), float(ra), float(dec), width))
            reach = width / max(0.01, abs(math.cos(math.radians(dec))))
            for _ in range(60):
                rows.append((cones[-1][0], (ra + r.uniform(-2, 2) * reach) % 360, max(-90.0, min(90.0, dec + r.uniform(-1, 1) * width))))
    df = spark.createDataFrame(rows, "cone int, ra double, dec double").withColumn("cell", coverage.pixel(F.col("ra"), F.col("dec"), 11))
    c = spark.createDataFrame(cones, "cone int, ra0 double, dec0 double, width double")
    spans = spark.createDataFrame([(i, *span) for i, ra, dec, w in cones for span in coverage.cone(ra, dec, w, 11)], "cone int, low long, high long")
    assert spans.groupBy("cone").count().agg(F.max("count")).first()[0] <= 60
    near = df.join(c, "cone").where(sky.separation(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0")) <= F.col("width"))
    assert near.count() > 1000
    missed = near.join(spans.withColumnRenamed("cone", "c"), (F.col("cone") == F.col("c")) & (F.col("cell") >= F.col("low")) & (F.col("cell") < F.col("high")), "left_anti")
    assert missed.count() == 0


@pytest.fixture(scope="module")
def by_sky(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables") / "sky")
    t = spark.range(5000).select("id", F.pmod(F.col("id") * 137.50776405, F.lit(360.0)).alias("ra"), F.degrees(F.asin(2 * F.pmod(F.col("id") * 0.7548776662, F.lit(1.0)) - 1)).alias("dec"))
    crowd = spark.range(3000).select((F.col("id") + 5000).alias("id"), (10 + F.col("id") * 1e-7).alias("ra"), F.lit(20.0).alias("dec"))
    odd = spark.createDataFrame([(9001, None, 1.0), (9002, float("nan"), 2.0)], "id long, ra double, dec double")
    whole = t.union(crowd).union(odd)
    tables.write_by_sky(whole, folder, depth=2, files=16)
    return spark.read.parquet(folder), whole


def files(df):
    """How many files the plan's scan takes, and how many the table has."""
    df = df.select("*")  # a plan that has not run before: its counters start at nothing
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    leaf = leaf.finalPhysicalPlan() if "Adaptive" in leaf.getClass().getSimpleName() else leaf
    return leaf.collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_cones_read_few_files(spark, by_sky):
    stored, whole = by_sky
    assert stored.count() == whole.count()
    every = files(stored.select("id"))
    for ra, dec, arcsec in ((10, 20, 3600), (0, 0, 7200), (200, 89.9, 36000), (10.0001, 20, 0.5)):
        got = tables.cone(stored, ra, dec, arcsec)
        want = whole.where(sky.separation_arcsec(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec))) <= arcsec)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
        assert files(got.select("id")) <= every / 8
    wide, narrow = files(tables.cone(stored, 200, 0, 300000).select("id")), files(tables.cone(stored, 200, 0, 3000).select("id"))
    assert every > wide > 5 * narrow
    # the crowded cell lies in several files
    assert stored.where("sky_cell_at_2 IS NOT NULL AND id >= 5000").select(F.input_file_name()).distinct().count() > 3


def test_points_read_their_cells(spark, by_sky):
    stored, whole = by_sky
    points = spark.createDataFrame([("a", 10.0, 20.0), ("b", 359.999, 0.0), ("none", None, None)], "name string, ra double, dec double")
    some = tables.around(stored, points, 5000)
    got = crossmatch.cone_search(some.select("id", "ra", "dec"), points, 5000)
    want = crossmatch.cone_search(whole, points, 5000)
    assert sorted((r.name, r.id) for r in got.collect()) == sorted((r.name, r.id) for r in want.collect()) != []
    assert files(some.select("id")) < files(stored.select("id")) / 8
    with pytest.raises(ValueError, match="1000"):
        tables.around(stored, points.crossJoin(spark.range(1000)), 1)
    assert tables.around(whole, points, 1) is whole


def test_keys_read_their_bucket(spark, tmp_path):
    whole = spark.range(2000).select(F.concat(F.lit("o"), (F.col("id") % 500).cast("string")).alias("objectId"), "id").union(spark.createDataFrame([(None, 1)], "objectId string, id long"))
    tables.write_by_key(whole, str(tmp_path / "t"), "objectId", 16)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2001
    one = tables.with_key(stored, "objectId", "o7")
    assert sorted(r.id for r in one.collect()) == [7, 507, 1007, 1507] and files(one.select("id")) == 1
    some = tables.buckets_of(stored, spark.createDataFrame([("o1",), ("o2",)], "objectId string"), "objectId")
    assert files(some.select("id")) <= 2 and some.where("objectId IN ('o1', 'o2')").count() == 8
    assert tables.with_key(whole, "objectId", "o7").count() == 4


def test_a_replacement_is_seen_whole_or_not_at_all(spark, tmp_path):
    v, made = tables.Versions(spark, f"file://{tmp_path}/t"), []
    with pytest.raises(ValueError, match="nothing"):
        v.read()
    assert v.replace("first", lambda _: spark.range(10).withColumn("n", F.lit(0))) == 1

    def make(before):
        made.append(1)
        return before.withColumn("n", F.col("id") + 1)

    def stopped(before, after):
        raise RuntimeError("lost")

    seen = v.read()
    with pytest.raises(RuntimeError):  # after the rows are written, before they are published
        v.replace("second", make, stopped)
    assert v.read().agg(F.sum("n")).first()[0] == 0 and v.published() == {1: "first"}
    with pytest.raises(Exception, match="halfway"):  # while rows are written
        v.replace("third", lambda b: b.withColumn("n", F.when(F.col("id") > 5, F.raise_error(F.lit("halfway"))).otherwise(1).cast("int")))
    assert v.published() == {1: "first"}
    assert v.replace("second", make, tables.same_but("n", "id")) == 2 and made == [1]
    assert v.replace("second", make) == 2 and made == [1]
    assert v.read().agg(F.sum("n")).first()[0] == 55 and seen.agg(F.sum("n")).first()[0] == 0
    with pytest.raises(tables.Invalid, match="more than"):
        v.replace("fourth", lambda b: b.where("id > 0"), tables.same_but("n", "id"))
    with pytest.raises(tables.Invalid, match="once"):
        v.replace("fifth", lambda b: b.union(b), tables.same_but("n", "id"))
    # a write that was begun from an older version is made anew
    with pytest.raises(RuntimeError):
        v.replace("sixth", make, stopped)
    v.replace("seventh", lambda b: b.withColumn("id", F.col("id") + 100))
    assert v.replace("sixth", make) == 4 and v.read().agg(F.min("n")).first()[0] == 101
    with pytest.raises(ValueError, match="name"):
        v.replace("../x", make)


def test_searches_prune(spark, tmp_path):
    """Pipelines, alert and object searches and cone searches over stored tables read the files that they need."""
    from skyloom import api
    from skyloom.plans import pipeline

    at = F.struct(F.pmod(F.col("_id") * 137.5, F.lit(360.0)).alias("ra"), (F.pmod(F.col("_id") * 77.7, F.lit(170.0)) - 85).alias("dec"), (F.col("_id") / 100).alias("jd"))
    a = spark.range(4000).select(F.col("id").alias("_id"), F.concat(F.lit("o"), (F.col("id") % 300).cast("string")).alias("objectId")).withColumn("candidate", at)
    a = a.withColumn("coordinates", sky.coordinates(F.col("candidate.ra"), F.col("candidate.dec")))
    tables.write_by_sky(a, str(tmp_path / "sky"), "candidate.ra", "candidate.dec", 2, 8, also=("coordinates.radec_geojson",))
    tables.write_by_key(a, str(tmp_path / "key"), "objectId", 16)
    by_sky, by_key = spark.read.parquet(str(tmp_path / "sky")), spark.read.parquet(str(tmp_path / "key"))
    every = files(by_sky)
    stages = [{"$match": {"coordinates.radec_geojson": {"$geoWithin": {"$centerSphere": [[-20.0, 10.0], 0.05]}}}}, {"$project": {"objectId": 1}}]
    found = pipeline.run(by_sky, stages, {})
    assert sorted(r["_id"] for r in found.collect()) == sorted(r["_id"] for r in pipeline.run(a, stages, {}).collect()) != []
    assert files(found) <= every / 10
    found, want = (api.alert_search(t, cone=(160.0, 10.0, 30000.0)) for t in (by_sky, a))
    assert [r["_id"] for r in found.collect()] == [r["_id"] for r in want.collect()] != [] and files(found) <= every / 10
    found, want = (api.alert_search(t, object_id="o5") for t in (by_key, a))
    assert [r["_id"] for r in found.collect()] == [r["_id"] for r in want.collect()] != [] and files(found) == 1
    # a table that is laid out by another position, or by another key, is read whole
    assert tables.in_cones(by_sky.schema, "other.ra", [(0.0, 0.0, 1.0)]) is None
    assert tables.with_key(by_key, "_id", 5).count() == 1


def test_a_stored_rematch_starts_again(spark, tmp_path, monkeypatch):
    kind = "objectId long, ra double, dec double, cross_matches struct<S:array<struct<distance_arcsec:double,row:struct<other:long,ra:double,dec:double>>>,T:array<int>>"
    o = spark.createDataFrame([(i, i * 1.0, 5.0, ([], [i])) for i in range(20)], kind)
    s = spark.createDataFrame([(100 + i, i * 1.0 + 0.0001, 5.0) for i in range(0, 20, 2)], "other long, ra double, dec double")
    v, how = tables.Versions(spark, str(tmp_path / "t")), crossmatch.Catalog("S", 2.0, ("other",))
    v.replace("load", lambda _: o)
    old = crossmatch.rematch
    monkeypatch.setattr(crossmatch, "rematch", lambda *x: old(*x).withColumn("ra", F.when(F.col("ra") > 3, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("ra"))))
    with pytest.raises(Exception, match="killed"):
        crossmatch.rematch_stored(v, "again", {"S": s}, how)
    monkeypatch.setattr(crossmatch, "rematch", lambda *x: old(*x).withColumn("cross_matches", F.col("cross_matches").withField("T", F.array(F.lit(0)))))
    with pytest.raises(tables.Invalid):
        crossmatch.rematch_stored(v, "wrong", {"S": s}, how)
    monkeypatch.undo()
    assert v.read().where("size(cross_matches.S) > 0").count() == 0
    assert crossmatch.rematch_stored(v, "again", {"S": s}, how) == 2
    assert {r.objectId: len(r.cross_matches.S) for r in v.read().collect()} == {i: int(i % 2 == 0) for i in range(20)}
    assert v.read().where("cross_matches.T[0] = objectId").count() == 20


def test_the_side_with_fewer_bytes_reaches(spark):
    few = spark.range(10).selectExpr("id AS objectId", "id * 1.0D AS ra", "0.0D AS dec")
    many = spark.range(1000).selectExpr("id AS other", "id * 0.01D AS ra", "0.0D AS dec", "repeat('x', 50) AS name")
    how = crossmatch.Catalog("S", 2.0)
    assert crossmatch.cheaper_reach(few, many, how) == "left"
    assert crossmatch.cheaper_reach(many.withColumnRenamed("other", "objectId"), few.withColumnRenamed("objectId", "other"), how) == "right"
    assert crossmatch.size_of(few.limit(0), ["ra"]) == (0, 0)
    a, b = (sorted((r.objectId, r.match.row.other) for r in crossmatch.matches(few, many, how, reach=side).collect()) for side in ("left", "right"))
    assert a == b != []
