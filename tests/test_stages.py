"""The three stages on keyed state: what batches keep, forget, and don't read again."""

import json

from skyloom.operators import crossmatch
from skyloom.plans import filters
from skyloom.streaming import stages

ALERT = "_id long, objectId string, candidate struct<jd:double,magpsf:double,sigmapsf:double,band:string,programid:int,ra:double,dec:double>"


def alert(i, o, jd, ra=10.0, mag=18.0):
    return (i, o, (jd, mag, 0.1, "g", 1, ra, 5.0))


def test_batches_read_nothing_of_the_past(spark, tmp_path):
    catalog = spark.createDataFrame([(1, 10.0, 5.0, "a"), (2, 10.0001, 5.0, "b"), (3, 11.0, 5.0, "c")], "id long, ra double, dec double, name string")
    note = {"points": {"$size": "$prv_candidates.jd"}, "near": "$cross_matches.C.row.name", "other": "$aliases.LSST"}
    f = filters.Filter("f", "ZTF", {"v": json.dumps([{"$match": {"candidate.magpsf": {"$lt": 20}}}, {"$project": {"objectId": 1, "annotations": note}}])}, "v", {"ZTF": [1]})
    others = [spark.createDataFrame([], "objectId string, ra double, dec double")]
    s = stages.Stages(str(tmp_path / "out"), {"C": catalog}, [crossmatch.Catalog("C", 2.0, ("name",), max_results=1)], lambda: {"LSST": others[0]}, lambda: [f], days=100.0)
    parts = [
        [alert(1, "o", 100.0), alert(2, "o", 101.0), alert(1, "o", 100.0), alert(7, "p", 100.0, 50.0)],
        [alert(2, "o", 101.0), alert(3, "o", 99.0, 11.0), alert(4, "q", 100.0, 11.0)],  # a repeat, a late point elsewhere, a new object
        [alert(5, "o", 300.0), (8, "r", None), (9, None, (1.0, 18.0, 0.1, "g", 1, None, None))],  # long after; odd ones
        [alert(6, "o", 301.0), alert(1, "o", 100.0)],  # what is forgotten counts as new
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ALERT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(ALERT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stages.run(stream, s, str(tmp_path / "progress")).awaitTermination()
        if i == 1:
            others[0] = spark.createDataFrame([("L1", 10.0, 5.0001)], "objectId string, ra double, dec double")
        if i < 3:  # nothing written may be needed again
            (tmp_path / "out").rename(tmp_path / f"gone{i}")
    got = {}
    for folder in ("gone0", "gone1", "gone2", "out"):
        for r in spark.read.parquet(f"{tmp_path}/{folder}/results").collect():
            n = json.loads(r.filters[0].annotations)
            got.setdefault(r["_id"], []).append((folder, n["points"], n.get("near"), n.get("other")))
    assert got == {
        1: [("gone0", 1, ["a"], []), ("out", 0, ["a"], ["L1"])], 2: [("gone0", 2, ["a"], [])], 7: [("gone0", 1, [], [])],
        3: [("gone1", 1, ["a"], [])], 4: [("gone1", 1, ["c"], [])], 5: [("gone2", 1, ["a"], ["L1"])], 6: [("out", 2, ["a"], ["L1"])], 9: [("gone2", 0, None, None)],
    }
    seen = [spark.read.parquet(f"{tmp_path}/{g}/objects").select("objectId").collect() for g in ("gone0", "gone1", "gone2", "out")]
    assert [sorted(str(r.objectId) for r in x) for x in seen] == [["o", "p"], ["q"], ["None", "r"], []]


def test_matches_are_neither_kept_nor_shuffled(spark, tmp_path):
    n = 300
    catalog = spark.range(n).selectExpr("id", "10 + id / 1e6 AS ra", "5.0D AS dec")
    f = filters.Filter("f", "ZTF", {"v": json.dumps([{"$match": {"candidate.magpsf": {"$lt": 20}}}, {"$project": {"objectId": 1, "annotations.near": {"$size": "$cross_matches.C"}}}])}, "v", {"ZTF": [1]})
    s = stages.Stages(str(tmp_path / "out"), {"C": catalog}, [crossmatch.Catalog("C", 5.0)], lambda: {}, lambda: [f])
    for i, rows in enumerate([[alert(1, "o", 100.0), alert(2, "o", 101.0, 50.0), alert(3, "p", 100.0, 50.0), alert(9, None, 100.0)], [alert(4, "o", 102.0, 50.0), alert(5, "p", 101.0)]]):
        spark.createDataFrame(rows, ALERT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(ALERT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stages.run(stream, s, str(tmp_path / "progress")).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/results").collect()
    near = {r["_id"]: json.loads(r.filters[0].annotations).get("near") for r in found}
    assert len(found) == 6 and near == {1: n, 2: n, 3: 0, 4: n, 5: 0, 9: None} | {9: near[9]} and not near[9]
    stored = {r.objectId: r.cross_matches.C for r in spark.read.parquet(f"{tmp_path}/out/objects").collect()}
    assert {k: len(v) for k, v in stored.items()} == {"o": n, "p": 0, None: n} and stored["o"] == sorted(stored["o"])
    kept = []
    stages.run_batches(s.keyed(stream), lambda b, _: kept.extend(b.where("kept IS NOT NULL").collect()), str(tmp_path / "again")).awaitTermination()
    assert len(kept) == 3 and max(len(r.kept) for r in kept) < 1000
    alerts = spark.createDataFrame([alert(i, f"o{i}", 100.0) for i in range(n // 3)], ALERT)
    objects = alerts.selectExpr("objectId", "struct(candidate.ra, candidate.dec) AS first_sight")
    plan = filters.run_filters(alerts, [f], {"ZTF_objects": objects}, s.matched)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
