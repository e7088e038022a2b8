"""Filters that share one plan, against each of them run alone."""

import json
import random

from pyspark.sql import functions as F

from skyloom import catalogue_surveys, views
from skyloom.plans import filters

SF = "/root/testdata/sf0.001"


def random_filter(rng, k):
    early = [{"$match": {"candidate.magpsf": {"$lt": rng.choice([16, 18, 20])}}}, {"$addFields": {"x": {"$multiply": ["$candidate.drb", 10]}, "candidate.mine": {"$add": ["$candidate.magpsf", k]}}}, {"$match": {"$expr": {"$gte": ["$x", k % 3]}}}, {"$unset": "x"}, {"$project": {"objectId": 1, "candidate": 1}}]
    late = [{"$match": {"prv_candidates.1": {"$exists": True}}}, {"$addFields": {"n": {"$size": "$prv_candidates"}, "bright": {"$min": "$prv_candidates.magpsf"}}}, {"$match": {"n": {"$gt": rng.randrange(4)}}}, {"$match": {"LSST.prv_candidates.0": {"$exists": True}}}, {"$project": {"objectId": 1, "n": 1, "bright": 1, "LSST": 1}}]
    stages = sorted(rng.sample(range(5), rng.randrange(1, 5)))
    stages = [early[0], *(early[i] for i in stages if i)]
    if rng.random() < 0.7:
        stages += [late[i] for i in sorted(rng.sample(range(5), rng.randrange(1, 5)))]
    stages.append({"$project": {"objectId": 1, "annotations.m": "$candidate.magpsf", "annotations.n": "$n", "annotations.b": "$bright", "annotations.l": {"$size": "$LSST.prv_candidates.magpsf"}}})
    f = filters.Filter(f"f{k}", "ZTF", {"v": json.dumps(stages)}, "v", rng.choice([{"ZTF": [1]}, {"ZTF": [1, 2]}, {"ZTF": [2, 3], "LSST": []}, {}]))
    return f



def test_shared_plan_equals_each_filter(spark):
    rng = random.Random(3)
    alerts = views.alerts(spark, SF).persist()
    objects = views.objects(spark, SF).withColumn("aliases", F.struct(F.when(F.col("objectId") > "U3", F.array(F.lit("U1"))).otherwise(F.array().cast("array<string>")).alias("LSST"))).persist()
    tables = {"ZTF_objects": objects, "LSST_objects": views.objects(spark, SF)}
    some = [random_filter(rng, k) for k in range(14)]
    moving = [{"$match": {"sso_history.0": {"$exists": True}}}, {"$project": {"objectId": 1}}]
    some.append(filters.Filter("moving", "ZTF", {"v": json.dumps(moving)}, "v", {"ZTF": [1, 2]}))
    want = {}
    for f in some:
        got = filters.run_filter(alerts, f, tables)
        for r in got.select("_id", (F.to_json("annotations") if "annotations" in got.columns else F.lit("{}")).alias("a")).collect():
            want.setdefault(r["_id"], []).append((f.id, r.a))
    out = filters.run_filters(alerts, some, tables).collect()
    assert {r["_id"]: [tuple(x) for x in r.filters] for r in out} == {i: sorted(v) for i, v in want.items()} and len(out) == len(want) > 50


def test_one_scan_and_one_join_for_any_number(spark):
    for n in (25, 70):
        alerts, objects = views.alerts(spark, SF), spark.read.parquet(f"{SF}/customer.parquet").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("objectId"), F.array(F.struct(F.lit(2460000.0).alias("jd"), F.lit(1).alias("programid"))).alias("prv_candidates"))
        out = filters.run_filters(alerts, catalogue_surveys._standing(n), {"ZTF_objects": objects})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Join") == 1 and "Union" not in plan
        assert out.count() > 0


def test_dry_run_sorts_by_alert_and_by_annotation(spark):
    alerts = views.alerts(spark, SF)
    stages = [{"$match": {"candidate.magpsf": {"$lt": 18}}}, {"$project": {"objectId": 1, "annotations.d": "$candidate.drb", "annotations.m": "$candidate.magpsf"}}]
    f = filters.Filter("f", "ZTF", {"v": json.dumps(stages)}, "v", {"ZTF": [1, 2]})
    run = lambda **how: [(r["_id"], r.annotations.d, r.annotations.m) for r in filters.dry_run(alerts, f, {}, 2460315.0, 2460321.0, limit=30, **how).collect()]
    every = [(r["_id"], r.annotations.d, r.annotations.m) for r in filters.dry_run(alerts, f, {}, 2460315.0, 2460321.0).collect()]
    assert run(sort={"annotations.d": -1, "candidate.magpsf": 1}) == sorted(every, key=lambda r: (-r[1], r[2], r[0]))[:30]
    assert run(sort={"candidate.magpsf": -1}) == sorted(every, key=lambda r: (-r[2], r[0]))[:30]
