"""The registered queries of the engine's own operators, with the SQL that each is held against.

Every query runs over its whole tables. Results carry rounded numbers and sizes or sums in place of arrays, so that two
engines can agree on them to the last digit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom import api, views
from skyloom.functions import photometry, sky
from skyloom.operators import crossmatch, lightcurve, nights, rules, series
from skyloom.plans import filters, pipeline
from skyloom.streaming import replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The SQL of views.detections, views.alerts and views.sky_positions.
D = """d AS (SELECT event_id AS candid, 'U' || user_id AS objectId, epoch_us(ts) / 86400e6 + 2440587.5 AS jd, 15 + value / 100 AS mag, CAST(0.05 AS DOUBLE) AS mag_err,
  CASE event_type WHEN 'click' THEN 'g' WHEN 'view' THEN 'r' WHEN 'purchase' THEN 'i' WHEN 'signup' THEN 'z' WHEN 'error' THEN 'y' END AS band,
  CAST(event_id % 3 + 1 AS INT) AS programid, CASE WHEN user_id % 5 = 0 THEN 'D' || user_id END AS designation, event_id % 7 / 7.0::DOUBLE AS drb, event_id % 11 / 11.0::DOUBLE AS sgscore1, CAST(event_id % 13 AS DOUBLE) AS ssdistnr FROM events)"""


def _sky(name: str, table: str, key: str, shift: float = 0.0) -> str:
    return f"{name} AS (SELECT {key} AS id, ({key} * 137.50776405003785::DOUBLE + {shift}::DOUBLE) % 360 AS ra, degrees(asin(2 * (({key} * 0.6180339887498949::DOUBLE) % 1) - 1)) AS dec FROM {table})"


def _apart(a: str, b: str) -> str:
    a1, d1, a2, d2 = f"radians({a}.ra)", f"radians({a}.dec)", f"radians({b}.ra)", f"radians({b}.dec)"
    return f"degrees(2 * asin(least(1, sqrt(pow(sin(({d2} - {d1}) / 2), 2) + cos({d1}) * cos({d2}) * pow(sin(({a2} - {a1}) / 2), 2)))))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _run(df: DataFrame, stages: list, **tables: DataFrame) -> DataFrame:
    return pipeline.run(df, json.dumps(stages), tables)


# ---- stages and expressions ----


@query(f"WITH {D} SELECT candid AS _id, objectId AS objectId, round(mag, 6) AS mag, band FROM d WHERE mag < 17 AND band = 'g'")
def match_project(spark, sf):
    out = _run(views.alerts(spark, sf), [{"$match": {"candidate.magpsf": {"$lt": 17}, "candidate.band": "g"}}, {"$project": {"objectId": 1, "mag": {"$round": ["$candidate.magpsf", 6]}, "band": "$candidate.band"}}])
    return out


@query(f"WITH {D} SELECT candid AS _id, objectId FROM d WHERE (programid = 1 OR mag >= 18.5) AND NOT (band = 'r' AND designation IS NOT NULL) AND drb / 2 < sgscore1")
def match_or_expr(spark, sf):
    return _run(views.alerts(spark, sf), [
        {"$match": {"$or": [{"candidate.programid": 1}, {"candidate.magpsf": {"$gte": 18.5}}], "$nor": [{"candidate.band": "r", "candidate.ssnamenr": {"$ne": None}}], "$expr": {"$lt": [{"$divide": ["$candidate.drb", 2]}, "$candidate.sgscore1"]}}},
        {"$project": {"objectId": 1}},
    ])


@query(f"WITH {D} SELECT candid AS _id, band FROM d WHERE band IN ('g', 'i') AND designation IS NOT NULL AND objectId LIKE 'U1%' AND programid NOT IN (2)")
def match_in_exists(spark, sf):
    return _run(views.alerts(spark, sf), [
        {"$match": {"candidate.band": {"$in": ["g", "i"]}, "candidate.ssnamenr": {"$exists": True}, "objectId": {"$regex": "^U1"}, "candidate.programid": {"$nin": [2]}, "candidate.nothing": {"$exists": False}}}, {"$project": {"band": "$candidate.band"}},
    ])


@query("SELECT o_orderkey, n FROM (SELECT o_orderkey, count(l_orderkey) AS n, max(CAST(l_quantity > 45 AND l_discount >= 0.05 AS INT)) AS hit FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE hit = 1 AND n > 3")
def match_elements(spark, sf):
    return _run(views.orders_with_lines(spark, sf), [
        {"$match": {"lines": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_discount": {"$gte": 0.05}}}, "lines.3": {"$exists": True}}}, {"$project": {"o_orderkey": 1, "n": {"$size": "$lines"}}},
    ]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query(f"WITH {D} SELECT candid AS _id, round(CASE WHEN designation IS NOT NULL THEN mag - 1 ELSE mag END, 6) AS corrected, coalesce(designation, 'none') AS name, round(mag * 2 + abs(mag - 17) - pow(drb, 2), 6) AS mixed FROM d")
def add_fields_unset(spark, sf):
    return _run(views.alerts(spark, sf), [
        {"$addFields": {"corrected": {"$round": [{"$cond": {"if": {"$ne": ["$candidate.ssnamenr", None]}, "then": {"$subtract": ["$candidate.magpsf", 1]}, "else": "$candidate.magpsf"}}, 6]}, "name": {"$ifNull": ["$candidate.ssnamenr", "none"]}, "candidate.extra": 1}},
        {"$set": {"mixed": {"$round": [{"$add": [{"$multiply": ["$candidate.magpsf", 2]}, {"$abs": {"$subtract": ["$candidate.magpsf", 17]}}, {"$multiply": [-1, {"$pow": ["$candidate.drb", 2]}]}]}, 6]}}},
        {"$unset": ["candidate", "objectId"]},
    ])


@query(f"WITH {D} SELECT candid AS _id, CASE WHEN mag < 16 THEN 'bright' WHEN mag < 18 THEN 'middle' ELSE 'faint' END AS kind, round(log10(mag), 6) AS lg, round(coalesce(mag / nullif(candid % 4, 0), -1), 7) AS part FROM d")
def cond_ifnull_round(spark, sf):
    return _run(views.alerts(spark, sf), [
        {"$addFields": {"rest": {"$mod": ["$_id", 4]}}},
        {"$project": {"kind": {"$switch": {"branches": [{"case": {"$lt": ["$candidate.magpsf", 16]}, "then": "bright"}, {"case": {"$lt": ["$candidate.magpsf", 18]}, "then": "middle"}], "default": "faint"}}, "lg": {"$round": [{"$log10": "$candidate.magpsf"}, 6]}, "part": {"$round": [{"$ifNull": [{"$divide": ["$candidate.magpsf", "$rest"]}, -1]}, 7]}}},
    ])


@query(f"WITH {D} SELECT candid AS _id, CAST(mag < 17 AND designation < 'D5' OR designation IS NULL AND mag < 17 AS BOOLEAN) AS low, designation IS NULL AS missing, CAST(designation IS NOT NULL AS BOOLEAN) AS above FROM d")
def null_order(spark, sf):
    """Null sorts below every value in expressions."""
    return _run(views.alerts(spark, sf), [{"$project": {"low": {"$and": [{"$lt": ["$candidate.magpsf", 17]}, {"$lt": ["$candidate.ssnamenr", "D5"]}]}, "missing": {"$eq": ["$candidate.ssnamenr", "$candidate.nothing"]}, "above": {"$gt": ["$candidate.ssnamenr", None]}}}])


@query(f"WITH {D} SELECT candid AS _id, objectId FROM d ORDER BY mag DESC, candid LIMIT 50 OFFSET 25")
def sort_skip_limit(spark, sf):
    return _run(views.alerts(spark, sf), [{"$sort": {"candidate.magpsf": -1, "_id": 1}}, {"$skip": 25}, {"$limit": 50}, {"$project": {"objectId": 1}}])


@query("SELECT s_suppkey, round(s_acctbal, 2) AS bal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def topk(spark, sf):
    return _run(views.load(spark, sf, "supplier"), [{"$sort": {"s_acctbal": -1, "s_suppkey": 1}}, {"$limit": 10}, {"$project": {"s_suppkey": 1, "bal": {"$round": ["$s_acctbal", 2]}}}])


@query(f"WITH {D} SELECT count(*) AS n FROM d WHERE mag > 18")
def count_stage(spark, sf):
    return _run(views.alerts(spark, sf), [{"$match": {"candidate.magpsf": {"$gt": 18}}}, {"$count": "n"}])


@query(f"WITH {D} SELECT band AS _id, count(*) AS n, round(avg(mag), 6) AS mean, round(max(mag), 6) AS faint, len(list(candid)) AS pushed, count(DISTINCT objectId) AS objects FROM d GROUP BY band")
def group_push_size(spark, sf):
    return _run(views.alerts(spark, sf), [
        {"$group": {"_id": "$candidate.band", "n": {"$sum": 1}, "mean": {"$avg": "$candidate.magpsf"}, "faint": {"$max": "$candidate.magpsf"}, "all": {"$push": "$_id"}, "ids": {"$addToSet": "$objectId"}}},
        {"$project": {"n": 1, "mean": {"$round": ["$mean", 6]}, "faint": {"$round": ["$faint", 6]}, "pushed": {"$size": "$all"}, "objects": {"$size": "$ids"}}},
    ]).select("_id", "n", "mean", "faint", F.col("pushed").cast("long").alias("pushed"), F.col("objects").cast("long").alias("objects"))


@query(f"WITH {D} SELECT DISTINCT objectId AS _id FROM d")
def distinct_ids(spark, sf):
    return _run(views.alerts(spark, sf), [{"$group": {"_id": "$objectId"}}])


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_left(spark, sf):
    return _run(views.load(spark, sf, "customer"), [
        {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}, {"$project": {"c_custkey": 1, "orders": {"$size": "$found"}, "total": {"$round": [{"$reduce": {"input": "$found.o_totalprice", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 2]}}},
    ], orders=views.load(spark, sf, "orders")).select("c_custkey", F.col("orders").cast("long").alias("orders"), "total")


@query("SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def lookup_unwind_inner(spark, sf):
    return _run(views.load(spark, sf, "orders"), [
        {"$match": {"o_totalprice": {"$gt": 200000}}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": {"path": "$c", "preserveNullAndEmptyArrays": False}}, {"$project": {"o_orderkey": 1, "segment": "$c.c_mktsegment"}},
    ], customer=views.load(spark, sf, "customer"))


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey GROUP BY 1")
def lookup_array_len(spark, sf):
    return _run(views.load(spark, sf, "nation"), [
        {"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}], "as": "s"}}, {"$project": {"n_nationkey": 1, "suppliers": {"$size": "$s"}}},
    ], supplier=views.load(spark, sf, "supplier")).select("n_nationkey", F.col("suppliers").cast("long").alias("suppliers"))


@query("SELECT 'c' AS kind, c_custkey AS key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's', s_suppkey FROM supplier WHERE s_acctbal < 0")
def union_with(spark, sf):
    tag = lambda k, name, bal: [{"$match": {bal: {"$lt": 0}}}, {"$project": {"kind": {"$literal": k}, "key": f"${name}"}}]
    return _run(views.load(spark, sf, "customer"), [*tag("c", "c_custkey", "c_acctbal"), {"$unionWith": {"coll": "supplier", "pipeline": tag("s", "s_suppkey", "s_acctbal")}}], supplier=views.load(spark, sf, "supplier"))


@query("SELECT o_orderkey, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS large, round(coalesce(sum(l_quantity) FILTER (l_quantity > 25), 0), 2) AS quantity, coalesce(max(CAST(l_discount > 0.09 AS INT)), 0) = 1 AS any FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def array_expressions(spark, sf):
    return _run(views.orders_with_lines(spark, sf), [
        {"$addFields": {"some": {"$filter": {"input": {"$ifNull": ["$lines", []]}, "as": "l", "cond": {"$gt": ["$$l.l_quantity", 25]}}}}},
        {"$project": {"o_orderkey": 1, "large": {"$size": "$some"}, "quantity": {"$round": [{"$reduce": {"input": {"$map": {"input": "$some", "as": "l", "in": "$$l.l_quantity"}}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 2]}, "any": {"$anyElementTrue": {"$map": {"input": "$lines", "as": "l", "in": {"$gt": ["$$l.l_discount", 0.09]}}}}}},
    ]).select("o_orderkey", F.col("large").cast("long").alias("large"), "quantity", "any")


@query("SELECT o_orderkey, CAST(coalesce(sum(CAST(l_quantity > before AS INT)), 0) AS BIGINT) AS rises FROM orders LEFT JOIN (SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_returnflag) AS before FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1")
def reduce_over_range(spark, sf):
    """A fold over places of an array, with its neighbours."""
    at = lambda i: {"$arrayElemAt": ["$lines", i]}
    step = {"$let": {"vars": {"a": at({"$subtract": ["$$this", 1]}), "b": at("$$this")}, "in": {"$add": ["$$value", {"$cond": [{"$gt": ["$$b.l_quantity", "$$a.l_quantity"]}, 1, 0]}]}}}
    return _run(views.orders_with_lines(spark, sf), [{"$project": {"o_orderkey": 1, "rises": {"$reduce": {"input": {"$range": [1, {"$size": "$lines"}]}, "initialValue": 0, "in": step}}}}]).select("o_orderkey", F.col("rises").cast("long").alias("rises"))


@query("SELECT o_orderkey, arg_min(l_linenumber, struct_pack(q := -l_quantity, n := l_linenumber)) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def sort_array_first(spark, sf):
    out = _run(views.orders_with_lines(spark, sf), [{"$match": {"lines.0": {"$exists": True}}}, {"$addFields": {"sorted": {"$sortArray": {"input": "$lines", "sortBy": {"l_quantity": -1, "l_linenumber": 1}}}}}, {"$project": {"o_orderkey": 1, "line": {"$first": "$sorted.l_linenumber"}}}])
    return out


@query("SELECT o_orderkey, l_linenumber AS line, round(l_quantity, 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def unwind_lines(spark, sf):
    return _run(views.orders_with_lines(spark, sf), [{"$unwind": "$lines"}, {"$match": {"lines.l_returnflag": "R"}}, {"$project": {"o_orderkey": 1, "line": "$lines.l_linenumber", "quantity": {"$round": ["$lines.l_quantity", 2]}}}])


# ---- time series ----


@query(f"WITH {D} SELECT a.candid, count(*) AS n, round(min(b.mag), 6) AS brightest FROM d a JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd AND a.jd - b.jd < 5 GROUP BY a.candid")
def array_filter_window(spark, sf):
    own = views.detections(spark, sf).select("candid", "objectId", "jd").join(views.objects(spark, sf), "objectId")
    past = own.select("candid", series.trailing(F.col("prv_candidates"), F.col("jd"), 5.0).alias("p"))
    return past.select("candid", F.size("p").cast("long").alias("n"), F.round(F.array_min(F.transform("p", lambda x: x["magpsf"])), 6).alias("brightest"))


@query(f"WITH {D} SELECT candid, count(*) OVER w AS n, round(sum(mag) OVER w, 4) AS total FROM d WINDOW w AS (PARTITION BY objectId ORDER BY jd RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)")
def trailing_window_count(spark, sf):
    w = Window.partitionBy("objectId").orderBy("jd").rangeBetween(-3, 0)
    return views.detections(spark, sf).select("candid", F.count("*").over(w).alias("n"), F.round(F.sum("mag").over(w), 4).alias("total"))


@query(f"WITH {D} SELECT candid, round(dt, 6) AS dt, round(rate, 4) AS rate FROM (SELECT candid, jd - lag(jd) OVER w AS dt, (mag - lag(mag) OVER w) / (jd - lag(jd) OVER w) AS rate FROM d WINDOW w AS (PARTITION BY objectId, band ORDER BY jd)) WHERE dt >= 0.02 AND rate >= 0.2")
def lag_rate_pairs(spark, sf):
    return series.fast_pairs(views.detections(spark, sf), "objectId").select("candid", F.round("dt", 6).alias("dt"), F.round("rate", 4).alias("rate"))


@query(f"WITH {D}, w AS (SELECT objectId, candid, row_number() OVER (PARTITION BY objectId ORDER BY jd, candid) AS f, row_number() OVER (PARTITION BY objectId ORDER BY jd DESC, candid) AS l, row_number() OVER (PARTITION BY objectId ORDER BY mag, candid) AS b, row_number() OVER (PARTITION BY objectId ORDER BY mag DESC, candid) AS x FROM d) SELECT objectId, max(candid) FILTER (f = 1) AS first, max(candid) FILTER (l = 1) AS last, max(candid) FILTER (b = 1) AS brightest, max(candid) FILTER (x = 1) AS faintest FROM w GROUP BY objectId")
def first_last_brightest(spark, sf):
    a = views.alerts(spark, sf)
    out = None
    for which in ("first", "last", "brightest", "faintest"):
        one = api.representative(a, which).select("objectId", F.col("_id").alias(which))
        out = one if out is None else out.join(one, "objectId")
    return out


@query(f"WITH {D}, m AS (SELECT objectId, CAST(floor(jd * 4) / 4 AS DOUBLE) AS jd, candid, CASE WHEN programid = 1 THEN 0 ELSE 1 END AS src FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY objectId, jd ORDER BY src, candid) AS n FROM m) SELECT objectId, count(*) AS points, sum(candid) AS ids FROM k WHERE n = 1 GROUP BY objectId")
def series_merge_keep_first(spark, sf):
    """Stored points win over new ones, and of each time one is kept."""
    m = views.detections(spark, sf).select("objectId", (F.floor(F.col("jd") * 4) / 4).alias("jd"), "candid", F.when(F.col("programid") == 1, 0).otherwise(1).alias("src"))
    arrays = m.groupBy("objectId").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("src") == s, F.struct("candid", "jd")))), lambda p: F.struct(p["jd"].alias("jd"), p["candid"].alias("candid"))).alias(n) for s, n in ((0, "old"), (1, "new"))))
    merged = arrays.select("objectId", series.merge(F.col("old"), F.col("new")).alias("p"))
    return merged.where(F.size("p") > 0).select("objectId", F.size("p").cast("long").alias("points"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["candid"]).alias("ids"))


@query(f"WITH {D}, m AS (SELECT objectId, CAST(floor(jd) AS DOUBLE) AS jd, candid, band FROM d), k AS (SELECT *, lag(jd) OVER w AS pj, lag(band) OVER w AS pb FROM m WINDOW w AS (PARTITION BY objectId ORDER BY jd, candid)) SELECT objectId, count(*) AS points, sum(candid) AS ids FROM k WHERE NOT (coalesce(pj = jd, false) AND coalesce(pb = band, false)) GROUP BY objectId")
def dedup_time_band(spark, sf):
    m = views.detections(spark, sf).select("objectId", F.floor("jd").cast("double").alias("jd"), "candid", "band")
    return series.without_repeats(m, "objectId", "candid").groupBy("objectId").agg(F.count("*").alias("points"), F.sum("candid").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(CAST(-2.5 * log10(l_extendedprice) + 23.9 AS FLOAT) AS DOUBLE), 3) AS mag, round(CAST(CAST(1.0857362047581296::DOUBLE * l_quantity / l_extendedprice AS FLOAT) AS DOUBLE), 5) AS err, round(CAST(CAST(-2.5 * log10(5 * l_quantity) + 23.9 AS FLOAT) AS DOUBLE), 3) AS lim FROM lineitem")
def flux_mag_roundtrip(spark, sf):
    m = photometry.flux_to_mag(F.col("l_extendedprice"), F.col("l_quantity"), photometry.ZTF_ZP)
    return views.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(m["mag"].cast("double"), 3).alias("mag"), F.round(m["err"].cast("double"), 5).alias("err"), F.round(photometry.flux_err_to_limit(F.col("l_quantity"), photometry.ZTF_ZP).cast("double"), 3).alias("lim"))


_PREPARED = "p AS (SELECT *, row_number() OVER (PARTITION BY objectId ORDER BY jd, band, mag) AS place FROM d), k AS (SELECT *, min(struct_pack(m := CAST(mag AS DOUBLE), p := place)) OVER (PARTITION BY objectId, band) AS peak, min(jd) OVER (PARTITION BY objectId, band) AS j0 FROM p)"


@query(f"WITH {D}, {_PREPARED} SELECT objectId, band, round(arg_min(jd, struct_pack(m := mag, p := place)), 6) AS peak_jd, round(min(mag), 4) AS peak_mag, round(max(mag), 4) AS faintest_mag, round(max(jd) - min(jd), 3) AS dt FROM k GROUP BY 1, 2")
def band_peak_stats(spark, sf):
    s = lightcurve.band_stats(lightcurve.prepared(views.detections(spark, sf)))
    return s.select("objectId", "band", F.round("peak_jd", 6).alias("peak_jd"), F.round(F.col("peak_mag").cast("double"), 4).alias("peak_mag"), F.round(F.col("faintest_mag").cast("double"), 4).alias("faintest_mag"), F.round(F.col("last_jd") - F.col("first_jd"), 3).alias("dt"))


@query(f"""WITH {D}, {_PREPARED}, s AS (SELECT objectId, band, jd - j0 AS x, mag AS y FROM k WHERE place >= peak.p), g AS (SELECT objectId, band, count(*) AS n, avg(x) AS mx, avg(y) AS my, max(x) - min(x) AS dt, min(y) AS lo, max(y) AS hi FROM s GROUP BY 1, 2),
c AS (SELECT s.objectId, s.band, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (x - mx)) AS xx FROM s JOIN g USING (objectId, band) GROUP BY 1, 2)
SELECT objectId, band, CAST(n AS INT) AS n, round(xy / xx, 3) AS rate FROM g JOIN c USING (objectId, band) WHERE n > 1 AND dt > 0.01 AND lo + 0.05 < hi - 0.05 AND xx * 400 >= 1e-10""")
def wls_slope(spark, sf):
    s = lightcurve.band_stats(lightcurve.prepared(views.detections(spark, sf)))
    return s.where("fading IS NOT NULL").select("objectId", "band", F.col("fading.nb_data").alias("n"), F.round(F.col("fading.rate").cast("double"), 3).alias("rate"))


@query(f"WITH {D}, {_PREPARED} SELECT objectId, round(min(mag), 4) AS peak_mag, round(max(mag), 4) AS faintest_mag, max(jd) - min(jd) > 0.01 AS stationary, count(DISTINCT band) AS bands FROM k GROUP BY 1")
def photstats(spark, sf):
    s = lightcurve.photstats(lightcurve.prepared(views.detections(spark, sf)))
    return s.select("objectId", F.round(F.col("peak_mag").cast("double"), 4).alias("peak_mag"), F.round(F.col("faintest_mag").cast("double"), 4).alias("faintest_mag"), "stationary", F.size("bands").cast("long").alias("bands"))


# ---- joins ----


@query(f"WITH {D} SELECT a.candid AS _id, count(*) AS n, round(sum(b.mag), 4) AS total FROM d a JOIN d b ON a.designation = b.designation AND b.jd <= a.jd AND b.jd >= a.jd - 10 AND b.programid IN (1, 2) WHERE a.designation IS NOT NULL GROUP BY 1")
def interval_history_join(spark, sf):
    out = filters.with_moving_history(views.alerts(spark, sf), F.col("candidate.ssnamenr"), 10.0, [1, 2])
    return out.where(F.size("sso_history") > 0).select("_id", F.size("sso_history").cast("long").alias("n"), F.round(F.aggregate("sso_history", F.lit(0.0), lambda s, p: s + p["magpsf"]), 4).alias("total"))


@query("WITH w AS (SELECT c_custkey AS id, list(o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9000 GROUP BY 1) SELECT o_orderkey AS _id, 1 AS watchers FROM orders WHERE EXISTS (SELECT 1 FROM w WHERE list_contains(w.orders, o_orderkey))")
def watchlist_semi(spark, sf):
    o = views.load(spark, sf, "orders")
    wl = views.load(spark, sf, "customer").where("c_acctbal > 9000").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("matching_ztf_objects"), F.first("c_mktsegment").alias("segment"))
    res = o.select(F.col("o_orderkey").alias("_id"), F.col("o_orderkey").cast("string").alias("objectId"))
    return filters.with_watchlist(res, wl, "ZTF", ["segment"]).select("_id", F.size("annotations.watchlist").alias("watchers"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def known_semi(spark, sf):
    from skyloom.sources import surveys

    known = views.load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return surveys.by_keys(views.load(spark, sf, "orders"), known, "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dup_anti(spark, sf):
    from skyloom.sources import surveys

    return surveys.insert_new(views.load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), views.load(spark, sf, "customer"), "c_custkey").select("c_custkey")


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, p(name, ra, dec) AS (VALUES ('pole', 10.0, 89.0), ('wrap', 359.9, 1.0), ('mid', 120.0, -35.0)) SELECT name, id, round({_apart('p', 'a')} * 3600, 2) AS dist FROM p, a WHERE {_apart('p', 'a')} <= 6")
def cone_search(spark, sf):
    points = spark.createDataFrame([("pole", 10.0, 89.0), ("wrap", 359.9, 1.0), ("mid", 120.0, -35.0)], "name string, ra double, dec double")
    found = crossmatch.cone_search(views.sky_positions(spark, sf, "customer", "c_custkey"), points, 6.0, "deg")
    return found.select("name", F.col("objectId").alias("id"), F.round("distance_arcsec", 2).alias("dist"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT a.id, b.id AS other, {_apart('a', 'b')} * 3600 AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_apart('a', 'b')}, b.id) AS n FROM a, b WHERE {_apart('a', 'b')} <= 8) SELECT id, other, round(dist, 2) AS dist FROM m WHERE n <= 3")
def xmatch_topk(spark, sf):
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "other")
    found = crossmatch.matches(views.sky_positions(spark, sf, "customer", "c_custkey"), b, crossmatch.Catalog("b", 8 * 3600.0, ("other",), max_results=3))
    return found.select(F.col("objectId").alias("id"), F.col("match.row.other").alias("other"), F.round("match.distance_arcsec", 2).alias("dist"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b0', 'supplier', 's_suppkey', 0.001)}, b AS (SELECT *, (id % 40) / 1000.0::DOUBLE AS z FROM b0), m AS (SELECT a.id, b.id AS other, z, {_apart('a', 'b')} * 3600 AS dist FROM a, b WHERE {_apart('a', 'b')} <= 5) SELECT id, other, round(dist, 2) AS dist, round(CASE WHEN z > 0.005 THEN dist * z / 0.05 ELSE -1 END, 2) AS kpc FROM m WHERE dist < CASE WHEN z < 0.01 THEN 18000 ELSE 5000 * 0.05 / z END")
def xmatch_scaled_radius(spark, sf):
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "other").withColumn("z", F.col("other") % 40 / 1000.0)
    how = crossmatch.Catalog("b", 5 * 3600.0, ("other", "z"), "z", 5000.0, 18000.0)
    found = crossmatch.matches(views.sky_positions(spark, sf, "customer", "c_custkey"), b, how)
    return found.select(F.col("objectId").alias("id"), F.col("match.row.other").alias("other"), F.round("match.distance_arcsec", 2).alias("dist"), F.round("match.distance_kpc", 2).alias("kpc"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT a.id, b.id AS other, {_apart('a', 'b')} * 3600 AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_apart('a', 'b')}, b.id) AS n FROM a, b WHERE {_apart('a', 'b')} <= 10 AND a.dec BETWEEN -90 AND 33.5) SELECT id, other, round(dist, 2) AS dist FROM m WHERE n = 1")
def nearest_neighbor(spark, sf):
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "match_id")
    found = crossmatch.nearest(views.sky_positions(spark, sf, "customer", "c_custkey"), b, 10 * 3600.0, covers=crossmatch.COVERAGE["LSST"])
    return found.select(F.col("objectId").alias("id"), F.col("match_id").alias("other"), F.round("distance_arcsec", 2).alias("dist"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, u AS (SELECT id, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM a), g AS (SELECT id, " + ", ".join(f"{r[0]} * x + {r[1]} * y + {r[2]} * z AS {n}" for n, r in zip("xyz", sky.GALACTIC)) + " FROM u) SELECT id, round(degrees(atan2(y, x)), 5) AS l, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS b FROM g")
def galactic(spark, sf):
    g = sky.galactic(F.col("ra"), F.col("dec"))
    return views.sky_positions(spark, sf, "customer", "c_custkey").select(F.col("objectId").alias("id"), F.round(g["l"], 5).alias("l"), F.round(g["b"], 5).alias("b"))


# ---- nights, rules, offsets, filters ----


@query(f"WITH {D}, days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS night), c AS (SELECT DATE '1970-01-01' + CAST(floor(jd - 2440587.5 - 19 / 24.0::DOUBLE) AS INT) AS night, count(*) AS n FROM d GROUP BY 1) SELECT CAST(night AS VARCHAR) AS night, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (night)")
def night_counts(spark, sf):
    return nights.nightly_counts(views.detections(spark, sf), "ZTF", "2023-12-30", "2024-02-02").select(F.col("night").cast("string").alias("night"), "n")


@query(f"WITH {D} SELECT band, count(*) FILTER (mag < 15.5) AS matched, count(*) AS total, count(*) > 0 AND count(*) FILTER (mag < 15.5) <= trunc(count(*) * 10 / 100) AS ok FROM d GROUP BY band")
def selectivity_guard(spark, sf):
    g = views.detections(spark, sf).groupBy("band").agg(F.count(F.when(F.col("mag") < 15.5, 1)).alias("matched"), F.count("*").alias("total"))
    return g.withColumn("ok", filters.is_selective(F.col("matched"), F.col("total"), 10))


@query(f"WITH {D} SELECT candid, CASE WHEN programid = 1 THEN 'ztf.lsst-match.' ELSE 'ztf.no-lsst-match.' END || CASE WHEN mag < 15.5 THEN 'stellar' WHEN sgscore1 BETWEEN 0 AND 0.5 THEN 'hosted' ELSE 'hostless' END AS topic FROM d")
def category_routing(spark, sf):
    a = views.alerts(spark, sf)
    topic = rules.ztf_category(F.col("candidate.magpsf") < 15.5, F.lit(False), [F.col("candidate.sgscore1")], F.col("candidate.programid") == 1)
    return a.select(F.col("_id").alias("candid"), topic.alias("topic"))


@query(f"WITH {D} SELECT candid, ssdistnr < 12 AND mag >= 0 AS rock, sgscore1 > 0.76 AND drb * 4 <= 2 AS star, sgscore1 > 0.49 AND drb * 4 <= 20 AND mag <= 15 AS near_brightstar FROM d")
def star_rules(spark, sf):
    given = {"ssdistnr": F.col("candidate.ssdistnr"), "ssmagnr": F.col("candidate.magpsf"), "sgscore1": F.col("candidate.sgscore1"), "distpsnr1": F.col("candidate.drb") * 4, "srmag1": F.col("candidate.magpsf")}
    flags = rules.ztf_flags(lambda name: given.get(name, F.lit(None).cast("double")))
    return views.alerts(spark, sf).select(F.col("_id").alias("candid"), *(c.alias(k) for k, c in flags.items()))


@query(f"WITH {D} SELECT candid FROM d WHERE programid = 1 AND NOT ssdistnr < 2 AND drb >= 0.2")
def publish_gate(spark, sf):
    a = views.alerts(spark, sf)
    return a.where(rules.ztf_public(F.col("candidate.programid"), F.col("candidate.ssdistnr") < 2, F.col("candidate.drb"))).select(F.col("_id").alias("candid"))


@query("SELECT o_custkey, count(*) AS samples, round(sum(delta), 2) AS delta FROM (SELECT o_custkey, greatest(coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0), 0) AS delta FROM orders) GROUP BY 1")
def offset_delta(spark, sf):
    return series.deltas(views.load(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("samples"), F.round(F.sum("delta"), 2).alias("delta"))


@query(f"WITH {D} SELECT objectId, count(*) FILTER (programid IN (1, 3)) AS visible, count(*) AS total FROM d GROUP BY 1")
def permission_filter(spark, sf):
    return views.objects(spark, sf).select("objectId", F.size(rules.permitted(F.col("prv_candidates"), [1, 3])).cast("long").alias("visible"), F.size("prv_candidates").cast("long").alias("total"))


_STORED = [
    {"$match": {"candidate.drb": {"$gte": 0.3}}},
    {"$addFields": {"recent": {"$filter": {"input": "$prv_candidates", "as": "p", "cond": {"$lt": [{"$subtract": ["$candidate.jd", "$$p.jd"]}, 10]}}}}},
    {"$match": {"$expr": {"$gte": [{"$size": "$recent"}, 3]}}},
    {"$project": {"objectId": 1, "annotations.n": {"$size": "$recent"}, "annotations.mag": "$candidate.magpsf"}},
]


@query(f"WITH {D}, a AS (SELECT * FROM d WHERE programid IN (1, 2) AND drb >= 0.3) SELECT a.candid AS _id, a.objectId AS objectId, CAST(count(*) AS INT) AS n, round(any_value(a.mag), 6) AS mag FROM a JOIN d b ON a.objectId = b.objectId AND b.programid IN (1, 2) AND b.jd <= a.jd AND a.jd - b.jd < 10 GROUP BY 1, 2 HAVING count(*) >= 3")
def pipeline_json_e2e(spark, sf):
    """A stored filter: its history is joined only after its first stage has thinned the alerts."""
    f = filters.Filter("f1", "ZTF", {"v1": json.dumps(_STORED)}, "v1", {"ZTF": [1, 2]})
    out = filters.run_filter(views.alerts(spark, sf), f, {"ZTF_objects": views.objects(spark, sf)})
    return out.select("_id", "objectId", F.col("annotations.n").alias("n"), F.round("annotations.mag", 6).alias("mag"))


@query(f"WITH {D}, h AS (SELECT a.candid, a.objectId FROM d a JOIN d b ON a.objectId = b.objectId AND b.programid IN (1, 2) AND b.jd <= a.jd AND a.jd - b.jd < 10 WHERE a.programid IN (1, 2) AND a.drb >= 0.3 GROUP BY 1, 2 HAVING count(*) >= 3), s AS (SELECT candid, objectId FROM d WHERE programid = 1 AND mag < 16), u AS (SELECT * FROM h UNION ALL SELECT * FROM s) SELECT candid AS _id, objectId, count(*) AS passed FROM u GROUP BY 1, 2")
def filters_per_alert(spark, sf):
    simple = [{"$match": {"candidate.magpsf": {"$lt": 16}}}, {"$project": {"objectId": 1}}]
    stored = [filters.Filter("f1", "ZTF", {"v": json.dumps(_STORED)}, "v", {"ZTF": [1, 2]}), filters.Filter("f2", "ZTF", {"v": json.dumps(simple)}, "v", {"ZTF": [1]})]
    out = filters.run_filters(views.alerts(spark, sf), stored, {"ZTF_objects": views.objects(spark, sf)})
    return out.select("_id", "objectId", F.size("filters").cast("long").alias("passed"))


@query(f"WITH {D} SELECT objectId, round(degrees(atan2(avg(s), avg(c))) - 360 * floor(degrees(atan2(avg(s), avg(c))) / 360), 5) AS ra FROM (SELECT objectId, sin(radians(drb * 10 + 355)) AS s, cos(radians(drb * 10 + 355)) AS c FROM d) GROUP BY 1")
def centroid(spark, sf):
    ra, _ = sky.centroid(F.col("candidate.drb") * 10 + 355, F.lit(0.0))
    return views.alerts(spark, sf).groupBy("objectId").agg(F.round(ra, 5).alias("ra"))


@query(f"WITH {D} SELECT objectId, count(DISTINCT jd) AS points, round(min(jd), 6) AS first_jd, round(max(jd), 6) AS last_jd FROM d GROUP BY 1")
def state_merge_stream(spark, sf):
    """The keyed merge of a stream, fed from the stored events, gives what one batch would."""
    return replayed.merged_objects(spark, sf)


# ---- enrichment, packets, bookkeeping ----


@query(f"WITH {D}, o AS (SELECT 'U' || ((CAST(substr(objectId, 2) AS BIGINT) + 1) % 150) AS alias, jd, programid FROM d WHERE programid = 1) SELECT a.candid AS _id, count(o.jd) AS points FROM d a LEFT JOIN o ON o.alias = a.objectId AND o.jd <= a.jd AND a.jd - o.jd < 365 GROUP BY 1")
def counterpart_alias(spark, sf):
    """The history of another survey's object, named by an alert's first alias; only its public points are seen."""
    at = (F.substring("objectId", 2, 20).cast("long") + 1) % 150  # the other survey has 150 objects, however many there are here
    mine, other = views.alerts(spark, sf), views.objects(spark, sf, F.concat(F.lit("U"), at.cast("string")))
    mine = mine.withColumn("aliases", F.struct(F.array("objectId").alias("ZTF")))
    out = filters.with_counterpart(mine, other, "ZTF", 365.0)
    return out.select("_id", F.coalesce(F.size(F.col("ZTF.prv_candidates")), F.lit(0)).cast("long").alias("points"))


@query(f"WITH {D} SELECT candid AS _id, objectId FROM d WHERE objectId = 'U7' AND mag <= 19 AND jd >= 2460310 ORDER BY candid LIMIT 40")
def alert_search(spark, sf):
    return api.alert_search(views.alerts(spark, sf), object_id="U7", ranges={"candidate.magpsf": (None, 19.0), "candidate.jd": (2460310.0, None)}, limit=40).select("_id", "objectId")


@query("SELECT o_orderstatus AS topic, sum(greatest(o_orderkey % 100 - o_custkey % 50, 0)) AS messages FROM orders GROUP BY 1")
def message_counts(spark, sf):
    o = views.load(spark, sf, "orders").select(F.col("o_orderstatus").alias("topic"), (F.col("o_custkey") % 50).alias("low"), (F.col("o_orderkey") % 100).alias("high"))
    return nights.message_counts(o)


@query("WITH d AS (SELECT o_custkey AS owner, o_orderstatus AS topic, o_orderpriority AS credential, greatest(coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0), 0) AS delta, o_orderkey % 100 AS high, o_custkey % 50 AS committed FROM orders) SELECT owner, round(sum(delta), 2) AS consumed, sum(greatest(high - committed, 0)) AS lag, count(DISTINCT topic) AS topics, count(DISTINCT credential) AS credentials FROM d GROUP BY 1")
def consumption(spark, sf):
    o = series.deltas(views.load(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    out = nights.consumption(o.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("topic"), F.col("o_orderpriority").alias("credential"), "delta", (F.col("o_orderkey") % 100).alias("high"), (F.col("o_custkey") % 50).alias("committed")))
    return out.withColumn("consumed", F.round("consumed", 2))


@query("WITH g AS (SELECT DISTINCT lower(replace(p_type, ' ', '-')) || '-' || p_size AS grp FROM part), o AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS owner FROM part WHERE p_size < 20), m AS (SELECT grp, owner, row_number() OVER (PARTITION BY grp ORDER BY length(owner) DESC) AS n FROM g JOIN o ON grp = owner OR starts_with(grp, owner || '-')) SELECT grp AS \"group\", owner FROM g LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (grp)")
def owner_by_prefix(spark, sf):
    p = views.load(spark, sf, "part")
    groups = p.select(F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_size").cast("string")).alias("group")).distinct()
    return nights.owner_of(groups, p.where("p_size < 20").select(F.lower(F.split("p_type", " ")[0]).alias("owner")).distinct())


@query(f"WITH {D} SELECT objectId, count(*) AS points, min(band) AS band, round(sum(mag), 4) AS flux FROM (SELECT objectId, 'ztf' || band AS band, mag FROM d) GROUP BY 1")
def packet_photometry(spark, sf):
    point = lambda p: F.struct(p["jd"].alias("jd"), p["magpsf"].alias("psfFlux"), p["sigmapsf"].alias("psfFluxErr"), p["band"].alias("band"), p["programid"].alias("programid"))
    o = views.objects(spark, sf).select("objectId", rules.packet_photometry("ZTF", F.transform("prv_candidates", point)).alias("p"))
    return o.select("objectId", F.size("p").cast("long").alias("points"), F.array_min(F.transform("p", lambda x: x["band"])).alias("band"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["flux"]), 4).alias("flux"))


@query(f"WITH {D} SELECT objectId, count(*) AS n, arg_min(candid, jd) AS first FROM d WHERE programid = 1 GROUP BY 1")
def classification_history(spark, sf):
    a = views.alerts(spark, sf).withColumn("classifications", F.when(F.col("candidate.programid") == 1, F.struct(F.col("candidate.drb").alias("drb"))))
    return api.history(a).select("objectId", F.size("history").cast("long").alias("n"), F.col("history")[0]["candid"].alias("first"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT a.id, count(*) AS n, min({_apart('a', 'b')}) * 3600 AS near FROM a, b WHERE {_apart('a', 'b')} <= 3 GROUP BY 1) SELECT a.id, coalesce(n, 0) AS n, round(coalesce(near, -1), 2) AS near FROM a LEFT JOIN m USING (id)")
def crossmatch_arrays(spark, sf):
    """Every object gets an array for the catalogue, empty where nothing matches."""
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "other")
    out = crossmatch.crossmatch(views.sky_positions(spark, sf, "customer", "c_custkey"), {"S": b}, [crossmatch.Catalog("S", 3 * 3600.0, ("other",))])
    return out.select(F.col("objectId").alias("id"), F.size("cross_matches.S").cast("long").alias("n"), F.round(F.coalesce(F.get(F.col("cross_matches.S"), F.lit(0))["distance_arcsec"], F.lit(-1.0)), 2).alias("near"))


@query("WITH w AS (SELECT c_custkey AS _id, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT _id, n + 1 AS n FROM w")
def watchlist_record(spark, sf):
    """Newly matched ids join those that a watchlist's rows have already."""
    wl = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.array(F.lit("old")).alias("matching_ztf_objects"))
    found = views.load(spark, sf, "orders").select(F.col("o_custkey").alias("_id"), F.col("o_orderkey").cast("string").alias("objectId"))
    return crossmatch.record_watchers(wl, found.unionByName(found), "matching_ztf_objects").select("_id", F.size("matching_ztf_objects").cast("long").alias("n"))


@query("SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 9.5::DOUBLE END AS updated_at FROM orders")
def written_back(spark, sf):
    from skyloom.sources import surveys

    o = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), "o_orderstatus")
    return surveys.written_back(o, o.where("_id % 3 = 0").select("_id", F.lit("changed").alias("o_orderstatus")), 9.5)


@query(f"WITH {D}, k AS (SELECT candid, mag < 15.5 AS star, CASE WHEN candid % 4 = 0 THEN NULL WHEN candid % 4 = 1 THEN 0.9 ELSE 0.4 END AS score, programid = 1 AS inside FROM d) SELECT candid, 'lsst.no-ztf-match.' || CASE WHEN star THEN 'stellar' WHEN score IS NULL AND inside THEN 'hostless' WHEN score IS NULL THEN 'unknown' WHEN score <= 0.5 THEN 'hosted' ELSE 'hostless' END AS topic FROM k")
def lsst_routing(spark, sf):
    a = views.alerts(spark, sf)
    score = F.when(F.col("_id") % 4 == 0, F.lit(None)).when(F.col("_id") % 4 == 1, 0.9).otherwise(0.4)
    near = F.filter(F.array(F.when(score.isNotNull(), F.struct(score.alias("score")))), lambda x: x.isNotNull())
    topic = rules.lsst_category(F.col("candidate.magpsf") < 15.5, F.lit(False), near, F.col("candidate.programid") == 1, F.lit(False))
    return a.select(F.col("_id").alias("candid"), topic.alias("topic"))


@query(f"WITH {D} SELECT 'ztf.' || band AS topic, count(*) AS packets FROM d GROUP BY 1")
def topic_groups(spark, sf):
    return rules.by_topic(views.detections(spark, sf).withColumn("topic", F.concat(F.lit("ztf."), F.col("band"))))


@query("SELECT o_orderkey, len(list_distinct(list_concat(a, b))) AS either, len(list_intersect(a, b)) AS common, len([x for x in a if NOT list_contains(b, x)]) AS only FROM (SELECT o_orderkey, coalesce(list_distinct(list(l_partkey % 10) FILTER (l_quantity > 25)), []) AS a, coalesce(list_distinct(list(l_partkey % 10) FILTER (l_quantity <= 25)), []) AS b FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def set_expressions(spark, sf):
    lines = views.load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("k"), "l_quantity")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("k"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") <= 25, F.col("k"))).alias("b"))
    o = views.load(spark, sf, "orders").select("o_orderkey").join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = lambda c: {"$ifNull": [f"${c}", []]}
    out = _run(o, [{"$project": {"o_orderkey": 1, "either": {"$size": {"$setUnion": [none("a"), none("b")]}}, "common": {"$size": {"$setIntersection": [none("a"), none("b")]}}, "only": {"$size": {"$setDifference": [none("a"), none("b")]}}}}])
    return out.select("o_orderkey", *(F.col(c).cast("long").alias(c) for c in ("either", "common", "only")))


@query("SELECT s_suppkey, round(53736 + s_suppkey % 4000 + 2400000.5 - CASE WHEN 53736 + s_suppkey % 4000 >= 57754 + 37 / 86400.0 THEN 37 WHEN 53736 + s_suppkey % 4000 >= 57204 + 36 / 86400.0 THEN 36 WHEN 53736 + s_suppkey % 4000 >= 56109 + 35 / 86400.0 THEN 35 WHEN 53736 + s_suppkey % 4000 >= 54832 + 34 / 86400.0 THEN 34 WHEN 53736 + s_suppkey % 4000 >= 53736 + 33 / 86400.0 THEN 33 ELSE 32 END / 86400.0::DOUBLE, 6) AS jd FROM supplier")
def tai_to_utc(spark, sf):
    return views.load(spark, sf, "supplier").select("s_suppkey", F.round(photometry.tai_mjd_to_jd((53736 + F.col("s_suppkey") % 4000).cast("double")), 6).alias("jd"))


@query(f"WITH {D} SELECT objectId, count(*) FILTER (programid <> 3) AS detections, count(*) FILTER (programid = 3) AS limits FROM d GROUP BY 1")
def display_curve(spark, sf):
    from skyloom.operators import enrich

    d = views.detections(spark, sf).select("objectId", "jd", F.when(F.col("programid") != 3, F.col("mag")).alias("mag"), F.lit(20.0).alias("snr"), F.lit(21.0).alias("diffmaglim"))
    return enrich.display_curve(d).groupBy("objectId").agg(F.count(F.when(F.col("kind") == "detection", 1)).alias("detections"), F.count(F.when(F.col("kind") == "limit", 1)).alias("limits"))


@query(f"WITH {D}, c AS (SELECT *, avg(drb) OVER (PARTITION BY objectId) AS r0, avg(sgscore1) OVER (PARTITION BY objectId) AS d0 FROM d) SELECT candid, round((drb - r0) * cos(radians(d0)) * 3600, 3) AS east, round((sgscore1 - d0) * 3600, 3) AS north FROM c")
def tangent_offsets(spark, sf):
    w = Window.partitionBy("objectId")
    a = views.alerts(spark, sf).select("_id", "objectId", F.col("candidate.drb").alias("ra"), F.col("candidate.sgscore1").alias("dec"))
    o = sky.offsets(F.col("ra"), F.col("dec"), F.avg("ra").over(w), F.avg("dec").over(w))
    return a.select(F.col("_id").alias("candid"), F.round(o["east"], 3).alias("east"), F.round(o["north"], 3).alias("north"))


@query(f"WITH {D} SELECT candid AS _id, CASE WHEN band <> 'y' THEN round((drb + sgscore1) / 2, 6) END AS score FROM d")
def scorer_stub(spark, sf):
    """Scores from a stand-in model over every alert: those without all features have none."""
    from skyloom.operators import models
    from skyloom.sources import images

    class Mean:
        def predict(self, features, triplets):
            return features.mean(1) + triplets.mean((1, 2, 3))

    blank = images.blank()
    rows = views.alerts(spark, sf).select("_id", F.col("candidate.drb").alias("drb"), F.when(F.col("candidate.band") != "y", F.col("candidate.sgscore1")).alias("sgscore1"), *(F.lit(blank).alias(c) for c in ("cutoutScience", "cutoutTemplate", "cutoutDifference")))
    rows = rows.repartition(spark.sparkContext.defaultParallelism)  # decoding and scoring take far longer than moving
    return models.scored(rows, {"mean": (Mean(), ("drb", "sgscore1"))}).select("_id", F.round("classifications.mean", 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from skyloom import catalogue_sources, catalogue_surveys  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: SQL[k] for k in queries() if k in SQL}
