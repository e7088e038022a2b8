"""More registered queries: survey records, stored tables, dry runs, packets and streams, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skyloom import api, views
from skyloom.catalogue import _STORED, D, _apart, _run, _sky, query
from skyloom.functions import photometry, sky
from skyloom.operators import coverage, crossmatch, enrich, lightcurve, models, rules, series
from skyloom.plans import filters
from skyloom.sources import surveys
from skyloom.streaming import replayed, stages, state

#: The SQL of a magnitude's flux at a zero point, in single precision.
_FLUX = "CAST(pow(10::DOUBLE, -0.4 * ({m} - {zp}::DOUBLE)) AS FLOAT)"
_MAG = "CAST(CAST(-2.5 * log10({f}) + {zp}::DOUBLE AS FLOAT) AS DOUBLE)"


def _long(name: str, c):
    return c.cast("long").alias(name)


# ---- expressions, lookups and positions ----


@query("SELECT p_partkey, p_size IN (1, 5, 10) AS inn, false AS text_is, true AS size_is, p_size AS b, p_partkey AS a, 3::BIGINT AS n, p_partkey + p_partkey % 7 AS two, p_partkey = p_partkey % 7 AS same FROM part")
def array_set_expressions(spark, sf):
    mod = lambda k: {"$mod": ["$p_partkey", k]}
    out = _run(views.load(spark, sf, "part"), [
        {"$addFields": {"cat": {"$concatArrays": [["$p_partkey"], [mod(7), mod(3)]]}, "m": {"$mergeObjects": [{"a": "$p_partkey", "b": 1}, {"b": "$p_size"}]}}},
        {"$project": {"p_partkey": 1, "inn": {"$in": ["$p_size", [1, 5, 10]]}, "text_is": {"$isNumber": "$p_name"}, "size_is": {"$isNumber": "$p_size"}, "b": "$m.b", "a": "$m.a", "n": {"$size": "$cat"}, "two": {"$reduce": {"input": {"$slice": ["$cat", 2]}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, "same": {"$setEquals": [["$p_partkey"], [mod(7)]]}}},
    ])
    return out.select("p_partkey", "inn", "text_is", "size_is", "b", "a", _long("n", F.col("n")), _long("two", F.col("two")), "same")


@query("SELECT o_orderkey, count(s_suppkey) AS suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def lookup_array_keys(spark, sf):
    """A lookup by an array of keys: equal arrays are looked up once, and a key that stands twice counts once."""
    keys = views.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("keys"))
    o = views.load(spark, sf, "orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "keys")
    out = _run(o, [{"$lookup": {"from": "supplier", "localField": "keys", "foreignField": "s_suppkey", "as": "s"}}, {"$project": {"o_orderkey": 1, "suppliers": {"$size": "$s"}, "total": {"$round": [{"$reduce": {"input": "$s.s_acctbal", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 2]}}}], supplier=views.load(spark, sf, "supplier"))
    return out.select("o_orderkey", _long("suppliers", F.col("suppliers")), "total")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(max(o_totalprice), 0), 2) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_unwind_outer(spark, sf):
    out = _run(views.load(spark, sf, "customer"), [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "price": "$o.o_totalprice"}}], orders=views.load(spark, sf, "orders"))
    return out.groupBy("c_custkey").agg(F.count("price").alias("n"), F.round(F.coalesce(F.max("price"), F.lit(0.0)), 2).alias("most"))


_POINT = "(SELECT 178.5::DOUBLE AS ra, 3.0::DOUBLE AS dec)"


def _placed(spark, sf):
    return views.sky_positions(spark, sf, "customer", "c_custkey").withColumn("coordinates", sky.coordinates(F.col("ra"), F.col("dec")))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, p AS {_POINT} SELECT id FROM a, p WHERE {_apart('a', 'p')} <= 12")
def geo_within(spark, sf):
    out = _run(_placed(spark, sf), [{"$match": {"coordinates.radec_geojson": {"$geoWithin": {"$centerSphere": [[-1.5, 3.0], 12 * 3.141592653589793 / 180]}}}}, {"$project": {"id": "$objectId"}}])
    return out.select("id")


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, p AS {_POINT} SELECT id, round({_apart('a', 'p')}, 4) AS dist FROM a, p WHERE {_apart('a', 'p')} <= 20 ORDER BY {_apart('a', 'p')} LIMIT 12")
def near_sphere(spark, sf):
    out = _run(_placed(spark, sf), [{"$match": {"coordinates.radec_geojson": {"$nearSphere": [-1.5, 3.0], "$maxDistance": 20 * 3.141592653589793 / 180}}}, {"$limit": 12}])
    return out.select(F.col("objectId").alias("id"), F.round(sky.separation(F.col("ra"), F.col("dec"), F.lit(178.5), F.lit(3.0)), 4).alias("dist"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')} SELECT id, round(ra - 180, 6) AS lon, round(dec, 6) AS lat FROM a")
def geo_coordinates(spark, sf):
    pair = F.col("coordinates.radec_geojson.coordinates")
    return _placed(spark, sf).select(F.col("objectId").alias("id"), F.round(pair[0], 6).alias("lon"), F.round(pair[1], 6).alias("lat"))


#: Positions with the poles and right ascension 0 among them, and the nested numbers of their cells at depth 11.
_CELLS = f"""{_sky('a0', 'customer', 'c_custkey')}, a AS (SELECT id, CASE id % 50 WHEN 0 THEN 0.0 WHEN 1 THEN 360.0 ELSE ra END::DOUBLE AS ra, CASE id % 50 WHEN 2 THEN 90.0 WHEN 3 THEN -90.0 ELSE dec END::DOUBLE AS dec FROM a0),
e AS (SELECT id, sin(radians(dec)) AS z, (ra % 360) / 90 AS t, dec, CAST(least(floor((ra % 360) / 90), 3) AS BIGINT) AS k FROM a),
f AS (SELECT *, CAST(floor(2048 * (0.5 + t - 0.75 * z)) AS BIGINT) AS p, CAST(floor(2048 * (0.5 + t + 0.75 * z)) AS BIGINT) AS m, 2048 * sqrt(6::DOUBLE) * sin(radians(90 - abs(dec)) / 2) AS s FROM e),
g AS (SELECT id, CASE WHEN abs(z) <= 2 / 3::DOUBLE THEN CASE WHEN p // 2048 = m // 2048 THEN p // 2048 % 4 + 4 WHEN p // 2048 < m // 2048 THEN p // 2048 % 4 ELSE m // 2048 % 4 + 8 END WHEN z > 0 THEN k ELSE k + 8 END AS face,
  CASE WHEN abs(z) <= 2 / 3::DOUBLE THEN m % 2048 WHEN z > 0 THEN 2047 - least(2047, CAST(floor((1 - t + k) * s) AS BIGINT)) ELSE least(2047, CAST(floor((t - k) * s) AS BIGINT)) END AS x,
  CASE WHEN abs(z) <= 2 / 3::DOUBLE THEN 2047 - p % 2048 WHEN z > 0 THEN 2047 - least(2047, CAST(floor((t - k) * s) AS BIGINT)) ELSE least(2047, CAST(floor((1 - t + k) * s) AS BIGINT)) END AS y FROM f),
h AS (SELECT id, face * 4194304 + list_sum([(((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1)) for i in range(11)])::BIGINT AS cell FROM g),
c AS (SELECT CAST(1 + s_suppkey % 6 AS INT) AS depth, s_suppkey * 7919 % (12 * CAST(pow(4, 1 + s_suppkey % 6) AS BIGINT)) AS cell FROM supplier WHERE s_suppkey % 3 <> 0),
v AS (SELECT id, h.cell, coalesce(bool_or(h.cell // CAST(pow(4, 11 - depth) AS BIGINT) = c.cell), false) AS covered FROM h LEFT JOIN c ON h.cell // CAST(pow(4, 11 - depth) AS BIGINT) = c.cell GROUP BY 1, 2)"""


def _covered(spark, sf):
    k = F.col("objectId") % 50
    a = views.sky_positions(spark, sf, "customer", "c_custkey").withColumns({"ra": F.when(k == 0, 0.0).when(k == 1, 360.0).otherwise(F.col("ra")), "dec": F.when(k == 2, 90.0).when(k == 3, -90.0).otherwise(F.col("dec"))})
    depth = 1 + F.col("s_suppkey") % 6
    cells = views.load(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(depth.cast("int").alias("depth"), (F.col("s_suppkey") * 7919 % (12 * F.pow(F.lit(4.0), depth).cast("long"))).alias("cell"))
    return coverage.covered(a, coverage.ranges(cells, 11), 11)


@query(f"WITH {_CELLS} SELECT id, cell, covered FROM v")
def sky_coverage(spark, sf):
    """Cells at depth 11, and whether a map of cells of several depths holds them."""
    return _covered(spark, sf).select(F.col("objectId").alias("id"), coverage.pixel(F.col("ra"), F.col("dec"), 11).alias("cell"), "covered")


@query(f"WITH {_CELLS} SELECT id, CASE WHEN id % 4 = 1 THEN true WHEN covered OR id % 4 = 2 THEN false END AS star, 'lsst.no-ztf-match.' || CASE WHEN id % 4 = 1 THEN 'stellar' WHEN id % 4 = 2 THEN 'hosted' WHEN covered THEN 'hostless' ELSE 'unknown' END AS topic FROM v")
def lsst_in_coverage(spark, sf):
    """Flags and topics of sources with and without neighbours, inside and outside the map."""
    k = F.col("objectId") % 4
    kind = "array<struct<distance_arcsec:double,score:double,mag_white:double>>"
    near = F.when(k == 1, F.array(F.struct(F.lit(0.5).alias("distance_arcsec"), F.lit(0.9).alias("score"), F.lit(18.0).alias("mag_white")))).when(k == 2, F.array(F.struct(F.lit(0.5).alias("distance_arcsec"), F.lit(0.1).alias("score"), F.lit(18.0).alias("mag_white")))).otherwise(F.array()).cast(kind)
    flags = rules.lsst_flags(near, F.col("covered"), F.lit(None).cast("long"))
    topic = rules.lsst_category(flags["star"], flags["near_brightstar"], near, F.col("covered"), F.lit(False))
    return _covered(spark, sf).select(F.col("objectId").alias("id"), flags["star"].alias("star"), topic.alias("topic"))


_UNIT = "u AS (SELECT g, avg(cos(radians(dec)) * cos(radians(ra))) AS x, avg(cos(radians(dec)) * sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM (SELECT *, id % 20 AS g FROM a) GROUP BY g)"


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_UNIT} SELECT g, round(degrees(atan2(y, x)) - 360 * floor(degrees(atan2(y, x)) / 360), 4) AS ra, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS dec FROM u")
def centroid_on_sphere(spark, sf):
    ra, dec = sky.centroid(F.col("ra"), F.col("dec"))
    a = views.sky_positions(spark, sf, "customer", "c_custkey").withColumn("g", F.col("objectId") % 20)
    return a.groupBy("g").agg(F.round(ra, 4).alias("ra"), F.round(dec, 4).alias("dec"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, o AS (SELECT id, ((ra - 350 + 180) - 360 * floor((ra - 350 + 180) / 360) - 180) * cos(radians(30::DOUBLE)) * 3600 AS e, (dec - 30) * 3600 AS n FROM a) SELECT id, round(e, 3) AS east, round(n, 3) AS north, round(sqrt(e * e + n * n), 3) AS radial FROM o")
def offsets_across_zero(spark, sf):
    o = sky.offsets(F.col("ra"), F.col("dec"), F.lit(350.0), F.lit(30.0))
    return views.sky_positions(spark, sf, "customer", "c_custkey").select(F.col("objectId").alias("id"), *(F.round(o[k], 3).alias(k) for k in ("east", "north", "radial")))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT a.id, count(*) AS n FROM a, b WHERE {_apart('a', 'b')} <= 4 GROUP BY 1) SELECT a.id, coalesce(n, 0) AS n, 1::BIGINT AS others FROM a LEFT JOIN m USING (id)")
def rematch(spark, sf):
    """Matches of one catalogue made anew; those of another stay."""
    kind = "array<struct<distance_arcsec:double,row:struct<other:bigint,ra:double,dec:double>>>"
    o = views.sky_positions(spark, sf, "customer", "c_custkey").withColumn("cross_matches", F.struct(F.array().cast(kind).alias("S"), F.array(F.lit(1)).alias("T")))
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "other")
    out = crossmatch.rematch(o, {"S": b}, crossmatch.Catalog("S", 4 * 3600.0, ("other",)))
    return out.select(F.col("objectId").alias("id"), _long("n", F.size("cross_matches.S")), _long("others", F.size("cross_matches.T")))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)} SELECT a.id, b.id AS other FROM a, b WHERE {_apart('a', 'b')} <= 2")
def pairs_from_right(spark, sf):
    a = views.sky_positions(spark, sf, "customer", "c_custkey").withColumnRenamed("objectId", "id")
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).toDF("other", "ra_b", "dec_b")
    return crossmatch.pairs_within(a, b, 2 * 3600.0, right_at=("ra_b", "dec_b"), reach="right").select("id", "other")


# ---- records of the surveys ----


@query(f"WITH {D} SELECT candid, CASE candid % 4 WHEN 0 THEN NULL WHEN 1 THEN 'g' WHEN 2 THEN 'r' ELSE 'i' END AS band, candid % 2 = 0 AS positive, CAST(sign(0.5 - candid % 2) AS DOUBLE) AS way, round(log10(pow(10::DOUBLE, -0.4 * (mag - 23.9)) * 1e9), 4) AS lg, round(1.0857362 / mag_err, 2) AS snr FROM d")
def ztf_fluxes(spark, sf):
    d = views.detections(spark, sf).select("candid", F.struct((F.col("candid") % 4).cast("int").alias("fid"), F.when(F.col("candid") % 2 == 0, "t").otherwise("f").alias("isdiffpos"), F.lit("null").alias("ssnamenr"), F.col("mag").alias("magpsf"), F.col("mag_err").alias("sigmapsf"), F.col("mag").alias("magap"), F.col("mag_err").alias("sigmagap")).alias("c"))
    n = photometry.ztf_candidate(F.col("c"))
    flux = n["psfFlux"].cast("double")
    return d.select("candid", n["band"].alias("band"), n["isdiffpos"].alias("positive"), F.signum(flux).alias("way"), F.round(F.log10(F.abs(flux)), 4).alias("lg"), F.round(n["snr_ap"].cast("double"), 2).alias("snr"))


@query(f"WITH {D} SELECT objectId, count(*) AS n, round(sum({_MAG.format(f='mag * 10', zp=31.4)}), 1) AS ap, round(sum(CAST(CAST(mag / (candid % 5 + 1) AS FLOAT) AS DOUBLE)), 2) AS chi, count(*) FILTER (candid % 4 <> 0) AS seen FROM d GROUP BY 1")
def rescaled_apertures(spark, sf):
    """Aperture magnitudes and reduced chi squared recomputed; where noise is large there is no magnitude of the point."""
    p = F.struct("jd", (F.col("mag") * 100).alias("psfFlux"), F.when(F.col("candid") % 4 == 0, F.col("mag") * 50).otherwise(F.lit(2.0)).alias("psfFluxErr"), (-F.col("mag") * 10).alias("apFlux"), F.lit(1.0).alias("apFluxErr"), F.col("mag").alias("psfChi2"), (F.col("candid") % 5 + 1).alias("psfNdata"))
    d = views.detections(spark, sf).groupBy("objectId").agg(F.collect_list(p).alias("points"))
    twice = api.rescaled(api.rescaled(d, "points"), "points").select("objectId", F.explode("points").alias("p"))
    return twice.groupBy("objectId").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p.magap").cast("double")), 1).alias("ap"), F.round(F.sum(F.col("p.chipsf").cast("double")), 2).alias("chi"), F.count("p.magpsf").alias("seen"))


@query(f"SELECT l_orderkey, count(*) FILTER (l_linenumber <> 7) AS points, count(*) FILTER (l_linenumber <> 7 AND l_linenumber <> 6 AND l_extendedprice > 3 * 400 * l_quantity) AS seen, coalesce(round(sum(CASE WHEN l_linenumber < 6 AND l_extendedprice > 3 * 400 * l_quantity THEN {_MAG.format(f='l_extendedprice', zp=31.4)} END), 2), 0) AS mags, coalesce(round(sum(CASE WHEN l_linenumber <> 7 THEN {_MAG.format(f='5 * 400 * l_quantity', zp=31.4)} END), 2), 0) AS limits, count(*) FILTER (l_linenumber < 6 AND l_extendedprice > 3 * 400 * l_quantity AND l_discount <= 0.05) AS positive FROM lineitem GROUP BY 1")
def lsst_forced_points(spark, sf):
    """Forced points of one survey: magnitudes above the least signal-to-noise, limits for all that have an error."""
    sign = F.when(F.col("l_discount") <= 0.05, 1.0).otherwise(-1.0)
    p = F.struct((59000.0 + F.col("l_linenumber")).alias("midpointMjdTai"), F.lit("r").alias("band"), F.when(F.col("l_linenumber") != 6, sign * F.col("l_extendedprice")).alias("psfFlux"), F.when(F.col("l_linenumber") != 7, 400.0 * F.col("l_quantity")).alias("psfFluxErr"))
    o = views.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(photometry.lsst_forced(F.collect_list(p)).alias("p"))
    total = lambda name: F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + F.coalesce(x[name].cast("double"), F.lit(0.0))), 2)
    return o.select("l_orderkey", _long("points", F.size("p")), _long("seen", F.size(F.filter("p", lambda x: x["magpsf"].isNotNull()))), total("magpsf").alias("mags"), total("diffmaglim").alias("limits"), _long("positive", F.size(F.filter("p", lambda x: F.coalesce(x["isdiffpos"], F.lit(False))))))


@query(f"SELECT l_orderkey, l_linenumber, round({_MAG.format(f='l_extendedprice', zp=31.4)}, 3) AS mag, round({_MAG.format(f='5 * l_quantity', zp=31.4)}, 3) AS lim, l_discount <= 0.05 AS positive, round(CAST(CAST(l_extendedprice / l_quantity AS FLOAT) AS DOUBLE), 1) AS snr, round(53736 + l_linenumber + 2400000.5 - CASE WHEN 53736 + l_linenumber >= 53736 + 33 / 86400.0 THEN 33 ELSE 32 END / 86400.0::DOUBLE, 6) AS jd, 1::INT AS ndet FROM lineitem")
def lsst_sources(spark, sf):
    sign = F.when(F.col("l_discount") <= 0.05, 1.0).otherwise(-1.0)
    flux = sign * F.col("l_extendedprice")
    s = F.struct((53736.0 + F.col("l_linenumber")).alias("midpointMjdTai"), F.lit("r").alias("band"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"), flux.alias("psfFlux"), F.col("l_quantity").alias("psfFluxErr"), flux.alias("apFlux"), F.col("l_quantity").alias("apFluxErr"), F.lit(4.0).alias("psfChi2"), F.lit(2).alias("psfNdata"))
    t = views.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", photometry.lsst_source(s).alias("s"))
    history = photometry.lsst_history(F.lit(None).cast("struct<firstDiaSourceMjdTai:double,nDiaSources:int>"), F.col("s.jd"))
    return t.select("l_orderkey", "l_linenumber", F.round(F.col("s.magpsf").cast("double"), 3).alias("mag"), F.round(F.col("s.diffmaglim").cast("double"), 3).alias("lim"), F.col("s.isdiffpos").alias("positive"), F.round(F.col("s.snr").cast("double"), 1).alias("snr"), F.round(history["jdstarthist"], 6).alias("jd"), history["ndethist"].alias("ndet"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 1000, 2) AS decam, round(59000 + l_linenumber + 2400000.5::DOUBLE, 3) AS jd, CASE l_linenumber WHEN 1 THEN 'j' WHEN 2 THEN 'h' WHEN 3 THEN 'k' ELSE 'y' END AS band, round(log10(pow(10::DOUBLE, -0.4 * (l_quantity / 10 + 15 - 31.4))), 4) AS lg FROM lineitem")
def decam_winter_fluxes(spark, sf):
    q = F.col("l_quantity")
    c = F.struct((59000.0 + F.col("l_linenumber")).alias("mjd"), q.alias("forcediffimflux"), (q / 5).alias("forcediffimfluxunc"), (q / 10 + 15).alias("magpsf"), F.lit(0.1).alias("sigmapsf"), F.col("l_linenumber").alias("fid"), F.lit(1.0).alias("jd"))
    d, w = photometry.decam_candidate(c), photometry.winter_candidate(c)
    return views.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(d["flux_njy"], 2).alias("decam"), F.round(d["jd"], 3).alias("jd"), w["band"].alias("band"), F.round(F.log10(w["flux_njy"].cast("double")), 4).alias("lg"))


@query(f"WITH {D}, k AS (SELECT candid, CAST(CASE candid % 4 WHEN 0 THEN 0.49 WHEN 1 THEN 0.2 WHEN 2 THEN 0.76 ELSE 0.5 END AS FLOAT) AS s, CAST(0.2 AS FLOAT) AS drb FROM d) SELECT candid, s > CAST(0.76 AS FLOAT) AS star, s > CAST(0.49 AS FLOAT) AS near_brightstar, drb >= CAST(0.2 AS FLOAT) AS pub FROM k")
def star_rules_in_single_precision(spark, sf):
    """Scores that lie on a threshold, stored as floats."""
    k = F.col("candid") % 4
    s = F.when(k == 0, 0.49).when(k == 1, 0.2).when(k == 2, 0.76).otherwise(0.5).cast("float")
    given = {"sgscore1": s, "distpsnr1": F.lit(0.9).cast("float"), "srmag1": F.lit(15.0).cast("float")}
    flags = rules.ztf_flags(lambda name: given.get(name, F.lit(None).cast("float")))
    return views.detections(spark, sf).select("candid", flags["star"].alias("star"), flags["near_brightstar"].alias("near_brightstar"), rules.ztf_public(F.lit(1), flags["rock"], F.lit(0.2).cast("float")).alias("pub"))


@query(f"WITH {D} SELECT candid, candid % 3 <> 0 AND drb < 0.5 AND candid % 5 <> 0 AS pub, designation IS NOT NULL AS is_sso, designation, CASE WHEN ssdistnr >= 2 THEN ssdistnr - 2 END AS distance, (CASE WHEN candid % 2 = 0 THEN 1 ELSE 0 END + 1)::BIGINT AS scores FROM d")
def survey_blocks(spark, sf):
    """Publishing gate of one survey, the solar-system block and the list of scores of another."""
    c = lambda n: F.col(f"candidate.{n}")
    given = {"ssdistnr": c("ssdistnr") - 2, "ssmagnr": c("magpsf"), "ssnamenr": F.coalesce(c("ssnamenr"), F.lit("null"))}
    sso = rules.sso(lambda n: given[n])
    gate = rules.lsst_public(F.when(F.col("_id") % 3 == 0, -1.0).otherwise(0.5), c("drb") >= 0.5, F.col("_id") % 5 == 0)
    scores = rules.classifications({"drb": c("drb"), "rb": F.when(F.col("_id") % 2 == 0, 0.5)})
    return views.alerts(spark, sf).select(F.col("_id").alias("candid"), gate.alias("pub"), F.coalesce(sso["is_sso"], F.lit(False)).alias("is_sso"), sso["designation"].alias("designation"), sso["distance"].alias("distance"), _long("scores", F.size(scores)))


@query(f"WITH {D} SELECT objectId, count(*) FILTER (programid = 1 AND candid % 4 <> 0) AS pub, count(*) FILTER (candid % 4 <> 0 AND candid % 5 <> 0) AS forced, round(coalesce(sum(mag) FILTER (candid % 4 <> 0 AND candid % 5 <> 0), 0), 1) AS total FROM d GROUP BY 1")
def forced_and_public_points(spark, sf):
    d = views.detections(spark, sf)
    flux = F.when(F.col("candid") % 4 == 0, -99999.0).otherwise(F.col("mag"))
    p = F.struct("jd", "programid", F.when(F.col("candid") % 4 != 0, F.col("mag")).alias("psfFlux"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"), F.when(F.col("candid") % 5 == 0, "61").otherwise("0").alias("procstatus"), flux.alias("forcediffimflux"), F.lit(0.5).alias("forcediffimfluxunc"), F.lit(23.9).alias("magzpsci"))
    o = d.groupBy("objectId").agg(F.collect_list(p).alias("points"))
    forced = enrich.forced_points(F.col("points"))
    return o.select("objectId", _long("pub", F.size(rules.public_points(F.col("points")))), _long("forced", F.size(forced)), F.round(F.aggregate(forced, F.lit(0.0), lambda s, x: s + x["psfFlux"].cast("double")), 1).alias("total"))


# ---- time series ----


@query(f"WITH {D} SELECT objectId, count(*) FILTER (programid <> 3) AS seen, count(*) FILTER (programid = 3) AS limits, count(*) AS again, count(DISTINCT floor(jd)) AS days FROM d GROUP BY 1")
def series_split_merge(spark, sf):
    """Detections and limits apart, merged again in order of time, and the first of each day."""
    d = views.detections(spark, sf)
    p = F.struct("jd", F.when(F.col("programid") != 3, F.col("mag")).alias("magpsf"))
    o = d.groupBy("objectId").agg(F.collect_list(p).alias("points"))
    seen, limits = series.split_detections(F.col("points"))
    merged = series.merged_by_time(seen, limits)
    ordered = F.when(F.forall(F.zip_with(merged, F.slice(merged, 2, F.greatest(F.size(merged) - 1, F.lit(0))), lambda a, b: b.isNull() | (a["jd"] <= b["jd"])), lambda x: x), F.size(merged))
    days = series.first_of_time(d.withColumn("jd", F.floor("jd").cast("double")), ["objectId"], "candid").groupBy("objectId").agg(F.count("*").alias("days"))
    return o.select("objectId", _long("seen", F.size(seen)), _long("limits", F.size(limits)), _long("again", ordered)).join(days, "objectId")


@query(f"WITH {D}, p AS (SELECT *, row_number() OVER (PARTITION BY objectId ORDER BY jd, band, mag) AS place FROM d), k AS (SELECT *, min(struct_pack(m := CAST(mag AS DOUBLE), p := place)) OVER (PARTITION BY objectId, band) AS peak, min(jd) OVER (PARTITION BY objectId, band) AS j0 FROM p), s AS (SELECT objectId, band, jd - j0 AS x, mag AS y FROM k WHERE place <= peak.p), g AS (SELECT objectId, band, count(*) AS n, avg(x) AS mx, avg(y) AS my, max(x) - min(x) AS dt, min(y) AS lo, max(y) AS hi FROM s GROUP BY 1, 2), c AS (SELECT s.objectId, s.band, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (x - mx)) AS xx FROM s JOIN g USING (objectId, band) GROUP BY 1, 2) SELECT objectId, band, CAST(n AS INT) AS n, round(xy / xx, 3) AS rate FROM g JOIN c USING (objectId, band) WHERE n > 1 AND dt > 0.01 AND lo + 0.05 < hi - 0.05 AND xx * 400 >= 1e-10")
def rising_slope(spark, sf):
    s = lightcurve.band_stats(lightcurve.prepared(views.detections(spark, sf)))
    return s.where("rising IS NOT NULL").select("objectId", "band", F.col("rising.nb_data").alias("n"), F.round(F.col("rising.rate").cast("double"), 3).alias("rate"))


@query(f"WITH {D} SELECT objectId, round(max(jd) - min(jd), 4) AS age, round(max(jd) - arg_min(jd, struct_pack(m := mag, j := jd)), 4) AS since, round(arg_min(jd, struct_pack(m := mag, j := jd)) - min(jd), 4) AS until, round(min(mag), 4) AS peak, round(max(mag), 4) AS faint FROM d WHERE band = 'g' GROUP BY 1")
def curve_features(spark, sf):
    """Light-curve features of a model, from the points that ``points_of`` makes of stored arrays."""
    o = views.objects(spark, sf)
    points = lightcurve.points_of(o, ["prv_candidates"], least_snr=3.0).where("band = 'g'")
    stats = lightcurve.photstats(lightcurve.prepared(points))
    f = models.curve_features(F.col("last_jd"), F.col, F.lit(0))
    return stats.select("objectId", F.round(f["age"], 4).alias("age"), F.round(f["days_since_peak"], 4).alias("since"), F.round(f["days_to_peak"], 4).alias("until"), F.round(f["peakmag_so_far"].cast("double"), 4).alias("peak"), F.round(f["maxmag_so_far"].cast("double"), 4).alias("faint"))


@query(f"WITH {D} SELECT objectId, count(*) AS n, round(sum({_MAG.format(f="mag * 100", zp=31.4)}), 1) AS mags, round(sum(CAST(CAST(mag * 100 / 2 AS FLOAT) AS DOUBLE)), 0) AS snr FROM d GROUP BY 1")
def rescaled_points(spark, sf):
    d = views.detections(spark, sf).groupBy("objectId").agg(F.collect_list(F.struct("jd", (F.col("mag") * 100).alias("psfFlux"), F.lit(2.0).alias("psfFluxErr"))).alias("points"))
    once = api.rescaled(d, "points")
    twice = api.rescaled(once, "points").select("objectId", F.explode("points").alias("p"))
    return twice.groupBy("objectId").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p.magpsf").cast("double")), 1).alias("mags"), F.round(F.sum(F.col("p.snr").cast("double")), 0).alias("snr"))


# ---- stored tables and searches ----


@query("SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def insert_if_absent(spark, sf):
    """Rows whose key is stored stay out; of rows with equal keys one comes in."""
    stored = views.load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("_id"))
    return surveys.insert_new(stored, views.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_id"))).select("_id")


@query(f"WITH {D} SELECT candid AS _id, candid % 2 = 0 AS has_cutouts FROM d WHERE objectId LIKE 'U1%' AND jd <= 2460320")
def back_fill(spark, sf):
    """Alerts of known objects up to a time, and which of them have images."""
    a = views.alerts(spark, sf)
    known = views.objects(spark, sf).where(F.col("objectId").startswith("U1"))
    cutouts = a.where("_id % 2 = 0").select("_id", F.lit(b"x").alias("cutoutScience"))
    have, lack = surveys.with_cutouts(surveys.known_only(a, known, max_jd=2460320.0), surveys.insert_new(a.limit(0), cutouts.unionByName(cutouts)))
    return have.select("_id", F.lit(True).alias("has_cutouts")).unionByName(lack.select("_id", F.lit(False).alias("has_cutouts")))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, p AS (SELECT 170.0::DOUBLE AS ra, 5.0::DOUBLE AS dec), u AS (SELECT 'LSST' AS survey, id, {_apart('b', 'p')} * 3600 AS dist FROM b, p UNION ALL SELECT 'ZTF', id, {_apart('a', 'p')} * 3600 FROM a, p) SELECT survey, CAST(id AS VARCHAR) AS id, round(dist, 2) AS dist FROM u WHERE dist <= 108000 ORDER BY u.dist, survey, id LIMIT 10")
def objects_around(spark, sf):
    at = lambda t, k, s: views.sky_positions(spark, sf, t, k, s).withColumn("objectId", F.col("objectId").cast("string"))
    out = api.objects_near({"ZTF": at("customer", "c_custkey", 0.0), "LSST": at("supplier", "s_suppkey", 0.001)}, 170.0, 5.0, 108000.0)
    return out.select("survey", F.col("objectId").alias("id"), F.round("distance_arcsec", 2).alias("dist"))


@query("SELECT 'ZTF' AS survey, 'ZTF18' || lpad(CAST(c_custkey AS VARCHAR), 7, 'a') AS id FROM customer WHERE starts_with('ZTF18' || lpad(CAST(c_custkey AS VARCHAR), 7, 'a'), 'ZTF18aaaaa') ORDER BY id LIMIT 10")
def objects_by_prefix(spark, sf):
    o = views.load(spark, sf, "customer").select(F.concat(F.lit("ZTF18"), F.lpad(F.col("c_custkey").cast("string"), 7, "a")).alias("objectId"))
    return api.object_search(spark, {"ZTF": o}, "ztf18AAAAA").select("survey", F.col("objectId").alias("id"))


@query("SELECT CASE WHEN o_totalprice > 100000 THEN 'ok' WHEN o_orderstatus = 'F' THEN 'late' ELSE 'failed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def outcomes(spark, sf):
    o = views.load(spark, sf, "orders").select((F.col("o_totalprice") > 100000).alias("ok"), F.when(F.col("o_orderstatus") == "F", "late").alias("why"))
    return api.tally(o, "ok", "why")


# ---- dry runs, packets, properties ----


@query(f"WITH {D}, a AS (SELECT * FROM d WHERE programid IN (1, 2) AND drb >= 0.3 AND jd BETWEEN 2460315 AND 2460321) SELECT a.candid AS _id, CAST(count(*) AS INT) AS n FROM a JOIN d b ON a.objectId = b.objectId AND b.programid IN (1, 2) AND b.jd <= a.jd AND a.jd - b.jd < 10 GROUP BY 1, a.mag HAVING count(*) >= 3 ORDER BY a.mag DESC, 1 LIMIT 20")
def dry_run(spark, sf):
    f = filters.Filter("f1", "ZTF", {"v1": json.dumps(_STORED)}, "v1", {"ZTF": [1, 2]})
    out = filters.dry_run(views.alerts(spark, sf), f, {"ZTF_objects": views.objects(spark, sf)}, 2460315.0, 2460321.0, sort={"candidate.magpsf": -1}, limit=20)
    return out.select("_id", F.col("annotations.n").alias("n"))


@query(f"WITH {D} SELECT candid AS _id, count(*) AS passed, CAST(sum(n_nationkey) AS BIGINT) AS which FROM d, nation WHERE n_regionkey <> 0 AND n_nationkey % 7 <> 0 AND mag < 15 + n_nationkey / 5.0::DOUBLE AND (programid = 1 OR programid = 2 AND n_nationkey % 2 = 0) GROUP BY 1")
def stored_filters(spark, sf):
    """Filters loaded from a table: the active version of the active ones, without those that may not run."""
    n = F.col("n_nationkey")
    text = F.when(n % 7 == 0, F.lit('[{"$group": {"_id": null}}]')).otherwise(F.format_string('[{"$match": {"candidate.magpsf": {"$lt": %s}}}, {"$project": {"objectId": 1, "annotations.k": {"$abs": %s}}}]', (15 + n / 5.0).cast("string"), n.cast("string")))
    rows = views.load(spark, sf, "nation").select(
        F.col("n_name").alias("_id"), F.lit("ZTF").alias("survey"), (F.col("n_regionkey") != 0).alias("active"), F.lit("v2").alias("active_fid"),
        F.array(F.struct(F.lit("v1").alias("fid"), F.lit("[]").alias("pipeline")), F.struct(F.lit("v2").alias("fid"), text.alias("pipeline"))).alias("fv"), F.create_map(F.lit("ZTF"), F.when(n % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("permissions"),
    )
    good, _ = filters.sound_filters(filters.load_filters(rows, "ZTF"))
    out = filters.run_filters(views.alerts(spark, sf), good, {"ZTF_objects": views.objects(spark, sf)})
    which = F.aggregate("filters", F.lit(0).cast("long"), lambda s, x: s + F.get_json_object(x["annotations"], "$.k").cast("double").cast("long"))
    return out.select("_id", _long("passed", F.size("filters")), which.alias("which"))


@query(f"WITH {D}, a AS (SELECT * FROM d WHERE programid IN (1, 2) ORDER BY jd DESC, candid DESC LIMIT 200) SELECT candid AS _id FROM a WHERE mag < 16")
def dry_run_latest(spark, sf):
    """What a filter passes of the newest alerts that it may see."""
    f = filters.Filter("f", "ZTF", {"v": json.dumps([{"$match": {"candidate.magpsf": {"$lt": 16}}}, {"$project": {"objectId": 1}}])}, "v", {"ZTF": [1, 2]})
    return filters.dry_run(views.alerts(spark, sf), f, {}, latest=200).select("_id")


def _standing(n: int) -> list[filters.Filter]:
    """Filters of rising brightness; every other one looks at the history that its programmes allow."""
    out = []
    for k in range(n):
        stages = [{"$match": {"candidate.magpsf": {"$lt": 15 + k / 5}, "candidate.drb": {"$gte": k % 5 / 10}}}]
        if k % 2:
            stages += [{"$addFields": {"n": {"$size": "$prv_candidates"}}}, {"$match": {"n": {"$gte": 3 + k}}}]
        stages.append({"$project": {"objectId": 1, "annotations.n": "$n" if k % 2 else {"$abs": 0}}})
        out.append(filters.Filter(f"f{k:03d}", "ZTF", {"v": json.dumps(stages)}, "v", {"ZTF": [1, 2] if k % 4 < 2 else [1]}))
    return out


@query(f"""WITH {D}, h AS (SELECT a.candid, count(*) FILTER (b.programid = 1) AS n1, count(*) FILTER (b.programid IN (1, 2)) AS n2 FROM d a JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd AND a.jd - b.jd < 365 GROUP BY 1),
w AS (SELECT d.candid, objectId, k, CASE WHEN k % 4 < 2 THEN n2 ELSE n1 END AS n FROM d JOIN h USING (candid), range(25) AS t(k) WHERE mag < 15 + k / 5::DOUBLE AND drb >= (k % 5) / 10::DOUBLE AND (programid = 1 OR programid = 2 AND k % 4 < 2))
SELECT candid AS _id, objectId, count(*) AS passed, CAST(sum(k) AS BIGINT) AS which, CAST(sum(CASE WHEN k % 2 = 1 THEN n ELSE 0 END) AS BIGINT) AS points FROM w WHERE k % 2 = 0 OR n >= 3 + k GROUP BY 1, 2""")
def many_filters(spark, sf):
    """25 standing filters in one scan of the alerts and one join with the objects."""
    out = filters.run_filters(views.alerts(spark, sf), _standing(25), {"ZTF_objects": views.objects(spark, sf)})
    total = lambda each: F.aggregate("filters", F.lit(0).cast("long"), lambda s, x: s + each(x))
    return out.select("_id", "objectId", _long("passed", F.size("filters")), total(lambda x: F.substring(x["filter_id"], 2, 3).cast("long")).alias("which"), total(lambda x: F.coalesce(F.get_json_object(x["annotations"], "$.n").cast("double").cast("long"), F.lit(0))).alias("points"))


@query(f"WITH {D}, a AS (SELECT * FROM d WHERE programid = 1 AND mag < 16) SELECT a.candid AS _id, a.objectId, 1::BIGINT AS passed, count(b.jd) FILTER (b.programid = 1) AS points, a.candid % 2 = 0 AS pictured FROM a LEFT JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd GROUP BY 1, 2")
def result_packets(spark, sf):
    a = views.alerts(spark, sf)
    f = filters.Filter("f2", "ZTF", {"v": json.dumps([{"$match": {"candidate.magpsf": {"$lt": 16}}}, {"$project": {"objectId": 1}}])}, "v", {"ZTF": [1]})
    found = filters.run_filters(a, [f], {"ZTF_objects": views.objects(spark, sf)})
    cutouts = a.where("_id % 2 = 0").select("_id", F.lit(b"x").alias("cutoutScience"))
    out = filters.result_packets(found, a, views.objects(spark, sf), cutouts, programs=[1])
    return out.select("_id", "objectId", _long("passed", F.size("filters")), _long("points", F.size("photometry")), F.col("cutouts").isNotNull().alias("pictured"))


def _told(out, *more, stats="properties.photstats", stationary=True):
    """Figures over all bands, and how many bands rise and fall, and how fast in sum."""
    bands = F.map_values(f"{stats}.bands")
    rate = lambda part: F.round(F.aggregate(bands, F.lit(0.0), lambda s, v: s + F.coalesce(v[part]["rate"].cast("double"), F.lit(0.0))), 3)
    count = lambda part: _long(f"n_{part}", F.size(F.filter(bands, lambda v: v[part].isNotNull())))
    return out.select("_id", *more, *([F.col("properties.stationary").alias("stationary")] if stationary else []), *(F.round(F.col(f"{stats}.{c}").cast("double"), 4).alias(c) for c in ("peak_mag", "faintest_mag")), count("rising"), rate("rising").alias("rising"), count("fading"), rate("fading").alias("fading"))


def _as_of(who: str, points: str = "SELECT a._id, b.band, b.jd, b.mag FROM a JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd") -> str:
    """u: what ``_told`` says of the alerts a, from all points up to each one."""
    part = lambda name, side: f"""CASE WHEN max(t) FILTER ({side}) - min(t) FILTER ({side}) > 0.01 AND min(m) FILTER ({side}) + CAST(0.05 AS FLOAT) < max(m) FILTER ({side}) - CAST(0.05 AS FLOAT)
    THEN CAST(CAST(regr_slope(CAST(m AS DOUBLE), t) FILTER ({side}) AS FLOAT) AS DOUBLE) END AS {name}"""  # noqa: E731
    return f"""a AS MATERIALIZED (SELECT * FROM (SELECT *, candid AS _id FROM d) WHERE {who}), p AS ({points}),
f AS (SELECT _id, band, jd - 2460300 AS t, CAST(mag AS FLOAT) AS m, row_number() OVER (PARTITION BY _id, band ORDER BY jd, mag) AS place FROM p QUALIFY row_number() OVER (PARTITION BY _id, band, jd ORDER BY mag) = 1),
k AS (SELECT *, (min(struct_pack(m := m, p := place)) OVER (PARTITION BY _id, band)).p AS pk FROM f),
g AS (SELECT _id, band, min(t) AS t0, max(t) AS t1, min(m) AS lo, max(m) AS hi, {part("rising", "place <= pk")}, {part("fading", "place >= pk")} FROM k GROUP BY 1, 2),
u AS (SELECT _id, max(t1) - min(t0) > 0.01 AS stationary, round(CAST(min(lo) AS DOUBLE), 4) AS peak_mag, round(CAST(max(hi) AS DOUBLE), 4) AS faintest_mag, count(rising) AS n_rising, round(coalesce(sum(rising), 0), 3) AS rising, count(fading) AS n_fading, round(coalesce(sum(fading), 0), 3) AS fading, count(*) AS bands FROM g GROUP BY 1)"""


@query(f"WITH {D}, {_as_of('programid = 1')} SELECT u.* EXCLUDE (bands), ssdistnr < 12 AS rock FROM u JOIN a USING (_id)")
def enrich_properties(spark, sf):
    """Flags and light-curve statistics of every public alert, from the points up to it."""
    out = enrich.ztf_properties(views.alerts(spark, sf).where("candidate.programid = 1"), views.objects(spark, sf))
    return _told(out, F.col("properties.rock").alias("rock"))


@query(f"WITH {D}, {_as_of('programid = 2')} SELECT _id, _id % 5 = 0 AS rock, _id % 3 = 0 AS star, u.* EXCLUDE (_id, bands) FROM u")
def lsst_enriched(spark, sf):
    near = F.array(F.struct(F.when(F.col("_id") % 3 == 0, 0.5).otherwise(5.0).alias("distance_arcsec"), F.lit(0.9).alias("score"), F.lit(18.0).alias("mag_white")))
    a = views.alerts(spark, sf).where("candidate.programid = 2")
    a = a.withColumn("candidate", F.col("candidate").withField("neighbours", near).withField("ssObjectId", F.when(F.col("_id") % 5 == 0, F.col("_id") + 1)))
    return _told(enrich.lsst_properties(a, views.objects(spark, sf)), F.col("properties.rock").alias("rock"), F.col("properties.star").alias("star"))


@query(f"WITH {D}, {_as_of('programid = 2')} SELECT u.* EXCLUDE (bands) FROM u")
def decam_winter_enriched(spark, sf):
    return _told(enrich.plain_properties(views.alerts(spark, sf).where("candidate.programid = 2"), views.objects(spark, sf)))


@query(f"WITH {D}, {_as_of('programid = 2', """SELECT a._id, b.band, b.jd, b.mag FROM a JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd UNION ALL
  SELECT a._id, 'lsst' || b.band, b.jd, b.mag FROM a JOIN d b ON 'U' || ((CAST(substr(a.objectId, 2) AS BIGINT) + 1) % 150) = b.objectId AND b.jd <= a.jd""")} SELECT u.* EXCLUDE (stationary) FROM u")
def multisurvey_photstats(spark, sf):
    """Statistics over an object's points and those of its counterpart, whose bands stay apart."""
    alias = F.concat(F.lit("U"), ((F.substring("objectId", 2, 20).cast("long") + 1) % 150).cast("string"))
    a = views.alerts(spark, sf).where("candidate.programid = 2").withColumn("aliases", F.struct(F.array(alias).alias("LSST")))
    o = views.objects(spark, sf)
    out = enrich.multisurvey_photstats(a, o, {"LSST": o})
    return _told(out, _long("bands", F.size("photstats.bands")), stats="photstats", stationary=False)


@query(f"""WITH {D}, a AS (SELECT candid, objectId, jd FROM d WHERE programid = 1), g AS (SELECT a.candid AS _id, b.candid AS c, b.jd, CAST(b.mag AS FLOAT) AS m, a.jd AS now FROM a JOIN d b ON a.objectId = b.objectId AND b.jd <= a.jd AND b.band = 'g' AND b.candid % 7 <> 0)
SELECT _id, round(max(jd) - min(jd), 4) AS age, round(any_value(now) - arg_min(jd, struct_pack(m := m, j := jd)), 4) AS since, round(CAST(min(m) AS DOUBLE), 4) AS peak, count(*) > 0 AS seen FROM g GROUP BY 1""")
def features_as_of(spark, sf):
    """Light-curve features of a model at each alert; forced points whose status isn't "0" don't count."""
    o = views.detections(spark, sf).groupBy("objectId").agg(F.array_sort(F.collect_list(F.struct("jd", F.col("mag").alias("magpsf"), F.col("mag_err").alias("sigmapsf"), "band", F.lit(99.0).alias("snr"), F.when(F.col("candid") % 7 == 0, F.when(F.col("candid") % 2 == 0, "61")).otherwise("0").alias("procstatus"), F.lit(23.9).alias("magzpsci")))).alias("fp_hists"))
    a = views.alerts(spark, sf).where("candidate.programid = 1")
    s = enrich.alert_bands(a, o, {"fp_hists": enrich.LEAST_SNR}).where("band = 'g'").join(a, "_id")
    f = models.curve_features(F.col("candidate.jd"), F.col, F.lit(0))
    return s.select("_id", F.round(F.col("last_jd") - F.col("first_jd"), 4).alias("age"), F.round(f["days_since_peak"], 4).alias("since"), F.round(f["peakmag_so_far"].cast("double"), 4).alias("peak"), F.lit(True).alias("seen"))


# ---- streams ----


def _at(key: str):
    return F.pmod(key * F.lit(137.50776405003785), F.lit(360.0)), F.degrees(F.asin(2 * F.pmod(key * F.lit(0.6180339887498949), F.lit(1.0)) - 1))


@query(f"WITH {D}, {_sky('u', '(SELECT DISTINCT user_id FROM events)', 'user_id')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT 'U' || u.id AS objectId, count(b.id) AS n FROM u LEFT JOIN b ON {_apart('u', 'b')} <= 6 GROUP BY 1) SELECT candid AS _id, objectId, n AS matched FROM d JOIN m USING (objectId) WHERE mag < 16 AND programid = 1")
def three_stages(spark, sf):
    """A stream in several batches: stored, matched on first sight, enriched, filtered."""
    alerts = _placed_alerts(replayed.in_batches(spark, sf, 3))
    supplier = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001)
    s = _stages(spark, supplier, {"$size": "$cross_matches.S"}, lambda: {"LSST": supplier.withColumn("objectId", F.col("objectId").cast("string"))})
    stages.run(alerts, s, replayed.shared_folder(spark, "progress")).awaitTermination()
    return _noted(spark, s, "matched")


def _placed_alerts(events):
    d = views.as_detections(events).withColumn("k", F.substring("objectId", 2, 20).cast("long"))
    ra, dec = _at(F.col("k"))
    c = F.struct("jd", F.col("mag").alias("magpsf"), F.col("mag_err").alias("sigmapsf"), "band", "programid", ra.alias("ra"), dec.alias("dec"))
    return d.select(F.col("candid").alias("_id"), "objectId", c.alias("candidate"))


def _stages(spark, supplier, note, others):
    f = filters.Filter("f", "ZTF", {"v": json.dumps([{"$match": {"candidate.magpsf": {"$lt": 16}}}, {"$project": {"objectId": 1, "annotations.note": note}}])}, "v", {"ZTF": [1]})
    return stages.Stages(replayed.shared_folder(spark, "stages"), {"S": supplier.withColumnRenamed("objectId", "other")}, [crossmatch.Catalog("S", 6 * 3600.0, ("other",))], others, lambda: [f])


def _noted(spark, s, name):
    out = s.table(spark, "results", "_id bigint, objectId string, filters array<struct<filter_id:string,annotations:string>>")
    return out.select("_id", "objectId", F.get_json_object(F.col("filters")[0]["annotations"], "$.note").cast("long").alias(name))


@query(f"WITH {D}, m AS (SELECT d.candid AS _id, d.objectId, CASE WHEN candid % 2 = 1 AND degrees(asin(2 * ((s_suppkey * 0.6180339887498949::DOUBLE) % 1) - 1)) <= 33.5 THEN 1 ELSE 0 END AS named FROM d LEFT JOIN supplier ON d.objectId = 'U' || s_suppkey WHERE mag < 16 AND programid = 1) SELECT _id, objectId, CAST(named AS BIGINT) AS named FROM m")
def late_counterparts(spark, sf):
    """A counterpart that appears between two batches, where the other survey looks at all, is named by the alerts that
    come after; alerts that come again count once."""
    supplier = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.0002)
    other = supplier.withColumn("objectId", F.col("objectId").cast("string"))
    folder, checkpoint = replayed.shared_folder(spark, "arriving"), replayed.shared_folder(spark, "progress")
    events = views.load(spark, sf, "events")
    there = [other.where("false")]
    s = _stages(spark, supplier, {"$size": "$aliases.LSST"}, lambda: {"LSST": there[0]})
    for part in (events.where("event_id % 2 = 0"), events):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        stages.run(_placed_alerts(stream), s, checkpoint).awaitTermination()
        there[0] = other
    return _noted(spark, s, "named")


@query("SELECT strftime(date_trunc('day', ts - INTERVAL 19 HOUR) + INTERVAL 19 HOUR, '%Y-%m-%d %H') AS noon, count(*) AS n FROM events GROUP BY 1")
def nightly_stream(spark, sf):
    """Counts by observing night of a stream, in which repeated alerts count once."""
    folder, checkpoint = replayed.shared_folder(spark, "nights"), replayed.shared_folder(spark, "progress")
    e = replayed.in_batches(spark, sf, 2).withColumn("ts", F.col("ts").cast("timestamp"))
    once = state.deduplicated(e, "event_id", "ts", "400 days")
    nights = once.groupBy(F.window("ts", "1 day", "1 day", "19 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("noon"), "n")
    sink = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(folder)
    nights.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema("noon timestamp, n long, batch int").parquet(folder).groupBy("noon").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("noon", "yyyy-MM-dd HH").alias("noon"), "n")
