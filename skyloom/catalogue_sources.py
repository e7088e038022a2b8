"""Registered queries of packets, images, models, stored tables and pages, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skyloom import api, views
from skyloom.catalogue import D, _apart, _sky, query
from skyloom.functions import photometry
from skyloom.operators import crossmatch, enrich, lightcurve, models, nights, rules, series
from skyloom.plans import filters
from skyloom.sources import images, packets, surveys, tables
from skyloom.streaming import replayed, topics


def _framed(i, value):
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(i.cast("long")), 8, "0")), value)


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderkey % 10 = 1 AS late FROM orders WHERE o_orderkey % 10 <> 0")
def framed_packets(spark, sf):
    """Rows as framed packets and back. Cut packets stay out; those of a schema that was unknown are read again from the
    bytes that were kept."""
    o = views.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    schema, key = packets.avro_schema(o.schema, "order"), F.col("key").cast("long")
    value = F.when(key % 10 == 0, F.expr("substring(value, 1, length(value) - 4)")).otherwise(F.col("value"))
    sent = packets.encode(o, "order", "o_orderkey").select(_framed(F.when(key % 10 == 1, 704).otherwise(703), value).alias("value"))
    read = packets.decode(sent, o.schema, packets.Framed({703: schema}))
    again = packets.decode(packets.quarantined(read).select("raw"), o.schema, packets.Framed({703: schema, 704: schema}), "raw")
    both = packets.good(read).withColumn("late", F.lit(False)).unionByName(packets.good(again).withColumn("late", F.lit(True)))
    return both.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(f"WITH {D} SELECT candid AS _id, CASE WHEN candid % 2 = 0 THEN 1 ELSE 2 END AS first, CASE WHEN candid % 3 = 0 THEN 2 ELSE 1 END AS last, 4 + 1 + 4::BIGINT AS packed_bytes FROM d WHERE programid = 1 AND (candid % 2 = 0 OR candid % 3 = 0)")
def cutout_store(spark, sf):
    """Images put in two batches that share keys, and got by key: the first or the last of each."""
    folder = replayed.shared_folder(spark, "cutouts")
    a = views.alerts(spark, sf).select("_id", F.col("candidate.programid").alias("p"))
    surveys.put_cutouts(a.where("_id % 2 = 0").select("_id", F.lit(b"1").alias("science")), folder, 1)
    for _ in range(2):  # run again after a failure, a batch replaces itself
        surveys.put_cutouts(a.where("_id % 3 = 0").select("_id", F.lit(b"2").alias("science")), folder, 2)
    keys = a.where("p = 1").select("_id")
    held = lambda latest, name: surveys.get_cutouts(spark, folder, keys, latest=latest).select("_id", F.decode("science", "utf-8").cast("int").alias(name), F.col("science").alias(f"{name}_image"))
    out = held(False, "first").join(held(True, "last"), "_id")
    return out.select("_id", "first", "last", F.length(surveys.packed(F.col("first_image"), F.lit(None).cast("binary"))).cast("long").alias("packed_bytes"))


def _with_image(rows, bright):
    """Rows with a FITS image whose first ``bright`` pixels are one; plain column functions build its bytes."""
    cards = [f"{k:<8}= {v:>20}" for k, v in (("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", images.SIZE), ("NAXIS2", images.SIZE))]
    header = F.lit("".join(c.ljust(80) for c in [*cards, "END"]).ljust(2880).encode())
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # a short table is one task, its images are not
    light = F.unhex(F.concat(F.repeat(F.lit("3F800000"), bright), F.repeat(F.lit("00000000"), images.SIZE**2 - bright)))
    return rows.withColumn("image", F.concat(header, light))


@query("SELECT s_suppkey, round(sqrt((s_suppkey % 9 + 1)::DOUBLE), 3) AS norm, CAST(s_suppkey % 9 + 1 AS DOUBLE) AS lit_up, 3969::BIGINT AS n, 0.5::DOUBLE AS mended FROM supplier WHERE s_suppkey % 4 <> 0")
def image_pixels(spark, sf):
    """Images decoded, normalised and stretched for display; what is no image has no pixels."""
    n = (F.col("s_suppkey") % 9 + 1).cast("int")
    s = _with_image(views.load(spark, sf, "supplier").select("s_suppkey"), n).withColumn("image", F.when(F.col("s_suppkey") % 4 != 0, F.col("image")).otherwise(F.lit(b"junk")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    p = s.select("s_suppkey", images.pixels("image").alias("p")).where("p IS NOT NULL")
    mended = images.cleaned(F.array(F.lit(float("nan")), F.lit(0.25), F.lit(1e30), F.lit(0.75), F.lit(0.5)))[2]
    return p.select("s_suppkey", F.round(total(F.col("p")), 3).alias("norm"), F.round(total(images.stretched(F.col("p"))), 3).alias("lit_up"), F.size("p").cast("long").alias("n"), mended.alias("mended"))


@query("SELECT s_suppkey AS _id, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN round(s_suppkey * 325 + 5200 + 3 * sqrt((s_suppkey % 9 + 1)::DOUBLE), 3) END AS score, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN round(s_suppkey + 24 + s_suppkey, 3)::DOUBLE END AS other FROM supplier")
def models_scored(spark, sf):
    """Two models with their features in order; alerts without images or without one feature have no scores."""

    class Weighted:
        def predict(self, features, triplets):
            return features @ range(1, features.shape[1] + 1) + triplets.sum((1, 2, 3))

    class Ends:
        def predict(self, features, triplets):
            return features[:, 0] + features[:, -1]

    k, names = F.col("s_suppkey"), models.CANDIDATE_FEATURES
    given = {n: F.when((k % 7 != 0) | F.lit(i != 11), k + i).cast("double") for i, n in enumerate(names)}
    s = _with_image(views.load(spark, sf, "supplier").select(k.alias("_id"), k, *(c.alias(n) for n, c in given.items())), (k % 9 + 1).cast("int"))
    image = F.when(k % 5 != 0, F.col("image"))
    s = s.withColumns({c: image for c in ("cutoutScience", "cutoutTemplate", "cutoutDifference")})
    out = models.scored(s, {"weighted": (Weighted(), names), "ends": (Ends(), (names[-1], names[0]))})
    return out.select("_id", F.round("classifications.weighted", 3).alias("score"), F.round("classifications.ends", 3).alias("other"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' ztf18' || lower(CAST('ABC' AS VARCHAR)) || ' ' WHEN 1 THEN 'SSO' || c_custkey WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'zT' WHEN 4 THEN 'ZTF1' ELSE '' END AS id FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ZTF' WHEN 1 THEN 'LSST' WHEN 2 THEN 'LSST' WHEN 3 THEN 'ZTF' END AS survey, CASE c_custkey % 6 WHEN 0 THEN 'ZTF18abc' WHEN 1 THEN 'sso' || c_custkey WHEN 2 THEN id WHEN 3 THEN 'ZT' END AS id FROM t""")
def object_ids(spark, sf):
    """The survey of an id and its spelling there."""
    k = F.col("c_custkey")
    key = k.cast("string")
    text = F.when(k % 6 == 0, " ztf18abc ").when(k % 6 == 1, F.concat(F.lit("SSO"), key)).when(k % 6 == 2, key).when(k % 6 == 3, "zT").when(k % 6 == 4, "ZTF1").otherwise("")
    return views.load(spark, sf, "customer").select("c_custkey", api.surveys_of(text).alias("s")).select("c_custkey", "s.survey", "s.id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderkey % 3 AS INT) END AS program, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey END AS candid FROM orders")
def queued_tasks(spark, sf):
    """Queued tasks taken apart; what is none has nulls."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat_ws(",", k % 3, k)).when(k % 4 == 1, F.concat_ws(",", k % 3, -k)).when(k % 4 == 2, F.concat_ws(",", k % 3 + 10, k)).otherwise(F.concat_ws(",", k % 3, F.lit("x")))
    return views.load(spark, sf, "orders").select("o_orderkey", filters.tasks_of(text).alias("t")).select("o_orderkey", "t.program", "t.candid")


@query(f"""WITH {D}, o AS (SELECT objectId, jd FROM d WHERE candid % 3 <> 0), n AS (SELECT DISTINCT objectId, jd FROM d WHERE candid % 2 = 0), a AS (SELECT * FROM n ANTI JOIN o USING (objectId, jd)), s AS (SELECT objectId, max(jd) AS last FROM o GROUP BY 1),
x AS (SELECT objectId, count(*) AS added, min(jd) AS first FROM a GROUP BY 1), m AS (SELECT objectId, count(DISTINCT jd) AS points FROM d WHERE candid % 3 <> 0 OR candid % 2 = 0 GROUP BY 1)
SELECT objectId, points, coalesce(added, 0) AS added, coalesce(first < last, false) AS resort, true AS increasing FROM m LEFT JOIN s USING (objectId) LEFT JOIN x USING (objectId)""")
def series_updates(spark, sf):
    """What new points add to stored ones, whether they come late, and both as one series."""
    d = views.detections(spark, sf)
    p = F.struct("jd", F.col("mag").alias("magpsf"))
    o = d.groupBy("objectId").agg(F.collect_list(F.when(F.col("candid") % 3 != 0, p)).alias("old"), F.collect_list(F.when(F.col("candid") % 2 == 0, p)).alias("new")).where("size(old) + size(new) > 0")
    o = o.select("objectId", series.clean(F.col("old")).alias("old"), "new")
    u = o.select("objectId", series.update_of(F.col("old"), F.col("new")).alias("u"), series.merge(F.col("old"), F.col("new")).alias("m"))
    return u.select("objectId", F.size("m").cast("long").alias("points"), F.size("u.add").cast("long").alias("added"), F.col("u.resort").alias("resort"), series.is_increasing(F.col("m")).alias("increasing"))


@query(f"WITH {D}, {_sky('u', '(SELECT DISTINCT user_id FROM events)', 'user_id')}, {_sky('b', 'supplier', 's_suppkey', 0.0003)} SELECT 'U7' AS objectId, (SELECT count(*) FROM d WHERE objectId = 'U7') AS alerts, (SELECT arg_min(candid, struct_pack(j := jd, c := candid)) FROM d WHERE objectId = 'U7') AS first_alert, CAST(b.id AS VARCHAR) AS counterpart, round({_apart('u', 'b')} * 3600, 3) AS dist FROM u LEFT JOIN b ON {_apart('u', 'b')} * 3600 <= 2 WHERE u.id = 7")
def object_page(spark, sf):
    """An object's page with its alerts and its nearest counterpart."""
    a = views.alerts(spark, sf)
    o = views.load(spark, sf, "events").select(F.col("user_id").alias("k")).distinct()
    ra, dec = F.pmod(F.col("k") * F.lit(137.50776405003785), F.lit(360.0)), F.degrees(F.asin(2 * F.pmod(F.col("k") * F.lit(0.6180339887498949), F.lit(1.0)) - 1))
    o = o.select(F.concat(F.lit("U"), F.col("k").cast("string")).alias("objectId"), ra.alias("ra"), dec.alias("dec"))
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.0003).withColumn("objectId", F.col("objectId").cast("string"))
    near = F.get("counterparts", F.lit(0))
    return api.object_page(a, o, {"LSST": b}, "U7").select("objectId", F.size("alerts").cast("long").alias("alerts"), F.col("alerts")[0]["_id"].alias("first_alert"), near["objectId"].alias("counterpart"), F.round(near["distance_arcsec"], 3).alias("dist"))


@query(f"WITH {D} SELECT candid AS _id, objectId FROM d WHERE band = 'g' ORDER BY jd DESC, candid LIMIT 20 OFFSET 5")
def find_options(spark, sf):
    """A query with a projection, an order by name, rows passed over and a limit."""
    store = api.Store(spark, {"alerts": views.alerts(spark, sf)})
    return store.find("alerts", {"candidate.band": "g"}, {"objectId": 1}, {"candidate.jd": "descending", "_id": "asc"}, skip=5, limit=20)


@query("SELECT l_linenumber, CASE WHEN l_linenumber < 3 THEN 1800 WHEN l_linenumber <= 7 THEN 86400 ELSE 31536000 END AS seconds, CASE WHEN 3 * l_linenumber < 3 THEN 1800 WHEN 3 * l_linenumber <= 7 THEN 86400 ELSE 31536000 END AS thrice, count(*) AS n FROM lineitem GROUP BY 1")
def cache_lifetimes(spark, sf):
    age = F.col("l_linenumber")
    return views.load(spark, sf, "lineitem").groupBy(age).agg(F.count("*").alias("n")).select("l_linenumber", nights.cache_seconds_of(age).alias("seconds"), nights.cache_seconds_of(3 * age).alias("thrice"), "n")


@query("WITH e AS (SELECT event_id, 'ztf_' || strftime(ts, '%Y%m%d') || '_programid' || (event_id % 3 + 1) AS topic FROM events), n AS (SELECT topic, count(*) AS due, count(*) FILTER (substr(topic, 12, 1) IN ('0', '2', '4', '6', '8') OR topic LIKE '%1') AS had FROM e GROUP BY 1) SELECT event_id, topic FROM e JOIN n USING (topic) WHERE due <> had")
def archive_replay(spark, sf):
    """Packets of an archive by night and programme; topics that hold all of theirs are passed over."""
    topic = F.concat(F.lit("ztf_"), F.date_format("ts", "yyyyMMdd"), F.lit("_programid"), (F.col("event_id") % 3 + 1).cast("string"))
    archive = views.load(spark, sf, "events").select("event_id", topic.alias("topic"))
    done = (F.substring("topic", 12, 1).cast("int") % 2 == 0) | F.col("topic").endswith("1")
    sent = archive.where(done).groupBy("topic").agg(F.count("*").alias("messages"))
    broken_off = archive.where(~done).groupBy("topic").agg((F.count("*") - 1).alias("messages"))
    return surveys.unsent(archive, sent.unionByName(broken_off)).select("event_id", "topic")


@query("SELECT DISTINCT strftime(CAST(ts AS DATE) - CAST(i AS INT), '%Y-%m-%d') AS night, 'ztf_' || strftime(CAST(ts AS DATE) - CAST(i AS INT), '%Y%m%d') || '_programid' || p AS topic FROM events, range(3) r(i), range(1, 3) q(p)")
def subscribed_topics(spark, sf):
    """Topics that a reader of each day follows: that day's and the two before it, of two programmes, each once."""
    days = views.load(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return surveys.topics_of(days, "day", "ZTF", 2, (1, 2)).select(F.date_format("night", "yyyy-MM-dd").alias("night"), "topic").distinct()


#: Crowds of positions: at a pole, across right ascension 0, and at a corner of coarse cells; and a third of all in one.
_CROWDS = """c AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey * 7.3) % 360 WHEN 1 THEN (359.98::DOUBLE + o_orderkey % 401 * 1e-4) % 360 WHEN 2 THEN 44.99 + o_orderkey % 211 * 1e-4 WHEN 3 THEN (o_orderkey * 137.2) % 360 ELSE 200 + o_orderkey % 17 * 1e-5 END::DOUBLE AS ra,
  CASE o_orderkey % 6 WHEN 0 THEN 89.99 + o_orderkey % 101 * 1e-4 WHEN 1 THEN -0.01 + o_orderkey % 199 * 1e-4 WHEN 2 THEN 41.8 + o_orderkey % 223 * 1e-4 WHEN 3 THEN (o_orderkey * 0.37) % 180 - 90 ELSE 12 + o_orderkey % 19 * 1e-5 END::DOUBLE AS dec FROM orders)"""


def _crowds(spark, sf):
    k = F.col("o_orderkey")
    of = lambda *values: F.when(k % 6 == 0, values[0]).when(k % 6 == 1, values[1]).when(k % 6 == 2, values[2]).when(k % 6 == 3, values[3]).otherwise(values[4])
    turn = F.lit(360.0)
    ra = of(F.pmod(k * 7.3, turn), F.pmod(359.98 + k % 401 * 1e-4, turn), 44.99 + k % 211 * 1e-4, F.pmod(k * 137.2, turn), 200 + k % 17 * 1e-5)
    dec = of(89.99 + k % 101 * 1e-4, -0.01 + k % 199 * 1e-4, 41.8 + k % 223 * 1e-4, F.pmod(k * 0.37, F.lit(180.0)) - 90, 12 + k % 19 * 1e-5)
    return views.load(spark, sf, "orders").select(k.alias("id"), ra.alias("ra"), dec.alias("dec"))


@query(f"""WITH {_CROWDS}, p AS (SELECT * FROM (VALUES ('pole', 120.0::DOUBLE, 89.9953::DOUBLE, 13.7::DOUBLE), ('zero', 0.0003, 0.0007, 13.7), ('corner', 45.0, 41.81, 13.7), ('crowd', 200.00005, 12.00005, 13.7), ('none', 300.0, -45.0, 13.7)) t(name, ra, dec, radius))
SELECT p.name, count(*) AS n, sum(c.id)::BIGINT AS ids FROM c, p WHERE {_apart('c', 'p')} * 3600 <= radius GROUP BY 1""")
def stored_cones(spark, sf):
    """Cones over a stored table that is laid out by sky, at a pole, across right ascension 0 and in crowds."""
    folder = replayed.shared_folder(spark, "by-sky")
    tables.write_by_sky(_crowds(spark, sf), folder, depth=1)
    stored = spark.read.parquet(folder)
    asked = spark.createDataFrame([("pole", 120.0, 89.9953), ("zero", 0.0003, 0.0007), ("corner", 45.0, 41.81), ("crowd", 200.00005, 12.00005), ("none", 300.0, -45.0)], "name string, ra double, dec double")
    found = crossmatch.cone_search(tables.around(stored, asked, 13.7), asked, 13.7)
    return found.groupBy("name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 13 = 5 GROUP BY 1")
def stored_by_key(spark, sf):
    """Rows of some keys out of a stored table that is laid out by key: only their buckets are read."""
    folder = replayed.shared_folder(spark, "by-key")
    orders = views.load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    tables.write_by_key(orders, folder, "o_custkey", 32)
    keys = views.load(spark, sf, "customer").where("c_custkey % 13 = 5").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    held = tables.buckets_of(spark.read.parquet(folder), keys, "o_custkey")
    out = keys.join(held, "o_custkey", "left").groupBy("c_custkey")
    return out.agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query(f"WITH {_sky('a', 'customer', 'c_custkey')}, {_sky('b', 'supplier', 's_suppkey', 0.001)}, m AS (SELECT a.id, count(*) AS n FROM a, b WHERE {_apart('a', 'b')} <= 4 GROUP BY 1) SELECT a.id, coalesce(n, 0) AS n, 1::BIGINT AS others, 2::BIGINT AS version, 0::BIGINT AS seen_between FROM a LEFT JOIN m USING (id)")
def rematch_stored(spark, sf):
    """Stored objects matched anew by a run that is stopped before it is published, and started again."""
    kind = "array<struct<distance_arcsec:double,row:struct<other:bigint,ra:double,dec:double>>>"
    o = views.sky_positions(spark, sf, "customer", "c_custkey").withColumn("cross_matches", F.struct(F.array().cast(kind).alias("S"), F.array(F.lit(1)).alias("T")))
    b = views.sky_positions(spark, sf, "supplier", "s_suppkey", 0.001).withColumnRenamed("objectId", "other")
    stored, how = tables.Versions(spark, replayed.shared_folder(spark, "objects")), crossmatch.Catalog("S", 4 * 3600.0, ("other",))
    stored.replace("load", lambda _: o)

    class Stopped(Exception):
        pass

    def stop(before, after):
        raise Stopped

    try:
        stored.replace("again", lambda before: crossmatch.rematch(before, {"S": b}, how), stop)
    except Stopped:
        between = stored.read().select("objectId", F.size("cross_matches.S").cast("long").alias("seen_between"))
    version = crossmatch.rematch_stored(stored, "again", {"S": b}, how)
    out = stored.read().join(between, "objectId")
    return out.select(F.col("objectId").alias("id"), F.size("cross_matches.S").cast("long").alias("n"), F.size("cross_matches.T").cast("long").alias("others"), F.lit(version).cast("long").alias("version"), "seen_between")


@query("SELECT event_id, 'ztf_' || strftime(ts, '%Y%m%d') || '_programid' || (event_id % 3 + 1) AS topic, 1::BIGINT AS times, true AS dense FROM events WHERE event_id % 3 < 2")
def topics_read(spark, sf):
    """Packets sent to topics in batches, one of them twice, and read by a reader that is stopped and started again. Each
    comes once, and the offsets of each topic and partition have no gaps."""
    folder, progress, out = (replayed.shared_folder(spark, n) for n in ("topics", "progress", "packets"))
    topic = F.concat(F.lit("ztf_"), F.date_format("ts", "yyyyMMdd"), F.lit("_programid"), (F.col("event_id") % 3 + 1).cast("string"))
    sent = views.load(spark, sf, "events").select("event_id", topic.alias("topic"), F.col("event_id").cast("string").alias("key"), F.encode(F.col("event_id").cast("string"), "utf-8").alias("value"))
    for batch, part in ((0, 0), (1, 1), (1, 1)):
        topics.send(sent.where(F.col("event_id") % 2 == part), folder, batch)
    first = dt.date(1970, 1, 1)
    stream = topics.open_topics(spark, folder, "reader", surveys.topic_pattern("ZTF", (1, 2)), first, days=40_000, most=40_000)

    def each(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    def reading(**trigger):
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(**trigger).start()

    reading(availableNow=True).awaitTermination()  # what one batch admits
    rest = reading(processingTime="0 seconds")
    rest.processAllAvailable()
    rest.stop()
    got = spark.read.schema(f"{topics.PACKETS}, batch int").parquet(out)
    whole = got.groupBy("topic", "partition").agg((F.count("*") == F.max("offset") + 1).alias("dense"))
    rows = got.groupBy(F.decode("value", "utf-8").cast("long").alias("event_id"), "topic", "partition").agg(F.count("*").alias("times"))
    return rows.join(whole, ["topic", "partition"]).select("event_id", "topic", "times", "dense")


@query("""WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1), e AS (SELECT l_suppkey, v, v[CAST(floor(0.01 * len(v)) AS INT) + 1] AS low, v[CAST(floor(0.95 * len(v)) AS INT) + 1] AS high FROM s)
SELECT l_suppkey, round(low, 2) AS low, round(high, 2) AS high, round(CASE WHEN low = high THEN 0.5 * len(v) ELSE list_sum([(greatest(low, least(high, x)) - low) / (high - low) for x in v]) END, 4) AS lit FROM e""")
def pixel_limits(spark, sf):
    """Limits of values at two ranks, and the values between them as 0 to 1."""
    v = views.load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_extendedprice").alias("v"))
    at = v.select("l_suppkey", images.limits(F.col("v"), 0.01, 0.95).alias("e"), images.clipped(F.col("v"), 0.01, 0.95).alias("c"))
    return at.select("l_suppkey", F.round("e.low", 2).alias("low"), F.round("e.high", 2).alias("high"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 4).alias("lit"))


@query(f"""WITH {D}, p AS (SELECT candid, objectId, jd, band, (359.9999 + candid % 97 * 3e-6 + CASE band WHEN 'g' THEN 1e-5 ELSE 0 END) % 360 AS ra, CASE WHEN objectId LIKE '%3' THEN 89.9 ELSE 20 END + candid % 89 * 3e-6 AS dec FROM d),
c AS (SELECT *, avg(cos(radians(dec)) * cos(radians(ra))) OVER w AS x, avg(cos(radians(dec)) * sin(radians(ra))) OVER w AS y, avg(sin(radians(dec))) OVER w AS z FROM p WINDOW w AS (PARTITION BY objectId)),
o AS (SELECT *, (degrees(atan2(y, x)) + 360) % 360 AS ra0, degrees(atan2(z, sqrt(x * x + y * y))) AS dec0 FROM c), f AS (SELECT *, ((ra - ra0 + 540) % 360 - 180) * cos(radians(dec0)) * 3600 AS east, (dec - dec0) * 3600 AS north FROM o)
SELECT candid, round(east, 4) AS east, round(north, 4) AS north, round(sqrt(east * east + north * north), 4) AS radial, round(avg(east) OVER w, 4) AS mean_east, round(avg(north) OVER w, 4) AS mean_north, count(*) OVER w AS so_far FROM f WINDOW w AS (PARTITION BY objectId, band ORDER BY jd, candid ROWS UNBOUNDED PRECEDING)""")
def offsets_over_time(spark, sf):
    """Offsets from the centroid across right ascension 0 and near a pole, with the mean of each band up to then."""
    d = views.detections(spark, sf)
    ra = F.pmod(359.9999 + F.col("candid") % 97 * 3e-6 + F.when(F.col("band") == "g", 1e-5).otherwise(0.0), F.lit(360.0))
    dec = F.when(F.col("objectId").endswith("3"), 89.9).otherwise(20.0) + F.col("candid") % 89 * 3e-6
    out = lightcurve.drift(d.withColumns({"ra": ra, "dec": dec}))
    return out.select("candid", *(F.round(c, 4).alias(c) for c in ("east", "north", "radial", "mean_east", "mean_north")), "so_far")


@query("SELECT 'A' AS catalogue, count(*) FILTER (c_custkey % 5 = 0) AS objects, min(c_custkey) FILTER (c_custkey % 5 = 0) AS example FROM customer UNION ALL SELECT 'B', count(*) FILTER (c_custkey % 5 = 0 OR c_custkey % 3 = 0), min(c_custkey) FILTER (c_custkey % 5 = 0 OR c_custkey % 3 = 0) FROM customer UNION ALL SELECT 'new', count(*), min(c_custkey) FROM customer")
def coverage_gaps(spark, sf):
    """Configured catalogues that stored objects lack."""
    k, none = F.col("c_custkey"), F.array().cast("array<int>")
    o = views.load(spark, sf, "customer").select(k.alias("objectId"), F.when(k % 5 != 0, F.struct(none.alias("A"), F.when(k % 3 != 0, none).alias("B"), none.alias("C"))).alias("cross_matches"))
    return api.coverage_gaps(o, ["A", "B", "new", "watchlist_x"])


@query(f"""WITH {D} SELECT candid, CASE WHEN candid % 4 <> 0 THEN 'rb ' ELSE '' END || 'drb ' || CASE WHEN candid % 5 <> 0 THEN 'sgscore1 ' ELSE '' END || CASE WHEN candid % 3 = 0 THEN 'acai_h acai_n acai_o acai_v acai_b btsbot ' ELSE '' END AS ztf,
CASE WHEN candid % 4 <> 0 THEN 'reliability ' ELSE '' END AS lsst, CASE WHEN candid % 4 <> 0 THEN 'rb ' ELSE '' END || CASE WHEN candid % 5 <> 0 THEN 'sgscore1 ' ELSE '' END AS winter, round(CASE WHEN candid % 5 <> 0 THEN ssdistnr END, 3) AS distance FROM d""")
def survey_classifications(spark, sf):
    """The scores that packets of each survey carry, in their order; a star's only with its distance."""
    k = F.col("candid")
    a = views.alerts(spark, sf).select(F.col("_id").alias("candid"), "candidate")
    score = {"rb": F.when(k % 4 != 0, 0.5), "reliability": F.when(k % 4 != 0, 0.5), "drb": F.col("candidate.drb"), "sgscore1": F.col("candidate.sgscore1"), "distpsnr1": F.when(k % 5 != 0, F.col("candidate.ssdistnr"))}
    lists = {s: rules.survey_classifications(s, score.get, lambda n: F.when(k % 3 == 0, 0.25)) for s in ("ZTF", "LSST", "WINTER")}
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["classifier"], F.lit(" "))), "")
    far = F.round(F.array_max(F.transform("ztf", lambda x: x["distance_arcsec"])).cast("double"), 3)
    return a.select("candid", *(c.alias(s.lower()) for s, c in lists.items())).select("candid", *(names(F.col(s.lower())).alias(s.lower()) for s in lists), far.alias("distance"))


@query(f"WITH {D} SELECT candid, CASE candid % 4 WHEN 1 THEN 'g' WHEN 2 THEN 'r' WHEN 3 THEN 'i' END AS band, round(mag, 4) AS magpsf, round(drb, 4) AS drb, candid % 2 = 0 AS positive, round(1.0857362 / mag_err, 2) AS snr FROM d WHERE candid % 10 <> 7")
def ztf_own_points(spark, sf):
    """Candidates as points of their objects' light curves; those without an error are none."""
    d, k = views.detections(spark, sf), F.col("candid")
    c = F.struct(k, "jd", "programid", (k % 4).cast("int").alias("fid"), F.when(k % 2 == 0, "t").otherwise("f").alias("isdiffpos"), F.lit("").alias("ssnamenr"), F.col("mag").alias("magpsf"), F.when(k % 10 != 7, F.col("mag_err")).alias("sigmapsf"), F.col("mag").alias("magap"), F.col("mag_err").alias("sigmagap"), F.lit(20.5).alias("diffmaglim"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"), (k % 7 / 7.0).alias("drb"))
    p = d.select(c.alias("c")).select(photometry.ztf_own_point(F.col("c")).alias("p")).where("p IS NOT NULL").select("p.*")
    return p.select("candid", "band", F.round("magpsf", 4).alias("magpsf"), F.round("drb", 4).alias("drb"), (F.col("psfFlux") > 0).alias("positive"), F.round(F.abs(F.col("snr").cast("double")), 2).alias("snr"))


@query(f"""WITH {D}, s AS (SELECT candid, jd, min(jd) OVER w AS first, max(jd) OVER w AS last, arg_min(jd, struct_pack(m := CAST(mag AS FLOAT), b := band, j := jd)) OVER w AS peak, min(CAST(mag AS FLOAT)) OVER w AS bright, max(CAST(mag AS FLOAT)) OVER w AS faint FROM d WINDOW w AS (PARTITION BY objectId ORDER BY jd RANGE UNBOUNDED PRECEDING))
SELECT candid AS _id, round(CAST(CAST(first - last AS FLOAT) AS DOUBLE), 3) AS age, round(CAST(CAST(last - peak AS FLOAT) AS DOUBLE), 3) AS since, round(CAST(CAST(peak - first AS FLOAT) AS DOUBLE), 3) AS until, round(bright::DOUBLE, 3) AS peakmag, round(faint::DOUBLE, 3) AS maxmag, CAST(candid % 13 - candid % 7 AS DOUBLE) AS nnondet, 25 AS features FROM s""")
def light_curve_models(spark, sf):
    """The features of a model that takes light curves too, as of each alert."""
    a, k = views.alerts(spark, sf), F.col("_id")
    given = {f: F.lit(1.0) for f in models.BOTH_FEATURES if f not in models.CURVE_FEATURES} | {"jd": F.col("candidate.jd"), "ncovhist": k % 13, "ndethist": k % 7}
    a = a.withColumn("candidate", F.struct(*(c.alias(n) for n, c in given.items())))
    figures = lightcurve.over_bands(enrich.alert_bands(a, views.objects(spark, sf), {"prv_candidates": None}), "_id")
    f = models.both_features(a, figures)
    out = f.select(k, *(F.round(F.col(c).cast("double"), 3).alias(n) for n, c in (("age", "age"), ("since", "days_since_peak"), ("until", "days_to_peak"), ("peakmag", "peakmag_so_far"), ("maxmag", "maxmag_so_far"), ("nnondet", "nnondet"))))
    return out.withColumn("features", F.lit(len(f.columns) - 1))
