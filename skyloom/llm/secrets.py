"""Secrets and multipart credentials, by DataFrame functions only.

Base findings are patterns that convict on their own. Weak parts (identifiers, tokens, endpoints) mean nothing alone:
they are joined with complementary parts of the same text by an interval join, on buckets of offsets, and reported
only where an identifier or endpoint and a secret stand within SCOPE characters of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, texts_of


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_OWNERS = "|".join(map(_any_case, ("access_?key_?id", "client_?id", "account_?id", "user_?name", "login")))
_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: pattern, the group that is measured, its least length, what else the match must hold. The order breaks ties.
PATTERNS = {
    "assign": (rf"({_NAMES}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, ()),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ()),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),
    "owner": (rf"({_OWNERS}){_SET}([A-Za-z0-9._@-]+)", 2, 4, ()),
    "key": (r"[A-Za-z0-9+/]{32,}", 0, 32, ("[0-9]", "[A-Z]", "[a-z]")),
    "endpoint": (r"(https?|jdbc:[a-z]+|redis|mongodb|postgres|postgresql|mysql|amqp|ftp|s3)://[A-Za-z0-9.-]+", 0, 8, ()),
}
BASE = ("assign", "access", "hex")
WEAK = {"owner": "identifier", "key": "secret", "endpoint": "endpoint"}
#: What each kind is to a credential.
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret", **WEAK}
SCOPE = 300


def _pieces(text: Column, kind: str) -> Column:
    """array<struct<rank, gap, hit, good>> of a kind's matches, in order: the code points before a match since the last
    one, those in it, and whether it is long enough. Offsets are sums over these, taken later by a window."""
    pattern, group, least, holds = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part"))

    def one(r: Column) -> Column:
        good = F.length(r["part"]) >= least
        for h in holds:
            good = good & r["hit"].rlike(h)
        return F.struct(F.lit(list(PATTERNS).index(kind)).alias("rank"), F.length(r["gap"]).alias("gap"), F.coalesce(F.length(r["hit"]), F.lit(0)).alias("hit"), F.coalesce(good, F.lit(False)).alias("good"))

    return F.when(text.rlike(pattern), F.transform(rows, one)).otherwise(F.array().cast("array<struct<rank:int,gap:int,hit:int,good:boolean>>"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked): a row for each row of docs.

    Counts and digest are those of the base findings; ``spans`` has the linked weak parts too, by start, then kind in
    the order of PATTERNS. Null and empty texts have none. Equal rows get equal results; ids may be null. Only findings
    are shuffled, never texts, and the work on a text is in proportion to its length and its findings.
    """
    docs = texts_of(docs)
    # numbers that the written table holds, so they are the same whenever it is read
    seen = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_pieces(F.col("text"), k) for k in PATTERNS)).alias("pieces")), "pieces")
    each = seen.where(F.size("pieces") > 0).select("row", F.posexplode("pieces").alias("pos", "p")).select("row", "pos", "p.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    names = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("rank") + 1)
    parts = each.withColumn("stop", end).where("good").select("row", "rank", (F.col("stop") - F.col("hit")).alias("start"), "stop", names(PATTERNS).alias("kind"), names([PARTS[k] for k in PATTERNS]).alias("part"), (F.col("rank") < len(BASE)).alias("is_base"))
    # a weak part that a base finding covers says nothing new: one that began before reaches into it, or the next one begins in it
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    reach, coming = F.max(F.when(F.col("is_base"), F.col("stop"))).over(before), F.min(F.when(F.col("is_base"), F.col("start"))).over(after)
    parts = stage(parts.withColumns({"reach": reach, "coming": coming}).withColumn("covered", F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("coming") < F.col("stop"), F.lit(False))).drop("reach", "coming"), "parts")

    # the interval join: both sides by text and bucket, the weak side also in the buckets next to its own
    bucket = F.floor(F.col("start") / SCOPE)
    mine = parts.where("NOT is_base AND NOT covered").withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    other = parts.select(F.col("row").alias("other_row"), F.col("start").alias("other_start"), F.col("stop").alias("other_stop"), F.col("part").alias("other_part"), bucket.alias("other_bucket"))
    near = (F.abs(F.col("start") - F.col("other_start")) <= SCOPE) & ((F.col("part") == "secret") != (F.col("other_part") == "secret")) & ((F.col("other_stop") <= F.col("start")) | (F.col("other_start") >= F.col("stop")))
    columns = ["row", "start", "rank", "stop", "kind", "is_base"]
    linked = mine.join(other, (F.col("row") == F.col("other_row")) & (F.col("bucket") == F.col("other_bucket")) & near, "left_semi").select(*columns).distinct()

    told = parts.where("is_base").select(*columns).unionByName(linked)
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "stop", "kind", "is_base")))  # a text's own findings
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    found = told.groupBy("row").agg(spans.alias("all"), *counts, F.count_if(~F.col("is_base")).alias("n_linked"))
    whole = seen.select("row", "doc_id").join(found, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType)))
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in BASE), "n_linked")}
    base = _joined(F.filter("all", lambda x: x["is_base"]))
    return whole.select("doc_id", *(numbers[f"n_{k}"] for k in BASE), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), numbers["n_linked"])


def _sql_kind(kind: str) -> str:
    pattern, group, least, holds = PATTERNS[kind]
    p = pattern.replace("'", "''")
    held = "".join(f" AND regexp_matches(hits[i], '{h}')" for h in holds)
    return f"""
    SELECT doc_id, own, '{kind}' AS kind, {list(PATTERNS).index(kind)} AS rank, '{PARTS[kind]}' AS part,
      list_sum([len(g) for g in gaps[1:i]]) + coalesce(list_sum([len(h) for h in hits[1:i - 1]]), 0) AS s,
      list_sum([len(g) for g in gaps[1:i]]) + list_sum([len(h) for h in hits[1:i]]) AS e
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, own, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS parts
      FROM d WHERE regexp_matches(t, '{p}')))
    WHERE len(parts[i]) >= {least}{held}"""


def oracle_sql() -> str:
    found = " UNION ALL ".join(map(_sql_kind, PATTERNS))
    weak = ", ".join(f"'{k}'" for k in WEAK)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS own FROM documents),
f AS ({found}),
linked AS (
  SELECT * FROM f AS p WHERE kind IN ({weak})
  AND EXISTS (SELECT 1 FROM f AS q WHERE q.own = p.own AND abs(p.s - q.s) <= {SCOPE} AND (p.part = 'secret') <> (q.part = 'secret') AND (q.e <= p.s OR q.s >= p.e))
  AND NOT EXISTS (SELECT 1 FROM f AS b WHERE b.own = p.own AND b.kind IN ({base}) AND b.s < p.e AND p.s < b.e)),
told AS (SELECT own, kind, rank, s, e, true AS base FROM f WHERE kind IN ({base}) UNION ALL SELECT own, kind, rank, s, e, false FROM linked),
g AS (SELECT own, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (base) AS base_spans,
  count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (NOT base) AS l
  FROM told GROUP BY own)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(l, 0) AS n_linked FROM d LEFT JOIN g USING (own)"""
