"""Repair of conversations: the cheapest edits that leave an optional system turn and then user and assistant by turns.

The search is A* on the lattice of (rows done, state of the pattern). Its heuristic is a suffix sum: blank and repeated
rows must be deleted, and a truncated one costs its charge or a deletion, whatever else happens. The queue is keyed by
(cost plus heuristic, audit), so of equally cheap edits those with the ASCII-least audit come out first.

A conversation may be of any length, so its rows are numbered by a range sort and searched in pieces of at most PIECE
rows: from each state that a piece may start in to each that it may end in. Such tables compose like products, FAN at a
time, until one is left for each conversation; then the states chosen go back down, and each piece tells the edits of
its rows. No task holds more than FAN pieces, and texts are only shuffled to be sorted and to be edited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, stage

PIECE, FAN = 256, 64
REROLE, DELETE, INSERT, CHARGE = 2, 3, 2, 1
#: States of the pattern: at the start, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What a rerole or an insertion makes in each state, and the insertions that end the pattern.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}

Table = dict[tuple[int, int], tuple[int, str]]


def search(initials: list[str], faults: list[str], entry: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best edits from the entry state to each state right after the last row."""
    n, rest = len(initials), [0]
    for fault in reversed(faults):
        rest.append(rest[-1] + (DELETE if fault in ("blank", "duplicate") else CHARGE if fault == "truncated" else 0))
    rest.reverse()
    queue, done, found = [(rest[0], "", 0, entry)], set(), {}
    while queue and len(found) < len(NEXT):
        key, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = (key, audit)
            continue
        cost = key - rest[i]
        after = NEXT[state][WANTED[state][0]]
        heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
        heappush(queue, (cost + INSERT + rest[i], audit + "I", i, after))
        if faults[i] not in ("blank", "duplicate"):
            cost += CHARGE * (faults[i] == "truncated") + rest[i + 1]
            if initials[i] in NEXT[state]:
                heappush(queue, (cost, audit + "K", i + 1, NEXT[state][initials[i]]))
            if initials[i] != WANTED[state][0]:
                heappush(queue, (cost + REROLE, audit + "R", i + 1, after))
    return found


def closed(table: Table, entry: int = START) -> tuple[int, str, int]:
    """(cost, audit, last state) of a whole conversation."""
    return min((cost + INSERT * len(CLOSING[q]), audit + CLOSING[q], q) for (e, q), (cost, audit) in table.items() if e == entry)


def edits(audit: str, entry: int, initials: list[str]) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, place before it, edit, role if it changes) of an audit; insertions stand before the row that follows."""
    state, row, place = entry, 0, 0
    for edit in audit:
        role = WANTED[state] if edit in "RI" else None
        yield row, place, edit, role
        if edit != "D":
            state = NEXT[state][role[0] if role else initials[row]]
        row, place = (row, place + 1) if edit == "I" else (row + 1, 0)


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seal, at): rows by conversation, turn (nulls first), role and a digest, as a table.

    ``at`` counts on over all rows. Only a count for each file's task goes through the driver.
    """
    of = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    of = of.withColumn("seal", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("seal")]
    placed = stage(of.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "turns")
    task = F.shiftright("id", 33).alias("task")
    before, offsets = 0, []
    for r in sorted(placed.groupBy(task).count().collect()):
        offsets.append((r["task"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "task long, before long")
    return placed.withColumn("task", task).join(F.broadcast(offsets), "task").withColumn("at", F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "before", "id")


_TABLE = "first long, piece long, n long, initials array<string>, blank long, duplicate long, truncated long, illegal long, head string, tail string, steps array<struct<entry:int,exit:int,cost:long,audit:string,via:string>>"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of equal first ``keys`` columns, of sorted batches."""
    held: list[dict] = []
    for batch in batches:
        names = batch.schema.names[:keys]
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, schema: str, keys: int, one) -> DataFrame:
    """``one`` on each group of rows of equal first ``keys`` columns; the groups are bounded and sorted beforehand."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema)

    def run(batches):
        yield from _in_batches((row for group in _groups(batches, keys) for row in one(group)), to_arrow_schema(kind))

    return df.mapInArrow(run, kind)


def _piece(rows: list[dict]) -> Iterator[dict]:
    initials, faults = [r["initial"] for r in rows], [r["fault"] for r in rows]
    steps = [{"entry": e, "exit": q, "cost": c, "audit": a, "via": ""} for e in NEXT for q, (c, a) in search(initials, faults, e).items()]
    yield {"first": rows[0]["first"], "piece": rows[0]["piece"], "n": rows[0]["n"], "initials": initials, "steps": steps, "head": initials[0], "tail": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}}


def _merged(rows: list[dict]) -> Iterator[dict]:
    """One table of those that follow each other; ``via`` holds the states between them."""
    ways = {(e, e): (0, "", "") for e in NEXT}
    for row in rows:
        longer: dict = {}
        for (e, q), (cost, audit, via) in ways.items():
            for s in row["steps"]:
                if s["entry"] == q:
                    way = (cost + s["cost"], audit + s["audit"], via + str(s["exit"]))
                    longer[e, s["exit"]] = min(way, longer.get((e, s["exit"]), way))
        ways = longer
    steps = [{"entry": e, "exit": q, "cost": c, "audit": a, "via": via[:-1]} for (e, q), (c, a, via) in ways.items()]
    yield {"first": rows[0]["first"], "piece": rows[0]["up"], "n": rows[0]["n"], "initials": [], "steps": steps, "head": rows[0]["head"], "tail": rows[-1]["tail"], **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(rows, rows[1:]))}


def _chosen(rows: list[dict]) -> Iterator[dict]:
    for row in rows:
        cost, audit, q = closed({(s["entry"], s["exit"]): (s["cost"], s["audit"]) for s in row["steps"]})
        yield {**{k: row[k] for k in ("first", "n", "blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "entry": START, "exit": q}


def repair(rows: DataFrame, size: int = PIECE, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired rows
    (conv_id, at, place, edit, role, text), in order of (at, place).

    ``rows`` has conv_id, turn, role and text; null roles and texts count as one space, rows without a conv_id are one
    conversation, rows without a turn come first. Rows of one turn stand in order of role and text digest, so repeated
    rows are adjacent. An empty role has no initial that the pattern knows. Texts of any length are looked at only by
    Spark's own functions. An empty table gives two empty ones.
    """
    turns = numbered(rows)
    convs = stage(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")), "conversations")
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    lean = turns.select(F.col("conv_id").alias("of"), "at", F.substring("role", 1, 1).alias("initial"), (core == "").alias("empty"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("open"), "seal")
    lean = stage(lean.join(convs.select("conv_id", "first", "n"), F.col("of").eqNullSafe(F.col("conv_id"))).drop("of", "conv_id"), "lean")
    seen = lean.groupBy("first", "seal").agg(F.min("at").alias("seen"), F.count("*").alias("times")).where("times > 1").drop("times")
    fault = F.when(F.col("empty"), "blank").when(F.col("at") > F.col("seen"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    dealt = lean.join(seen, ["first", "seal"], "left").select("first", F.floor((F.col("at") - F.col("first")) / size).alias("piece"), "at", "n", "initial", fault.alias("fault"))
    pieces = stage(_mapped(dealt.repartition("first", "piece").sortWithinPartitions("first", "piece", "at"), _TABLE, 2, _piece), "pieces")
    levels = [pieces.where(F.col("n") > size)]
    while not levels[-1].where("piece > 0").isEmpty():
        up = F.floor(F.col("piece") / fan).alias("up")
        levels.append(stage(_mapped(levels[-1].withColumn("up", up).repartition("first", "up").sortWithinPartitions("first", "up", "piece").select("first", "up", *[c for c in levels[-1].columns if c != "first"]), _TABLE, 2, _merged), "merged"))
    tops = pieces.where(F.col("n") <= size).unionByName(levels[-1])
    chosen = stage(_mapped(tops, "first long, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, entry int, exit int", 1, _chosen), "chosen")
    states = chosen.select("first", F.lit(0).cast("long").alias("piece"), "entry", "exit", "n")
    single, states = states.where(F.col("n") <= size).drop("n"), states.where(F.col("n") > size).drop("n")
    way = lambda steps: F.element_at(F.filter(steps, lambda s: (s["entry"] == F.col("entry")) & (s["exit"] == F.col("exit"))), 1)
    for upper, lower in zip(levels[:0:-1], levels[-2::-1]):  # the states between an upper table's parts go to them
        via = upper.join(states, ["first", "piece"]).select("first", F.col("piece").alias("up"), "entry", "exit", way("steps")["via"].alias("via"))
        part = (F.col("piece") % fan).cast("int")
        states = lower.select("first", "piece").withColumn("up", F.floor(F.col("piece") / fan)).join(via, ["first", "up"]).select(
            "first", "piece", F.when(part == 0, F.col("entry")).otherwise(F.expr(f"substring(via, int(piece % {fan}), 1)").cast("int")).alias("entry"),
            F.when(part == F.length("via"), F.col("exit")).otherwise(F.expr(f"substring(via, int(piece % {fan}) + 1, 1)").cast("int")).alias("exit"))
    states = single.unionByName(states)

    def told(rows: list[dict]) -> Iterator[dict]:
        for r in rows:
            last = r["piece"] == (r["n"] - 1) // size
            for row, place, edit, role in edits(r["audit"] + (CLOSING[r["exit"]] if last else ""), r["entry"], r["initials"]):
                yield {"first": r["first"], "at": r["first"] + r["piece"] * size + row, "place": place, "edit": edit, "new": role}

    ways = pieces.join(states, ["first", "piece"]).select("first", "piece", "n", "initials", "entry", "exit", way("steps")["audit"].alias("audit"))
    plan = _mapped(ways, "first long, at long, place int, edit string, new string", 1, told).where("edit <> 'D'")
    ids = convs.select("first", "conv_id")
    made = plan.where("edit = 'I'").join(ids, "first").select("conv_id", "at", "place", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    old = plan.where("edit <> 'I'").select("at", "place", "edit", "new").join(turns, "at").select("conv_id", "at", "place", "edit", F.coalesce("new", "role").alias("role"), "text")
    told_of = chosen.drop("entry", "exit", "n").join(convs.select("conv_id", "first", "gaps"), "first")
    return told_of.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "audit"), old.unionByName(made)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage that the key of each names: dropped, emptied, without full stops, doubled, or a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = part("text"), part("role")
    out = rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"), F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), lot.alias("lot"))
    return out.where("lot <> 0").withColumn("copy", F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("lot", "copy")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 over the lines ``role:text`` of each conversation.

    Such a hash goes through a conversation from its first line to its last; the task streams the rows and holds one.
    """
    kind = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def hashed() -> Iterator[dict]:
            now, state = None, None
            for batch in batches:
                for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if state is None or conv != now:
                        if state is not None:
                            yield {"conv_id": now, "repaired_sha256": state.hexdigest()}
                        now, state = conv, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
            if state is not None:
                yield {"conv_id": now, "repaired_sha256": state.hexdigest()}

        yield from _in_batches(hashed(), to_arrow_schema(kind))

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place").select("conv_id", "role", "text").mapInArrow(run, kind)


def report(rows: DataFrame, size: int = PIECE, fan: int = FAN) -> DataFrame:
    """What the damage leaves of each conversation and what its repair costs; a row for every conv_id, a null one too."""
    told, repaired = repair(damaged(rows), size, fan)
    out = rows.select(F.col("conv_id").alias("id")).distinct()
    hashes = digests(repaired).withColumnRenamed("conv_id", "hashed")
    out = out.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same by a plain recursion over the rows, with the best edits to each state."""
    add = lambda s, c, a: f"{{'c': {s}.c + {c}, 'a': {s}.a || '{a}'}}"
    take = lambda s, i: f"CASE WHEN o.fault IN ('blank', 'duplicate') THEN {{'c': 1000000, 'a': ''}} WHEN o.initial = '{i}' THEN {{'c': {s}.c + o.charge, 'a': {s}.a || 'K'}} ELSE {{'c': {s}.c + o.charge + {REROLE}, 'a': {s}.a || 'R'}} END"
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
l AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS lot FROM d),
m AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) FROM l WHERE lot <> 0),
n AS (SELECT *, row_number() OVER w AS pos, left(role, 1) AS initial,
  coalesce(lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS wrong, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text))),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS charge FROM n),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': ''}} AS s1, {{'c': 1000000, 'a': ''}} AS s2, {{'c': 1000000, 'a': ''}} AS s3, {{'c': 1000000, 'a': ''}} AS s4 FROM o
  UNION ALL SELECT t.conv_id, o.pos, {add("s1", DELETE, "D")}, least({add("s2", DELETE, "D")}, CASE WHEN o.initial = 's' THEN {take("s1", "s")} ELSE {{'c': 1000000, 'a': ''}} END),
    least({add("i3", DELETE, "D")}, {take("s1", "u")}, {take("s2", "u")}, {take("i4", "u")}), least({add("i4", DELETE, "D")}, {take("i3", "a")})
  FROM (SELECT *, least(s3, {add("s1", INSERT, "I")}, {add("s2", INSERT, "I")}, {add("s4", INSERT, "I")}) AS i3, least(s4, {add("s3", INSERT, "I")}) AS i4 FROM r) AS t
  JOIN o ON o.conv_id IS NOT DISTINCT FROM t.conv_id AND o.pos = t.pos + 1),
b AS (SELECT conv_id, min(turn) AS t0, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (wrong) AS illegal, count(*) AS n FROM o GROUP BY 1),
e AS MATERIALIZED (SELECT b.*, least(s1, s4, {add("s3", INSERT, "I")}, {add("s2", 2 * INSERT, "II")}) AS best FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.n),
x AS (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, unnest(range(length(best.a))) AS i FROM e WHERE best.a <> ''),
y AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS place FROM x),
z AS (SELECT y.conv_id, y.i, y.edit, y.place, CASE WHEN y.edit = 'I' THEN '' ELSE o.text END AS text, o.role,
  max(CASE WHEN y.place = 1 AND y.edit = 'K' AND o.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS sys FROM y LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM y.conv_id AND o.pos = y.pos WHERE y.edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS hash FROM z GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""
