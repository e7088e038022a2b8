"""Stored filters: validated pipelines that run over each batch of alerts.

A filter sees the fields of its survey and may use an object's history, matches and counterparts. These come from
joins, which are put in just before the first stage that needs them and left out where none does, so that the stages
before make the batch smaller first. Programmes that a user may not see are removed from rows and arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.expressions import Scope
from skyloom.operators import series
from skyloom.operators.rules import PUBLIC, permitted

from . import pipeline
from .pipeline import Tables, apply, parse, stage_of

#: What each survey's filters see of an alert, the arrays of its objects, days of history, and the other surveys.
SURVEYS = {
    "ZTF": {"fields": ("objectId", "candidate", "classifications", "properties", "coordinates"), "arrays": ("prv_candidates", "prv_nondetections", "fp_hists"), "days": 365.0, "others": ("LSST",), "programs": True},
    "LSST": {"fields": ("objectId", "candidate", "ss_source", "properties", "coordinates"), "arrays": ("prv_candidates", "fp_hists"), "days": 365.0, "others": ("ZTF",), "programs": False},
    "DECAM": {"fields": ("objectId", "candidate", "properties", "coordinates"), "arrays": ("prv_candidates", "fp_hists"), "days": 1000.0, "others": (), "programs": False},
    "WINTER": {"fields": ("objectId", "candidate", "properties", "coordinates"), "arrays": ("prv_candidates",), "days": 1000.0, "others": (), "programs": False},
}
FORBIDDEN = ("$group", "$unwind", "$lookup")


class FilterError(ValueError):
    """A filter that may not be stored."""


def validate(stages: list[dict]) -> None:
    """Raise unless rows stay one for each alert, keep their identity, are restricted, and end in a projection."""
    if not stages:
        raise FilterError("a filter has stages")
    for s in stages:
        op, v = stage_of(s)
        if op in FORBIDDEN:
            raise FilterError(f"{op} is not allowed in a filter")
        if op == "$project":
            flat = {k: x for k, x in v.items() if k != "_id"}
            if v.get("_id") in (0, False):
                raise FilterError("_id must stay")
            if v.get("objectId") in (0, False):
                raise FilterError("objectId must stay")
            if any(x not in (0, False) for x in flat.values()) and "objectId" not in v:
                raise FilterError("a projection must include objectId")
        if op == "$unset":
            if not isinstance(v, str) and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
                raise FilterError("$unset takes a name or names")
            if {"_id", "objectId"} & set([v] if isinstance(v, str) else v):
                raise FilterError("_id and objectId must stay")
    if not any("$match" in s for s in stages):
        raise FilterError("a filter needs a $match")
    op, v = stage_of(stages[-1])
    if op != "$project" or v.get("objectId") not in (1, True):
        raise FilterError("a filter ends in a $project with objectId: 1")


def uses(part: Any, name: str) -> bool:
    """Whether a stage mentions a field, as a key or as a value, alone, with "$", or as the start of a path."""
    if isinstance(part, dict):
        return any(uses(k, name) or uses(v, name) for k, v in part.items())
    if isinstance(part, list):
        return any(uses(x, name) for x in part)
    return isinstance(part, str) and (part.lstrip("$") == name or part.lstrip("$").startswith(name + "."))


def first_use(stages: list[dict], *names: str) -> int | None:
    """The first stage that mentions any of the names."""
    return next((i for i, s in enumerate(stages) if any(uses(s, n) for n in names)), None)


def with_history(alerts: DataFrame, objects: DataFrame, survey: str, programs: list[int] | None) -> DataFrame:
    """Alerts with their objects' arrays, cut to the survey's days before the alert and to permitted programmes."""
    spec = SURVEYS[survey]
    here = [a for a in spec["arrays"] if a in objects.columns]
    more = [c for c in ("cross_matches", "aliases") if c in objects.columns and c not in alerts.columns]
    out = alerts.join(objects.select("objectId", *here, *more), "objectId", "left")
    for a in here:
        points = series.trailing(F.col(a), F.col("candidate.jd"), spec["days"])
        out = out.withColumn(a, F.coalesce(permitted(points, programs) if programs is not None and spec["programs"] else points, F.array().cast(objects.schema[a].dataType)))
    return out


def with_counterpart(alerts: DataFrame, other: DataFrame, name: str, days: float, programs: list[int] | None = None) -> DataFrame:
    """Alerts with the object of another survey that their first alias names, as a struct under the survey's name."""
    kept = [a for a in SURVEYS[name]["arrays"] if a in other.columns]
    seen = lambda a: permitted(F.col(a), programs if programs is not None else [PUBLIC]).alias(a) if SURVEYS[name]["programs"] else F.col(a)
    mine = other.select(F.col("objectId").alias("__other"), F.struct(F.col("objectId"), *map(seen, kept)).alias(name))
    out = alerts.withColumn("__alias", F.get(F.col(f"aliases.{name}"), F.lit(0))).join(mine, F.col("__alias") == F.col("__other"), "left").drop("__alias", "__other")
    for a in kept:
        points = series.trailing(F.col(f"{name}.{a}"), F.col("candidate.jd"), days)
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name).withField(a, points)))
    return out


def with_moving_history(alerts: DataFrame, designation: Column, days: float = 365.0, programs: list[int] | None = None, fields: tuple[str, ...] = ("jd", "magpsf", "sigmapsf", "band", "programid")) -> DataFrame:
    """Alerts of moving objects with ``sso_history``: detections of the designation in the days before, by time.

    Equal designations meet in buckets of the history's length, two for an alert, so a bright asteroid's years of
    detections are not all compared with each other.
    """
    named = alerts.withColumn("__name", designation)
    seen = named.where(F.col("__name").isNotNull()).select("__name", F.col("candidate.jd").alias("__t"), F.floor(F.col("candidate.jd") / days).alias("__bucket"), F.col("candidate.programid").alias("__program") if programs is not None else F.lit(None).alias("__program"), F.struct(*(F.col(f"candidate.{f}").alias(f) for f in fields if f in alerts.schema["candidate"].dataType.names)).alias("__point"))
    if programs is not None:
        seen = seen.where(F.col("__program").isin(programs))
    asked = named.where(F.col("__name").isNotNull()).select(F.col("_id"), F.col("__name"), F.col("candidate.jd").alias("__at"))
    asked = asked.withColumn("__bucket", F.explode(F.array(F.floor(F.col("__at") / days), F.floor(F.col("__at") / days) - 1)))
    met = asked.join(seen, ["__name", "__bucket"]).where((F.col("__t") <= F.col("__at")) & (F.col("__t") >= F.col("__at") - days))
    found = met.groupBy("_id").agg(F.array_sort(F.collect_list("__point")).alias("sso_history"))
    return alerts.join(found, "_id", "left").withColumn("sso_history", F.coalesce("sso_history", F.array().cast(found.schema["sso_history"].dataType)))


def with_watchlist(result: DataFrame, watchlist: DataFrame, survey: str, fields: list[str]) -> DataFrame:
    """Only results whose object a row of the watchlist has matched, with those rows under annotations.watchlist."""
    column = f"matching_{survey.lower()}_objects"
    rows = watchlist.select(F.explode(F.array_distinct(column)).alias("objectId"), F.struct("_id", *fields).alias("__row")).groupBy("objectId").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    out = result.join(rows, "objectId")
    old = F.col("annotations").withField("watchlist", F.col("__rows")) if "annotations" in result.columns else F.struct(F.col("__rows").alias("watchlist"))
    return out.withColumn("annotations", old).drop("__rows")


@dataclass(frozen=True)
class Filter:
    """A stored filter: its versions, which one is active, and whose alerts it may see."""

    id: str
    survey: str
    versions: dict[str, str]
    active_version: str
    permissions: dict[str, list[int]] = field(default_factory=dict)
    active: bool = True
    watchlist: str | None = None
    watch_fields: tuple[str, ...] = ()

    def stages(self) -> list[dict]:
        if self.active_version not in self.versions:
            raise FilterError(f"{self.id} has no version {self.active_version}")
        return parse(self.versions[self.active_version])


def load_filters(rows: DataFrame, survey: str) -> list[Filter]:
    """The active filters of a survey from a small table (_id, survey, active, active_fid, fv, permissions, watchlist)."""
    out = []
    for r in rows.where((F.col("survey") == survey) & F.col("active")).orderBy("_id").collect():
        out.append(Filter(r["_id"], survey, {v["fid"]: v["pipeline"] for v in r["fv"]}, r["active_fid"], {k: list(v) for k, v in (r["permissions"] or {}).items()}, True, r["watchlist"] if "watchlist" in rows.columns else None))
    return out


def sound_filters(filters: list[Filter]) -> tuple[list[Filter], dict[str, str]]:
    """The filters that may run, and why the others may not, by id: one bad filter doesn't stop the rest."""
    good, bad = [], {}
    for f in filters:
        try:
            validate(f.stages())
        except ValueError as e:
            bad[f.id] = str(e)
        else:
            good.append(f)
    return good, bad


def run_filter(alerts: DataFrame, f: Filter, tables: Tables) -> DataFrame:
    """Run a filter over a batch of alerts. ``tables`` has <survey>_objects for its survey and the others."""
    spec, stages = SURVEYS[f.survey], f.stages()
    validate(stages)
    programs = f.permissions.get(f.survey) if spec["programs"] else None
    df = alerts.select("_id", *(c for c in spec["fields"] if c in alerts.columns))
    if spec["programs"]:
        df = df.where(F.col("candidate.programid").isin(programs) if programs else F.lit(False))
    history = first_use(stages, *spec["arrays"], "cross_matches", "aliases", *spec["others"])
    moving = first_use(stages, "sso_history")
    other = {n: first_use(stages, n) for n in spec["others"]}
    for i, s in enumerate(stages):
        if i == history:
            df = with_history(df, tables[f"{f.survey}_objects"], f.survey, programs)
        for name, at in other.items():
            if i == at and f"{name}_objects" in tables:
                df = with_counterpart(df, tables[f"{name}_objects"], name, spec["days"], f.permissions.get(name))
        if i == moving:
            df = with_moving_history(df, F.col("candidate.ssnamenr") if f.survey == "ZTF" else F.col("ss_source.designation"), programs=programs)
        df = apply(df, s, tables)
    return with_watchlist(df, tables[f.watchlist], f.survey, list(f.watch_fields)) if f.watchlist else df


#: What a stage of the shared plan may be: it looks at one document and leaves one or none.
ROWWISE = ("$match", "$project", "$addFields", "$set", "$unset")
#: Filters whose flags stand in one number.
WORD = 60
PASSED = "array<struct<filter_id:string,annotations:string>>"
#: Column of objects whose matches are made on demand: a struct of ra and dec.
FIRST_SIGHT = "first_sight"


def _note(doc: Scope) -> Column:
    return F.coalesce(F.to_json(doc.column("annotations")) if "annotations" in doc.schema.names else F.lit("{}"), F.lit("{}"))


def _seen_of(f: Filter, other: str) -> tuple[int, ...]:
    """Programmes of another survey that a filter may see: the public one unless it says otherwise."""
    return tuple(f.permissions[other]) if f.permissions.get(other) is not None else (PUBLIC,)


def _names_matches(f: Filter) -> bool:
    """Whether a filter can see its object's matches: it names them, or the whole document."""
    return first_use(f.stages(), "cross_matches", "ROOT", "CURRENT") is not None


def _shared(alerts: DataFrame, filters: list[Filter], tables: Tables, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(_id, objectId, filters) of filters of one survey, in one scan of the alerts and one join with each table.

    Every filter has a bit, and a document: the alert's own columns until a stage changes it, then a struct. A step of all
    filters is one projection. (With a column for each flag the optimizer's constraints would double with every filter.)
    First come the stages before any history is needed; rows that no filter wants any more go, the others get their
    history and counterparts once, trimmed once for each set of permissions, and the rest of the stages follows.

    With ``near`` an object's alerts go with it as one row while its matches are made: that is done once for an object,
    and no array of matches is shuffled.
    """
    survey = filters[0].survey
    spec, stored = SURVEYS[survey], tables.get(f"{survey}_objects")
    arrays = [a for a in spec["arrays"] if stored is not None and a in stored.columns]
    df = alerts.select("_id", *(c for c in spec["fields"] if c in alerts.columns))
    base = Scope(df.schema)
    stages = [f.stages() for f in filters]
    for s in stages:
        validate(s)
    programs = [tuple(sorted(f.permissions.get(f.survey) or ())) if spec["programs"] else None for f in filters]
    history = [first_use(s, *spec["arrays"], "cross_matches", "aliases", *spec["others"]) for s in stages]
    other = [{n: first_use(s, n) for n in spec["others"] if f"{n}_objects" in tables} for s in stages]
    docs = [base] * len(filters)
    words = range(0, len(filters), WORD)
    bit = lambda i: F.lit(1 << i % WORD).cast("long")

    def where(tests: dict[int, Column], first: int) -> Column:
        """The bits of a word's filters whose tests hold, or that have none."""
        free = sum(1 << i - first for i in range(first, min(first + WORD, len(filters))) if i not in tests)
        return reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, bit(i)).otherwise(F.lit(0).cast("long")) for i, c in tests.items() if first <= i < first + WORD), F.lit(free).cast("long"))

    allowed = {i: F.col("candidate.programid").isin(*p) if p else F.lit(False) for i, p in enumerate(programs) if p is not None}
    df = df.withColumns({f"__b{w}": where(allowed, w) for w in words})

    def step(df: DataFrame, todo: dict[int, dict]) -> DataFrame:
        new, tests, changed = {}, {}, []
        for i, s in todo.items():
            op, v = stage_of(s)
            if op == "$match":
                tests[i] = pipeline.match(docs[i], v)
                continue
            fields = {c: docs[i].column(c) for c in docs[i].schema.names} | pipeline.added(docs[i], v) if op in ("$addFields", "$set") else pipeline.projected(docs[i], v) if op == "$project" else pipeline.without(docs[i], v)
            new[f"__d{i}"] = F.struct(*(c.alias(k) for k, c in fields.items()))
            changed.append(i)
        df = df.withColumns(new | ({f"__b{w}": F.col(f"__b{w}").bitwiseAND(where(tests, w)) for w in words} if tests else {}))
        for i in changed:
            kind = df.schema[f"__d{i}"].dataType
            docs[i] = Scope(kind, {}, {n: F.col(f"__d{i}")[n] for n in kind.names})
        return df

    def given(i: int, more: dict[str, tuple[Column, T.DataType]]) -> None:
        at = {c: docs[i].column(c) for c in docs[i].schema.names} | {n: c for n, (c, _) in more.items()}
        kinds = {f.name: f.dataType for f in docs[i].schema.fields} | {n: kind for n, (_, kind) in more.items()}
        docs[i] = Scope(T.StructType([T.StructField(n, kinds[n]) for n in at]), {}, at)

    early = [len(s) if h is None else h for s, h in zip(stages, history)]
    for k in range(max(early)):
        df = step(df, {i: s[k] for i, s in enumerate(stages) if k < early[i]})
    df = df.where(reduce(lambda a, b: a | b, (F.col(f"__b{w}") != 0 for w in words)))
    wanting = [i for i, h in enumerate(history) if h is not None]
    if wanting:
        objects = tables[f"{survey}_objects"]
        more = [c for c in ("cross_matches", "aliases") if c in objects.columns]
        late = near is not None and "cross_matches" not in (*more, *base.schema.names) and any(_names_matches(filters[i]) for i in wanting)
        if late:
            df = df.groupBy("objectId").agg(F.collect_list(F.struct(*df.columns)).alias("__alerts"))
        df = df.join(objects.select(F.col("objectId").alias("__object"), *(F.col(c).alias(f"__{c}") for c in (*arrays, *more)), *([FIRST_SIGHT] if late else [])), F.col("objectId") == F.col("__object"), "left")
        if late:
            df = near(df).withColumn("__cross_matches", F.when(F.col("__object").isNotNull(), F.col("cross_matches")))
            more = [*more, "cross_matches"]
            df = df.select(F.explode("__alerts").alias("__a"), *(f"__{c}" for c in (*arrays, *more)), "__object").select("__a.*", *(f"__{c}" for c in (*arrays, *more)), "__object")
        df = df.drop("__object")
        kinds = {c: df.schema[f"__{c}"].dataType for c in (*arrays, *more)}

        def trimmed(a: str, p: tuple | None) -> Column:
            points = series.trailing(F.col(f"__{a}"), F.col("candidate.jd"), spec["days"])
            return F.coalesce(permitted(points, list(p)) if p is not None else points, F.array().cast(kinds[a]))

        sets = list(dict.fromkeys(programs[i] for i in wanting))
        # as a generator's output the histories are trimmed once; a projection's would be put into every filter's conditions
        held = F.struct(*(F.struct(*(trimmed(a, p).alias(a) for a in arrays)).alias(f"h{j}") for j, p in enumerate(sets)))
        df = df.withColumn("__h", F.explode(F.array(held))).drop(*(f"__{a}" for a in arrays)) if arrays else df
        named = [n for n in spec["others"] if any(n in other[i] and other[i][n] is not None for i in wanting)]
        for n in named:
            mine = tables[f"{n}_objects"]
            kept = [a for a in SURVEYS[n]["arrays"] if a in mine.columns]
            source = "__aliases" if "aliases" not in df.columns and "aliases" in more else "aliases"
            df = df.withColumn("__alias", F.get(F.col(f"{source}.{n}"), F.lit(0))).join(mine.select(F.col("objectId").alias("__other"), F.struct("objectId", *kept).alias(f"__{n}")), F.col("__alias") == F.col("__other"), "left").drop("__alias", "__other")
            for p in dict.fromkeys(_seen_of(filters[i], n) for i in wanting):
                whole = F.col(f"__{n}")
                for a in kept:
                    points = series.trailing(F.col(f"__{n}.{a}"), F.col("candidate.jd"), spec["days"])
                    whole = whole.withField(a, permitted(points, list(p)) if SURVEYS[n]["programs"] else points)
                df = df.withColumn(f"__{n}:{','.join(map(str, p))}", F.when(F.col(f"__{n}").isNotNull(), whole))
        for i in wanting:
            given(i, {a: (F.col(f"__h.h{sets.index(programs[i])}.{a}"), kinds[a]) for a in arrays} | {c: (F.col(f"__{c}"), kinds[c]) for c in more if c not in docs[i].schema.names})
        for k in range(min(early[i] for i in wanting), max(len(stages[i]) for i in wanting)):
            for i in wanting:
                for n, at in other[i].items():
                    if at == k and n in named:
                        column = f"__{n}:{','.join(map(str, _seen_of(filters[i], n)))}"
                        given(i, {n: (F.col(f"`{column}`"), df.schema[column].dataType)})
            df = step(df, {i: stages[i][k] for i in wanting if early[i] <= k < len(stages[i])})
    told = F.array(*(F.when(F.col(f"__b{i // WORD * WORD}").bitwiseAND(bit(i)) != 0, F.struct(F.lit(f.id).alias("filter_id"), _note(docs[i]).alias("annotations"))) for i, f in enumerate(filters)))
    out = df.select("_id", "objectId", F.array_sort(F.filter(told, lambda x: x.isNotNull())).alias("filters"))
    return out.where(F.size("filters") > 0)


def _alone(f: Filter) -> bool:
    """Whether a filter has a plan of its own: it compares alerts with each other, or with a watchlist."""
    stages = f.stages()
    return bool(f.watchlist) or first_use(stages, "sso_history") is not None or any(stage_of(s)[0] not in ROWWISE for s in stages)


def run_filters(alerts: DataFrame, filters: list[Filter], tables: Tables, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(_id, objectId, filters): which filters each alert passes, with their annotations as JSON, by filter id.

    Filters of a survey share one plan, so the alerts are read once and objects joined once, however many there are.
    Those that need other alerts or a watchlist are run one by one.

    ``near`` adds ``cross_matches`` to rows with the objects' ``FIRST_SIGHT``, each object once. It is called only where a
    filter can see them.
    """
    parts = []
    for survey in dict.fromkeys(f.survey for f in filters):
        some = [f for f in filters if f.survey == survey and not _alone(f)]
        if some:
            parts.append(_shared(alerts, some, tables, near))
    for f in filters:
        if _alone(f):
            name = f"{f.survey}_objects"
            got = run_filter(alerts, f, tables | {name: near(tables[name])} if near and _names_matches(f) else tables)
            parts.append(got.select("_id", "objectId", F.array(F.struct(F.lit(f.id).alias("filter_id"), _note(Scope(got.schema)).alias("annotations"))).alias("filters")))
    if not parts:
        return alerts.select("_id", "objectId").where(F.lit(False)).withColumn("filters", F.array().cast(PASSED))
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("_id").agg(F.first("objectId").alias("objectId"), F.array_sort(F.flatten(F.collect_list("filters"))).alias("filters"))


def selective(matched: int, total: int, percent: float) -> bool:
    """Whether a filter may be activated: there are alerts, and it passes few enough of them."""
    return total > 0 and matched <= int(total * percent / 100)


def is_selective(matched: Column, total: Column, percent: float) -> Column:
    """The same for columns of counts."""
    return (total > 0) & (matched <= F.floor(total * percent / 100))


def dry_run(alerts: DataFrame, f: Filter, tables: Tables, start: float | None = None, end: float | None = None, objects: list[str] | None = None, candids: list[int] | None = None, sort: dict[str, int] | None = None, limit: int | None = None, latest: int | None = None) -> DataFrame:
    """What a filter would pass of a restricted set of alerts, sorted and limited if asked.

    The restriction is checked first, and thins the alerts before the filter runs; its count is ``dry_run(...).count()``.
    With ``latest`` so many of the newest alerts that the filter may see are looked up. A sort may name fields of the filter's result, annotations too, or else of the alert: these are looked up again for
    what has passed, as the filter may not keep them.
    """
    if latest:
        if latest > 1000:
            raise FilterError("too many objects or alerts")
        seen = F.col("candidate.programid").isin(f.permissions.get(f.survey) or []) if SURVEYS[f.survey]["programs"] else F.lit(True)
        candids = [r["_id"] for r in alerts.where(seen).orderBy(F.col("candidate.jd").desc(), F.col("_id").desc()).limit(latest).select("_id").collect()] or [None]
    check_test_window(start, end, objects, candids)
    if start is not None:
        alerts = alerts.where((F.col("candidate.jd") >= start) & (F.col("candidate.jd") <= end))
    if objects:
        alerts = alerts.where(F.col("objectId").isin(objects))
    if candids:
        alerts = alerts.where(F.col("_id").isin(candids))
    out = run_filter(alerts, f, tables)
    if sort:
        scope = pipeline.scope_of(out)
        own = {k for k in sort if pipeline.path_of(scope, k) is not pipeline.NULL}
        if lost := [k for k in sort if k not in own]:
            out = out.join(alerts.select(F.col("_id").alias("__id"), *(F.col(k).alias(f"__{k}") for k in lost)), F.col("_id") == F.col("__id"))
        by = {k: pipeline.path_of(scope, k).column if k in own else F.col(f"`__{k}`") for k in sort}
        out = out.orderBy(*(by[k].asc_nulls_first() if way > 0 else by[k].desc_nulls_last() for k, way in sort.items()), "_id")
        return (out.limit(limit) if limit else out).drop("__id", *(f"__{k}" for k in lost))
    return out.limit(limit) if limit else out


def result_packets(results: DataFrame, alerts: DataFrame, objects: DataFrame, cutouts: DataFrame | None = None, survey: str = "ZTF", array: str = "prv_candidates", programs: list[int] | None = None) -> DataFrame:
    """A packet for each alert that passed a filter: (_id, objectId, filters, candidate, photometry, cut-outs).

    ``results`` is what ``run_filters`` gives. Photometry is the object's up to the alert, of permitted programmes, in
    time order; cut-outs are null where none are stored.
    """
    passed = results.select("_id", "filters").join(alerts.select("_id", "objectId", "candidate"), "_id")
    series_of = objects.select("objectId", F.col(array).alias("__points"))
    out = passed.join(series_of, "objectId", "left")
    past = series.up_to(F.col("__points"), F.col("candidate.jd"))
    points = F.array_sort(permitted(past, programs) if programs is not None else past)
    out = out.withColumn("photometry", F.coalesce(points, F.array().cast(objects.schema[array].dataType))).drop("__points")
    return out.join(cutouts.select("_id", F.struct(*(c for c in cutouts.columns if c != "_id")).alias("cutouts")), "_id", "left") if cutouts is not None else out


def check_test_window(start: float | None, end: float | None, objects: list[str] | None = None, candids: list[int] | None = None) -> None:
    """Raise unless a dry run is restricted, to a week, a thousand objects or a hundred thousand alerts."""
    if start is None and not objects and not candids:
        raise FilterError("a test needs a window, objects or alerts")
    if start is not None and (end is None or end <= start or end - start > 7):
        raise FilterError("a window ends after it starts and lasts seven days at most")
    if len(objects or ()) > 1000 or len(candids or ()) > 100_000:
        raise FilterError("too many objects or alerts")


def add_version(f: Filter, fid: str, stages: list[dict]) -> Filter:
    """The filter with another version, made active."""
    validate(stages)
    return Filter(f.id, f.survey, f.versions | {fid: json.dumps(stages)}, fid, f.permissions, f.active, f.watchlist, f.watch_fields)


def task_of(text: str) -> tuple[int, int]:
    """(programme, alert id) of a queued task "p,candid"; a programme has one digit."""
    program, comma, candid = text.partition(",")
    if not (comma and len(program) == 1 and program.isdigit() and candid.lstrip("-").isdigit()):
        raise FilterError(f"no task: {text}")
    return int(program), int(candid)


def tasks_of(text: Column) -> Column:
    """struct<program, candid> of a column of queued tasks; both are null where a text is no task."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^([0-9]),(-?[0-9]+)$", i), F.lit(""))
    candid = part(2).try_cast("long")
    return F.struct(F.when(candid.isNotNull(), part(1).cast("int")).alias("program"), candid.alias("candid"))
