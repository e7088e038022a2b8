"""Aggregation pipelines over tables: each stage is a DataFrame transformation, and Catalyst does the rest."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import sky
from skyloom.functions.expressions import NULL, ExpressionError, Scope, Typed, compile_expression, path_of, truth
from skyloom.sources import tables as layouts

Tables = Mapping[str, DataFrame]


def scope_of(df: DataFrame) -> Scope:
    return Scope(df.schema)


def _holds(x: Typed, test) -> Column:
    """A test of a value, or of any element of an array; null counts as no."""
    if isinstance(x.kind, T.ArrayType):
        return F.coalesce(F.exists(x.column, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))
    return F.coalesce(test(x.column), F.lit(False))


def _condition(scope: Scope, name: str, cond: Any) -> Column:
    x = path_of(scope, name)
    if not (isinstance(cond, dict) and cond and all(k.startswith("$") for k in cond)):
        return _is(x, cond)
    parts = []
    for op, v in cond.items():
        if op == "$eq":
            parts.append(_is(x, v))
        elif op == "$ne":
            parts.append(~_is(x, v))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            test = {"$gt": lambda c: c > v, "$gte": lambda c: c >= v, "$lt": lambda c: c < v, "$lte": lambda c: c <= v}[op]
            parts.append(_holds(x, test) if x is not NULL else F.lit(False))
        elif op in ("$in", "$nin"):
            some = [i for i in v if i is not None]
            inside = _holds(x, lambda c: c.isin(some)) if some else F.lit(False)
            inside = inside | x.column.isNull() if None in v else inside
            parts.append(inside if op == "$in" else ~inside)
        elif op == "$exists":
            head, _, last = name.rpartition(".")
            there = x.column.isNotNull()
            if last.isdigit() and isinstance(path_of(scope, head).kind, T.ArrayType):
                there = F.coalesce(F.size(path_of(scope, head).column) > int(last), F.lit(False))
            parts.append(there if v else ~there)
        elif op == "$regex":
            prefix = v[1:] if v.startswith("^") and v[1:].replace("_", "").replace("-", "").isalnum() else None
            parts.append(_holds(x, lambda c: c.startswith(prefix) if prefix is not None else c.rlike(v)))
        elif op == "$not":
            parts.append(~_condition(scope, name, v))
        elif op == "$size":
            parts.append(F.coalesce(F.size(x.column) == v, F.lit(False)))
        elif op == "$elemMatch":
            inner = x.kind.elementType
            parts.append(F.coalesce(F.exists(x.column, lambda e: _elem(inner, e, v)), F.lit(False)))
        elif op == "$geoWithin":
            (lon, lat), radius = v["$centerSphere"]
            parts.append(_cone(scope, name, lon, lat, radius))
        elif op == "$nearSphere":
            parts.append(_cone(scope, name, *v, cond.get("$maxDistance", math.pi)))
        elif op == "$maxDistance":
            continue
        else:
            raise ExpressionError(f"unknown condition {op}")
    return reduce(lambda a, b: a & b, parts)


def _cone(scope: Scope, name: str, lon: float, lat: float, radians: float) -> Column:
    ra, dec = _position(scope, name)
    within = sky.separation(ra, dec, F.lit(lon + 180.0), F.lit(float(lat))) <= F.degrees(F.lit(float(radians)))
    here = sky.near_box(ra, dec, lon + 180.0, lat, math.degrees(radians)) & within
    cells = layouts.in_cones(scope.schema, name, [(lon + 180.0, lat, math.degrees(radians))]) if scope.at is None else None
    return F.coalesce(here, F.lit(False)) if cells is None else cells & F.coalesce(here, F.lit(False))


def nearest_first(df: DataFrame, query: dict) -> DataFrame:
    """Rows by their distance from the position that a ``$nearSphere`` of the query names, if it has one."""
    for name, v in query.items():
        if isinstance(v, dict) and "$nearSphere" in v:
            (lon, lat), (ra, dec) = v["$nearSphere"], _position(scope_of(df), name)
            return df.orderBy(sky.separation(ra, dec, F.lit(lon + 180.0), F.lit(float(lat))))
    return df


def _elem(kind: T.DataType, e: Column, cond: dict) -> Column:
    scope = Scope(T.StructType([T.StructField("x", kind)]), {"e": Typed(e, kind)})
    tests = []
    for k, v in cond.items():
        ops = v if isinstance(v, dict) else {"$eq": v}
        target = f"$$e.{k}" if not k.startswith("$") else "$$e"
        for op, w in (ops if not k.startswith("$") else {k: v}).items():
            x = compile_expression(target, scope)
            test = compile_expression({op: [target, w]}, scope).column
            tests.append(x.column.isNotNull() & test if w is not None else test)
    return reduce(lambda a, b: a & b, tests)


def _position(scope: Scope, name: str) -> tuple[Column, Column]:
    """Right ascension and declination of a GeoJSON point, whose longitude is shifted by 180 degrees."""
    pair = path_of(scope, f"{name}.coordinates").column
    return F.get(pair, F.lit(0)) + 180.0, F.get(pair, F.lit(1))


def _is(x: Typed, v: Any) -> Column:
    if v is None:
        return x.column.isNull()
    return _holds(x, lambda c: c == v) if x is not NULL else F.lit(False)


def match(scope: Scope, query: dict) -> Column:
    """A match document as a column that is never null, so negation and disjunction are safe."""
    parts = []
    for k, v in query.items():
        if k in ("$and", "$or", "$nor"):
            subs = [match(scope, q) for q in v]
            joined = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), subs)
            parts.append(~joined if k == "$nor" else joined)
        elif k == "$expr":
            parts.append(truth(compile_expression(v, scope)))
        else:
            parts.append(_condition(scope, k, v))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _tree(spec: dict) -> dict:
    """Dotted names as nested objects."""
    out: dict = {}
    for k, v in spec.items():
        at = out
        *heads, last = k.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = v
    return out


def _shown(x: Typed, spec: Any, scope: Scope) -> Typed | None:
    """What a projection makes of a value: the value, some of its fields, or a computed object."""
    if spec in (1, True):
        return x if x is not NULL else None
    if isinstance(spec, dict) and not any(k.startswith("$") for k in spec):
        if isinstance(x.kind, T.ArrayType) and isinstance(x.kind.elementType, T.StructType):
            inner = x.kind.elementType
            names = [k for k in spec if k in inner.names]
            if names and all(spec[k] in (1, True) for k in names):
                return Typed(F.transform(x.column, lambda e: F.struct(*(e[k].alias(k) for k in names))), T.ArrayType(T.StructType([inner[k] for k in names])))
        parts = {}
        for k, v in spec.items():
            here = Typed(x.column[k], x.kind[k].dataType) if isinstance(x.kind, T.StructType) and k in x.kind.names else NULL
            if (made := _shown(here, v, scope)) is not None:
                parts[k] = made
        if not parts:
            return None
        built = F.struct(*(p.column.alias(k) for k, p in parts.items()))
        return Typed(built, T.StructType([T.StructField(k, p.kind) for k, p in parts.items()]))
    return compile_expression(spec, scope)


def projected(scope: Scope, spec: dict) -> dict[str, Column]:
    """The fields that a projection leaves of a document."""
    tree = _tree(spec)
    flat = [v for k, v in spec.items() if k != "_id"]
    if flat and all(v in (0, False) and not isinstance(v, dict) for v in flat) or not flat and spec.get("_id") in (0, False):
        return without(scope, [k for k, v in spec.items() if v in (0, False)])
    if "_id" not in tree and "_id" in scope.schema.names:
        tree = {"_id": 1} | tree
    out = {}
    for k, v in tree.items():
        if v in (0, False) and not isinstance(v, dict):
            continue
        made = _shown(path_of(scope, k), v, scope)
        if made is not None:
            out[k] = F.lit(None).cast("string") if isinstance(made.kind, T.NullType) else made.column
    return out


def added(scope: Scope, spec: dict) -> dict[str, Column]:
    """New values, all computed from the document as it was."""
    columns: dict[str, Column] = {}
    for k, e in spec.items():
        head, _, rest = k.partition(".")
        value = compile_expression(e, scope)
        column = F.lit(None).cast("string") if isinstance(value.kind, T.NullType) else value.column
        if rest:
            old = head in scope.schema.names
            here = columns.get(head) if head in columns else (scope.column(head) if old and isinstance(scope.schema[head].dataType, T.StructType) else None)
            if here is None:
                for part in reversed(rest.split(".")):
                    column = F.struct(column.alias(part))
            else:
                column = (F.coalesce(here, F.from_json(F.lit("{}"), scope.schema[head].dataType.simpleString())) if old else here).withField(rest, column)
        columns[head] = column
    return columns


def without(scope: Scope, names: str | list[str]) -> dict[str, Column]:
    """The document's fields without those named."""
    out = {c: scope.column(c) for c in scope.schema.names}
    for name in [names] if isinstance(names, str) else names:
        head, _, rest = name.partition(".")
        if not rest:
            out.pop(name, None)
        elif head in out and path_of(scope, name) is not NULL:
            kind = scope.schema[head].dataType
            if isinstance(kind, T.StructType):
                out[head] = out[head].dropFields(rest)
            elif isinstance(kind, T.ArrayType):
                out[head] = F.transform(out[head], lambda e: e.dropFields(rest))  # noqa: B023
    return out


def project(df: DataFrame, spec: dict) -> DataFrame:
    return df.select(*(c.alias(k) for k, c in projected(scope_of(df), spec).items()))


def add_fields(df: DataFrame, spec: dict) -> DataFrame:
    return df.withColumns(added(scope_of(df), spec))


def unset(df: DataFrame, names: str | list[str]) -> DataFrame:
    return df.select(*(c.alias(k) for k, c in without(scope_of(df), names).items()))


_SUMMARIES = {
    "$sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "$avg": F.avg, "$min": F.min, "$max": F.max, "$push": F.collect_list, "$addToSet": F.collect_set, "$first": F.first, "$last": F.last,
    "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp,
}


def group(df: DataFrame, spec: dict) -> DataFrame:
    scope, aggs = scope_of(df), []
    for name, how in spec.items():
        if name != "_id":
            (op, arg), = how.items()
            aggs.append((F.count("*") if op == "$count" else _SUMMARIES[op](compile_expression(arg, scope).column)).alias(name))
    key = compile_expression(spec["_id"], scope)
    if isinstance(key.kind, T.NullType):
        return df.groupBy().agg(F.lit(None).cast("string").alias("_id"), *aggs)
    keyed = df.groupBy(key.column.alias("_id"))
    return keyed.agg(*aggs) if aggs else df.select(key.column.alias("_id")).distinct()


def unwind(df: DataFrame, spec: str | dict) -> DataFrame:
    """One row for each element; rows without elements go unless they are to be preserved."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    name, keep = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False)
    head, _, rest = name.partition(".")
    value = path_of(scope_of(df), name).column
    explode = (F.posexplode_outer if keep else F.posexplode)(value).alias("__place", "__item")
    out = df.select("*", explode)
    out = out.withColumn(head, F.col(head).withField(rest, F.col("__item")) if rest else F.col("__item"))
    if place := spec.get("includeArrayIndex"):
        out = out.withColumn(place, F.col("__place"))
    return out.drop("__place", "__item")


def lookup(df: DataFrame, spec: dict, tables: Tables) -> DataFrame:
    """The foreign rows with an equal key, as an array; none gives an empty array. Null keys meet nothing.

    The foreign side is gathered by key before the join, so each side is shuffled once and no row is repeated.
    """
    foreign = run(tables[spec["from"]], spec.get("pipeline", []), tables)
    key, local = path_of(scope_of(foreign), spec["foreignField"]), path_of(scope_of(df), spec["localField"])
    rows = foreign.where(key.column.isNotNull()).groupBy(key.column.alias("__key")).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in foreign.columns))).alias("__rows"))
    if isinstance(local.kind, T.ArrayType):
        # what an array meets depends on its keys alone, so equal arrays are looked up once and no row needs a number
        keyed = df.withColumn("__keys", F.array_sort(F.array_distinct(local.column)))
        each = keyed.select("__keys").where("size(__keys) > 0").distinct().select("__keys", F.explode("__keys").alias("__key")).join(rows, "__key")
        each = each.groupBy("__keys").agg(F.flatten(F.collect_list("__rows")).alias("__rows")).withColumnRenamed("__keys", "__met")
        joined = keyed.join(each, F.col("__keys") == F.col("__met"), "left").drop("__keys", "__met")
    else:
        joined = df.withColumn("__local", local.column).join(rows, F.col("__local") == F.col("__key"), "left").drop("__local", "__key")
    empty = F.array().cast(rows.schema["__rows"].dataType)
    return joined.withColumn(spec["as"], F.coalesce("__rows", empty)).drop("__rows")


def lookup_unwound(df: DataFrame, spec: dict, keep: bool, tables: Tables) -> DataFrame:
    """A lookup whose array is taken apart at once: a plain join, where no key's rows are ever gathered."""
    foreign = run(tables[spec["from"]], spec.get("pipeline", []), tables)
    key, local = path_of(scope_of(foreign), spec["foreignField"]), path_of(scope_of(df), spec["localField"])
    rows = foreign.select(key.column.alias("__key"), F.struct(*(F.col(f"`{c}`") for c in foreign.columns)).alias("__row"))
    joined = df.withColumn("__local", local.column).join(rows, F.col("__local") == F.col("__key"), "left" if keep else "inner")
    return joined.withColumn(spec["as"], F.col("__row")).drop("__local", "__key", "__row")


def _joins(now: dict, after: dict, df: DataFrame) -> bool:
    """Whether a stage and the next are a lookup by one value and the unwinding of what it found."""
    if "$lookup" not in now or "$unwind" not in after or isinstance(path_of(scope_of(df), now["$lookup"]["localField"]).kind, T.ArrayType):
        return False
    how = after["$unwind"]
    return (how if isinstance(how, str) else how["path"]) == "$" + now["$lookup"]["as"] and not (isinstance(how, dict) and how.get("includeArrayIndex"))


def sort(df: DataFrame, spec: dict) -> DataFrame:
    """Nulls come first ascending and last descending."""
    scope = scope_of(df)
    return df.orderBy(*(path_of(scope, k).column.asc_nulls_first() if way in (1, "asc") else path_of(scope, k).column.desc_nulls_last() for k, way in spec.items()))


def stage_of(stage: dict) -> tuple[str, Any]:
    if len(stage) != 1:
        raise ExpressionError(f"a stage has one operator: {stage}")
    return next(iter(stage.items()))


def apply(df: DataFrame, stage: dict, tables: Tables) -> DataFrame:
    op, v = stage_of(stage)
    if op == "$match":
        return nearest_first(df.where(match(scope_of(df), v)), v)
    if op == "$project":
        return project(df, v)
    if op in ("$addFields", "$set"):
        return add_fields(df, v)
    if op == "$unset":
        return unset(df, v)
    if op == "$sort":
        return sort(df, v)
    if op == "$limit":
        return df.limit(v)
    if op == "$skip":
        return df.offset(v)
    if op == "$count":
        return df.groupBy().agg(F.count("*").alias(v))
    if op == "$group":
        return group(df, v)
    if op == "$unwind":
        return unwind(df, v)
    if op == "$lookup":
        return lookup(df, v, tables)
    if op == "$unionWith":
        spec = {"coll": v} if isinstance(v, str) else v
        return df.unionByName(run(tables[spec["coll"]], spec.get("pipeline", []), tables), allowMissingColumns=True)
    if op == "$sample":
        return df.orderBy(F.rand()).limit(v["size"])
    if op == "$replaceRoot":
        new = compile_expression(v["newRoot"], scope_of(df))
        return df.select(*(new.column[f.name].alias(f.name) for f in new.kind.fields))
    if op == "$sortByCount":
        return sort(group(df, {"_id": v, "count": {"$sum": 1}}), {"count": -1})
    raise ExpressionError(f"unknown stage {op}")


def parse(stages: str | list) -> list[dict]:
    """Stages from JSON text or as they are."""
    out = json.loads(stages) if isinstance(stages, str) else stages
    if not isinstance(out, list) or not all(isinstance(s, dict) for s in out):
        raise ExpressionError("a pipeline is a list of stages")
    return out


def run(df: DataFrame, stages: str | list, tables: Tables | None = None) -> DataFrame:
    todo = parse(stages)
    while todo:
        if len(todo) > 1 and _joins(todo[0], todo[1], df):
            how = todo[1]["$unwind"]
            df = lookup_unwound(df, todo[0]["$lookup"], isinstance(how, dict) and how.get("preserveNullAndEmptyArrays", False), tables or {})
            todo = todo[2:]
        else:
            df, todo = apply(df, todo[0], tables or {}), todo[1:]
    return df
