"""Pipeline expressions as Spark columns.

An expression is a literal, a "$path", a "$$variable", an array, or an object with one operator. It compiles to a
column and its type, so that paths into structs, arrays of structs and lambda variables are resolved when the query is
built; a path that leads nowhere is null. In expressions null sorts below every value (``compare``); in match
conditions a comparison with null never holds (``plans.pipeline``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """An expression that can't be compiled."""


@dataclass(frozen=True)
class Typed:
    """A column with its type; without a column it is null."""

    made: Column | None
    kind: T.DataType

    @property
    def column(self) -> Column:
        return F.lit(None) if self.made is None else self.made


NULL = Typed(None, T.NullType())


@dataclass(frozen=True)
class Scope:
    """What paths and variables mean: the document's schema, the variables bound so far, and where the document's fields
    are: the row's own columns unless ``at`` names others."""

    schema: T.StructType
    variables: dict[str, Typed] = field(default_factory=dict)
    at: dict[str, Column] | None = None

    def bind(self, **more: Typed) -> Scope:
        return Scope(self.schema, self.variables | more, self.at)

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.at is None else self.at[name]


def resolve(start: Typed, path: list[str]) -> Typed:
    """Follow field names and array places; through an array of structs a name gives the array of that field."""
    at = start
    for step in path:
        kind = at.kind
        if isinstance(kind, T.StructType):
            at = Typed(at.column[step], kind[step].dataType) if step in kind.names else NULL
        elif isinstance(kind, T.MapType):
            at = Typed(F.element_at(at.column, step), kind.valueType)
        elif isinstance(kind, T.ArrayType) and step.lstrip("-").isdigit():
            at = element(at, int(step))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and step in kind.elementType.names:
            at = Typed(at.column[step], T.ArrayType(kind.elementType[step].dataType))
        else:
            return NULL
    return at


def element(array: Typed, i: int) -> Typed:
    """The i-th element, from the end for negative places, null outside."""
    kind = array.kind.elementType if isinstance(array.kind, T.ArrayType) else T.NullType()
    return Typed(F.get(array.column, F.lit(i)) if i >= 0 else F.get(array.column, F.size(array.column) + i), kind)


def path_of(scope: Scope, path: str) -> Typed:
    head, *rest = path.split(".")
    if head not in scope.schema.names:
        return NULL
    return resolve(Typed(scope.column(head), scope.schema[head].dataType), rest)


def compare(op: str, a: Column, b: Column) -> Column:
    """Total order with null lowest; never null."""
    below = F.coalesce(a < b, a.isNull() & b.isNotNull())
    above = F.coalesce(a > b, a.isNotNull() & b.isNull())
    return {"$eq": a.eqNullSafe(b), "$ne": ~a.eqNullSafe(b), "$lt": below, "$gt": above, "$lte": ~above, "$gte": ~below}[op]


def truth(x: Typed) -> Column:
    """False for null, false and zero."""
    if isinstance(x.kind, T.BooleanType):
        return F.coalesce(x.column, F.lit(False))
    if isinstance(x.kind, T.NumericType):
        return F.coalesce(x.column != 0, F.lit(False))
    return x.column.isNotNull()


def _number(value: Callable[..., Column]) -> Callable[[list[Typed]], Typed]:
    return lambda xs: Typed(value(*(x.column for x in xs)), T.DoubleType())


def _sum(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def _product(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


def _round(x: Column, places: Column | None = None) -> Column:
    """Half to even, on the decimal that the number prints as; NaN and infinities stay."""
    return F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e30), x.cast("double")).otherwise(F.bround(x.cast("double"), 0 if places is None else places))


SIMPLE: dict[str, Callable[[list[Typed]], Typed]] = {
    "$add": _number(_sum), "$multiply": _number(_product), "$subtract": _number(lambda a, b: a - b), "$divide": _number(lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))),
    "$mod": _number(lambda a, b: F.try_mod(a, b)), "$pow": _number(F.power), "$sqrt": _number(F.sqrt), "$abs": _number(F.abs), "$log10": _number(lambda x: F.log10(x.cast("double"))), "$ln": _number(lambda x: F.ln(x.cast("double"))), "$exp": _number(F.exp),
    "$floor": _number(F.floor), "$ceil": _number(F.ceil), "$round": _number(_round),
    "$max": _number(lambda *xs: F.greatest(*xs) if len(xs) > 1 else F.array_max(xs[0])), "$min": _number(lambda *xs: F.least(*xs) if len(xs) > 1 else F.array_min(xs[0])),
}


def compile_expression(e: Any, scope: Scope) -> Typed:
    if isinstance(e, str) and e.startswith("$$"):
        name, *rest = e[2:].split(".")
        if name in ("ROOT", "CURRENT"):
            whole = Typed(F.struct(*(scope.column(c).alias(c) for c in scope.schema.names)), scope.schema)
            return resolve(whole, rest)
        if name not in scope.variables:
            raise ExpressionError(f"unknown variable $${name}")
        return resolve(scope.variables[name], rest)
    if isinstance(e, str) and e.startswith("$"):
        return path_of(scope, e[1:])
    if isinstance(e, list):
        return _array([compile_expression(x, scope) for x in e])
    if isinstance(e, dict):
        names = list(e)
        if len(names) == 1 and names[0].startswith("$"):
            return _operator(names[0], e[names[0]], scope)
        parts = {k: compile_expression(v, scope) for k, v in e.items()}
        return Typed(F.struct(*(p.column.alias(k) for k, p in parts.items())), T.StructType([T.StructField(k, p.kind) for k, p in parts.items()]))
    return literal(e)


def literal(e: Any) -> Typed:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return NULL if e is None else Typed(F.lit(e), kinds[type(e)])


def _array(xs: list[Typed]) -> Typed:
    kind = next((x.kind for x in xs if not isinstance(x.kind, T.NullType)), T.NullType())
    return Typed(F.array(*(x.column for x in xs)), T.ArrayType(kind))


def _list(args: Any) -> list:
    return args if isinstance(args, list) else [args]


def _items(x: Typed) -> Typed:
    """An array, or an empty one in place of what is none."""
    return x if isinstance(x.kind, T.ArrayType) else Typed(F.array(), T.ArrayType(T.NullType()))


def _lambda(array: Typed, body: Callable[[Typed], Typed], make: Callable) -> tuple[Column, T.DataType]:
    """Apply a higher-order function; the body's type is seen as it is compiled."""
    seen: list[T.DataType] = []

    def inner(x: Column) -> Column:
        out = body(Typed(x, array.kind.elementType))
        seen.append(out.kind)
        return out.column

    column = make(array.column, inner)
    return column, seen[-1] if seen else T.NullType()


def _operator(op: str, args: Any, scope: Scope) -> Typed:
    sub = lambda x, **more: compile_expression(x, scope.bind(**more) if more else scope)
    if op in SIMPLE:
        return SIMPLE[op]([sub(x) for x in _list(args)])
    if op == "$literal":
        return literal(args)
    if op in ("$eq", "$ne", "$lt", "$lte", "$gt", "$gte"):
        a, b = (sub(x) for x in args)
        return Typed(compare(op, a.column, b.column), T.BooleanType())
    if op in ("$and", "$or"):
        parts = [truth(sub(x)) for x in args]
        out = F.lit(op == "$and")
        for p in parts:
            out = out & p if op == "$and" else out | p
        return Typed(out, T.BooleanType())
    if op == "$not":
        return Typed(~truth(sub(_list(args)[0])), T.BooleanType())
    if op == "$in":
        what, where = (sub(x) for x in args)
        return Typed(F.coalesce(F.exists(_items(where).column, lambda x: x.eqNullSafe(what.column)), F.lit(False)), T.BooleanType())
    if op == "$cond":
        a, b, c = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
        yes, no = sub(b), sub(c)
        kind = no.kind if isinstance(yes.kind, T.NullType) or isinstance(yes.kind, T.ArrayType) and isinstance(yes.kind.elementType, T.NullType) else yes.kind
        return Typed(F.when(truth(sub(a)), yes.column).otherwise(no.column), kind)
    if op == "$switch":
        out = sub(args["default"]) if "default" in args else NULL
        for b in reversed(args["branches"]):
            then = sub(b["then"])
            out = Typed(F.when(truth(sub(b["case"])), then.column).otherwise(out.column), then.kind)
        return out
    if op == "$ifNull":
        parts = [sub(x) for x in args]
        real = [p for p in parts if not isinstance(p.kind, T.NullType)]
        if not real:
            return NULL
        solid = [p for p in real if not (isinstance(p.kind, T.ArrayType) and isinstance(p.kind.elementType, T.NullType))]
        return Typed(F.coalesce(*(p.column for p in real)), (solid or real)[0].kind)
    if op == "$isNumber":
        x = sub(_list(args)[0])
        return Typed(x.column.isNotNull() if isinstance(x.kind, T.NumericType) else F.lit(False), T.BooleanType())
    if op == "$isArray":
        return Typed(F.lit(isinstance(sub(_list(args)[0]).kind, T.ArrayType)), T.BooleanType())
    if op == "$size":
        x = sub(_list(args)[0])
        return Typed(F.coalesce(F.size(F.when(x.column.isNotNull(), x.column)), F.lit(0)) if isinstance(x.kind, T.ArrayType) else F.lit(0), T.IntegerType())
    if op == "$arrayElemAt":
        array, at = args
        return element(sub(array), at) if isinstance(at, int) else Typed(F.get(sub(array).column, sub(at).column.cast("int")), sub(array).kind.elementType)
    if op in ("$first", "$last"):
        return element(sub(_list(args)[0]), 0 if op == "$first" else -1)
    if op == "$slice":
        array, *n = [sub(args[0]), *args[1:]]
        whole = F.size(array.column)
        if len(n) == 2:
            return Typed(F.slice(array.column, n[0] + 1, n[1]), array.kind)
        return Typed(F.slice(array.column, 1, n[0]) if n[0] >= 0 else F.slice(array.column, F.greatest(whole + n[0], F.lit(0)) + 1, -n[0]), array.kind)
    if op == "$concatArrays":
        parts = [p for p in map(sub, args) if isinstance(p.kind, T.ArrayType)]
        kind = next((p.kind for p in parts if not isinstance(p.kind.elementType, T.NullType)), parts[0].kind)
        return Typed(F.concat(*(p.column for p in parts)), kind)
    if op == "$concat":
        return Typed(F.concat(*(sub(x).column.cast("string") for x in args)), T.StringType())
    if op == "$filter":
        name, array = args.get("as", "this"), sub(args["input"])
        if not isinstance(array.kind, T.ArrayType):
            return NULL
        column, _ = _lambda(array, lambda x: Typed(truth(sub(args["cond"], **{name: x})), T.BooleanType()), F.filter)
        return Typed(column, array.kind)
    if op == "$map":
        name, array = args.get("as", "this"), sub(args["input"])
        if not isinstance(array.kind, T.ArrayType):
            return NULL
        column, kind = _lambda(array, lambda x: sub(args["in"], **{name: x}), F.transform)
        return Typed(column, T.ArrayType(kind))
    if op == "$anyElementTrue":
        array = sub(_list(args)[0])
        return Typed(F.coalesce(F.exists(array.column, lambda x: truth(Typed(x, array.kind.elementType))), F.lit(False)) if isinstance(array.kind, T.ArrayType) else F.lit(False), T.BooleanType())
    if op == "$allElementsTrue":
        array = sub(_list(args)[0])
        return Typed(F.coalesce(F.forall(array.column, lambda x: truth(Typed(x, array.kind.elementType))), F.lit(True)), T.BooleanType())
    if op == "$reduce":
        return _reduce(args, scope)
    if op == "$range":
        start, stop, step = [sub(x).column.cast("int") for x in args] + ([F.lit(1)] if len(args) == 2 else [])
        ahead = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
        last = stop - F.signum(step.cast("double")).cast("int")
        return Typed(F.when(ahead, F.sequence(start, F.when(ahead, last).otherwise(start), F.when(ahead, step).otherwise(F.lit(1)))).otherwise(F.array().cast("array<int>")), T.ArrayType(T.IntegerType()))
    if op == "$let":
        return sub(args["in"], **{k: sub(v) for k, v in args["vars"].items()})
    if op == "$mergeObjects":
        out = sub(args[0])
        for x in args[1:]:
            more = sub(x)
            column, names = out.column, {f.name: f.dataType for f in out.kind.fields}
            for f in more.kind.fields:
                column = column.withField(f"`{f.name}`", more.column[f.name])
                names[f.name] = f.dataType
            out = Typed(column, T.StructType([T.StructField(k, v) for k, v in names.items()]))
        return out
    if op == "$sortArray":
        return sort_array(sub(args["input"]), args["sortBy"])
    if op == "$reverseArray":
        x = sub(_list(args)[0])
        return Typed(F.reverse(x.column), x.kind)
    if op in ("$setUnion", "$setIntersection", "$setDifference"):
        xs = [sub(x) for x in args]
        f = {"$setUnion": F.array_union, "$setIntersection": F.array_intersect, "$setDifference": F.array_except}[op]
        out = xs[0].column
        for x in xs[1:]:
            out = f(out, x.column)
        return Typed(out, xs[0].kind)
    if op == "$setEquals":
        a, b = (sub(x).column for x in args)
        return Typed(F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b))), T.BooleanType())
    raise ExpressionError(f"unknown operator {op}")


def _reduce(args: dict, scope: Scope) -> Typed:
    """Fold an array. The accumulator has the type that the fold itself gives, so an empty start needs no type."""
    array, start = compile_expression(args["input"], scope), compile_expression(args["initialValue"], scope)
    if not isinstance(array.kind, T.ArrayType):
        return start
    kind: list[T.DataType] = [T.DoubleType() if isinstance(start.kind, T.NumericType) else start.kind]

    def step(value: Column, this: Column) -> Column:
        out = compile_expression(args["in"], scope.bind(value=Typed(value, kind[0]), this=Typed(this, array.kind.elementType)))
        if isinstance(kind[0], T.NullType) or isinstance(kind[0], T.ArrayType) and isinstance(kind[0].elementType, T.NullType):
            kind[0] = out.kind
        return out.column.cast(kind[0]) if not isinstance(kind[0], T.NullType) else out.column

    F.aggregate(array.column, start.column, step)  # once to see the type
    return Typed(F.aggregate(array.column, start.column.cast(kind[0]) if not isinstance(kind[0], T.NullType) else start.column, step), kind[0])


def sort_array(array: Typed, by: Any) -> Typed:
    """Sort by a direction, or by {field: direction, ...}; nulls first ascending, equal elements in their order."""
    if not isinstance(array.kind, T.ArrayType):
        return array
    keys = by.items() if isinstance(by, dict) else [("", by)]

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, way in reversed(list(keys)):
            x, y = (resolve(Typed(c["v"], array.kind.elementType), name.split(".") if name else []).column for c in (a, b))
            out = F.when(compare("$lt", x, y), F.lit(-way)).when(compare("$gt", x, y), F.lit(way)).otherwise(out)
        return F.when(out != 0, out).otherwise(F.when(a["i"] < b["i"], -1).otherwise(1))

    numbered = F.transform(array.column, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return Typed(F.transform(F.array_sort(numbered, order), lambda x: x["v"]), array.kind)
