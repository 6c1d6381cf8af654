"""Python's built-in functions on column values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from ..plans.values import Value


def _range(*args: Value) -> Value:
    """As a value, a range is the number of its steps; loops go over its elements."""
    a = [v.col.cast("long") for v in args]
    if len(a) == 1:
        return Value(F.greatest(a[0], F.lit(0).cast("long")), V.LONG)
    span = F.greatest(a[1] - a[0], F.lit(0).cast("long"))
    return Value(span if len(a) == 2 else F.ceil(span / a[2]).cast("long"), V.LONG)


def _numbers(v: Value) -> T.DataType:
    return V.LONG if Value(v.col, v.type.elementType).kind == "I" else V.DOUBLE


def _sum(v: Value) -> Value:
    t = _numbers(v)
    return Value(F.aggregate(v.col, F.lit(0).cast(t), lambda a, x: a + F.coalesce(x.cast(t), F.lit(0).cast(t))), t)


def _extreme(of_array, of_values):  # noqa: ANN001, ANN202
    def f(*args: Value) -> Value:
        if len(args) == 1:
            return Value(of_array(args[0].col), args[0].type.elementType)
        t = args[0].type
        for v in args[1:]:
            t = V.common(t, v.type)
        return Value(of_values(*[V.cast(v, t) for v in args]), t)

    return f


def _round(v: Value, digits: Value | None = None) -> Value:
    if digits is None:
        return Value(F.round(v.col.cast("double")).cast("long"), V.LONG)
    return Value(F.round(v.col.cast("double"), digits.const), V.DOUBLE)


def _zip(*args: Value) -> Value:
    t = T.StructType([T.StructField(str(i), v.type.elementType) for i, v in enumerate(args)])
    n = F.least(*[F.size(v.col) for v in args]) if len(args) > 1 else F.size(args[0].col)
    return Value(F.slice(F.arrays_zip(*[v.col.alias(str(i)) for i, v in enumerate(args)]), F.lit(1), n), T.ArrayType(t))


def _enumerate(v: Value) -> Value:
    t = T.StructType([T.StructField("0", V.LONG), T.StructField("1", v.type.elementType)])
    return Value(F.transform(v.col, lambda x, i: F.struct(i.cast("long").alias("0"), x.alias("1"))), T.ArrayType(t))


def _each(v: Value, test) -> Value:  # noqa: ANN001
    return Value(F.coalesce(test(v.col, lambda x: V.truthy(Value(x, v.type.elementType))), F.lit(False)), V.BOOL)


def _reversed(v: Value) -> Value:
    return Value(F.reverse(v.col), v.type)


BUILTINS = {
    "len": V.size,
    "range": _range,
    "int": lambda v: Value(v.col.cast("long"), V.LONG),
    "float": lambda v: Value(v.col.cast("double"), V.DOUBLE),
    "str": lambda v: Value(V.cast(v, V.STRING), V.STRING),
    "bool": lambda v: Value(V.truthy(v), V.BOOL),
    "abs": lambda v: Value(F.abs(v.col), v.type),
    "round": _round,
    "min": _extreme(F.array_min, F.least),
    "max": _extreme(F.array_max, F.greatest),
    "sum": _sum,
    "sorted": lambda v: Value(F.array_sort(v.col), v.type),
    "reversed": _reversed,
    "any": lambda v: _each(v, F.exists),
    "all": lambda v: _each(v, F.forall),
    "list": lambda v: v,
    "tuple": lambda v: v,
    "set": lambda v: Value(F.array_distinct(v.col), v.type),
    "zip": _zip,
    "enumerate": _enumerate,
    "type": lambda v: V.literal({"S": "string", "I": "int", "D": "float", "B": "bool", "A": "array", "M": "object", "N": "null"}.get(v.kind, "any")),
    "isinstance": lambda v, t: V.literal(v.kind == {"str": "S", "int": "I", "float": "D", "bool": "B", "list": "A", "dict": "M"}.get(str(t.const))),
    "print": lambda *a: V.NULL,
    "sleep": lambda *a: V.NULL,  # accepted; a wait has no meaning in a plan
}
