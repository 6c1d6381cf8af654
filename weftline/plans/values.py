"""Typed column values, and the semantics of operators on them.

Kinds come from the schema when the plan is built: S string, I whole number, D other number, B boolean, A array,
M map or struct, V variant, N null, X anything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    raw: Column | None  # None is null, so that null needs no session
    type: T.DataType
    const: object = None  # of a literal
    cost: int = 1  # nodes of its expression tree, about

    @property
    def col(self) -> Column:
        return F.lit(None) if self.raw is None else self.raw

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.StringType):
            return "S"
        if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
            return "I"
        if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
            return "D"
        if isinstance(t, T.BooleanType):
            return "B"
        if isinstance(t, T.ArrayType):
            return "A"
        if isinstance(t, T.MapType | T.StructType):
            return "M"
        if isinstance(t, T.VariantType):
            return "V"
        return "N" if isinstance(t, T.NullType) else "X"


LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
NULL = Value(None, T.NullType())


VARIANT = T.VariantType()

_found: list[list[Column]] = []  # failures of the test at hand, the innermost last


@contextmanager
def faults() -> Iterator[list[Column]]:
    """Within, what would fail a row gives null instead, and the list has the conditions under which it would."""
    _found.append([])
    try:
        yield _found[-1]
    finally:
        _found.pop()


@contextmanager
def under(cond: Column) -> Iterator[None]:
    """Failures within count only where cond holds: that part of a test is not evaluated elsewhere."""
    if not _found:
        yield
        return
    with faults() as own:
        yield
    _found[-1].extend(cond & bad for bad in own)


def require(ok: Column, col: Column, message: Column | str, t: T.DataType) -> Column:
    """col where ok holds; elsewhere the row fails."""
    ok = F.coalesce(ok, F.lit(False))
    if _found:
        _found[-1].append(~ok)
        return F.when(ok, col)
    return F.when(ok, col).otherwise(fail(message, t))


def literal(x: object) -> Value:
    if x is None:
        return NULL
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), LONG, x)
    if isinstance(x, float):
        return Value(F.lit(x), DOUBLE, x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, x)
    if isinstance(x, list | tuple):
        return array([literal(v) for v in x])
    if isinstance(x, dict):
        return struct({str(k): literal(v) for k, v in x.items()})
    raise TypeError(f"no literal of {type(x).__name__}")


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: the wider number, else text."""
    if a == b:
        return a
    ka, kb = Value(None, a).kind, Value(None, b).kind
    if ka == "N":
        return b
    if kb == "N":
        return a
    if "V" in (ka, kb):
        return VARIANT
    if {ka, kb} <= {"I"}:
        return LONG
    if {ka, kb} <= {"I", "D"}:
        return DOUBLE
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        return T.StructType([T.StructField(x.name, common(x.dataType, y.dataType)) for x, y in zip(a, b, strict=True)])
    return STRING


def cast(v: Value, t: T.DataType) -> Column:
    if v.type == t:
        return v.col
    if isinstance(t, T.VariantType):
        return F.to_variant_object(v.col) if v.kind in "AM" else v.col.cast("variant")
    if isinstance(t, T.StringType) and v.kind in "AMV":
        return F.to_json(v.col)
    return v.col.cast(t)


def choose(cond: Column, a: Value, b: Value) -> Value:
    t = common(a.type, b.type)
    return Value(F.when(cond, cast(a, t)).otherwise(cast(b, t)), t)


def truthy(v: Value) -> Column:
    """false, null, zero and the empty string are false; arrays and objects are true."""
    match v.kind:
        case "B":
            test = v.col
        case "I" | "D":
            test = v.col != 0
        case "S":
            test = v.col != ""
        case "N":
            return F.lit(False)
        case "V":
            test = F.when(is_number(v), of_variant(v, "double") != 0).when(tag(v) == "STRING", of_variant(v, "string") != "").when(tag(v) == "BOOLEAN", of_variant(v, "boolean")).otherwise(tag(v) != "VOID")
        case _:
            test = v.col.isNotNull()
    return F.coalesce(test, F.lit(False))


# parsed JSON: each row's value has a kind of its own


def tag(v: Value) -> Column:
    """The kind of a variant's value: BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(v.col)


def of_variant(v: Value, t: str) -> Column:
    return F.try_variant_get(v.col, "$", t)


def is_whole(v: Value) -> Column:
    return F.coalesce(tag(v) == "BIGINT", F.lit(False)) if v.kind == "V" else F.lit(v.kind == "I") & v.col.isNotNull()


def is_number(v: Value) -> Column:
    return F.coalesce(tag(v).isin("BIGINT", "DOUBLE", "FLOAT") | tag(v).startswith("DECIMAL"), F.lit(False)) if v.kind == "V" else F.lit(v.kind in "ID") & v.col.isNotNull()


def _as(v: Value, t: str) -> Column:
    """A number of any kind as long or double; null for anything else."""
    return of_variant(v, t) if v.kind == "V" else v.col.cast(t) if v.kind in "ID" else F.lit(None).cast(t)


def elements(v: Value) -> Value:
    """The elements of a variant that is an array."""
    kind = T.ArrayType(VARIANT)
    return Value(require(tag(v).startswith("ARRAY"), of_variant(v, "array<variant>"), "not an array", kind), kind)


def _variant_equal(a: Value, b: Value) -> Column:
    if a.kind != "V":
        a, b = b, a
    null = a.col.isNull() | (tag(a) == "VOID")
    if b.kind == "N":
        return null
    if b.kind == "V":
        same = F.when(null, b.col.isNull() | (tag(b) == "VOID")).when((tag(a) == tag(b)) & tag(a).isin("STRING", "BOOLEAN"), of_variant(a, "string") == of_variant(b, "string"))
    else:
        kind = {"S": "STRING", "B": "BOOLEAN"}.get(b.kind, "")
        same = F.when(null, b.col.isNull())
        if kind:
            same = same.when(tag(a) == kind, of_variant(a, kind.lower()) == b.col)
    numbers = F.when(is_whole(a) & is_whole(b), _as(a, "long") == _as(b, "long")).when(is_number(a) & is_number(b), _as(a, "double") == _as(b, "double"))
    return F.coalesce(same, numbers, F.lit(False))


def _variant_binary(op: str, a: Value, b: Value) -> Value:
    """Arithmetic where a side is parsed JSON: whole numbers stay whole, and `+` joins text."""
    if op == "+" and "S" in (a.kind, b.kind):
        return Value(F.concat(text(a), text(b)), STRING)
    whole, both = is_whole(a) & is_whole(b), is_number(a) & is_number(b)
    of_long = lambda v: Value(_as(v, "long"), LONG)
    with under(whole):
        x = binary(op, of_long(a), of_long(b))
    if op in ("&", "|", "^", "<<", ">>"):
        return Value(require(whole, x.col, f"{op} needs whole numbers", LONG), LONG)
    with under(both & ~whole):
        y = binary(op, Value(_as(a, "double"), DOUBLE), Value(_as(b, "double"), DOUBLE))
    out = F.when(whole, cast(x, VARIANT)).when(both, cast(y, VARIANT))
    ok = both
    if op == "+":
        words = F.lit(False)
        for v in (a, b):
            words = words | (F.coalesce(tag(v) == "STRING", F.lit(False)) if v.kind == "V" else F.lit(False))
        out, ok = out.when(words, F.concat(text(a), text(b)).cast("variant")), both | words
    return Value(require(ok, out, f"{op} needs numbers", VARIANT), VARIANT)


def contains(v: Value, x: Value) -> Column:
    """Whether a variant has x: as an element, a key, or a part of its text."""
    key = text(x)
    inside = F.exists(of_variant(v, "array<variant>"), lambda e: equal(x, Value(e, VARIANT)))
    return F.when(tag(v).startswith("ARRAY"), inside).when(tag(v).startswith("OBJECT"), F.map_contains_key(of_variant(v, "map<string,variant>"), key)).when(tag(v) == "STRING", F.contains(of_variant(v, "string"), key))


def text(v: Value) -> Column:
    """A scalar as text in a concatenation; null, arrays and objects are empty there."""
    if v.kind == "V":
        return F.when(tag(v).startswith("ARRAY") | tag(v).startswith("OBJECT"), F.lit("")).otherwise(F.coalesce(of_variant(v, "string"), F.lit("")))
    return F.lit("") if v.kind in "NAM" else F.coalesce(v.col.cast("string"), F.lit(""))


def _numbers(a: Value, b: Value, what: str) -> tuple[Column, Column, T.DataType]:
    if {a.kind, b.kind} <= {"I"}:
        return a.col.cast("long"), b.col.cast("long"), LONG
    if {a.kind, b.kind} <= {"I", "D", "N"}:
        return a.col.cast("double"), b.col.cast("double"), DOUBLE
    raise TypeError(f"{what} needs numbers, not {a.type.simpleString()} and {b.type.simpleString()}")


def binary(op: str, a: Value, b: Value) -> Value:
    """Arithmetic: whole numbers stay 64-bit and checked, any other number makes doubles."""
    if "V" in (a.kind, b.kind):
        return _variant_binary(op, a, b)
    if op == "+" and "S" in (a.kind, b.kind):
        return Value(F.concat(text(a), text(b)), STRING)
    if op == "+" and a.kind == b.kind == "A":
        t = common(a.type, b.type)
        return Value(F.concat(cast(a, t), cast(b, t)), t)
    x, y, t = _numbers(a, b, op)
    whole = t == LONG
    if _found and op in ("/", "//", "%"):
        _found[-1].append(F.coalesce(y == 0, F.lit(False)))
        y = F.when(y != 0, y)
    match op:
        case "+" | "-" | "*" if whole and _found:
            made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            _found[-1].append(made.isNull() & x.isNotNull() & y.isNotNull())
            return Value(made, t)
        case "+":
            return Value(x + y, t)
        case "-":
            return Value(x - y, t)
        case "*":
            return Value(x * y, t)
        case "/":
            return Value(F.call_function("div", x, y), LONG) if whole else Value(x / y, DOUBLE)
        case "//":
            if not whole:
                return Value(F.floor(x / y).cast("double"), DOUBLE)
            quotient = F.call_function("div", x, y)
            return Value(quotient - ((x % y != 0) & ((x < 0) != (y < 0))).cast("long"), LONG)
        case "%":  # the sign of the divisor
            return Value((x % y + y) % y, t)
        case "**":
            power = F.pow(x, y)
            return Value(power.cast("long"), LONG) if whole and isinstance(b.const, int) and b.const >= 0 else Value(power, DOUBLE)
        case "&" | "|" | "^" | "<<" | ">>":
            if not whole:
                raise TypeError(f"{op} needs whole numbers")
            made = {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}.get(op)
            if made:
                return Value(made(y), LONG)
            return Value(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")), LONG)
    raise TypeError(f"no operator {op}")


def equal(a: Value, b: Value) -> Column:
    """null equals null, whole and other numbers compare, different kinds and containers are never equal."""
    ka, kb = a.kind, b.kind
    if "V" in (ka, kb):
        return _variant_equal(a, b)
    if ka == kb == "N":
        return F.lit(True)
    if "N" in (ka, kb):
        return (a if kb == "N" else b).col.isNull()
    if {ka, kb} <= {"I", "D"}:
        return a.col.eqNullSafe(b.col)
    if ka == kb and ka in "SBX":
        return a.col.eqNullSafe(b.col)
    return F.lit(False)


def compare(op: str, a: Value, b: Value) -> Column:
    """Order of numbers; anything else is false, and so is null."""
    if not {a.kind, b.kind} <= {"I", "D", "V"}:
        return F.lit(False)
    if "V" in (a.kind, b.kind):
        wide = lambda v: F.when(is_number(v), _as(v, "double"))
        by_double = compare(op, Value(wide(a), DOUBLE), Value(wide(b), DOUBLE))
        return F.when(is_whole(a) & is_whole(b), compare(op, Value(_as(a, "long"), LONG), Value(_as(b, "long"), LONG))).otherwise(by_double)
    x, y = a.col, b.col
    return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))


def array(items: list[Value]) -> Value:
    """An array literal; elements of different kinds keep them, as variants."""
    t: T.DataType = T.NullType()
    for v in items:
        t = common(t, v.type)
    kinds = {v.kind for v in items} - {"N"}
    if len(kinds) > 1 and not kinds <= {"I", "D"}:
        t = VARIANT
    kind = T.ArrayType(t)
    const = [v.const for v in items] if all(v.const is not None or v.kind == "N" for v in items) else None
    return Value(F.array(*[cast(v, t) for v in items]).cast(kind) if items else F.array().cast(kind), kind, const)


def struct(items: dict[str, Value]) -> Value:
    kind = T.StructType([T.StructField(k, STRING if v.kind == "N" else v.type) for k, v in items.items()])
    return Value(F.struct(*[cast(v, f.dataType).alias(k) for (k, v), f in zip(items.items(), kind, strict=True)]) if items else F.struct(), kind)


def fail(message: Column | str, t: T.DataType) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message).cast(t)


def _variant_subscript(base: Value, key: Value) -> Value:
    if isinstance(key.const, str) and "'" not in key.const:
        got = F.try_variant_get(base.col, f"$['{key.const}']", "variant")
        return Value(require(got.isNotNull(), got, f"missing {key.const}", VARIANT), VARIANT)
    name = text(key)
    of_object = F.when(tag(base).startswith("OBJECT"), F.try_element_at(of_variant(base, "map<string,variant>"), name))
    if key.kind in "IV":
        items, i = of_variant(base, "array<variant>"), _as(key, "int")
        got = F.when(tag(base).startswith("ARRAY"), F.get(items, F.when(i < 0, i + F.size(items)).otherwise(i))).otherwise(of_object)
    else:
        got = of_object
    return Value(require(got.isNotNull(), got, F.concat(F.lit("missing "), name), VARIANT), VARIANT)


def subscript(base: Value, key: Value) -> Value:
    """Strict: a missing key, an index out of bounds and a null base raise; negative indices count from the end."""
    match base.kind:
        case "A":
            if key.kind != "I":
                raise TypeError("arrays are indexed by whole numbers")
            t, i = base.type.elementType, key.col.cast("int")
            n = F.size(base.col)
            at = F.get(base.col, F.when(i < 0, i + n).otherwise(i))
            return Value(require((i >= -n) & (i < n), at, "index out of bounds", t), t)
        case "M" if isinstance(base.type, T.MapType):
            t, k = base.type.valueType, key.col.cast(base.type.keyType)
            found = F.get(F.array(F.try_element_at(base.col, k)), F.lit(0))
            return Value(require(F.map_contains_key(base.col, k), found, F.concat(F.lit("missing key "), F.coalesce(k.cast("string"), F.lit("null"))), t), t)
        case "M":
            if key.const is None or str(key.const) not in base.type.names:
                raise KeyError(f"no field {key.const!r} in {base.type.simpleString()}")
            f = base.type[str(key.const)]
            return Value(require(base.col.isNotNull(), base.col[f.name], "subscript of null", f.dataType), f.dataType)
        case "V":
            return _variant_subscript(base, key)
    raise TypeError(f"no subscript of {base.type.simpleString()}")


def size(v: Value) -> Value:
    match v.kind:
        case "V":
            n = F.when(tag(v).startswith("ARRAY"), F.size(of_variant(v, "array<variant>"))).when(tag(v).startswith("OBJECT"), F.size(of_variant(v, "map<string,variant>"))).when(tag(v) == "STRING", F.char_length(of_variant(v, "string")))
            return Value(require(n.isNotNull(), n.cast("long"), "len() of a number, a truth value or null", LONG), LONG)
        case "A":
            return Value(F.size(v.col).cast("long"), LONG)
        case "S":
            return Value(F.char_length(v.col).cast("long"), LONG)
        case "M" if isinstance(v.type, T.MapType):
            return Value(F.size(v.col).cast("long"), LONG)
        case "M":
            return literal(len(v.type.names))
    raise TypeError(f"len() of {v.type.simpleString()}")
