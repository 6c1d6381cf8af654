"""Built-in tools: array, map, JSON, string, number and environment functions as columns.

A tool takes (setting, args, kwargs) of values. `attempt` gives its value and whether it succeeded, without raising.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from ..plans.values import Value

TOOLS: dict[str, Tool] = {}


class Tool:
    def __init__(self, name: str, params: list[str], make: Callable, ok: Callable | None = None, pure: bool = True):
        self.name, self.params, self.make, self.ok, self.pure = name, params, make, ok, pure

    @property
    def digest(self) -> str:
        """Of what callers rely on: the name and its parameters."""
        return hashlib.sha256(f"{self.name}({', '.join(self.params)})".encode()).hexdigest()

    def bind(self, args: list[Value], kw: dict[str, Value]) -> dict[str, Value]:
        given = dict(zip(self.params, args, strict=False)) | kw
        need = [p for p in self.params if not p.endswith("?")]
        lacking = [p for p in need if p not in given]
        if lacking and "value" in given and len(lacking) == 1:  # the one argument under its general name
            given[lacking[0]] = given["value"]
        elif lacking:
            raise TypeError(f"{self.name} needs {', '.join(lacking)}")
        return given

    def __call__(self, setting: object, args: list[Value], kw: dict[str, Value]) -> Value:
        return self.make(setting, self.bind(args, kw))

    def attempt(self, setting: object, args: list[Value], kw: dict[str, Value]) -> tuple[Value, Column]:
        a = self.bind(args, kw)
        with V.faults() as found:
            made = self.make(setting, a)
        good = self.ok(setting, a) if self.ok else F.lit(True)
        for bad in found:
            good = good & ~bad
        return made, good


def tool(name: str, *params: str, ok: Callable | None = None, pure: bool = True) -> Callable:
    def put(make: Callable) -> Callable:
        TOOLS[name] = Tool(name, list(params), make, ok, pure)
        return make

    return put


def _field(x: Column, t: T.DataType, key: Value) -> tuple[Value, Column] | None:
    """An element's value under a key and whether it has one; None where no element can."""
    if isinstance(t, T.StructType):
        return (Value(x[str(key.const)], t[str(key.const)].dataType), x.isNotNull()) if str(key.const) in t.names else None
    if isinstance(t, T.MapType):
        k = key.col.cast(t.keyType)
        return Value(F.try_element_at(x, k), t.valueType), F.coalesce(F.map_contains_key(x, k), F.lit(False))
    if isinstance(t, T.VariantType):
        of = F.try_variant_get(x, "$", "map<string,variant>")
        k = V.text(key)
        return Value(F.try_element_at(of, k), t), F.coalesce(F.map_contains_key(of, k), F.lit(False))
    return None


def _array(v: Value) -> Value:
    return V.elements(v) if v.kind == "V" else v


@tool("array.len", "array")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(F.size(_array(a["array"]).col).cast("long"), V.LONG)


def _matches(a: dict[str, Value], strict: bool) -> Column | None:
    array, key, value = _array(a["array"]), a["key"], a["value"]
    elem = array.type.elementType
    probe = _field(F.lit(None).cast(elem), elem, key)
    loose = probe is not None and "V" in (probe[0].kind, value.kind)
    if probe is None or strict and not loose and probe[0].kind != value.kind and value.kind != "N":
        return None

    def test(x: Column) -> Column:
        field, has = _field(x, elem, key)
        hit = has & V.equal(field, value)
        return hit & (V.is_whole(field) == V.is_whole(value)) if strict and loose else hit

    return F.filter(array.col, test)


@tool("array.count_where", "array", "key", "value")
def _(s, a):  # noqa: ANN001, ANN202
    hits = _matches(a, strict=True)
    return V.literal(0) if hits is None else Value(F.size(hits).cast("long"), V.LONG)


@tool("array.find", "array", "key", "value")
def _(s, a):  # noqa: ANN001, ANN202
    hits = _matches(a, strict=False)
    return V.NULL if hits is None else Value(F.get(hits, F.lit(0)), _array(a["array"]).type.elementType)


def _in_bounds(s, a):  # noqa: ANN001, ANN202
    i, items = a["index"].col.cast("int"), a["array"]
    items = V.of_variant(items, "array<variant>") if items.kind == "V" else items.col
    return F.coalesce((i >= 0) & (i < F.size(items)), F.lit(False))


@tool("list.get", "array", "index", ok=_in_bounds)
def _(s, a):  # noqa: ANN001, ANN202
    with V.faults():  # the bounds speak for an array that is none
        items = _array(a["array"])
    t = items.type.elementType
    i = a["index"].col.cast("int")
    return Value(V.require(_in_bounds(s, a), F.get(items.col, i), "list.get: index out of bounds", t), t)


@tool("dict.get", "obj", "key", "default?")
def _(s, a):  # noqa: ANN001, ANN202
    default = a.get("default", V.NULL)
    found = _field(a["obj"].col, a["obj"].type, a["key"])
    return default if found is None else V.choose(found[1], found[0], default)


def _json_ok(s, a):  # noqa: ANN001, ANN202
    return F.try_parse_json(a["json"].col).isNotNull()


@tool("json.parse", "json", ok=_json_ok)
def _(s, a):  # noqa: ANN001, ANN202
    schema = a.get("schema")
    if schema is not None:  # typed where a schema is known; invalid text raises all the same
        t = T._parse_datatype_string(schema.const)
        v = F.from_json(a["json"].col, t, {"mode": "FAILFAST"})
        return Value(V.require(_json_ok(s, a), v, "json.parse: invalid JSON", t), t)
    return Value(V.require(_json_ok(s, a), F.try_parse_json(a["json"].col), "json.parse: invalid JSON", V.VARIANT), V.VARIANT)


@tool("json.get", "json", "path", "type?")
def _(s, a):  # noqa: ANN001, ANN202
    t = T._parse_datatype_string(a["type"].const if "type" in a else "string")
    return Value(F.try_variant_get(F.try_parse_json(a["json"].col) if a["json"].kind == "S" else a["json"].col, a["path"].const, t.simpleString()), t)


@tool("string.len", "text")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(F.octet_length(a["text"].col).cast("long"), V.LONG)


@tool("text.reverse", "text")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(F.reverse(a["text"].col), V.STRING)


@tool("math.add", "a", "b")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(a["a"].col.cast("double") + a["b"].col.cast("double"), V.DOUBLE)


@tool("math.mul", "a", "b")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(a["a"].col.cast("double") * a["b"].col.cast("double"), V.DOUBLE)


@tool("echo", "input")
def _(s, a):  # noqa: ANN001, ANN202
    return a["input"]


@tool("env.get", "key", "default?")
def _(s, a):  # noqa: ANN001, ANN202
    value = s.env.get(a["key"].const) if s.env is not None else None
    if value is not None:
        return V.literal(value)
    if "default" not in a:
        raise KeyError(f"env.get: {a['key'].const} is not set")
    return a["default"]


@tool("env.list")
def _(s, a):  # noqa: ANN001, ANN202
    items = s.env.all() if s.env is not None else {}
    t = T.MapType(V.STRING, V.STRING)
    return Value(F.create_map(*[F.lit(x) for kv in items.items() for x in kv]).cast(t), t)


@tool("env.template", "template")
def _(s, a):  # noqa: ANN001, ANN202
    from .env import Env

    return V.literal((s.env or Env()).resolve(a["template"].const))


@tool("test.error", "message?", ok=lambda s, a: F.lit(False), pure=False)
def _(s, a):  # noqa: ANN001, ANN202
    return Value(V.require(F.lit(False), F.lit(None).cast("string"), "test.error", V.STRING), V.STRING)


@tool("test.large", "n")
def _(s, a):  # noqa: ANN001, ANN202
    return Value(F.repeat(F.lit("x"), a["n"].col.cast("int")), V.STRING)


@tool("test.sleep", "ms", pure=False)
def _(s, a):  # noqa: ANN001, ANN202
    return V.NULL  # a wait has no meaning in a plan; sinks wait on the driver


@tool("send_email", "to", pure=False)
def _(s, a):  # noqa: ANN001, ANN202
    return V.struct({"status": V.literal("queued"), "to": a["to"]})


def python_tool(name: str, params: list[str], make: Callable[..., Column], type_: str) -> Tool:
    """A tool of one's own from a function of columns; pandas UDFs are such functions too."""
    t = T._parse_datatype_string(type_)
    return Tool(name, params, lambda s, a: Value(make(*[a[p].col for p in params]), t))
