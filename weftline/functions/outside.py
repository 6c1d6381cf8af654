"""Tools that reach outside the session from a graph: SQLite files, HTTP and PostgreSQL.

SQLite and HTTP calls run on the executors in Arrow batches, one for each row that reaches the call and none for others;
their column lands in a projection of its own, so that a call is made once however often its value is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from ..plans.values import Value
from .tools import TOOLS, Tool


def scalars(params: object) -> list | dict:
    """Bound parameters: numbers, text, truth values and null."""
    values = params.values() if isinstance(params, dict) else params or []
    if any(isinstance(v, list | dict | tuple) for v in values):
        raise TypeError("SQL parameters are numbers, text, booleans or null")
    return params or []


def sqlite_query(db: str, query: str, params: object = None) -> list | dict:
    """Rows as objects, blobs as 0x... text; {changes, last_insert_rowid} of a statement without rows. A connection a call."""
    import sqlite3

    with sqlite3.connect(db or ":memory:") as con:
        try:
            cur = con.execute(query, scalars(params))
            if cur.description is None:
                con.commit()
                return {"changes": max(cur.rowcount, 0), "last_insert_rowid": cur.lastrowid or 0}
            names = [d[0] for d in cur.description]
            rows = [dict(zip(names, ["0x" + v.hex() if isinstance(v, bytes) else v for v in r], strict=True)) for r in cur]
            con.commit()
            return rows
        finally:
            cur = None


def http_request(url: str, method: str = "GET", headers: dict | None = None, body: str | None = None, timeout_secs: float = 30) -> dict:
    """{status, body, headers}; a status outside 2xx is an error."""
    import urllib.request

    request = urllib.request.Request(url, body.encode() if body is not None else None, headers or {}, method=method or "GET")
    with urllib.request.urlopen(request, timeout=timeout_secs or 30) as r:
        return {"status": r.status, "body": r.read().decode("utf-8", "replace"), "headers": {k.lower(): v for k, v in r.headers.items()}}


class OutsideTool(Tool):
    """A tool whose calls a Python function answers, a JSON object of arguments a row."""

    def __init__(self, name: str, params: list[str], answer: Callable[..., object]):
        super().__init__(name, params, None, None, False)
        self.answer = answer

    def _call(self, setting: object, a: dict[str, Value]) -> Column:
        if setting.stage is None or setting.folds:
            raise TypeError(f"{self.name} is called outside loops: join tables for lookups by element")
        answer = self.answer

        def run(args):  # noqa: ANN001, ANN202
            value, error = [], []
            for raw in args:
                v = e = None
                if raw is not None:
                    try:
                        v = json.dumps(answer(**json.loads(raw)))
                    except Exception as x:  # the row fails, or goes on by its policy
                        e = f"{type(x).__name__}: {x}"
                value.append(v)
                error.append(e)
            return pd.DataFrame({"value": value, "error": error}, dtype=object)

        kind = T.StructType([T.StructField("value", V.STRING), T.StructField("error", V.STRING)])
        udf = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR).asNondeterministic()
        given = {k: v for k, v in a.items() if k != "schema"}
        args = F.to_json(F.struct(*[V.cast(v, V.STRING if v.kind == "N" else v.type).alias(k) for k, v in given.items()]))
        args = args if setting.running is None else F.when(setting.running, args)
        return setting.stage.land([udf(args)], 50)[0]

    def __call__(self, setting: object, args: list[Value], kw: dict[str, Value]) -> Value:
        a = self.bind(args, kw)
        got = self._call(setting, a)
        t = T._parse_datatype_string(a["schema"].const) if "schema" in a else V.VARIANT
        value = F.from_json(got["value"], t) if "schema" in a else F.parse_json(got["value"])
        return Value(V.require(got["error"].isNull(), value, F.concat(F.lit(f"{self.name}: "), F.coalesce(got["error"], F.lit(""))), t), t)

    def attempt(self, setting: object, args: list[Value], kw: dict[str, Value]) -> tuple[Value, Column]:
        with V.faults() as found:
            value = self(setting, args, kw)
        return value, ~found[0]


def literal_sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def bound_sql(query: str, params: list) -> str:
    """A statement with $1, $2, ... replaced by literals; placeholders inside quotes stay."""
    import re

    scalars(params)
    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|\$(\d+)", lambda m: literal_sql(params[int(m[1]) - 1]) if m[1] else m[0], query)


class JdbcTool(Tool):
    """The rows of a query of an outside database, read once for all rows; its arguments are constants."""

    def __call__(self, setting: object, args: list[Value], kw: dict[str, Value]) -> Value:
        from ..sources import inputs

        a = self.bind(args, kw)
        url = next((a[k].const for k in ("connection_string", "dsn", "conn") if k in a), None)
        params = kw["params"] if "params" in kw else a.get("params")
        values = params.const if params is not None else []
        if not isinstance(a["query"].const, str) or not isinstance(url, str) or values is None:
            raise TypeError(f"{self.name} takes constants: join the table for lookups by row")
        df = inputs.decode_binary(inputs.jdbc(setting.stage.df.sparkSession, url, bound_sql(a["query"].const, list(values))))
        t = T.ArrayType(df.schema)
        return Value(df.agg(F.collect_list(F.struct(*df.columns))).scalar(), t)

    def attempt(self, setting: object, args: list[Value], kw: dict[str, Value]) -> tuple[Value, Column]:
        return self(setting, args, kw), F.lit(True)


TOOLS["sqlite.query"] = OutsideTool("sqlite.query", ["query", "params?", "db?", "schema?"], lambda query, params=None, db=":memory:": sqlite_query(db, query, params))
TOOLS["http_request"] = OutsideTool("http_request", ["url", "method?", "headers?", "body?", "timeout_secs?", "schema?"], http_request)
TOOLS["postgres"] = JdbcTool("postgres", ["query", "connection_string?", "dsn?", "conn?", "params?"], None, None, False)
