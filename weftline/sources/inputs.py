"""Inputs of executions: JSON objects, query strings, SQL over registered tables, databases and HTTP."""

from __future__ import annotations

import functools
import json
import urllib.parse
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json_type(x: object) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.LongType() if -(2**63) <= x < 2**63 else T.DoubleType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, str):
        return T.StringType()
    if isinstance(x, list):
        return T.ArrayType(functools.reduce(_wider, map(_json_type, x), T.NullType()))
    return T.StructType([T.StructField(k, _json_type(v)) for k, v in x.items()])


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of values of both, a variant where they have none in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wider(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        both = {f.name: f.dataType for f in a}
        for f in b:
            both[f.name] = _wider(both.get(f.name, T.NullType()), f.dataType)
        return T.StructType([T.StructField(k, t) for k, t in both.items()])
    return T.VariantType()


def _settled(t: T.DataType) -> T.DataType:
    """Null alone is text."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in t])
    return t


def _shaped(x: object, t: T.DataType) -> object:
    if x is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(x)
    if isinstance(t, T.ArrayType):
        return [_shaped(v, t.elementType) for v in x]
    if isinstance(t, T.StructType):
        return tuple(_shaped(x.get(f.name), f.dataType) for f in t)
    return x


def json_inputs(spark: SparkSession, objects: list[str | dict], schema: str | None = None) -> DataFrame:
    """A row for each JSON object; anything but an object is an error.

    Types come from the values: whole numbers stay 64-bit, a key that is missing or null is null, a key whose values
    have no type in common is parsed JSON (a variant).
    """
    parsed = [json.loads(o) if isinstance(o, str) else o for o in objects]
    if not all(isinstance(o, dict) for o in parsed):
        raise ValueError("inputs are JSON objects")
    if schema:
        return spark.createDataFrame(parsed, schema)
    kinds = {f.name: _settled(f.dataType) for f in functools.reduce(_wider, map(_json_type, parsed), T.StructType())}
    loose = {k for k, t in kinds.items() if "variant" in t.simpleString()}
    rows = [tuple((None if k not in o else json.dumps(o[k])) if k in loose else _shaped(o.get(k), t) for k, t in kinds.items()) for o in parsed]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(k, T.StringType() if k in loose else t) for k, t in kinds.items()]))
    return df.withColumns({k: F.parse_json(k) for k in loose}) if loose else df


def sniff(value: str) -> object:
    """The scalar that a query-string value means: true, false, null, a whole number, a number, or text."""
    if value in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[value]
    for kind in (int, float):
        try:
            n = kind(value)
        except ValueError:
            continue
        if kind is float or -(2**63) <= n < 2**63:
            return n
    return value


def query_string(q: str) -> dict[str, object]:
    return {k: sniff(v) for k, v in urllib.parse.parse_qsl(q.lstrip("?"), keep_blank_values=True)}


def sql(spark: SparkSession, query: str, params: list | dict | None = None) -> DataFrame:
    """A parameterised statement over registered tables; parameters are scalars."""
    values = params.values() if isinstance(params, dict) else params or []
    if any(isinstance(v, list | dict | tuple) for v in values):
        raise TypeError("SQL parameters are numbers, text, booleans or null")
    return spark.sql(query, args=params) if params else spark.sql(query)


def decode_binary(df: DataFrame) -> DataFrame:
    """Binary columns as 0x... text, as SQL results hand them to graphs."""
    return df.select(*[F.concat(F.lit("0x"), F.lower(F.hex(c))).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query of an outside database; partition (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, low, high, parts = partition
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return reader.option("query", query).load()


def http_requests(df: DataFrame, url_col: str = "url", method: str = "GET", headers: dict | None = None, body_col: str | None = None, timeout: int = 30) -> DataFrame:
    """df with status, body and error of a request a row, made on the executors; statuses outside 2xx are errors."""
    schema = T.StructType([*df.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.request

        for pdf in parts:
            status, body, error = [], [], []
            for i, url in enumerate(pdf[url_col]):
                data = pdf[body_col].iloc[i].encode() if body_col else None
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, data, headers or {}, method=method), timeout=timeout) as r:
                        got = (r.status, r.read().decode("utf-8", "replace"), None)
                except Exception as e:  # the row says what went wrong; others go on
                    got = (getattr(e, "code", None), None, str(e))
                for x, v in zip((status, body, error), got, strict=True):
                    x.append(v)
            yield pdf.assign(status=pd.array(status, "Int32"), body=body, error=error)

    return df.mapInPandas(run, schema)


def tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Register Parquet tables of a folder as views."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
