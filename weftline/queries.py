"""Queries over the driver's tables, one for each operator, and their SQL for an independent engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.env import Env
from .operators import relational as R
from .plans import report
from .plans.lower import apply_graph
from .sources import inputs
from .streaming import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def graph(name: str, table: str, keep: list[str], code: str, sql: str, **how: object) -> None:
    """A query that runs a graph over a table, or over what a function makes of the tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = SHAPES[table](spark, d) if table in SHAPES else _t(spark, d, table)
        return apply_graph(df, code, keep=keep, **how)

    QUERIES[name], ORACLE[name] = run, sql


def _carts(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as an array of objects, in line order."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    """Signed whole numbers per order: returned lines are negative."""
    x = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long").alias("q"))
    a = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    return a.select("l_orderkey", F.col("xs.q").alias("items"))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("long"), F.lit("price"), F.when(F.col("p_size") > 5, F.col("p_retailprice").cast("long"))).alias("m"))


SHAPES = {"carts": _carts, "quantities": _quantities, "maps": _maps}
_CARTS = "c AS (SELECT l_orderkey, list({'line': l_linenumber::BIGINT, 'part': l_partkey, 'qty': CAST(trunc(l_quantity) AS BIGINT), 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, trunc(l_quantity), l_returnflag) AS items FROM lineitem GROUP BY l_orderkey)"
_QUANTITIES = "c AS (SELECT l_orderkey, list(CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) ORDER BY l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT)) AS items FROM lineitem GROUP BY l_orderkey)"

# expressions

graph("input_default", "customer", ["c_custkey"], "def graph(c_acctbal, rate=3):\n    return c_acctbal * rate", "SELECT c_custkey, c_acctbal * 3 AS result FROM customer")
graph("calc_arith", "lineitem", ["l_orderkey", "l_linenumber"], "def graph(l_extendedprice, l_discount, l_tax):\n    net = l_extendedprice * (1 - l_discount)\n    return net + net * l_tax", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax AS result FROM lineitem")
graph("calc_int_div", "orders", ["o_orderkey"], "def graph(o_orderkey, o_custkey):\n    return (o_orderkey - o_custkey * 3) / 7", "SELECT o_orderkey, (o_orderkey - o_custkey * 3) // 7 AS result FROM orders")
graph("calc_modulo", "orders", ["o_orderkey"], "def graph(o_orderkey, o_custkey):\n    d = o_orderkey - o_custkey * 3\n    return d // 7 * 100 + d % 7", "SELECT o_orderkey, CAST(floor((o_orderkey - o_custkey * 3) / 7.0) AS BIGINT) * 100 + (((o_orderkey - o_custkey * 3) % 7) + 7) % 7 AS result FROM orders")
graph("calc_concat", "orders", ["o_orderkey"], "def graph(o_orderkey, o_orderstatus):\n    return 'order ' + o_orderkey + ':' + o_orderstatus", "SELECT o_orderkey, 'order ' || o_orderkey || ':' || coalesce(o_orderstatus, '') AS result FROM orders")
graph("calc_compare", "lineitem", ["l_orderkey", "l_linenumber"], "def graph(l_quantity, l_returnflag):\n    return l_quantity >= 25 and not l_returnflag == 'R'", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity >= 25, false) AND NOT (l_returnflag IS NOT DISTINCT FROM 'R') AS result FROM lineitem")
graph("calc_chain_compare", "lineitem", ["l_orderkey", "l_linenumber"], "def graph(l_quantity):\n    return 10 < l_quantity <= 30", "SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_quantity <= 30 AS result FROM lineitem")
graph("calc_not", "events", ["event_id"], "def graph(user_id):\n    return not (user_id - 12)", "SELECT event_id, user_id = 12 AS result FROM events")
graph("calc_nullsafe_eq", "events", ["event_id"], "def graph(event_type):\n    e = None\n    if event_type == 'click':\n        e = event_type\n    return e == None", "SELECT event_id, event_type <> 'click' AS result FROM events")
graph("calc_conditional", "part", ["p_partkey"], "def graph(p_size):\n    return 'big' if p_size > 25 else 'small'", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS result FROM part")
graph("calc_in", "orders", ["o_orderkey"], "def graph(o_orderstatus):\n    return o_orderstatus in ['F', 'P']", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS result FROM orders")
graph("calc_bits", "part", ["p_partkey"], "def graph(p_partkey):\n    return (p_partkey & 12) + (p_partkey | 3) + (p_partkey ^ 5) + (p_partkey << 2) + (p_partkey >> 1)", "SELECT p_partkey, (p_partkey & 12) + (p_partkey | 3) + xor(p_partkey, 5) + (p_partkey << 2) + (p_partkey >> 1) AS result FROM part")
graph("calc_builtins", "part", ["p_partkey"], "def graph(p_size, p_retailprice):\n    return round(p_retailprice) + abs(0 - p_size) + max(p_size, 20) + min(p_size, 5)", "SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) + p_size + greatest(p_size, 20) + least(p_size, 5) AS result FROM part")
graph("len_string", "documents", ["doc_id"], "def graph(text):\n    return len(text)", "SELECT doc_id, length(text) AS result FROM documents")
graph("len_bytes", "documents", ["doc_id"], "def graph(text):\n    return call('string.len', text=text)", "SELECT doc_id, strlen(text) AS result FROM documents")
graph("len_array", "embeddings", ["vec_id"], "def graph(embedding):\n    return call('array.len', array=embedding)", "SELECT vec_id, len(embedding) AS result FROM embeddings")
graph("range_count", "part", ["p_partkey"], "def graph(p_size):\n    return range(2, p_size, 3)", "SELECT p_partkey, CAST(ceil(greatest(p_size - 2, 0) / 3.0) AS BIGINT) AS result FROM part")
graph("subscript_index", "embeddings", ["vec_id"], "def graph(embedding):\n    return embedding[3]", "SELECT vec_id, embedding[4] AS result FROM embeddings")
graph("subscript_negative", "embeddings", ["vec_id"], "def graph(embedding):\n    return embedding[-1]", "SELECT vec_id, embedding[len(embedding)] AS result FROM embeddings")
graph("subscript_dynamic", "embeddings", ["vec_id"], "def graph(embedding, label):\n    return embedding[label]", "SELECT vec_id, embedding[label + 1] AS result FROM embeddings")
graph("dict_literal", "orders", ["o_orderkey"], "def graph(o_custkey, o_totalprice):\n    d = {'who': o_custkey, 'cents': o_totalprice * 100}\n    return d['who'] + d.cents", "SELECT o_orderkey, o_custkey + o_totalprice * 100 AS result FROM orders")
graph("attr_chain", "carts", ["l_orderkey"], "def graph(items):\n    return items[0].part + items[-1]['qty']", f"WITH {_CARTS} SELECT l_orderkey, items[1].part + items[len(items)].qty AS result FROM c")
graph("map_subscript", "maps", ["p_partkey"], "def graph(m):\n    return m['size'] * 2", "SELECT p_partkey, p_size::BIGINT * 2 AS result FROM part")
graph("truthiness", "events", ["event_id"], "def graph(value, props, user_id):\n    n = 0\n    if value:\n        n = n + 1\n    if props:\n        n = n + 10\n    if user_id - 12:\n        n = n + 100\n    return n", "SELECT event_id, CASE WHEN coalesce(value <> 0, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(props <> '', false) THEN 10 ELSE 0 END + CASE WHEN coalesce(user_id <> 12, false) THEN 100 ELSE 0 END::BIGINT AS result FROM events")

# branches

TIER = "def graph(l_quantity, l_extendedprice, l_discount):\n    net = l_extendedprice * (1 - l_discount)\n    if l_quantity > 25:\n        tier = 'bulk'\n    else:\n        tier = 'retail'\n    return {'net': net, 'tier': tier}"


@query("decide_tier", "SELECT CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'retail' END AS tier, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS n FROM lineitem GROUP BY 1")
def decide_tier(spark: SparkSession, d: str) -> DataFrame:
    out = apply_graph(_t(spark, d, "lineitem"), TIER, keep=[])
    return out.groupBy("result.tier").agg(F.round(F.sum("result.net"), 2).alias("net"), F.count("*").alias("n"))


graph("decide_elif", "part", ["p_partkey"], "def graph(p_size):\n    if p_size > 40:\n        r = 'xl'\n    elif p_size > 20:\n        r = 'l'\n    elif p_size > 10:\n        r = 'm'\n    else:\n        r = 's'\n    return r", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'xl' WHEN p_size > 20 THEN 'l' WHEN p_size > 10 THEN 'm' ELSE 's' END AS result FROM part")
graph("early_return", "orders", ["o_orderkey"], "def graph(o_totalprice, o_orderstatus):\n    if o_totalprice < 1000:\n        return 0\n    fee = o_totalprice * 0.01\n    if o_orderstatus == 'F':\n        return fee\n    return fee * 2", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_orderstatus = 'F' THEN o_totalprice * 0.01e0 ELSE o_totalprice * 0.01e0 * 2 END AS result FROM orders")
graph("switch_status", "orders", ["o_orderkey"], "def graph(o_orderstatus):\n    match o_orderstatus:\n        case 'F':\n            r = 'finished'\n        case 'O' | 'P':\n            r = 'open'\n        case _:\n            r = 'unknown'\n    return r", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'unknown' END AS result FROM orders")
graph("chain_100", "part", ["p_partkey"], "def graph(p_size):\n    x = p_size\n" + "    x = x + 1\n" * 100 + "    return x", "SELECT p_partkey, p_size::BIGINT + 100 AS result FROM part")
graph("doubling_20", "part", ["p_partkey"], "def graph(p_size):\n    x = p_size\n" + "    x = x + x\n" * 20 + "    return x", "SELECT p_partkey, p_size::BIGINT * 1048576 AS result FROM part")
graph("many_ifs", "part", ["p_partkey"], "def graph(p_partkey):\n    n = 0\n" + "".join(f"    if p_partkey // {2**k} % 2 == 1:\n        n = n + {k + 1}\n" for k in range(30)) + "    return n", "SELECT p_partkey, list_sum([CASE WHEN (p_partkey >> k) & 1 = 1 THEN k + 1 ELSE 0 END for k in range(30)])::BIGINT AS result FROM part")
graph("ifs_in_loop", "quantities", ["l_orderkey"], "def graph(items):\n    n = 0\n    for x in items:\n        y = x\n" + "".join(f"        if y > {5 * k}:\n            y = y - {k}\n            n = n + y\n" for k in range(1, 9)) + "    return n", f"WITH {_QUANTITIES}, u AS (SELECT l_orderkey, unnest(items) AS y0 FROM c), " + ", ".join(f"s{k} AS (SELECT l_orderkey, CASE WHEN y{k - 1} > {5 * k} THEN y{k - 1} - {k} ELSE y{k - 1} END AS y{k}, {'0' if k == 1 else 'n'} + CASE WHEN y{k - 1} > {5 * k} THEN y{k - 1} - {k} ELSE 0 END AS n FROM {'u' if k == 1 else f's{k - 1}'})" for k in range(1, 9)) + " SELECT l_orderkey, sum(n)::BIGINT AS result FROM s8 GROUP BY l_orderkey")
graph("decide_error", "quantities", ["l_orderkey"], "def graph(items):\n    if items[3] > 10 or items[5] > 0:\n        return 1\n    if 100 / (items[0] - 7) > 3 and len(items) > 1:\n        return 2\n    return 0", f"WITH {_QUANTITIES} SELECT l_orderkey, CASE WHEN len(items) >= 4 AND (items[4] > 10 OR len(items) >= 6 AND items[6] > 0) THEN 1 WHEN items[1] <> 7 AND CASE WHEN items[1] = 7 THEN 0 ELSE 100 // (items[1] - 7) END > 3 AND len(items) > 1 THEN 2 ELSE 0 END::BIGINT AS result FROM c")
graph("assert_holds", "part", ["p_partkey"], "def graph(p_size):\n    assert p_size >= 0\n    if p_size < 0:\n        raise ValueError('negative')\n    return p_size", "SELECT p_partkey, p_size AS result FROM part")

# loops

graph("loop_sum", "quantities", ["l_orderkey"], "def graph(items):\n    t = 0\n    for x in items:\n        t = t + x\n    return t", f"WITH {_QUANTITIES} SELECT l_orderkey, list_sum(items)::BIGINT AS result FROM c")
graph("loop_break", "quantities", ["l_orderkey"], "def graph(items):\n    t = 0\n    for x in items:\n        if x < 0:\n            break\n        t = t + x\n    return t", f"WITH {_QUANTITIES}, u AS (SELECT l_orderkey, x, sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS b FROM (SELECT l_orderkey, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM c)) SELECT l_orderkey, coalesce(sum(x) FILTER (b = 0), 0)::BIGINT AS result FROM u GROUP BY l_orderkey")
graph("loop_continue", "quantities", ["l_orderkey"], "def graph(items):\n    t = 0\n    for i in range(len(items)):\n        if items[i] < 0:\n            continue\n        t = t + items[i] * (i + 1)\n    return t", f"WITH {_QUANTITIES} SELECT l_orderkey, coalesce(sum(x * i) FILTER (x >= 0), 0)::BIGINT AS result FROM (SELECT l_orderkey, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM c) GROUP BY l_orderkey")
graph("loop_return", "quantities", ["l_orderkey"], "def graph(items):\n    for x in items:\n        if x > 40:\n            return x\n    return 0", f"WITH {_QUANTITIES} SELECT l_orderkey, coalesce(list_filter(items, lambda x: x > 40)[1], 0) AS result FROM c")
graph("loop_empty", "part", ["p_partkey"], "def graph(p_size):\n    t = 7\n    for i in range(p_size - 25):\n        t = t + i\n    return t", "SELECT p_partkey, CAST(7 + greatest(p_size - 25, 0) * (greatest(p_size - 25, 0) - 1) // 2 AS BIGINT) AS result FROM part")
graph("loop_nested", "part", ["p_partkey"], "def graph(p_size):\n    n = 0\n    for i in range(1, p_size % 5 + 1):\n        for j in range(i):\n            n += j * i\n    return n", "SELECT p_partkey, coalesce((SELECT sum(i * i * (i - 1) // 2) FROM range(1, p_size % 5 + 1) r(i)), 0)::BIGINT AS result FROM part")

# parallel branches

_MERGED = {
    "last": "p_size::BIGINT * 2", "first": "100::BIGINT", "min": "least(100, p_size + 5, p_size * 2)::BIGINT", "max": "greatest(100, p_size + 5, p_size * 2)::BIGINT",
    "sum": "100 + p_size + 5 + p_size * 2::BIGINT", "avg": "((100 + p_size + 5) / 2.0e0 + p_size * 2) / 2",
}

for _k, _sql in _MERGED.items():
    graph(f"merge_{_k}", "part", ["p_partkey"], "def graph(p_size):\n    r = 100\n    with PARALLEL():\n        r = p_size + 5\n        r = p_size * 2\n    return r", f"SELECT p_partkey, {_sql} AS result FROM part", merge={"r": _k})
graph("merge_concat", "part", ["p_partkey"], "def graph(p_brand):\n    r = 'start'\n    with PARALLEL():\n        r = 'a'\n        r = p_brand\n    return r", "SELECT p_partkey, 'start' || 'a' || p_brand AS result FROM part", merge={"r": "concat"})
graph("parallel_block", "part", ["p_partkey"], "def graph(p_size, p_retailprice):\n    with PARALLEL() as p:\n        a = p_size + 1\n        b = p_retailprice * 2\n    return a + b", "SELECT p_partkey, p_size + 1 + p_retailprice * 2 AS result FROM part")

# tools

graph("array_count_where", "carts", ["l_orderkey"], "def graph(items):\n    return call('array.count_where', array=items, key='flag', value='R')", f"WITH {_CARTS} SELECT l_orderkey, len(list_filter(items, lambda x: x.flag = 'R'))::BIGINT AS result FROM c")
graph("array_find", "carts", ["l_orderkey"], "def graph(items):\n    hit = call('array.find', array=items, key='line', value=2)\n    if hit == None:\n        return -1\n    return call('dict.get', obj=hit, key='qty', default=-1)", f"WITH {_CARTS} SELECT l_orderkey, coalesce(list_filter(items, lambda x: x.line = 2)[1].qty, -1) AS result FROM c")
graph("list_get", "carts", ["l_orderkey"], "def graph(items):\n    x = call('list.get', array=items, index=1, on_error='continue_with_null')\n    return call('dict.get', obj=x, key='part', default=0)", f"WITH {_CARTS} SELECT l_orderkey, CASE WHEN len(items) > 1 THEN items[2].part ELSE 0 END AS result FROM c")
graph("dict_get", "maps", ["p_partkey"], "def graph(m):\n    return call('dict.get', obj=m, key='none', default=5) + call('dict.get', obj=m, key='size', default=0)", "SELECT p_partkey, 5 + p_size::BIGINT AS result FROM part")
graph("json_parse_props", "events", ["event_id"], "def graph(props):\n    p = call('json.parse', json=props, schema='struct<k:bigint>')\n    return p.k * 2", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS result FROM events")
graph("json_variant", "events", ["event_id"], "def graph(props):\n    return int(call('json.parse', json=props)['k'])", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS result FROM events")
graph("on_error_null", "events", ["event_id"], "def graph(event_type, props):\n    x = props if event_type == 'click' else event_type\n    return call('json.parse', json=x, on_error='continue_with_null') == None", "SELECT event_id, event_type <> 'click' AS result FROM events")
graph("json_variant_compare", "events", ["event_id"], "def graph(props):\n    p = call('json.parse', json=props)\n    return p['k'] > 50 and not p['k'] >= 90 and 3 < p.k and not p['k'] > 'a'", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND CAST(json_extract(props, '$.k') AS BIGINT) < 90 AS result FROM events")
graph("json_variant_eq", "events", ["event_id"], "def graph(props, user_id):\n    p = call('json.parse', json=props)\n    q = call('json.parse', json='{\"k\": ' + user_id + ', \"s\": \"x\", \"z\": null}')\n    n = 0\n    if p['k'] == 12:\n        n = n + 1\n    if p['k'] == q['k']:\n        n = n + 10\n    if p['k'] != '12' and q['s'] == 'x' and q['z'] == None:\n        n = n + 100\n    return n", "SELECT event_id, (k = 12)::BIGINT + 10 * (k = user_id)::BIGINT + 100 AS result FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
graph("json_variant_truthy", "events", ["event_id"], "def graph(props):\n    p = call('json.parse', json=props)\n    if p['k']:\n        return 1\n    return 0", "SELECT event_id, (CAST(json_extract(props, '$.k') AS BIGINT) <> 0)::BIGINT AS result FROM events")
graph("json_variant_loop", "events", ["event_id"], "def graph(user_id):\n    a = call('json.parse', json='[' + user_id + ', 2, 3.5, \"x\"]')\n    t = 0\n    for x in a:\n        if x == 'x':\n            break\n        t = t + x\n    return float(t)", "SELECT event_id, user_id + 5.5::DOUBLE AS result FROM events")
graph("json_variant_len", "events", ["event_id"], "def graph(props, user_id):\n    a = call('json.parse', json='[' + user_id + ', [1, 2], \"xyz\"]')\n    return len(a) + 10 * len(a[1]) + 100 * len(a[-1]) + 1000 * len(call('json.parse', json=props)) + int(a[0] * 2)", "SELECT event_id, (3 + 20 + 300 + 1000 + user_id * 2)::BIGINT AS result FROM events")
graph("json_variant_tools", "events", ["event_id"], "def graph(user_id):\n    a = call('json.parse', json='[{\"u\": ' + user_id + '}, {\"u\": 12}, {\"u\": 12.0}, {\"v\": 1}]')\n    return call('array.count_where', array=a, key='u', value=12) * 10 + call('array.len', array=a)", "SELECT event_id, 14 + CASE WHEN user_id = 12 THEN 10 ELSE 0 END::BIGINT AS result FROM events")
graph("sqlite_query", "part", ["p_partkey"], "def graph(p_size, p_brand):\n    if p_size > 10:\n        r = call('sqlite.query', query='SELECT ? * 2 AS d, upper(?) AS s UNION ALL SELECT 1, NULL', params=[p_size, p_brand], schema='array<struct<d:bigint,s:string>>')\n        return r[0].d + ':' + r[0]['s'] + len(r)\n    return 'x' + call('sqlite.query', query='SELECT nothing', on_error='continue_with_fallback', fallback_value='none')", "SELECT p_partkey, CASE WHEN p_size > 10 THEN (p_size * 2) || ':' || upper(p_brand) || '2' ELSE 'xnone' END AS result FROM part")
graph("on_error_fallback", "events", ["event_id"], "def graph(user_id):\n    return call('list.get', array=[10, 20, 30], index=user_id, on_error='continue_with_fallback', fallback_value=-1)", "SELECT event_id, CASE user_id WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE -1 END::BIGINT AS result FROM events")
graph("text_reverse", "nation", ["n_nationkey"], "def graph(n_name):\n    return call('text.reverse', text=n_name)", "SELECT n_nationkey, reverse(n_name) AS result FROM nation")
graph("math_add", "part", ["p_partkey"], "def graph(p_size):\n    return call('math.add', p_size, 2)", "SELECT p_partkey, p_size::DOUBLE + 2 AS result FROM part")
graph("math_mul", "part", ["p_partkey"], "def graph(p_size):\n    return call('math.mul', p_size, 3)", "SELECT p_partkey, p_size::DOUBLE * 3 AS result FROM part")
graph("echo", "nation", ["n_nationkey"], "def graph(n_name):\n    return call('echo', n_name)", "SELECT n_nationkey, n_name AS result FROM nation")
graph("test_large", "nation", ["n_nationkey"], "def graph(n_nationkey):\n    return call('test.large', n=n_nationkey)", "SELECT n_nationkey, repeat('x', n_nationkey) AS result FROM nation")
graph("env_template_url", "pages", ["page_id"], "def graph(url):\n    return call('env.template', value='${BASE:-https://mirror}/{{REGION}}$${x}?u=') + url", "SELECT page_id, 'https://mirror/eu${x}?u=' || url AS result FROM pages", env=Env({"REGION": "eu"}))
graph("env_get", "nation", ["n_nationkey"], "def graph(n_nationkey):\n    return call('env.get', key='REGION') + call('env.get', key='NONE', default='-') + n_nationkey", "SELECT n_nationkey, 'eu-' || n_nationkey AS result FROM nation", env=Env({"REGION": "eu"}))
graph("subgraph_compose", "orders", ["o_orderkey"], "def graph(o_totalprice, o_custkey):\n    net = call('subgraph:net', price=o_totalprice)\n    return net + o_custkey", "SELECT o_orderkey, o_totalprice - o_totalprice * 0.2e0 + o_custkey AS result FROM orders", subgraphs={"net": "def graph(price, vat=0.2):\n    return price - call('subgraph:vat', price=price, vat=vat)", "vat": "def graph(price, vat):\n    return price * vat"})

# SQL text

_SQL = {
    "filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'",
    "join": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "right_join": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "full_join": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 100",
    "theta_join": "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS q FROM lineitem",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_custkey, round(t, 2) AS t FROM big JOIN customer ON c_custkey = o_custkey WHERE t > (SELECT avg(t) FROM big) * 2",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "recursive": "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
}
_TABLES = "region nation customer supplier part orders lineitem events pages".split()


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        inputs.tables(spark, d, [t for t in _TABLES if t in text])
        out = inputs.sql(spark, text)
        return out.select(*[F.col(c).cast("long").alias(c) if t == "int" and c in ("y", "m") else F.col(c) for c, t in out.dtypes])

    return run


for _k, _sql in _SQL.items():
    QUERIES[f"sql_{_k}"], ORACLE[f"sql_{_k}"] = _sql_query(_sql), _sql


@query("sql_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000.5")
def sql_params(spark: SparkSession, d: str) -> DataFrame:
    inputs.tables(spark, d, ["orders"])
    return inputs.sql(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :s AND o_totalprice > :p", {"s": "F", "p": 250000.5})


@query("sql_binary", "SELECT n_nationkey, '0x' || lower(hex(encode(n_name))) AS raw FROM nation")
def sql_binary(spark: SparkSession, d: str) -> DataFrame:
    return inputs.decode_binary(_t(spark, d, "nation").select("n_nationkey", F.encode("n_name", "utf-8").alias("raw")))


# listings, versions, reports


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("graph_id"), F.when(F.col("user_id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.floor(F.col("value") * 100).cast("long").alias("duration_us"), F.col("ts").alias("started_at"))


_RUNS = "r AS (SELECT event_id AS id, event_type AS graph_id, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CAST(floor(value * 100) AS BIGINT) AS duration_us, ts AS started_at FROM events)"
_STATS = "count(*) AS executions, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'failed') * 1000.0 / count(*)) / 10 AS failure_rate, CAST(sum(duration_us) // count(duration_us) AS BIGINT) AS avg_duration_us, quantile_disc(duration_us, 0.95) AS p95_duration_us"


@query("report_graphs", f"WITH {_RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY started_at DESC, id DESC) AS n FROM r) SELECT graph_id, {_STATS} FROM l WHERE n <= 500 GROUP BY graph_id")
def report_graphs(spark: SparkSession, d: str) -> DataFrame:
    return report.graph_stats(_runs(spark, d))


@query("report_p95", f"WITH {_RUNS} SELECT graph_id, {_STATS} FROM r GROUP BY graph_id")
def report_p95(spark: SparkSession, d: str) -> DataFrame:
    return report.graph_stats(_runs(spark, d), latest=None)


_GRAPHS = "g AS (SELECT DISTINCT event_type AS id FROM events)"


@query("report_portfolio", f"WITH {_RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY started_at DESC, id DESC) AS n FROM r), s AS (SELECT graph_id, count(*) AS e, count(*) FILTER (status = 'failed') AS f FROM l WHERE n <= 500 GROUP BY graph_id) SELECT count(*) AS graphs, sum(e)::BIGINT AS executions, sum(f)::BIGINT AS failed, round(sum(f) * 1000.0 / sum(e)) / 10 AS failure_rate, count(*) FILTER (graph_id = 'error') AS rollbacks, count(*) FILTER (graph_id <> 'view') AS deployed FROM s")
def report_portfolio(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    g = runs.select(F.col("graph_id").alias("id")).distinct()
    g = g.select("id", F.when(F.col("id") == "view", "draft").otherwise("deployed").alias("status"), F.lit(1).alias("version"), F.lit(True).alias("active"), F.when(F.col("id") == "error", "rollback:1").otherwise("deploy:1").alias("last_event"))
    return report.portfolio(g, report.graph_stats(runs))


@query("tool_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def tool_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(_t(spark, d, "events"), "event_type")


@query("endpoint_hosts", "SELECT host, row_number() OVER (ORDER BY first, host)::BIGINT AS nth FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, min(page_id) AS first FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/:?#]+') GROUP BY 1)")
def endpoint_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = _t(spark, d, "pages").select(report.url_host(F.col("url")).alias("host"), "page_id")
    ordered = R.in_order(hosts, "host", [F.col("page_id")])
    return ordered.select("host", (F.monotonically_increasing_id()).alias("m")).select("host", F.row_number().over(Window.orderBy("m")).cast("long").alias("nth"))


@query("topn_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topn_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_key(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_per_key(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("paged_list", "SELECT o_orderkey, length(o_orderpriority) AS n FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_list(spark: SparkSession, d: str) -> DataFrame:
    return R.paged(_t(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 40).select("o_orderkey", F.length("o_orderpriority").cast("long").alias("n"))


@query("search_like", "SELECT doc_id FROM documents WHERE contains(lower(text), 'er_st%') OR contains(lower(source), 'src1')")
def search_like(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return R.like_search(docs, ["text"], "er_st%").unionByName(R.like_search(docs, ["source"], "SRC1")).select("doc_id").distinct()


_BM25 = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'that')) AS f1 FROM t),
g AS (SELECT count(*) AS docs, avg(len) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
SELECT doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score
FROM c, g WHERE f0 > 0 AND f1 > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query("search_ranked", _BM25)
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.full_text_search(_t(spark, d, "documents"), "doc_id", "text", "the that", 20).select("doc_id", F.round("score", 6).alias("score"))


_ASOF = "SELECT c.event_id, p.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON c.user_id = p.user_id AND c.ts >= p.ts"


@query("asof_join", _ASOF)
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return R.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], "ts", ["value"]).select("event_id", "asof_value")


@query("interval_join", "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.value >= p.p_size * 10 AND e.value < p.p_size * 10 + 3 WHERE p.p_partkey <= 200")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    ranges = _t(spark, d, "part").where("p_partkey <= 200").select("p_partkey", (F.col("p_size") * 10).cast("double").alias("low"), (F.col("p_size") * 10 + 3).cast("double").alias("high"))
    return R.interval_join(_t(spark, d, "events").select("event_id", "value"), ranges, "value", "low", "high", 3.0).select("event_id", "p_partkey")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local session may do without a set one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{path or tempfile.mkdtemp(prefix='weftline-')}/stream-{uuid.uuid4().hex}"


_HOURS = """
WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, value FROM events),
     late AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, max(value) AS top
FROM w, late WHERE h + INTERVAL 1 HOUR <= mark GROUP BY 1, 2"""


@query("stream_windows", _HOURS)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of each kind of event, by a stream: the hours that its watermark has passed."""
    # a glob, as a stream takes folders and globs but no file
    e = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = adapter.windowed(e, "ts", ["event_type"], "1 hour", "10 minutes", n=F.count("*"), top=F.max("value"))
    return adapter.settled(w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "top"), _folder(spark))


@query("approx_counts", "SELECT o_orderstatus, true AS near FROM orders GROUP BY 1")
def approx_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sketched distinct counts and quantiles that lie within their bounds of the exact ones."""
    g = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("n"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("q"), F.expr("percentile(o_totalprice, 0.49)").alias("lo"), F.expr("percentile(o_totalprice, 0.51)").alias("hi"))
    return g.select("o_orderstatus", ((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n") + 1) & F.col("q").between(F.col("lo"), F.col("hi"))).alias("near"))


@query("json_inputs_nulls", "SELECT * FROM (VALUES (9007199254740993::BIGINT, NULL, 1.5::DOUBLE), (1, 'b', NULL), (NULL, 'c', 2.0)) t(n, s, d)")
def json_inputs_nulls(spark: SparkSession, d: str) -> DataFrame:
    return inputs.json_inputs(spark, ['{"n": 9007199254740993, "s": null, "d": 1.5}', '{"n": 1, "s": "b"}', '{"s": "c", "d": 2}'])


@query("steps_in_order", "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS nth FROM events WHERE user_id = 12")
def steps_in_order(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("execution_id"), F.col("ts").alias("started_at"))
    steps = report.steps_of(e, 12)
    return steps.select("id", F.row_number().over(Window.partitionBy("execution_id").orderBy("started_at", "id")).cast("long").alias("nth"))


@query("env_missing_keys", "SELECT DISTINCT p_brand AS key FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49 AND p_brand IS NOT NULL)")
def env_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_brand").alias("key"), "p_size")
    return R.missing_keys(p.select("key").distinct(), p.where("p_size > 49").select("key"), "key")


@query("next_version", "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next FROM conversations GROUP BY conv_id")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next"))


@query("paused_runs", f"WITH {_RUNS} SELECT id, graph_id FROM r WHERE status = 'failed' ORDER BY started_at")
def paused_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("status = 'failed'").select("id", "graph_id")


_CHAIN = "SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent_id, n_name FROM nation"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.expr("cast((n_nationkey - 1) div 2 as int)")).alias("parent_id"), "n_name")


@query("fork_lineage", f"WITH RECURSIVE t AS ({_CHAIN}), up AS (SELECT id, parent_id, n_name, 0 AS u FROM t WHERE id = 20 UNION ALL SELECT t.id, t.parent_id, t.n_name, up.u + 1 FROM t JOIN up ON t.id = up.parent_id) SELECT id, n_name, (max(u) OVER () - u)::BIGINT AS depth FROM up")
def fork_lineage(spark: SparkSession, d: str) -> DataFrame:
    return R.lineage(_chain(spark, d), 20).select("id", "n_name", F.col("depth").cast("long").alias("depth"))


@query("fork_tree", f"WITH RECURSIVE t AS ({_CHAIN}), down AS (SELECT id, n_name, 0 AS depth FROM t WHERE id = 1 UNION ALL SELECT t.id, t.n_name, down.depth + 1 FROM t JOIN down ON t.parent_id = down.id) SELECT id, n_name, depth::BIGINT AS depth FROM down")
def fork_tree(spark: SparkSession, d: str) -> DataFrame:
    return R.tree(_chain(spark, d), 1).select("id", "n_name", F.col("depth").cast("long").alias("depth"))


@query("fork_children", f"WITH t AS ({_CHAIN}) SELECT p.id AS parent, c.id AS child FROM t p JOIN t c ON c.parent_id = p.id")
def fork_children(spark: SparkSession, d: str) -> DataFrame:
    t = _chain(spark, d)
    return t.select(F.col("id").alias("parent")).join(t.select(F.col("id").alias("child"), "parent_id"), F.col("parent") == F.col("parent_id")).select("parent", "child")
