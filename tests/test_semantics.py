"""Parsed JSON, failures of tests, long graphs, tools that reach outside, streams, reports and records."""

import http.server
import json
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline import GraphError, apply_graph, compile_graph
from weftline.functions import outside, user
from weftline.functions.env import Env
from weftline.functions.tools import TOOLS, python_tool
from weftline.operators import relational as R
from weftline.plans import catalog as C
from weftline.plans import checkpoint, report, views
from weftline.plans.lower import Budget, BudgetError
from weftline.sources import inputs
from weftline.streaming import adapter


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(5, [1, -2, 3, 4]), (-3, [1, 2, -5, 3]), (0, [])], "x long, items array<long>")


def run(df, code, **how):
    return [r.result for r in apply_graph(df, code, **how).collect()]


def one(spark, expr, text):
    df = spark.createDataFrame([(text,)], "t string")
    return run(df, f"def graph(t):\n    p = call('json.parse', json=t)\n    return {expr}")[0]


@pytest.mark.parametrize(
    "expr, text, want",
    [
        ("p['k'] > 3", '{"k": 5}', True), ("p['k'] == 5", '{"k": 5}', True), ("p['k'] == 5.0", '{"k": 5}', True), ("p['k'] == '5'", '{"k": 5}', False),
        ("p['k'] == '5'", '{"k": "5"}', True), ("p['k'] > 3", '{"k": "5"}', False), ("p['k'] == True", '{"k": true}', True), ("p['k'] == 1", '{"k": true}', False),
        ("p['k'] == None", '{"k": null}', True), ("p['k'] == p['j']", '{"k": 1, "j": 1.0}', True), ("p['k'] == p['j']", '{"k": "a", "j": "b"}', False),
        ("1 if p['k'] else 0", '{"k": 0}', 0), ("1 if p['k'] else 0", '{"k": ""}', 0), ("1 if p['k'] else 0", '{"k": []}', 1), ("1 if p['k'] else 0", '{"k": null}', 0),
        ("1 if p['k'] else 0", '{"k": false}', 0), ("len(p)", "[1, 2, 3]", 3), ("len(p)", '"abc"', 3), ("len(p)", '{"a": 1}', 1),
        ("int(p[-1])", "[1, 9007199254740993]", 9007199254740993), ("int(p['a'] + 1)", '{"a": 9007199254740992}', 9007199254740993), ("float(p['a'] * 2)", '{"a": 1.5}', 3.0),
        ("'v' + p['a']", '{"a": 1}', "v1"), ("'b' in p", '{"b": 1}', True), ("2 in p", "[1, 2]", True), ("2 in p", "[1, 3]", False), ("call('array.len', array=p)", "[4]", 1),
    ],
)
def test_parsed_json(spark, expr, text, want):
    assert one(spark, expr, text) == want


def test_parsed_json_loops_and_fails(spark):
    df = spark.createDataFrame([('{"xs": [1, 2, 3.5]}',), ('{"xs": []}',)], "t string")
    assert run(df, "def graph(t):\n    s = 0\n    for x in call('json.parse', json=t).xs:\n        s = s + x\n    return float(s)") == [6.5, 0.0]
    for expr in ("p['none']", "p[9]", "len(p.xs[0])"):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, expr, '{"xs": [1]}')


def test_failed_tests_count_as_false_outside_loops(rows):
    assert run(rows, "def graph(items):\n    if items[3] > 3:\n        return 1\n    return 0") == [1, 0, 0]
    assert run(rows, "def graph(x):\n    if 10 / x > 1:\n        return 1\n    return 0") == [1, 0, 0]
    assert run(rows, "def graph(x):\n    if x == 0 or 10 / x > 1:\n        return 1\n    return 0") == [1, 0, 1]
    assert run(rows, "def graph(x, items):\n    if len(items) == 0:\n        return 7\n    if items[0] > 0:\n        return 1\n    return 0") == [1, 1, 7]
    with pytest.raises(Exception):  # noqa: B017
        run(rows, "def graph(items):\n    n = 0\n    for i in range(5):\n        if items[i] > 0:\n            n = n + 1\n    return n")


def test_long_graphs(rows):
    start = time.time()
    assert run(rows, "def graph(x):\n" + "    x = x + 1\n" * 1000 + "    return x") == [1005, 997, 1000]
    assert run(rows, "def graph(x):\n" + "    x = x + x\n" * 30 + "    return x") == [5 << 30, -3 << 30, 0]
    ifs = "def graph(x):\n    n = 0\n" + "".join(f"    if x > {k % 7}:\n        n = n + x\n        x = x - 1\n    else:\n        n = n + 1\n" for k in range(40)) + "    return n"

    def slow(x):
        n = 0
        for k in range(40):
            if x > k % 7:
                n, x = n + x, x - 1
            else:
                n += 1
        return n

    assert run(rows, ifs) == [slow(5), slow(-3), slow(0)]
    assert time.time() - start < 90


def test_long_bodies_and_nested_loops(rows):
    body = "def graph(items):\n    t = 0\n    for i in items:\n        y = i\n" + "        y = y + y\n" * 20 + "        for j in range(3):\n            for k in range(j):\n                t = t + y * k\n        t = t + 1\n    return t"
    want = [sum((i << 20) + 1 for i in xs) for xs in ([1, -2, 3, 4], [1, 2, -5, 3], [])]
    assert run(rows, body) == want


def test_untaken_branches_do_not_fail_when_they_land(rows):
    deep = "".join(f"        y = y + 10 / x + items[0] * {k}\n" for k in range(12))
    code = f"def graph(x, items):\n    y = 0\n    if x != 0:\n{deep}    elif len(items) > 0:\n        y = items[0]\n    else:\n        y = -1\n    return y"
    want = lambda x, xs: sum(int(10 / x) + xs[0] * k for k in range(12)) if x else -1
    assert run(rows, code) == [want(5, [1]), want(-3, [1]), -1]


def test_subgraph_variables_come_back(rows):
    subs = {"a": "def graph(x):\n    seen = x * 2\n    return seen + 1"}
    assert run(rows, "def graph(x):\n    y = call('subgraph:a', x=x)\n    return y + seen", subgraphs=subs) == [21, -11, 1]


def test_merge_strategies_take_the_outer_value(rows):
    code = "def graph(x):\n    r = 100\n    with PARALLEL():\n        r = x + 5\n        r = x * 2\n    return r"
    with pytest.raises(GraphError):
        compile_graph(code)
    assert run(rows, code, merge={"r": "max"}) == [100, 100, 100] and run(rows, code, merge={"r": "first"}) == [100, 100, 100]
    assert run(rows, code, merge={"r": "sum"}) == [120, 96, 105]


def test_budgets(rows, spark, tmp_path):
    with pytest.raises(BudgetError):
        run(rows, "def graph(x):\n" + "    x = x + 1\n" * 30 + "    return x", budget=Budget(nodes=20))
    with pytest.raises(Exception, match="bytes"):
        run(rows, "def graph(x):\n    s = call('test.large', n=500)\n    return s", budget=Budget(size=100))
    c = C.Catalog(spark, str(tmp_path))
    c.create("slow", "def graph(x):\n    return call('wait', x=x)")

    def nap(s):  # local, so that workers get it by value: they can't import this module
        time.sleep(20)
        return s

    wait = python_tool("wait", ["x"], F.pandas_udf(nap, "long"), "long")
    with pytest.raises(BudgetError):
        c.execute("slow", rows, str(tmp_path / "o"), budget=Budget(millis=1500), tools={"wait": wait})
    assert c.executions("failed").first().error == "time budget exceeded"


def test_sqlite(spark, rows, tmp_path):
    db = str(tmp_path / "t.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE t (k INTEGER, v TEXT, b BLOB)")
    put = f"def graph(x):\n    if x > 0:\n        r = call('sqlite.query', db='{db}', query='INSERT INTO t VALUES (?, ?, ?)', params=[x, 'v', None])\n        return int(r.changes)\n    return 0"
    assert run(rows.coalesce(1), put) == [1, 0, 0]
    with sqlite3.connect(db) as con:
        assert con.execute("SELECT k, v, b FROM t").fetchall() == [(5, "v", None)]  # rows of other branches made no call
    get = f"def graph(x):\n    r = call('sqlite.query', db='{db}', query='SELECT v, x''0aff'' AS b FROM t WHERE k = ?', params=[x])\n    if len(r) == 0:\n        return 'none'\n    return '-' + r[0]['v'] + r[0].b"
    assert run(rows, get.replace("''", "\\'")) == ["-v0x0aff", "none", "none"]
    with pytest.raises(Exception, match="no such table"):
        run(rows, "def graph(x):\n    return call('sqlite.query', query='SELECT * FROM missing')")
    with pytest.raises(Exception):  # noqa: B017  (one statement a call; scalars only)
        run(rows, "def graph(x):\n    return call('sqlite.query', query='SELECT 1; SELECT 2')")
    with pytest.raises(Exception, match="parameters"):
        run(rows, "def graph(x):\n    return call('sqlite.query', query='SELECT ?', params=[[1]])")
    with pytest.raises(TypeError, match="loops"):
        run(rows, "def graph(items):\n    n = 0\n    for i in items:\n        n = call('sqlite.query', query='SELECT 1')\n    return n")


def test_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("X-Kind", "t")
            self.end_headers()
            self.wfile.write(b"hello")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(base + "/ok",), (base + "/no",)], "url string")
    code = "def graph(url):\n    r = call('http_request', url=url, on_error='continue_with_null')\n    if r == None:\n        return 'failed'\n    return r.body + ' ' + r.status + ' ' + r.headers['x-kind']"
    assert run(df, code) == ["hello 200 t", "failed"]
    got = {r.url[-3:]: (r.status, r.body) for r in inputs.http_requests(df).collect()}
    assert got == {"/ok": (200, "hello"), "/no": (404, None)}
    server.shutdown()


def test_bound_sql_and_jdbc_tool(spark, rows, monkeypatch):
    assert outside.bound_sql("SELECT $1, '$1', $2, $3, $4", [1, "it's", None, True]) == "SELECT 1, '$1', 'it''s', NULL, TRUE"
    with pytest.raises(TypeError):
        outside.bound_sql("SELECT $1", [[1]])
    monkeypatch.setattr(inputs, "jdbc", lambda s, url, q: s.sql(q))
    code = "def graph(x):\n    r = call('postgres', dsn='jdbc:x', query='SELECT $1 AS a UNION ALL SELECT 9', params=[4])\n    return len(r) + x"
    assert run(rows, code) == [7, -1, 2]


def test_wait_and_print_are_accepted(rows):
    assert run(rows, "def graph(x):\n    sleep(2)\n    print(x)\n    call('test.sleep', ms=5)\n    return x") == [5, -3, 0]
    with pytest.raises(Exception, match="test.error"):
        run(rows, "def graph(x):\n    return call('test.error', message='m')")
    assert run(rows, "def graph(x):\n    return call('test.error', on_error='continue_with_fallback', fallback_value='f')") == ["f"] * 3
    assert run(rows, "def graph(x):\n    return call('env.list')", env=Env({"A": "1"}))[0] == {"A": "1"}
    assert run(rows, "def graph(x):\n    return call('send_email', to='a').status")[0] == "queued"


def test_json_inputs(spark):
    df = inputs.json_inputs(spark, ['{"n": 9007199254740993, "s": null, "a": [1, 2.5], "o": {"x": 1}, "m": 1}', '{"n": null, "o": {"y": "z"}, "m": "t"}', "{}"])
    a, b, c = df.drop("m").collect()
    assert a.n == 9007199254740993 and a.s is None and a.a == [1.0, 2.5] and a.o.x == 1 and a.o.y is None
    assert b.n is None and b.o.y == "z" and c.n is None and c.o is None
    assert run(df, "def graph(m):\n    if m == 1:\n        return 'one'\n    return 'other'") == ["one", "other", "other"]
    with pytest.raises(ValueError):
        inputs.json_inputs(spark, ["[1]"])


def test_records_steps_drift_and_reports(spark, tmp_path, rows, monkeypatch):
    c = C.Catalog(spark, str(tmp_path))
    c.create("a", "def graph(x):\n    y = call('echo', x)\n    z = call('env.get', key='KEY', default='d')\n    return y")
    c.create("b", "def graph(x):\n    r = call('http_request', url='https://api.example.org/v1', on_error='continue_with_null')\n    k = call('env.get', key='MUST')\n    return call('subgraph:a', x=x)")
    seen = []
    c.execute("a", rows, str(tmp_path / "out"), env=Env({}), observer=lambda *e: seen.append(e))
    run_id = c.executions("completed").first().id
    steps = c.steps(run_id).collect()
    assert [s.node_op for s in steps] == [n.op for n in views.plan_of(c.load("a")).nodes] and all(x.completed_at == y.started_at for x, y in zip(steps, steps[1:], strict=False))
    assert [s.parent_step_id for s in steps[1:]] == [s.id for s in steps[:-1]] and [e[0] for e in seen] == ["start"] * len(steps) + ["done"] * len(steps)
    assert c.missing_env("b", Env({})) == ["MUST"]
    s = report.sections(c, Env({}))
    assert set(s) == {k for p in report.PROFILES.values() for k in p.focus} and len(s) == 10
    assert s["tools"].collect()[0].tools == "echo x1, env.get x1" and s["endpoints"].collect()[0].endpoints == "api.example.org"
    assert s["env"].where("missing = 'MUST'").count() == 1 and s["subgraphs"].first().subgraphs == "a" and s["executions"].first().executions == 1
    for p in report.PROFILES.values():
        text = report.render(p, s)
        assert all(f"## {k.capitalize()}" in text for k in p.focus)
    monkeypatch.setitem(TOOLS, "echo", python_tool("echo", ["other"], lambda x: x, "long"))
    with pytest.raises(C.SchemaDrift):
        c.execute("a", rows, str(tmp_path / "out2"))


def test_a_loop_of_stages_resumes_at_its_cursor(spark, tmp_path, rows):
    body = lambda df: apply_graph(df, "def graph(x):\n    return x * 2 + 1", output="x", keep=["items"])
    stages = checkpoint.loop_stages("round", body, 4)
    whole = checkpoint.Run(spark, str(tmp_path / "a"), stages).run(rows)
    r, told = checkpoint.Run(spark, str(tmp_path / "b"), stages), []
    assert r.run(rows, pause_after=2) is None and json.loads(r.manifest())["done"] == 2
    again = checkpoint.Run(spark, str(tmp_path / "b"), stages).run(rows, observer=lambda *e: told.append(e))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect())) and told == [("start", "round-2"), ("done", "round-2"), ("start", "round-3"), ("done", "round-3")]
    bad = checkpoint.Run(spark, str(tmp_path / "c"), [("x", lambda df: df.select("nothing"))])
    good = checkpoint.Run(spark, str(tmp_path / "d"), stages)
    assert checkpoint.scheduler_round([(bad, rows), (good, rows)], 3) == {"completed": 0, "paused": 1, "failed": 1}


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    schema = "k string, v long, at string"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src).withColumn("at", F.to_timestamp("at"))
    batches = [[("a", 1, t(1)), ("a", 2, t(4))], [("b", 5, t(30))], [("b", 7, t(31))], [("a", 100, t(2)), ("c", 1, t(59))]]  # the last has a late row
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(src)
        time.sleep(0.05)
    q = adapter.stream_graph(read(), "def graph(v):\n    if v > 4:\n        return 'big'\n    return 'small'", lambda df, i: out.extend(df.collect()), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert sorted(r.result for r in out) == ["big"] * 3 + ["small"] * 3
    for name, df, want in (
        ("w", adapter.windowed(read(), "at", ["k"], "5 minutes", "10 minutes", total=F.sum("v")), {("a", 3), ("b", 12)}),
        ("s", adapter.sessions(read(), "at", ["k"], "5 minutes", "10 minutes"), {("a", 2), ("b", 2)}),
    ):
        df.writeStream.format("memory").queryName(f"q_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        got = {(r.k, r[-1]) for r in spark.table(f"q_{name}").collect()}
        assert got == want, name  # the row late by more than ten minutes is in none


def test_own_aggregates_and_table_functions(spark, rows):
    spread = user.aggregate_function(lambda v: float(v.max() - v.min()), "double")
    assert rows.groupBy().agg(spread("x").alias("s")).first().s == 8.0
    out = user.table_function(rows, lambda r: ({"x": r["x"], "i": int(i)} for i in r["items"]), "x long, i long")
    assert out.count() == 8 and out.where("x = 5").count() == 4
    double = python_tool("double", ["x"], lambda x: x * 2, "long")
    assert run(rows, "def graph(x):\n    return call('double', x=x)", tools={"double": double}) == [10, -6, 0]


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4)], "k string, at long, v long")
    right = spark.createDataFrame([("a", 3, 10), ("a", 5, 20), ("a", 5, 15), ("b", 10, 30), (None, 1, 40)], "k string, at long, v long")
    got = {(r.k, r.at, r.v): r.asof_v for r in R.asof_join(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {("a", 5, 1): 20, ("a", 1, 2): None, ("b", 9, 3): None, (None, 9, 4): None}
    points, ranges = spark.createDataFrame([(x,) for x in (-3, 0, 4, 5, 11)], "p long"), spark.createDataFrame([(0, 5), (-9, 0), (5, 12), (4, 4), (3, 100)], "lo long, hi long")
    got = sorted(map(tuple, R.interval_join(points, ranges, "p", "lo", "hi", 4.0).collect()))
    assert got == sorted((p, lo, hi) for p in (-3, 0, 4, 5, 11) for lo, hi in ((0, 5), (-9, 0), (5, 12), (3, 100)) if lo <= p < hi)
    assert R.exists(points) and not R.exists(points.limit(0)) and R.round_robin(points, 3).rdd.getNumPartitions() == 3


def test_ranked_search_matches_a_plain_formula(spark):
    import math

    texts = ["The cat that sat", "the the that", "dog", None, "THAT is the way the world ends", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r.id: r.score for r in R.full_text_search(df, "id", "t", "the that").collect()}
    toks = [(t or "").lower().split() for t in texts]
    avg, n = sum(map(len, toks)) / len(toks), len(toks)
    want = {}
    for i, w in enumerate(toks):
        if "the" in w and "that" in w:
            want[i] = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for q in ("the", "that") for d in [sum(q in x for x in toks)])
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)
