"""Versioned graphs and their executions in append-only tables; the newest record of a key is its state.

Tables are Parquet folders under one root. A graph's change is a new record, so a rollback is a new version too.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outside  # noqa: F401  (registers tools)
from ..functions.tools import TOOLS
from ..operators import relational as R
from . import report, views
from .frontend import Graph, compile_graph
from .lower import Budget, BudgetError, apply_graph

SCHEMAS = {
    "graphs": "id string, name string, version long, status string, active boolean, code string, parent_id string, fork_node string, fork_label string, last_event string, tools string, seq long, at timestamp",
    "executions": "id string, graph_id string, graph_version long, input string, output string, status string, error string, started_at timestamp, completed_at timestamp, duration_us long, seq long",
    "steps": "id string, execution_id string, node_id string, node_op string, status string, error string, started_at timestamp, completed_at timestamp, duration_us long, parent_step_id string, seq long",
}


class SchemaDrift(RuntimeError):
    pass


def tool_digests(graph: Graph, tools: dict | None = None) -> dict[str, str]:
    """Of each tool that a graph calls, the digest of its parameters."""
    have = {**TOOLS, **(tools or {})}
    return {t: have[t].digest for t, _ in graph.calls() if t in have}


def check_drift(compiled: dict[str, str], graph: Graph, tools: dict | None = None) -> None:
    """Raise where a tool's parameters are no longer those that the graph was stored with."""
    for name, now in tool_digests(graph, tools).items():
        if compiled.get(name, now) != now:
            raise SchemaDrift(f"{name}: its parameters have changed since the graph was stored")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._compiled = lru_cache(64)(compile_graph)

    def _append(self, table: str, *rows: dict[str, object], **row: object) -> None:
        """One file for all rows."""
        rows = rows or (row,)
        names = [f.split()[0] for f in SCHEMAS[table].split(", ")]
        seq = time.time_ns()
        now = F.timestamp_micros(F.lit(seq // 1000))
        rows = [{**r, "seq": seq + i} for i, r in enumerate(rows)]
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f.replace(" timestamp", " string") for f in SCHEMAS[table].split(", ")))
        stamps = [f.split()[0] for f in SCHEMAS[table].split(", ") if f.endswith(" timestamp")]
        df.withColumns({c: F.coalesce(F.col(c).cast("timestamp"), now) if c == "at" else F.col(c).cast("timestamp") for c in stamps}).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def table(self, table: str) -> DataFrame:
        """All records; none where nothing is written yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}")

    def graphs(self) -> DataFrame:
        return R.latest_per_key(self.table("graphs"), ["id"], [F.col("seq")])

    def executions(self, status: str | None = None) -> DataFrame:
        df = R.latest_per_key(self.table("executions"), ["id"], [F.col("seq")])
        return df.where(F.col("status") == status) if status else df

    def _one(self, name: str) -> dict:
        """By id, else the newest graph of that name."""
        rows = self.graphs().where((F.col("id") == name) | (F.col("name") == name)).orderBy(F.desc(F.col("id") == name), F.desc("seq")).limit(1).collect()
        if not rows:
            raise KeyError(f"no graph {name}")
        return rows[0].asDict()

    def _next(self, graph_id: str) -> int:
        return self.table("graphs").where(F.col("id") == graph_id).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]

    def create(self, name: str, code: str) -> str:
        compile_graph(code)
        graph_id = uuid.uuid4().hex
        self._append("graphs", id=graph_id, name=name, version=1, status="draft", active=False, code=code, last_event="create", tools=json.dumps(tool_digests(compile_graph(code))))
        return graph_id

    def update(self, name: str, code: str) -> int:
        compile_graph(code)
        g = self._one(name)
        version = self._next(g["id"])
        self._append("graphs", **{**g, "version": version, "code": code, "status": "draft", "last_event": f"update:{version}", "tools": json.dumps(tool_digests(compile_graph(code))), "at": None})
        return version

    def deploy(self, name: str) -> None:
        g = self._one(name)
        self._append("graphs", **{**g, "status": "deployed", "active": True, "last_event": f"deploy:{g['version']}", "at": None})

    def rollback(self, name: str, version: int) -> int:
        g = self._one(name)
        old = R.latest_per_key(self.versions(g["id"]).where(F.col("version") == version), ["version"], [F.col("seq")]).collect()
        if not old:
            raise KeyError(f"{name} has no version {version}")
        new = self._next(g["id"])
        self._append("graphs", **{**g, "version": new, "code": old[0]["code"], "tools": old[0]["tools"], "status": "deployed", "active": True, "last_event": f"rollback:{version}", "at": None})
        return new

    def fork(self, name: str, label: str, node: str | None = None) -> str:
        g = self._one(name)
        child = uuid.uuid4().hex
        self._append("graphs", id=child, name=f"{g['name']}-{label}", version=1, status="draft", active=False, code=g["code"], tools=g["tools"], parent_id=g["id"], fork_node=node, fork_label=label, last_event="fork")
        return child

    def versions(self, graph_id: str) -> DataFrame:
        return self.table("graphs").where(F.col("id") == graph_id)

    def load(self, name: str, version: int | None = None) -> Graph:
        g = self._one(name)
        if version is not None:
            g = R.latest_per_key(self.versions(g["id"]).where(F.col("version") == version), ["version"], [F.col("seq")]).first()
        return self._compiled(g["code"])

    def missing_env(self, name: str, env: object) -> list[str]:
        """Required keys of a graph and of all it calls that the environment lacks."""
        out = []
        for g in R.closure(name, lambda n: self.load(n).subgraphs()):
            scope = env if g == name else env.scoped(g)
            out += [k for k, optional in self.load(g).env_keys().items() if not optional and scope.get(k) is None]
        return list(dict.fromkeys(out))

    def execute(self, name: str, df: DataFrame, path: str, env: object = None, budget: Budget | None = None, observer: Callable[[str, str, str], None] | None = None, **how: object) -> DataFrame:
        """Run a graph over df into a Parquet table and record it and its steps; a failure is recorded and raised.

        A budget's milliseconds end the run's jobs. The observer is told (event, node, op): "start" of every node as the
        plan is made, "done" when the table is written.
        """
        g, started = self._one(name), time.time()
        if env is not None and (lacking := self.missing_env(name, env)):
            raise KeyError(f"missing environment: {', '.join(lacking)}")
        graph = self._compiled(g["code"])
        check_drift(json.loads(g["tools"] or "{}"), graph, how.get("tools"))
        run, nodes = uuid.uuid4().hex, views.plan_of(graph).nodes
        stamp = lambda t: str(datetime.fromtimestamp(t, UTC).replace(tzinfo=None)) + "+00:00"
        record = {"id": run, "graph_id": g["id"], "graph_version": g["version"], "input": json.dumps(df.columns), "started_at": stamp(started)}
        self._append("executions", **record, status="running")
        tell = observer or (lambda *_: None)
        for n in nodes:
            tell("start", str(n.id), n.op)
        limit = budget.millis if budget else None
        over = lambda: limit and time.time() - started >= limit / 1000
        done = threading.Event()

        def watch() -> None:  # a job that starts after an interrupt isn't reached by it, so there is one after another
            done.wait(limit / 1000)
            while not done.wait(0.2):
                self.spark.interruptTag(run)

        try:
            self.spark.addTag(run)
            if limit:
                threading.Thread(target=watch, daemon=True).start()
            apply_graph(df, graph, subgraphs=self.load, env=env, budget=budget, **how).write.mode("overwrite").parquet(path)
            if over():
                raise TimeoutError
        except Exception as e:
            late = over()
            self._append("executions", **record, status="failed", error="time budget exceeded" if late else str(e)[:2000], completed_at=stamp(time.time()), duration_us=int((time.time() - started) * 1e6))
            if late:
                raise BudgetError(f"{name} ran longer than {limit} ms") from e
            raise
        finally:
            done.set()
            self.spark.removeTag(run)
        ended = time.time()
        self._append("executions", **record, status="completed", output=path, completed_at=stamp(ended), duration_us=int((ended - started) * 1e6))
        # one plan runs all nodes at once: each has an equal part of the time, in order
        each, steps = int((ended - started) * 1e6) // max(1, len(nodes)), []
        for i, n in enumerate(nodes):
            begin = (int(started * 1e6) + i * each) / 1e6
            steps.append({"id": f"{run}-{i}", "execution_id": run, "node_id": str(n.id), "node_op": n.op, "status": "completed", "started_at": stamp(begin), "completed_at": stamp((int(started * 1e6) + (i + 1) * each) / 1e6), "duration_us": each, "parent_step_id": f"{run}-{i - 1}" if i else None})
            tell("done", str(n.id), n.op)
        if steps:
            self._append("steps", *steps)
        return self.spark.read.parquet(path)

    def steps(self, execution_id: str) -> DataFrame:
        return report.steps_of(self.table("steps"), execution_id)
