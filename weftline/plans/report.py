"""Execution reports: portfolio figures and per-graph statistics as DataFrames, and their text by role profile."""

from __future__ import annotations

import ast
import urllib.parse
from collections import Counter
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frontend import Graph
from .views import plan_of

if TYPE_CHECKING:
    from .catalog import Catalog

#: Executions of a graph that its statistics cover: the latest ones.
LATEST = 500


@dataclass(frozen=True)
class Profile:
    name: str
    label: str
    view: str
    direction: str
    focus: tuple[str, ...]


# The built-in roles, their views and directions, and the sections that each sees.
PROFILES = {
    p.name: p
    for p in (
        Profile("pm", "PM", "full", "td", ("executions", "tools", "structure", "churn")),
        Profile("ba", "BA", "summary", "td", ("duration", "structure", "endpoints", "churn")),
        Profile("ceo", "CEO", "summary", "lr", ("portfolio", "executions", "reliability")),
        Profile("architect", "Architect", "layers", "td", ("structure", "subgraphs", "endpoints", "tools")),
        Profile("senior", "Senior Engineer", "full", "td", ("structure", "tools", "churn", "reliability")),
        Profile("devops", "DevOps", "full", "td", ("reliability", "endpoints", "env", "duration")),
    )
}


def rate(part: Column, whole: Column) -> Column:
    """A share in per cent with one decimal, half away from zero; 0 for none."""
    return F.when(whole > 0, F.round(part * 1000.0 / whole) / 10).otherwise(0.0)


def graph_stats(executions: DataFrame, latest: int | None = LATEST) -> DataFrame:
    """Per graph_id: executions, failed, failure rate, mean (whole) and nearest-rank 95th percentile of duration_us."""
    if latest:
        nth = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("started_at"), F.desc("id")))
        executions = executions.withColumn("__n", nth).where(F.col("__n") <= latest)
    n, failed = F.count("*"), F.count_if(F.col("status") == "failed")
    return executions.groupBy("graph_id").agg(
        n.alias("executions"),
        failed.alias("failed"),
        rate(failed, n).alias("failure_rate"),
        F.expr("sum(duration_us) div count(duration_us)").alias("avg_duration_us"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_us)").cast("long").alias("p95_duration_us"),
    )


def portfolio(graphs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: totals over all graphs (id, status, version, active, last_event) and their statistics."""
    j = graphs.join(stats.withColumnRenamed("graph_id", "id"), "id", "left")
    total, failed = F.coalesce(F.sum("executions"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))
    return j.agg(
        F.count("*").alias("graphs"),
        total.alias("executions"),
        failed.alias("failed"),
        rate(failed, total).alias("failure_rate"),
        F.count_if(F.coalesce(F.startswith("last_event", F.lit("rollback:")), F.lit(False))).alias("rollbacks"),
        F.count_if((F.col("status") == "deployed") | ((F.col("version") > 1) & F.col("active"))).alias("deployed"),
    )


def histogram(df: DataFrame, col: str) -> DataFrame:
    """How often each value occurs, the commonest first, equal counts by name."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def steps_of(steps: DataFrame, execution_id: object) -> DataFrame:
    """An execution's steps by their start."""
    return steps.where(F.col("execution_id") == execution_id).orderBy("started_at", "id")


def plan_facts(spark: SparkSession, graphs: dict[str, Graph], env: object = None) -> DataFrame:
    """A row for each graph by id: nodes, edges, tool calls by number, hosts that it calls, subgraphs, environment keys and those missing."""
    rows = []
    for key, g in graphs.items():
        plan, calls = plan_of(g), Counter(t for t, _ in g.calls() if not t.startswith("subgraph:"))
        urls = [k.value.value for t, n in g.calls() if t == "http_request" for k in n.keywords if k.arg == "url" and isinstance(k.value, ast.Constant)]
        hosts = list(dict.fromkeys(h for u in urls if (h := urllib.parse.urlsplit(str(u)).hostname)))
        keys = g.env_keys()
        lacking = [k for k, optional in keys.items() if not optional and env is not None and env.get(k) is None]
        tools = [f"{t} x{n}" for t, n in sorted(calls.items(), key=lambda x: (-x[1], x[0]))]
        rows.append((key, len(plan.nodes), len(plan.edges), tools, hosts, g.subgraphs(), [k + " (opt)" * o for k, o in keys.items()], lacking))
    return spark.createDataFrame(rows, "id string, nodes int, edges int, tools array<string>, endpoints array<string>, subgraphs array<string>, env array<string>, missing array<string>")


def sections(catalog: Catalog, env: object = None) -> dict[str, DataFrame]:
    """The ten sections over a catalog's graphs and executions; graphs go by name."""
    graphs = catalog.graphs().drop("tools")
    versions = catalog.table("graphs").groupBy("id").agg(F.count_distinct("version").alias("versions"))
    facts = plan_facts(catalog.spark, {r["id"]: catalog.load(r["id"]) for r in graphs.select("id").collect()}, env)
    stats = graph_stats(catalog.executions())
    all_ = graphs.join(stats.withColumnRenamed("graph_id", "id"), "id", "left").join(versions, "id").join(facts, "id").withColumnsRenamed({"name": "graph"})
    n = F.coalesce("executions", F.lit(0))
    some = lambda c: all_.where(F.size(c) > 0).select("graph", F.array_join(c, ", ").alias(c)).orderBy("graph")
    env_rows = all_.where((F.size("env") > 0) | (F.size("missing") > 0))
    return {
        "portfolio": all_.select("graph", "version", "status", "last_event", n.alias("executions"), F.coalesce("failed", F.lit(0)).alias("failed"), "avg_duration_us", "p95_duration_us").orderBy("graph"),
        "executions": portfolio(graphs, stats),
        "reliability": all_.where("executions > 0").select("graph", "failure_rate", "failed", "executions").orderBy(F.desc("failure_rate"), "graph"),
        "duration": all_.where("p95_duration_us is not null").select("graph", "p95_duration_us", "avg_duration_us", "executions").orderBy("p95_duration_us", "graph"),
        "tools": some("tools"),
        "endpoints": some("endpoints"),
        "env": env_rows.select("graph", F.array_join("env", ", ").alias("env"), F.array_join("missing", ", ").alias("missing")).orderBy("graph"),
        "structure": all_.select("graph", "nodes", "edges", F.array_join("subgraphs", ", ").alias("subgraphs")).orderBy("graph"),
        "subgraphs": some("subgraphs"),
        "churn": all_.select("graph", "versions", "last_event").orderBy(F.desc("versions"), "graph"),
    }


def render(profile: Profile, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """Fixed-width text of the sections in a profile's focus; each shows its first rows only."""
    out = [f"report: {profile.label}", ""]
    for name in profile.focus:
        if name in sections:
            df = sections[name]
            out += [f"## {name.capitalize()}", "  ".join(f"{c:<18}" for c in df.columns)]
            out += ["  ".join(f"{'-' if v is None else v!s:<18.18}" for v in r) for r in df.limit(rows).collect()]
            out.append("")
    return "\n".join(out)
