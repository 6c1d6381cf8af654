"""Pause and resume between stages: each stage's rows are a Parquet table, and a manifest says which are done."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lower import apply_graph

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def loop_stages(name: str, body: Callable[[DataFrame], DataFrame], rounds: int) -> list[Stage]:
    """A loop over whole tables as stages, one a round: its cursor is the number of whole ones, so it resumes in mid-loop."""
    return [(f"{name}-{i}", body) for i in range(rounds)]


def graph_stage(name: str, code: str, output: str, **how: object) -> Stage:
    return name, lambda df: apply_graph(df, code, output=output, **how)


class Run:
    """A run of stages under a folder. What a paused and resumed run returns equals that of an uninterrupted one."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages

    def _path(self, i: int) -> str:
        return f"{self.folder}/stage={i}-{self.stages[i][0]}"

    def done(self) -> int:
        """Stages whose output is whole: Spark leaves a _SUCCESS file where a write has ended."""
        jvm, n = self.spark._jvm, 0
        for i in range(len(self.stages)):
            p = jvm.org.apache.hadoop.fs.Path(f"{self._path(i)}/_SUCCESS")
            if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
                break
            n += 1
        return n

    def run(self, source: DataFrame, pause_after: int | None = None, pause_at: set[str] = frozenset(), observer: Callable[[str, str], None] | None = None) -> DataFrame | None:
        """Go on from the last whole stage; None if the policy pauses the run before its end. The observer is told (event, stage)."""
        tell = observer or (lambda *_: None)
        at = self.done()
        df = self.spark.read.parquet(self._path(at - 1)) if at else source
        for i in range(at, len(self.stages)):
            name, step = self.stages[i]
            tell("start", name)
            step(df).write.mode("overwrite").parquet(self._path(i))
            df = self.spark.read.parquet(self._path(i))
            tell("done", name)
            if i + 1 < len(self.stages) and (pause_after is not None and i + 1 - at >= pause_after or name in pause_at):
                return None
        return df

    def manifest(self) -> str:
        return json.dumps({"stages": [n for n, _ in self.stages], "done": self.done()})


def scheduler_round(runs: list[tuple[Run, DataFrame]], budget: int | None = None) -> dict[str, int]:
    """Resume paused runs, `budget` stages each; one that fails doesn't stop the others."""
    out = {"completed": 0, "paused": 0, "failed": 0}
    for run, source in runs:
        try:
            out["paused" if run.run(source, budget) is None else "completed"] += 1
        except Exception:
            out["failed"] += 1
    return out
