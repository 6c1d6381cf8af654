"""Graphs over streams, which are new beside batches: the same projection runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lower import apply_graph


def stream_graph(source: DataFrame, code: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **how: object):  # noqa: ANN201
    """A running query that hands each micro-batch's results to `sink`; the checkpoint makes restarts exact."""
    return apply_graph(source, code, **how).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(source: DataFrame, time_col: str, keys: list[str], size: str, late: str, slide: str | None = None, **aggregates: object) -> DataFrame:
    """Aggregates by event-time window and keys; rows later than `late` behind the newest are dropped."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return source.withWatermark(time_col, late).groupBy(w, *keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def settled(stream: DataFrame, folder: str) -> DataFrame:
    """The rows that a stream's present input makes final, as a table under `folder`, which driver and executors have to share."""
    out = f"{folder}/rows"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def sessions(source: DataFrame, time_col: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return source.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), *keys).agg(F.count("*").alias("n"))
