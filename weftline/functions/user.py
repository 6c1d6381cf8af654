"""Aggregates and table functions of one's own, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_function(make: Callable[..., object], type_: str) -> Callable[..., Column]:
    """An aggregate from a function of pandas series. A group is held in one task: give it groups of bounded size."""
    return F.pandas_udf(make, type_, F.PandasUDFType.GROUPED_AGG)


def table_function(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that a generator makes of each row of df, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(",")]
        for pdf in parts:
            rows = [out for r in pdf.to_dict("records") for out in make(r)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)
