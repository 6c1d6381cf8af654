"""Token counts: rank-synchronous array merging over ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_core import BPETables, read_spec, tables
from .common import table, text_slices

#: Pre-tokens whose counts a worker remembers; it forgets all of them beyond that.
CACHE = 300_000


def count_tokens(texts: list[str | None], bpe: BPETables, cache: dict[str, int]) -> list[int]:
    """Tokens of each text; null counts as empty."""
    pieces = [bpe.pieces(t) if t else [] for t in texts]
    if len(cache) > CACHE:
        cache.clear()
    new = list({p for ps in pieces for p in ps if p not in cache})
    _, n = bpe.merge([p.encode() for p in new])
    cache.update(zip(new, n.tolist(), strict=True))
    if bpe.special:
        cache.update(dict.fromkeys(bpe.special, 1))
    return [sum(map(cache.__getitem__, ps)) for ps in pieces]


def with_token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text, without special tokens added.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null ids stay rows of their own, other
    columns are not read, an empty table gives an empty one. No shuffle; a worker holds a few MB of text and a
    bounded cache, so a lost executor costs its own tasks only.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = tables(spec.value), {}
        for part, texts in text_slices(batches):
            n_bytes = pc.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), n_bytes, pa.array(np.array(count_tokens(texts, bpe, cache), np.int64))], ["id", "n_bytes", "n_tokens"])

    return src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
