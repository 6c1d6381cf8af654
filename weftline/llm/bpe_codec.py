"""BPE encoding and decoding: forced-boundary splitting.

Two neighbouring bytes that no token of the vocabulary holds side by side can never be merged, so the place
between them is a certain cut. Pre-tokens are cut there, the fragments are encoded on their own, each distinct
one once, and their ids are joined again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_core import BPETables, read_spec, tables
from .common import table, text_slices

#: Pre-tokens, and fragments, that a worker remembers.
CACHE = 200_000


class Codec:
    """Encoder and decoder of one Python worker; ids are little-endian int32 in bytes."""

    def __init__(self, bpe: BPETables):
        self.bpe = bpe
        self.pieces: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self._special()

    def _special(self) -> None:
        self.pieces.update((t, np.int32(i).tobytes()) for t, i in self.bpe.special.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.bpe.pieces(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE:
            self.pieces.clear()
            self._special()
        if len(self.fragments) > CACHE:
            self.fragments.clear()
        fresh = list({p for ps in split for p in ps if p not in self.pieces})
        new = dict(zip(fresh, self.bpe.fragments([p.encode() for p in fresh]), strict=True))
        todo = list({f for fs in new.values() for f in fs if f not in self.fragments})
        flat, n = self.bpe.merge(todo)
        raw, at = flat.astype("<i4").tobytes(), (np.cumsum(n) * 4).tolist()
        self.fragments.update((f, raw[b - 4 * k : b]) for f, b, k in zip(todo, at, n.tolist(), strict=True))
        self.pieces.update((p, b"".join(map(self.fragments.__getitem__, fs))) for p, fs in new.items())
        return [b"".join(map(self.pieces.__getitem__, ps)) for ps in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bpe.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row's whole text; with `decoded`, also the text read back from those ids.

    A null text is an empty one: no ids, and "" decoded. Strings of special tokens inside a text become those
    tokens, as is the library's default. Rows with equal or null ids stay apart; no shuffle; bounded memory.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables(spec.value))
        for part, texts in text_slices(batches):
            raw = codec.encode(texts)
            flat = np.frombuffer(b"".join(raw), "<i4")
            ends = np.cumsum([len(x) // 4 for x in raw], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(flat))
            cols = [part.column("id"), ids]
            if decoded:
                cols.append(pa.array([codec.decode(np.frombuffer(x, "<i4")) for x in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][: len(cols)])

    return src.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) read back from arrays of ids; null ids are an empty text, ids outside the vocabulary are skipped."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables(spec.value))
        most = len(codec.bpe.token_bytes)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [codec.decode(np.array([i for i in x or () if i is not None and 0 <= i < most], np.int32)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(out: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of the columns ids and decoded."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True))
