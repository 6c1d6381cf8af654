"""A corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing, and BPE encoding with decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_codec, line_dedup, minhash_dedup, mixing, quality_rules
from weftline.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts have no words and are rejected; rows with equal or null ids are judged apart, so
    repeated rows share their fate; null languages are held to the base rules alone. An empty table stays empty."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated three-line windows go; n_chars follows the text. Null texts stay null, a text may become empty; rows
    equal in id and text share their fate; null ids come first in order. No row goes."""
    out = line_dedup.dedup_lines(docs)
    cols = [F.char_length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*cols)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id; shingles of five words. Of rows equal in id and text the first by
    their other columns stays, versions of one id are one group; rows without words, text or id link with nothing and stay."""
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last cut at its budget. Null sources are one source, last in order; texts without
    words are taken nothing of and go; rows equal in id, text and source share their takes."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids of whole texts, and whether they decode to the text. A null text is an empty one; every
    row has a row, whatever its id."""
    import public_tokenizers

    texts = docs.select("doc_id", "text", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).alias("key"))
    out = bpe_codec.encode(texts, public_tokenizers.path("byte_bpe_50k.json"), id_col="key", decoded=True)
    return out.select("key.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("key.sha")).alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("minhash near-dedup", near_dups), ("mixing", mix), ("bpe codec", tokens)]

#: Exact binomial bounds, sketches and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
