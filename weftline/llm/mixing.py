"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source the rows are sorted by key range, and prefix sums of their
sizes are distributed: sums by (source, key range) first, their running sums next, then running sums inside
each range. A source takes whole epochs and then the rows below the cut at its exact budget; the row at the cut
gives only the words up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Weights of the sources in order, repeating; the share of all words that the mix has; times a source may be taken.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows that a range of keys holds, about. Windows hold one range of one source, so a source of a third of all rows is spread.
ROWS_A_RANGE = 20_000
SEED = 20240601


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source key, total, target) from (source key, total): water-filling with all sources in distributed tables.

    A source is capped at `most` times its total if the common level reaches it, i.e. in the order of
    total / weight the level after capping the first k is (goal - their caps) / (weights of the rest).
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    # one row a source: the only window over all sources; rows are short and sums, never documents
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    by_level = Window.orderBy(most * F.col("total") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    step = (
        ranked.withColumn("goal", share * F.sum("total").over(Window.partitionBy()))
        .withColumn("level", (F.col("goal") - most * F.coalesce(F.sum("total").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("free", most * F.col("total") >= F.col("level") * F.col("weight"))
    )
    # the first free source's level holds for it and all after it; those before are capped
    step = step.withColumn("free_level", F.min(F.when(F.col("free"), F.struct(most * F.col("total") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"])
    return step.select("source", "total", F.least(most * F.col("total"), F.coalesce(F.col("free_level") * F.col("weight"), most * F.col("total"))).alias("target"))


def plan(df: DataFrame, id_cols: list[str], source_col: str = "source", size_col: str = "size", seed: int = SEED, rows_a_range: int = ROWS_A_RANGE, **how) -> DataFrame:
    """For rows (ids, source, size): source_size, target, and taken, the words that the mix takes of each.

    Null sources are one source of their own, last in order; sizes that are null count as 0; rows that are equal in
    every id share a key, and their order is that of their sizes, so reruns agree. An empty table stays empty.
    """
    ids = [F.col(c).alias(f"i{k}") for k, c in enumerate(id_cols)]
    names = [f"i{k}" for k in range(len(id_cols))]
    rows = df.select(*ids, F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    u = F.xxhash64(F.lit(seed), *names, F.coalesce("source", F.lit("")))
    rows = materialize(rows.withColumn("key", u), "mix")
    bits = max(4, min(40, (rows.count() // rows_a_range).bit_length()))  # 2 ** bits ranges of the key's upper bits, in its order
    rows = rows.withColumn("range", F.shiftright("key", 64 - bits))
    # a null source cannot be a join key, so each has a name that is never null
    tag = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = rows.withColumn("tag", tag)
    parts = materialize(rows.groupBy("tag", "source", "range").agg(F.sum("size").alias("part"), F.count("*").alias("n")), "mix-parts")
    of_source = targets(parts.groupBy("source").agg(F.sum("part").alias("total")), **how).withColumn("tag", tag).drop("source")
    run = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.drop("source", "n").withColumn("offset", F.coalesce(F.sum("part").over(run), F.lit(0)))
        .join(of_source, "tag")
        .select("tag", "range", "offset", "total", "target")
    )
    within = Window.partitionBy("tag", "range").orderBy("key", *names, "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    out = rows.join(offsets.hint("shuffle_hash"), ["tag", "range"]).withColumn("begin", begin)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("total") > 0, F.floor(budget / F.col("total"))).otherwise(0)
    rest = budget - epochs * F.col("total")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begin")))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, id_cols, strict=True)], F.col("source").alias(source_col), "size", F.col("total").alias("source_size"), "target", taken.cast("long").alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of df: a row for each time a text is taken, the last one cut at its budget.

    A text taken k times whole and then partly comes k + 1 times, the last with only its first words; n_chars, where
    it is there as a whole number, follows the text. Rows that the mix takes nothing of are gone.
    """
    keyed = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    keyed = keyed.withColumn("size", count_words(F.col(at[text_col]))).withColumn("h", F.xxhash64(at[text_col], at[source_col])).withColumn("id", F.coalesce(F.col(at[id_col]).cast("string"), F.lit("")))
    p = plan(keyed.select("id", "h", F.col(at[source_col]).alias("source"), "size"), ["id", "h"], **how)
    p = p.groupBy("id", "h").agg(F.sort_array(F.collect_list("taken"), asc=False).alias("takes"), F.first("size").alias("p_size"))
    # what has no words is taken nothing of; rows equal in id, text and source share the takes of their class, one each by number
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("size"))
    out = keyed.where("size > 0").join(p.where("p_size > 0"), ["id", "h"]).withColumn("taken", F.col("takes")[nth - 1])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("words", F.explode(copies))
    text = F.col(at[text_col])
    new = F.when(F.col("words") >= F.col("size"), text).otherwise(_first_words(text, F.col("words")))
    cols = {c: new if c == text_col else F.col(at[c]) for c in df.columns}
    kinds = dict(df.dtypes)
    if kinds.get("n_chars") in ("int", "bigint"):
        cols["n_chars"] = F.char_length(new).cast(kinds["n_chars"])
    return out.select(*[v.alias(c) for c, v in cols.items()])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word, as it stands."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(tokens, F.lit(1), F.greatest(n, F.lit(0))), "")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    return plan(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
