"""Relational operators around graphs and executions: listings, search, versions, lineage, dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. Rows meet as aggregates, not windows, so a key of very many rows is no burden."""
    ranked = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(ranked.alias("__r")).select("__r.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def like_search(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    """Rows with the term, taken literally and without case, in any column."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return df.where(hit)


def full_text_search(df: DataFrame, id_col: str, text_col: str, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows with every word of the query, best BM25 score first; limit is 100 at most.

    Texts are split once: the counts of the few query words are carried to the corpus figures by a window without keys
    over sums a partition, never over rows. Nothing is exploded.
    """
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = range(len(words))
    # one fold over a text's words counts its length and each query word
    first = F.struct(F.lit(0).alias("len"), *[F.lit(0).alias(f"f{i}") for i in n])
    step = lambda a, x: F.struct((a["len"] + 1).alias("len"), *[(a[f"f{i}"] + (x == F.lit(w)).cast("int")).alias(f"f{i}") for i, w in enumerate(words)])
    counts = df.select(F.col(id_col), F.aggregate(tokens, first, step).alias("c")).select(id_col, "c.*")
    match = " AND ".join(f"f{i} > 0" for i in n) or "false"
    # matching rows stay rows; all others meet as sums of their partition
    tagged = counts.withColumn("part", F.spark_partition_id()).withColumn("hit", F.expr(match))
    key = F.when(F.col("hit"), F.col(id_col))
    nth = F.when(F.col("hit"), F.monotonically_increasing_id())
    sums = tagged.groupBy("hit", key.alias(id_col), nth.alias("nth"), F.when(~F.col("hit"), F.col("part")).alias("part")).agg(
        F.count("*").alias("docs"), F.sum("len").alias("len"), *[F.max(f"f{i}").alias(f"f{i}") for i in n], *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in n]
    )
    return _bm25(sums, id_col, len(words), limit, k1, b)


def _bm25(sums: DataFrame, id_col: str, n: int, limit: int, k1: float, b: float) -> DataFrame:
    figures = sums.agg(F.sum("docs").alias("docs"), (F.sum("len") / F.sum("docs")).alias("avg_len"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(n)])
    hits = sums.where("hit").select(id_col, "len", *[f"f{i}" for i in range(n)]).crossJoin(F.broadcast(figures))  # figures is one row
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(min(limit, 100))


def lineage(df: DataFrame, leaf: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The rows from a root down to a leaf, with their depth."""
    return df.sparkSession.sql(
        f"""WITH RECURSIVE up AS (
              SELECT *, 0 AS __up FROM {{rows}} WHERE {id_col} = :leaf
              UNION ALL SELECT p.*, up.__up + 1 FROM {{rows}} p JOIN up ON p.{id_col} = up.{parent_col})
            SELECT * EXCEPT (__up), max(__up) OVER () - __up AS depth FROM up""",
        args={"leaf": leaf},
        rows=df,
    )


def tree(df: DataFrame, root: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """A root and all below it, with their depth."""
    return df.sparkSession.sql(
        f"""WITH RECURSIVE down AS (
              SELECT *, 0 AS depth FROM {{rows}} WHERE {id_col} = :root
              UNION ALL SELECT c.*, down.depth + 1 FROM {{rows}} c JOIN down ON c.{parent_col} = down.{id_col})
            SELECT * FROM down""",
        args={"root": root},
        rows=df,
    )


def exists(df: DataFrame) -> bool:
    """Whether there is a row; no row is read beyond the first."""
    return not df.isEmpty()


def in_order(df: DataFrame, col: str, order: list[Column]) -> DataFrame:
    """The distinct values of a column, each where it comes first; nulls are left out."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.struct(*order)).alias("__first"))
    return first.orderBy("__first", col).drop("__first")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each row of left with the values of the newest row of right of its keys at or before its time; null where there is none.

    Both sides meet in one window by key and time, a single shuffle, and nothing is paired. Rows of right of equal time:
    the greatest values win. Rows with null keys meet none.
    """
    struct = F.struct(*[F.col(v) for v in values])
    # a row's own columns travel as one struct, so that any names may clash
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(struct.alias("v")).schema[0].dataType).alias("__v"))
    b = right.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), struct.alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return joined.select("__row.*", *[F.when(known, F.col("__v")[v]).alias(f"asof_{v}") for v in values])


def interval_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges low <= point < high that hold them.

    A range is dealt to the buckets of `width` that it covers, a point has one, so the join is by bucket and not over
    all pairs; take the width near a range's usual length.
    """
    bucket = lambda c: F.floor(c.cast("double") / F.lit(width)).cast("long")
    r = ranges.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return points.withColumn("__b", bucket(F.col(at))).join(r, "__b").where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("__b")


def missing_keys(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return required.join(available, key, "left_anti")


def closure(root: str, children: Callable[[str], list[str]]) -> list[str]:
    """All that a graph depends on, itself first; each once, so cycles end."""
    seen, todo = [], [root]
    while todo:
        x = todo.pop(0)
        if x not in seen:
            seen.append(x)
            todo += children(x)
    return seen


def round_robin(df: DataFrame, workers: int) -> DataFrame:
    return df.repartition(workers)
