"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Lines without a word are passed over when windows are formed. Every three consecutive lines are hashed (two 64-bit
hashes); a window that occurs more than once stays where it occurs first by (id, line), and all lines that its
later occurrences cover are removed, with the blank lines between them. Any line removed still stands where its
window occurred first, so no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _windows(full: Column, size: int) -> Column:
    """Structs of two hashes and the first and last line of each window; full: structs (i, x) of the lines with a word."""
    n = F.greatest(F.size(full) - size + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(full, j + 1, n).alias(f"l{j}") for j in range(size)])
    return F.transform(
        shifted,
        lambda w: F.struct(
            F.xxhash64(*[w[f"l{j}"]["x"] for j in range(size)]).alias("h1"),
            F.xxhash64(F.lit(7), *[w[f"l{j}"]["x"] for j in range(size)]).alias("h2"),
            w["l0"]["i"].alias("lo"),
            w[f"l{size - 1}"]["i"].alias("hi"),
        ),
    )


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, h, islands): the merged line ranges that go, for each text (by id and hash) that loses lines; from columns id, h, lines."""
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(_WORD))
    w = docs.select("id", "h", full.alias("full"))  # its own step: used inside functions, it would be made anew for each element
    w = materialize(w.select("id", "h", F.inline(_windows(F.col("full"), size))), "windows")
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "h", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # one row a window on the right: where a window is very common, the left side's partition can be split
    later = w.join(first.hint("merge"), ["h1", "h2"]).where(~F.struct("id", "h", "lo").eqNullSafe(F.col("first"))).select("id", "h", "lo", "hi")
    by_text = Window.partitionBy("id", "h").orderBy("lo")
    edge = F.max("hi").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("lo") > F.col("edge") + 1, F.lit(True))).cast("int")).over(by_text)
    runs = later.withColumn("edge", edge).withColumn("island", island).groupBy("id", "h", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("islands"))


def _rest(lines: Column, islands: Column) -> Column:
    """The lines outside the islands, by slices between them."""
    end = F.size(islands)
    gaps = F.transform(
        F.sequence(F.lit(0), end),
        lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get(islands, k - 1)["hi"] + 1).alias("a"),
            F.when(k == end, F.size(lines)).otherwise(F.get(islands, k)["lo"]).alias("b"),
        ),
    )
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """df with the text without its repeated windows, and __lines and __removed, the numbers of lines before and removed.

    A row is known by its id and its text's hash: rows that agree in both share their fate, and the first
    occurrence among them stays in each. Null ids come first in order. Null texts and texts with fewer
    than three lines with a word have no window and stay as they are; a text may become empty.
    """
    named = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    text = F.col(at[text_col])
    keyed = named.withColumn("id", F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))).withColumn("h", F.xxhash64(text)).withColumn("order_id", F.col(at[id_col]))
    lines = F.split(text, "\n")
    islands = covered(keyed.where(text.isNotNull()).select(F.struct(F.col("order_id"), F.col("id")).alias("id"), "h", lines.alias("lines")), size)
    islands = islands.select(F.col("id.id").alias("id"), "h", "islands")
    out = keyed.join(islands, ["id", "h"], "left").withColumn("lines", lines)
    gone = F.aggregate("islands", F.lit(0), lambda n, r: n + r["hi"] - r["lo"] + 1)
    new = F.when(F.col("islands").isNull(), text).otherwise(F.array_join(_rest(F.col("lines"), F.col("islands")), "\n"))
    cols = [(new if c == text_col else F.col(at[c])).alias(c) for c in df.columns]
    return out.select(*cols, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("__lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("__removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines")).cast("long").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


OP5_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM d WHERE text IS NOT NULL),
f AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT a.doc_id, a.i AS lo, c.i AS hi, a.x AS x1, b.x AS x2, c.x AS x3
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN f c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, lo) AS nth FROM w),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON l.doc_id = r.doc_id AND l.i BETWEEN r.lo AND r.hi WHERE r.nth > 1),
k AS (SELECT l.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed,
             coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
