"""Quality rules with risk-controlled thresholds.

Labelled documents are split by a hash of their ids. One part, pooled over strata, orders the cutoffs of all rules into a
path of ever stricter policies, the next step being the one that rejects the most bad documents for a good one. The
other part, the holdout, certifies: in each stratum the policies are tested along the path, and one stands only if the
exact (Clopper-Pearson) upper bound of the share of good documents that all its rules together reject stays below the
allowed risk. The path being fixed beforehand, the first failure ends it without further correction; the level is
divided over the strata (Bonferroni). So with probability 1 - DELTA no stratum loses more than RISK of its good documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table, text_slices

#: Rules: a share in 0..1 of the text that good text seldom has, and its cutoffs from loose to strict.
RULES = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
}
#: Share of a stratum's good documents that all rules together may reject, and the chance that a bound is wrong anywhere.
RISK, DELTA = 0.02, 0.05
#: Share of labelled rows that orders the path.
EXPLORE = 0.3

_SPACE, _SYMBOL = " \t\n\r\x0b\x0c", "#*$%&|<>"


def base_features(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        n, edge = Counter(windows), 0
        for i, w in enumerate(windows):
            if n[w] > 1:
                repeated += i + 3 - max(edge, i)
                edge = i + 3
    return len(words), chars, sum(map(text.count, _SYMBOL)), len(lines), len(lines) - len(set(lines)), repeated


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_features(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` as k0, k1, ... and the counts of base_features() for every row; no shuffle, bounded memory."""
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = [src.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            rows = list(zip(*map(base_features, texts), strict=True))
            cols = [part.column(f"k{i}") for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in rows]
            yield pa.RecordBatch.from_arrays(cols, [*(f"k{i}" for i in range(len(keep))), *_COUNTS])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), *(f"{c} long" for c in _COUNTS)])
    return src.mapInArrow(run, schema)


def upper_bound_holds(k: int, n: int, rate: float, level: float) -> bool:
    """Whether the exact one-sided upper bound at `level` for k of n lies at or below `rate`: P(Bin(n, rate) <= k) <= level.

    The sum goes down from its greatest term and ends where terms no longer count, so it is short however large k is.
    """
    if n == 0 or k >= n * rate:  # at or above its mean the chance is about a half or more
        return n > 0 and k < n and _lower_tail(k, n, rate) <= math.log(level)
    return _lower_tail(k, n, rate) <= math.log(level)


def _lower_tail(k: int, n: int, rate: float) -> float:
    """log P(Bin(n, rate) <= k)."""
    top = min(k, int((n + 1) * rate))  # the mode, or what of the tail is nearest to it
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
    peak, total = log(top), 0.0
    for step in (range(top, -1, -1), range(top + 1, k + 1)):
        for i in step:
            term = math.exp(log(i) - peak)
            total += term
            if term < 1e-18 * total:
                break
    return peak + math.log(total)


def _shares() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def _exceeded() -> dict[str, Column]:
    """How many of a rule's cutoffs a document's share exceeds."""
    return {r: sum((s > F.lit(c)).cast("int") for c in RULES[r]) for r, s in _shares().items()}


def order_policies(bins: list[tuple[int, tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """Policies from none to all cutoffs, one cutoff stricter each: how many cutoffs each rule (in order) has taken.

    bins: (quality, cutoffs exceeded by each rule, documents). A rule that has taken p cutoffs rejects documents that
    exceed more than len(grid) - p of them. Ties go to the rule named first.
    """
    sizes = [len(g) for g in RULES.values()]
    at = tuple(0 for _ in sizes)
    path = []
    left = list(bins)
    while at != tuple(sizes):
        gains = []
        for r, size in enumerate(sizes):
            if at[r] < size:
                hit = [0, 0]
                for q, b, n in left:
                    if b[r] >= size - at[r]:
                        hit[q] += n
                gains.append(((hit[0] + 0.5) / (hit[1] + 0.5), -r))
        r = -max(gains)[1]
        at = (*at[:r], at[r] + 1, *at[r + 1 :])
        path.append(at)
        left = [x for x in left if x[1][r] < sizes[r] - at[r] + 1]
    return path


def _step(path: list[tuple[int, ...]]) -> Column:
    """The first policy of the path, by number, that rejects a document; len(path) for none."""
    first = []
    for r, (rule, grid) in enumerate(RULES.items()):
        when = [next(k for k, p in enumerate(path) if p[r] == t + 1) for t in range(len(grid))]  # by cutoffs taken
        over = _exceeded()[rule]
        first.append(F.coalesce(F.get(F.array(*map(F.lit, when)), F.lit(len(grid)) - over), F.lit(len(path))))
    return F.least(*first)


def calibrate(features: DataFrame, labels: DataFrame, stratum: str, id_col: str, risk: float = RISK, delta: float = DELTA) -> tuple[list[tuple[int, ...]], dict[str, int]]:
    """The path of policies, and for each stratum how many of its steps stand; a stratum that is not there rejects nothing.

    Labelled rows past the base rules only: an id with several labels counts as good if any says so, null labels count
    for nothing. To the driver come counts by exceeded cutoffs, whose number the grids bound, and a row for each
    stratum with good documents enough for any certificate.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").cast("int").alias("__q"))
    rows = features.where(~base_failed()).join(known, F.col(id_col) == F.col("__id"))
    explore = F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1000)) < int(1000 * EXPLORE)
    bins = rows.where(explore).select("__q", *[c.alias(r) for r, c in _exceeded().items()]).groupBy("__q", *RULES).count().collect()
    path = order_policies([(int(b["__q"] > 0), tuple(b[r] for r in RULES), b["count"]) for b in sorted(bins, key=str)])
    good = rows.where(~explore & (F.col("__q") == 1) & F.col(stratum).isNotNull()).select(F.col(stratum).alias("__s"), _step(path).alias("step"))
    table_ = materialize(good.groupBy("__s").agg(F.count("*").alias("n"), *[F.count_if(F.col("step") <= k).alias(f"k{k}") for k in range(len(path))]), "strata")
    level = delta / max(1, table_.count())
    least = math.ceil(math.log(level) / math.log1p(-risk))  # with fewer not even a policy that rejects none stands
    out = {}
    for r in table_.where(F.col("n") >= least).collect():
        stands = 0
        while stands < len(path) and upper_bound_holds(r[f"k{stands}"], r["n"], risk, level):
            stands += 1
        out[r["__s"]] = stands
    release(table_)
    return path, out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdicts(df: DataFrame, labels: DataFrame, keep: list[str], id_col: str, stratum: str, text_col: str) -> DataFrame:
    """with_features() of every row, base_failed and kept."""
    features = materialize(with_features(df, keep, text_col), "quality")
    of = f"k{keep.index(stratum)}"
    own_id = features.withColumn(id_col, F.col(f"k{keep.index(id_col)}"))
    path, stands = calibrate(own_id, labels.select(id_col, "quality"), of, id_col)
    allowed = F.lit(0)
    if stands:
        allowed = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(stands.items()) for x in kv])[F.col(of)], F.lit(0))
    return features.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (_step(path) >= allowed))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """Counts, base_failed and kept of every row.

    A row is kept if it doesn't fail the base rules and no share exceeds a cutoff that stands in its stratum. Where no
    bound can stand, in strata of few labels and for null strata, only the base rules reject. A null or empty text has no
    words and fails; rows with equal ids stay apart; an empty table gives an empty one.
    """
    out = verdicts(df, labels, [id_col, stratum], id_col, stratum, text_col)
    return out.withColumnsRenamed({"k0": id_col, "k1": stratum})


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows that judge() keeps, with all their own columns."""
    out = verdicts(df, labels, df.columns, id_col, stratum, text_col)
    return out.where("kept").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

