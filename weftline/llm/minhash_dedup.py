"""MinHash near-dedup with bottom-k sketches of one hash function.

1. A text's set of word shingles is hashed once; texts with equal sets form a class, and only the row of its smallest id
   goes on. Classes that share an id are linked.
2. The k smallest hashes are its sketch. Inverted lists by retained value give overlaps: two sets of similarity
   0.8 share at least 22 of 48 values (all but about one pair in ten million), so of each sketch only
   the 48 - 22 + 1 values with the shortest lists are needed for any such pair to meet.
3. In rounds, each text meets a few pivots of one of its long lists, and links unite components. What then still
   lies in different components of any list is compared pair by pair, in the first list that both are in. A large
   group of near copies so costs a few rows a member, not all its pairs, and no list is capped.
4. Pairs are filtered where they arise by the parities and minima of the bins of their full sets, then by the overlap
   in the sketch of their union, and those left are verified on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, materialize, release, table, text_slices
from .components import connected_components

SIMILARITY = 80  # per cent
SKETCH = 48
#: Bins of the hash; of each the smallest value gives four bits, so that a pair can be judged from 32 bytes a text.
BINS = 64
#: Bins of which the parity of a set's count is kept: the bits that differ are at most the hashes that are in one of two sets.
PARITIES = 512
MINIMA = BINS // 16  # numbers
#: Chance that a filter loses a pair of just the asked similarity.
LOSS = 1e-7
WORDS = 5
#: Most pivots of a list in each round, fewer texts being left that they don't reach; texts that make a list worth them. Rounds
#: end where they link less than a share of the texts that they look at.
PIVOTS, LONG, GAIN = (4, 16, 32, 64, 128), 8, 0.002
#: Texts of a list that meet its pivots in one task, about; a longer list is dealt over more.
SHARE = 1000
_CACHE = 300_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, of_word: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, as signed numbers in the hash's own order."""
    w = text.encode().lower().split() if text else []  # bytes: A-Z only, and blanks are exactly \x20 and \x09-\x0D
    if not w:
        return np.empty(0, np.int64)
    if len(of_word) > _CACHE:
        of_word.clear()
    h = np.fromiter(map(of_word.__getitem__, w), np.uint64, len(w))
    if len(h) < words:
        s = np.full(1, len(h), np.uint64)
        for x in h:
            s = _mix(s) + x
    else:
        n = len(h) - words + 1
        s = np.full(n, words, np.uint64)
        for j in range(words):
            s = _mix(s) + h[j : j + n]
    return np.unique((_mix(s) ^ np.uint64(1 << 63)).view(np.int64))


def sure_hits(n: int, p: float) -> int:
    """The most hits that n trials of chance p have, but for a chance of LOSS."""
    tail = 0.0
    for k in range(n + 1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > LOSS:
            return k
    return n


def bin_minima(s: np.ndarray) -> np.ndarray:
    """Four bits of the smallest hash of each bin (0 for none), 16 bins a number."""
    x = s.view(np.uint64)
    which, at = np.unique(x & np.uint64(BINS - 1), return_index=True)
    bits = np.zeros(BINS, np.uint64)
    bits[which] = x[at] >> np.uint64(6) & np.uint64(15)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)


def bin_parities(s: np.ndarray) -> np.ndarray:
    """For each bin whether an odd number of hashes lies in it, 64 bins a number."""
    n = np.bincount((s.view(np.uint64) & np.uint64(PARITIES - 1)).view(np.int64), minlength=PARITIES)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def _sketches(src: DataFrame, words: int, k: int) -> DataFrame:
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for part, texts in text_slices(batches):
            sets = [shingle_set(t, words, cache) for t in texts]
            sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            low = [s[:k] for s in sets]
            ends = np.cumsum([len(x) for x in low], dtype=np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.concatenate(low) if low else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array([[*bin_minima(s).tolist(), *bin_parities(s).tolist()] for s in sets], pa.list_(pa.int64())), sketch], ["id", "h", "n", "sig", "m", "sketch"])

    return src.mapInArrow(run, f"id {kind}, h long, n int, sig binary, m array<long>, sketch array<long>")


def _sets(src: DataFrame, words: int) -> DataFrame:
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for part, texts in text_slices(batches):
            sets = [shingle_set(t, words, cache) for t in texts]
            ends = np.cumsum([len(x) for x in sets], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.concatenate(sets)))], ["id", "set"])

    return src.mapInArrow(run, f"id {kind}, set array<long>")


def _fits(x: str, y: str, similarity: int) -> Column:
    """Whether sizes, bin parities and bin minima of two rows allow the similarity; only the minima may err, and that by LOSS."""
    n1, n2 = F.col(f"{x}n"), F.col(f"{y}n")
    odd = F.lit(0)
    for j in range(MINIMA, MINIMA + PARITIES // 64):
        odd = odd + F.bit_count(F.col(f"{x}m{j}").bitwiseXOR(F.col(f"{y}m{j}")))
    same = F.lit(0)
    for j in range(MINIMA):
        z = F.col(f"{x}m{j}").bitwiseXOR(F.col(f"{y}m{j}"))
        for k in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        same = same + F.bit_count(F.bitwise_not(z).bitwiseAND(F.lit(0x1111111111111111)))
    p = similarity / 100
    near = (100 + similarity) * odd <= (100 - similarity) * (n1 + n2)
    return (100 * F.least(n1, n2) >= similarity * F.greatest(n1, n2)) & near & (same >= sure_hits(BINS, p + (1 - p) / 16))


def _needed(n: Column, k: int, shared: int, similarity: int) -> Column:
    """Values that sketches of n values have in common, at least, with those of any similar set."""
    whole = F.ceil(F.lit(similarity) * n / 100).cast("int")
    return F.when(n * 100 <= k * similarity, whole).otherwise(F.least(whole, F.lit(shared)))


def _union_sketch_passes(a: Column, b: Column, k: int, shared: int, similarity: int) -> Column:
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(low, a), b))
    return F.when(F.size(low) < k, 100 * both >= similarity * F.size(low)).otherwise(both >= shared)


def link_classes(reps: DataFrame, texts: DataFrame, versions: DataFrame, words: int, similarity: int, k: int) -> DataFrame:
    """(node, component) over classes (id, n, m, sketch, and doc and h of a row of theirs) that are linked at all.

    texts: (doc, h, text) of these rows and others; versions: (a, b), classes that are linked whatever their sets.
    """
    shared = sure_hits(k, similarity / 100)
    values = reps.select("id", "n", F.explode("sketch").alias("v"))
    long = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    met = values.join(long, "v")
    by_id = Window.partitionBy("id")
    size = F.least(F.col("n"), F.lit(k))
    spare = size - _needed(F.col("n"), k, shared, similarity) + 1 - (size - F.count("*").over(by_id))  # values in no other sketch come first
    lists = met.withColumn("spare", spare).withColumn("nth", F.row_number().over(by_id.orderBy("f", "v"))).where("nth <= spare").select("v", "id", "n", "f")
    own = [f"m{j}" for j in range(MINIMA + PARITIES // 64)]
    bins = reps.select("id", "n", *[F.col("m")[j].alias(c) for j, c in enumerate(own)])
    lists = materialize(lists, "lists")
    wanted = reps.select("id", "doc", "h").join(lists.select("id").distinct(), "id", "left_semi")
    # rows equal in id and text are the same set
    sets = materialize(_sets(texts.join(wanted, ["doc", "h"]).select("id", "text"), words).dropDuplicates(["id"]), "sets")
    sketches = reps.select("id", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, and their components ca, cb), those whose full sets are similar."""
        x = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("ka")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("kb")), "b")
        x = x.where(_union_sketch_passes(F.col("ka"), F.col("kb"), k, shared, similarity)).drop("ka", "kb")
        x = x.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return x.where(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("ca", "cb")

    # for each round, each id in one of its long lists: the same for near copies as a rule, and another one each round
    least = [F.min(F.struct(F.xxhash64(F.lit(turn), "v").alias("o"), "v", "f")).alias(f"h{turn}") for turn in range(len(PIVOTS))]
    homes = materialize(met.where(F.col("f") >= LONG).groupBy("id").agg(*least).join(bins, "id"), "homes")
    components = None if versions.isEmpty() else materialize(connected_components(versions), "components")

    def united(rows: DataFrame) -> DataFrame:
        if components is None:
            return rows.withColumn("c", F.col("id"))
        own_part = components.select(F.col("node").alias("id"), "component")
        return rows.join(own_part, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def link(pairs: DataFrame) -> int:
        """Unite the components of pairs that are similar: only those that a new link touches are gone through again."""
        nonlocal components
        new = materialize(verified(pairs.distinct()), "links")
        gain, old = new.count(), components
        if gain or old is None:
            merged = connected_components(new, "ca", "cb")
            if old is None:
                components = materialize(merged, "components")
            else:
                merged = materialize(merged, "merged")
                moved = old.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
                both = moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(merged.join(old.select("node"), "node", "left_anti"))
                components = materialize(both, "components")
                release(merged)
                release(old)
        release(new)
        drop_shuffles(lists.sparkSession)
        return gain

    for turn in range(len(PIVOTS)):
        star = materialize(united(homes.select("id", f"h{turn}.v", F.ceil(F.col(f"h{turn}.f") / SHARE).cast("int").alias("shares"), "n", *own)), "star")
        # a pivot is the least of its slot: partitions pass on one row a slot, and the slots of one list lie in several tasks
        order = F.xxhash64(F.lit(turn), "id")
        pivots = star.groupBy("v", F.pmod(order, F.lit(PIVOTS[turn])).alias("slot")).agg(F.min(F.struct(order.alias("o"), "id", "n", "c", *own)).alias("p"), F.max("shares").alias("shares"))
        pivots = pivots.select("v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "p")
        pairs = star.withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).join(pivots, ["v", "share"]).where((F.col("c") != F.col("p.c")) & _fits("", "p.", similarity))
        me, pivot = F.struct("id", "c"), F.struct("p.id", "p.c")
        ends = pairs.select(F.least(me, pivot).alias("x"), F.greatest(me, pivot).alias("y"))
        gain = link(ends.select(F.col("x.id").alias("a"), F.col("x.c").alias("ca"), F.col("y.id").alias("b"), F.col("y.c").alias("cb")))
        rows = star.count()
        release(star)
        if gain <= GAIN * rows:
            break
    # all pairs of a list that lie in different components yet; each in the first list that both are in
    rows = united(lists)
    split = rows.groupBy("v").agg((F.min("c") != F.max("c")).alias("split")).where("split").select("v")
    split = rows.join(split, "v", "left_semi").groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    todo = rows.drop("f", "n").join(split, "v").join(lists.groupBy("id").agg(F.collect_list("v").alias("vs")), "id").join(bins, "id")
    todo = materialize(todo.withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")), "open")
    # a long list is dealt into shares, and each two of them meet in a task of their own: (lower, higher) by share
    ends = F.col("shares") - 1
    x = todo.withColumns({"lo": F.col("share"), "hi": F.explode(F.sequence("share", ends))}).alias("x")
    y = todo.withColumns({"hi": F.col("share"), "lo": F.explode(F.sequence(F.lit(0), "share"))}).alias("y")
    cell = (F.col("x.v") == F.col("y.v")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.lo") != F.col("x.hi")) | (F.col("x.id") < F.col("y.id"))
    cross = cell & once & (F.col("x.c") != F.col("y.c")) & _fits("x.", "y.", similarity)
    cross = cross & (F.col("x.v") == F.array_min(F.array_intersect("x.vs", "y.vs")))
    me, other = F.struct(F.col("x.id").alias("id"), F.col("x.c").alias("c")), F.struct(F.col("y.id").alias("id"), F.col("y.c").alias("c"))
    ends = x.join(y, cross).select(F.least(me, other).alias("x"), F.greatest(me, other).alias("y"))
    link(ends.select(F.col("x.id").alias("a"), F.col("x.c").alias("ca"), F.col("y.id").alias("b"), F.col("y.c").alias("cb")))
    for used in (todo, sets, lists, homes):
        release(used)
    return components


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, k: int = SKETCH) -> DataFrame:
    """(id, h, n_shingles, component_id, kept) of every row; h is xxhash64 of its text.

    Rows are linked if 100 * intersection >= similarity * union of their shingle sets; component_id is the smallest id
    reachable. A text of fewer than `words` words is one shingle; a null text or one without words has none and
    links with nothing. Rows with null ids link with nothing either, keep a null component and are kept. Rows with
    equal ids are versions of one document: their links count for that id.
    """
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_sketches(src, words, k), "sketches")
    live = rows.where("n > 0 and id is not null")
    reps = live.groupBy("sig").agg(F.min(F.struct("id", "h", "n", "m", "sketch")).alias("r"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "sig", "r.*"), "classes")
    # a class goes by its own node, as versions of one id can lie in different classes; these are linked
    several = live.groupBy("id").agg(F.min("sig").alias("first"), F.max("sig").alias("last")).where("first < last").select("id", "first")
    versions = live.select("id", "sig").join(several, "id").where("sig > first").select("sig", "first").distinct()
    of_sig = reps.select("sig", "node")
    versions = versions.join(of_sig.withColumnRenamed("node", "a"), "sig").join(of_sig.select(F.col("sig").alias("first"), F.col("node").alias("b")), "first").select("a", "b")
    versions = materialize(versions, "versions")
    classes = reps.select(F.col("node").alias("id"), F.col("id").alias("doc"), "h", "n", "m", "sketch")
    components = link_classes(classes, src.withColumnRenamed("id", "doc"), versions, words, similarity, k)
    release(versions)
    least = components.join(reps.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    named = components.join(least, "component").select("node", "least")
    of_class = reps.join(named, "node", "left").select("sig", F.coalesce("least", "id").alias("component"))
    out = rows.join(of_class, "sig", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "h", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _ordered(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df's rows of one document for each group, with their own columns; of rows equal in id and text the first by their other columns stays."""
    names = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    keyed = names.withColumn("h", F.xxhash64(at[text_col])).withColumn("id", F.col(at[id_col]))
    verdict = near_duplicates(df, id_col, text_col, **how).where("kept and " + f"`{id_col}` is not null").select(F.col(id_col).alias("id"), "h").distinct()
    out = keyed.where("id is not null").join(verdict, ["id", "h"], "left_semi")
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id", "h").orderBy(*[F.col(c) for c, t in keyed.dtypes if c in at.values() and _ordered(t)], F.lit(1)))).where("nth = 1")
    out = out.select(*[F.col(c) for c in at.values()]).unionByName(keyed.where("id is null").select(*at.values()))
    return out.select(*[F.col(v).alias(c) for c, v in at.items()])


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
