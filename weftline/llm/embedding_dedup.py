"""Embedding near-dedup: a navigable small-world graph per shard, queries from every shard to every shard.

Equal vectors are one node with a count. Every shard has a graph, whatever its size, and every query goes through it; a beam
can lose links, so an exact check follows, of each query against all nodes that its beam did not give. Links are thus
the same for any size, number of shards or shape of a graph. They are verified in double precision. A pair of shards returns
counts and a spanning forest of its links, never the links themselves, and the forests are united. Of two shards the first
one's vectors are the queries of the second one's graph, and what is found counts for both.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table
from .components import connected_components
from .hnsw import Graph

COSINE = 0.95
#: Shards at least, and the bytes of a shard's vectors in double precision: a task holds two shards and one's links.
SHARDS, SHARD_BYTES = 8, 96 << 20
#: Places of a beam, queries at once.
BEAM, CHUNK = 24, 256
#: Similarities that a check holds at once.
CELLS = 16 << 20
#: Links that the gauge of a graph plants: with none missed, recall of such links is 99.9 % at least, at 98 % confidence.
PLANTED = 4096
#: Nodes that are checked in the time of one place in a beam (measured: 6 ns a node, 10 us a place). Nothing is decided by it.
WORTH = 1600
_SLACK = 1e-4  # single precision finds candidates, double precision decides


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    u = _unit(np.stack(pdf["embedding"].to_numpy()))
    g = Graph.build(u)
    f = io.BytesIO()
    np.savez(f, u=u, ids=pdf["node"].to_numpy(np.int64), many=pdf["many"].to_numpy(np.int64))
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "vectors": [f.getvalue()], "links": [g.dump()]})


def _finds_planted(g: Graph, ef: int, least: float) -> bool:
    """Whether beams find random nodes from queries that lie in random directions at just the asked similarity: a gauge, the check needs none."""
    rng = np.random.default_rng(ef)
    for _ in range(0, PLANTED, CHUNK):
        who = rng.integers(0, len(g.x), CHUNK)
        v = g.x[who]
        away = rng.normal(size=v.shape).astype(np.float32)
        away -= (away * v).sum(1, keepdims=True) * v
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), np.float32(1e-9))
        ids, sims = g.search((least * v + np.sqrt(1 - least * least) * away).astype(np.float32), ef)
        if not ((ids == who[:, None]).any(1) | (sims >= least).all(1)).all():
            return False
    return True


def candidates(g: Graph, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of similarity `least` or more, each once: those that beams find, then those that they missed."""
    step = max(1, CELLS // max(1, len(g.x)))
    for lo in range(0, len(q), CHUNK):
        part = q[lo : lo + CHUNK]
        ids, sims = g.search(part, BEAM)
        hit = sims >= least
        r, c = np.nonzero(hit)
        yield r + lo, ids[r, c]
        for at in range(0, len(part), step):
            missed = part[at : at + step] @ g.x.T >= least
            r, c = np.nonzero(hit[at : at + step])
            missed[r, ids[at + r, c]] = False
            a, b = np.nonzero(missed)
            yield a + at + lo, b


def _root(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents after uniting a[i] with b[i]; each parent is the smallest node of its tree."""
    while True:
        x, y = parent[a], parent[b]
        high, low = np.maximum(x, y), np.minimum(x, y)
        if (high == low).all():
            return parent
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def link_pair(queries: bytes, vectors: bytes, links: bytes, same: bool, cosine: float) -> pd.DataFrame:
    """What two shards link: counts by node, and a spanning forest."""
    a, b = (dict(np.load(io.BytesIO(raw))) for raw in (queries, vectors))
    g = Graph.load(links, b["u"])
    n, m = len(a["u"]), len(b["u"])
    count = np.zeros(n if same else n + m)
    parent = np.arange(len(count))
    for q, x in candidates(g, a["u"].astype(np.float32), cosine - _SLACK):
        for lo in range(0, len(q), 200_000):
            i, j = q[lo : lo + 200_000], x[lo : lo + 200_000]
            ok = np.einsum("ij,ij->i", a["u"][i], b["u"][j]) >= cosine
            if same:
                ok &= i != j
            i, j = i[ok], j[ok]
            if len(i):
                count[:n] += np.bincount(i, weights=b["many"][j], minlength=n)
                if not same:
                    count[n:] += np.bincount(j, weights=a["many"][i], minlength=m)
                parent = _root(parent, i, j if same else j + n)
    ids = a["ids"] if same else np.append(a["ids"], b["ids"])
    tree = np.flatnonzero(parent != np.arange(len(parent)))
    some = np.flatnonzero(count)
    return pd.DataFrame({"node": np.append(ids[tree], ids[some]), "other": pd.array([*ids[parent[tree]].tolist(), *[None] * len(some)], "Int64"), "links": np.append(np.zeros(len(tree), np.int64), count[some].astype(np.int64))})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, shards: int = SHARDS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link if the cosine of their vectors, in double precision, is at least `cosine`; rows of different lengths
    don't. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are components
    of their own; so are rows with null ids, which are kept. Equal vectors link with each other. Repeated rows
    count as vectors of their own, and so do rows of one id with different vectors; ids are whole numbers.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    src = src.withColumn("fit", F.coalesce(fit, F.lit(False)))
    nodes = src.where("fit").groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("many"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "id", "many", "embedding"), "vectors")
    size = nodes.agg(F.sum("dim")).first()[0] or 0
    s = max(shards, -(-8 * size // SHARD_BYTES))
    keyed = nodes.select("dim", F.pmod(F.xxhash64("node"), F.lit(s)).cast("int").alias("shard"), "node", "many", "embedding")
    graphs = materialize(keyed.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, vectors binary, links binary"), "graphs")
    left = graphs.select("dim", F.col("shard").alias("i"), F.explode(F.sequence("shard", F.lit(s - 1))).alias("j"), F.col("vectors").alias("queries")).repartition(s * (s + 1) // 2, "dim", "i", "j")
    right = graphs.select("dim", F.explode(F.sequence(F.lit(0), "shard")).alias("i"), F.col("shard").alias("j"), "vectors", "links").repartition(s * (s + 1) // 2, "dim", "i", "j")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield link_pair(r.queries, r.vectors, r.links, r.i == r.j, cosine)

    found = left.hint("shuffle_hash").join(right, ["dim", "i", "j"]).mapInPandas(run, "node long, other long, links long")
    found = materialize(found, "found")
    release(graphs)
    components = connected_components(found.where("other is not null"), "node", "other")
    least = components.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    per_node = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(components.join(least, "component").select("node", "least"), "node", "left")
    per_node = per_node.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("least", "id").alias("component"))
    # each vector has one row on the right; where a vector is very common the left side's partition can be split
    rows = src.withColumn("key", F.when(F.col("fit"), F.col("embedding"))).drop("embedding")
    out = rows.join(per_node.withColumnRenamed("embedding", "key").hint("merge"), "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE (SELECT bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0) FROM unnest(embedding) AS t(x))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
