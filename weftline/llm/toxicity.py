"""Toxicity by weak supervision.

Voters look at whole texts: lexicons of words and of word beginnings, mined from labelled rows, vote for toxicity; a lexicon
of clean words and the lack of any hit vote against; patterns vote for it: words of the lexicon in disguise, stretched or
repeated, and shouting. A generative label model has, for each class, every voter's chances of its votes given the vote
of the voter it hangs on most (a tree of correlations by conditional mutual information); expectation-maximisation fits
it to the votes alone. An abstention says nothing of the class: most toxic texts have a few words of the lexicon only,
and a model that expects all voters to speak would call such texts clean. A linear classifier over the lexicons and patterns is trained on the posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, release, table, text_slices

#: Labelled rows the model is fitted on at most, chosen by a hash of the id; the least support of a word.
ROWS, SUPPORT = 20_000, 3
#: Voters that each of the mined lexicons (words, beginnings) is dealt into.
LEXICONS = 6
PATTERNS = ("p:disguise", "p:stretch", "p:repeat", "p:shout")
#: A word is clean if its rows are toxic at most this share as often as all rows.
CLEAN = 0.25
#: Share of toxic rows among a word's rows (0.3 more counted against it) with which it enters a lexicon.
PRECISION = 0.95
#: Steps of the classifier's descent.
STEPS = 2000
#: Lengths of word beginnings.
STEMS = (4, 5)
#: Letters that digits and signs stand for in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
_CACHE = 300_000


SHOUT = re.compile(r"[A-Z]{4,}(?:\W+[A-Z]{4,}){2}|!{3}")


def forms(token: str) -> list[str]:
    """Features of a lower-case token: w:, the bare word, and what it reads as if disguised or stretched; b:, its beginnings; d: and s:, those readings."""
    w = token.strip("\"'`.,;:!?()[]{}<>«»„“”…-–—*#%&|/\\~^=+")
    if not w:
        return []
    out = [f"w:{w}"]
    out += [f"b:{w[:k]}" for k in STEMS if len(w) > k and w[:k].isalpha()]
    if not w.isalpha():
        d = "".join(c for c in w.translate(DISGUISE) if c.isalpha())
        if d and d != w:
            out += [f"w:{d}", f"d:{d}"]
    elif any(a == b == c for a, b, c in zip(w, w[1:], w[2:], strict=False)):  # looooser
        x = "".join(c for i, c in enumerate(w) if not i or c != w[i - 1])
        out += [f"w:{x}", f"s:{x}"]
    return out


def _features(text: str | None) -> set[str]:
    if not text:
        return set()
    n = Counter(text.lower().split())
    out = {f for t in n for f in forms(t)}
    out |= {"r:" + f[2:] for t, k in n.items() if k > 1 for f in forms(t)[:1]}
    if SHOUT.search(text):
        out.add("p:shout")
    return out


def voted(features: Iterable[str], words: frozenset[str] | dict) -> list[str]:
    """Of a text's or a token's features, those of the lexicon, and the patterns that these features are of."""
    kinds = {"d": "p:disguise", "s": "p:stretch", "r": "p:repeat"}
    return [f if f[0] in "wbc" else kinds.get(f[0], f) for f in features if f in words or f[0] == "p" or f[0] in kinds and "w:" + f[2:] in words]


def _logs(table: np.ndarray) -> np.ndarray:
    return np.log(table / table.sum(-1, keepdims=True))


class LabelModel:
    """Chances of votes (1, -1, 0 to abstain) in two classes; in each, a voter's depend on its parent's vote.

    parent[j] is -1 for a voter that hangs on none; `alone` are voters that others must not hang on, nor they on others.
    """

    def __init__(self, prior: float, alone: tuple[int, ...] = ()):
        self.prior, self.alone = prior, alone
        self.parent: np.ndarray = np.zeros(0, int)
        self.tables = np.zeros((2, 0, 3, 3))  # class, voter, parent's vote + 1, vote + 1: logarithms

    def tree(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Each voter's parent in the tree of most mutual information within the classes."""
        k = votes.shape[1]
        hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float).reshape(len(votes), -1)
        info = np.zeros((k, k))
        for w in (1 - p, p):
            joint = ((hot * w[:, None]).T @ hot).reshape(k, 3, k, 3).transpose(0, 2, 1, 3) + 1e-9
            total = joint.sum((2, 3), keepdims=True)
            q = joint / total
            a, b = q.sum(3, keepdims=True), q.sum(2, keepdims=True)
            info += (q * np.log(q / (a * b))).sum((2, 3)) * total[..., 0, 0] / max(1, len(votes))
        parent, seen = np.full(k, -1), np.zeros(k, bool)
        free = [j for j in range(k) if j not in self.alone]
        info[list(self.alone)] = info[:, list(self.alone)] = -2
        seen[free[:1]] = True
        for _ in free[1:]:
            best = np.where(seen[:, None] & ~seen[None, :], info, -1)
            i, j = np.unravel_index(best.argmax(), best.shape)
            parent[j], seen[j] = i, True
        return parent

    def update(self, votes: np.ndarray, p: np.ndarray, smooth: float = 0.1) -> None:
        """Tables of greatest likelihood given class chances p, with `smooth` rows added to each place."""
        k = votes.shape[1]
        self.tables = np.zeros((2, k, 3, 3))
        for j in range(k):
            up = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
            at = (up + 1) * 3 + votes[:, j] + 1
            for y, w in enumerate((1 - p, p)):
                self.tables[y, j] = _logs(np.bincount(at, w, 9).reshape(3, 3) + smooth)

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of class 1 from the votes cast, without its share; given the vote it hangs on, a vote never speaks against its own class."""
        out = np.zeros(len(votes))
        for j, i in enumerate(self.parent):
            up = votes[:, i] + 1 if i >= 0 else np.ones(len(votes), int)
            odds = self.tables[1, j][up, votes[:, j] + 1] - self.tables[0, j][up, votes[:, j] + 1]
            out += np.where(votes[:, j] > 0, np.maximum(odds, 0), np.where(votes[:, j] < 0, np.minimum(odds, 0), 0))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + self.evidence(votes), -30, 30)))

    def fit(self, votes: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Posteriors of class 1. Starts from the vote of any; the tree is drawn from the first rounds and then stays."""
        p = np.where((votes > 0).any(1), 0.95, 0.02)
        for r in range(rounds):
            if r < 3:
                self.parent = self.tree(votes, p)
            self.update(votes, p)
            new = self.posterior(votes)
            if r >= 3 and np.abs(new - p).max() < 1e-5:
                return new
            p = new
        return p


def ballots(rows: list[list[int]], names: list[str]) -> np.ndarray:
    """Votes of every voter on rows of feature numbers; features come with the most telling first. Voters that never vote are
    left out but for the last, which votes against where no lexicon does."""
    voter = np.full(len(names), -1)
    for j, c in enumerate("wb"):
        for r, i in enumerate(i for i, f in enumerate(names) if f[0] == c):
            voter[i] = j * LEXICONS + r % LEXICONS
    at = 2 * LEXICONS
    for k, f in enumerate(PATTERNS):
        if f in names:
            voter[names.index(f)] = at + k
    clean, none = at + len(PATTERNS), at + len(PATTERNS) + 1
    for i, f in enumerate(names):
        if f[0] == "c":
            voter[i] = clean
    votes = np.zeros((len(rows), none + 1), int)
    for r, fs in enumerate(rows):
        votes[r, voter[fs]] = 1
    votes[:, clean] *= -1
    votes[:, none] = -(votes[:, : 2 * LEXICONS] == 0).all(1).astype(int)
    some = (votes != 0).any(0)
    some[none] = True
    return votes[:, some]


def train_rows(rows: list[tuple[list[int], int]], names: list[str]) -> dict:
    """Weights by feature and a bias, from rows (feature numbers, label); labels give the share of class 1 alone."""
    y = np.array([t for _, t in rows], float)
    prior = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    votes = ballots([f for f, _ in rows], names)
    target = LabelModel(prior, (votes.shape[1] - 1,)).fit(votes) if len(rows) else np.zeros(0)
    # a linear classifier on the posteriors: one weight a feature, each present or not
    size = np.array([len(f) for f, _ in rows], int)
    col = np.array([i for f, _ in rows for i in f], int)
    row = np.repeat(np.arange(len(rows)), size)
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    gw, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(STEPS if len(rows) else 0):
        z = bias + np.bincount(row, w[col], len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(col, err[row], len(names)) / len(rows) + 2e-5 * w
        b = err.mean()
        gw += g * g
        gb += b * b
        w -= 0.3 * g / np.sqrt(gw)
        bias -= 0.3 * b / np.sqrt(gb)
    return {"weights": {n: float(x) for n, x in zip(names, w, strict=True)}, "bias": bias}


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from rows with a label, at most ROWS of them by a hash of their ids; an id with several labels is toxic if any says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = ROWS / max(1, known.count())
    u = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30)) / float(1 << 30)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(u < share).join(known.where(u < share), "id")
    src = src.select("toxic", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([sorted(_features(t)) for t in texts], pa.list_(pa.string()))], ["toxic", "features"])

    rows = materialize(src.mapInArrow(run, "toxic int, features array<string>"), "toxic")  # at most about ROWS of them
    n = rows.agg(F.count_if(F.expr("toxic = 1")).alias("t"), F.count_if(F.expr("toxic = 0")).alias("c")).first()
    counts = rows.select("toxic", F.explode("features").alias("f")).where(F.col("f").rlike("^[wb]:")).groupBy("f").agg(F.count_if(F.expr("toxic = 1")).alias("t"), F.count_if(F.expr("toxic = 0")).alias("c"))
    share_t = n["t"] / max(1, n["t"] + n["c"])
    # features whose share of toxic rows is above chance even as the best of all of them (a Chernoff bound, Bonferroni)
    counts = materialize(counts.where(F.col("t") + F.col("c") >= SUPPORT), "toxic-counts")
    total = counts.count()
    q = F.col("t") / (F.col("t") + F.col("c"))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    surprise = (F.col("t") + F.col("c")) * (part(q, F.lit(share_t)) + part(1 - q, F.lit(1 - share_t)))
    bad = (F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * (F.col("t") + F.col("c") + 0.3))
    good = F.col("f").startswith("w:") & (q <= CLEAN * share_t)
    chosen = counts.withColumns({"surprise": surprise, "bad": bad}).where((bad | good) & (F.col("surprise") > np.log(max(total, 2)).item()))
    top = chosen.orderBy(F.desc("surprise"), "f").collect() if 0 < share_t < 1 else []  # words of the sample's rows
    release(counts)
    names = [r["f"] if r["bad"] else "c" + r["f"][1:] for r in top] + list(PATTERNS)
    held = _only(rows, names)
    number = {f: i for i, f in enumerate(names)}
    data = sorted(([number[f] for f in r["f"]], r["toxic"]) for r in held.collect())
    release(rows)
    return train_rows(data, names)


def _only(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with none but the given features and the patterns, of about ROWS rows."""
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(voted(fs, wanted.value)) | {"c" + f[1:] for f in fs if "c" + f[1:] in wanted.value and f[0] == "w"}) for fs in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.list_(pa.string()))], ["toxic", "f"])

    return rows.mapInArrow(run, "toxic int, f array<string>")


def _of_token(token: str, weights: dict[str, float]) -> tuple[tuple[str, ...], bool]:
    """A token's weighted features, and whether its repetition counts."""
    fs = forms(token)
    own = {*voted(fs, weights), *("c" + f[1:] for f in fs if f[0] == "w" and "c" + f[1:] in weights)}
    return tuple(f for f in own if f in weights), bool(fs) and fs[0] in weights


def score(df: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and score: the classifier's probability for a whole text; a null text scores as an empty one, and
    a kept column named score gives way.

    Row by row: no shuffle, bounded memory; repeated rows get equal scores.
    """
    keep = [c for c in keep if c != "score"]
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = [src.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value["weights"], shared.value["bias"]
        cache: dict[str, tuple[tuple[str, ...], bool]] = {}
        for part, texts in text_slices(batches):
            if len(cache) > _CACHE:
                cache.clear()
            out = []
            for t in texts:
                found: set[str] = set()
                all_words = t.lower().split() if t else []
                for w in set(all_words):
                    hit = cache.get(w)
                    if hit is None:
                        hit = cache[w] = _of_token(w, weights)
                    if hit[0]:
                        found.update(hit[0])
                        if hit[1] and "p:repeat" not in found and all_words.count(w) > 1:
                            found.add("p:repeat")
                if t and SHOUT.search(t):
                    found.add("p:shout")
                found &= weights.keys()
                z = bias + sum(weights[f] for f in sorted(found))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), pa.array(out, pa.float64())], [*(f"k{i}" for i in range(len(keep))), "score"])

    out = src.mapInArrow(run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "score double"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
