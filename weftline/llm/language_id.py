"""Language of code-switched text by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, character n-grams, and whether it stands in a language's lexicon;
transitions are learned. Forward-backward gives each word's marginals over whole texts, exactly: texts are cut into
blocks, blocks become products of transition matrices in lock step, vectors at their edges follow, then the words.
A run of letters too long for a word, as in scripts without blanks, is cut into units that are all labelled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_slices

#: The model is fitted on at most DOCS documents, an equal number of each language and at most DOCS_A_LANG, chosen by a hash
#: of their ids, and of each on SPANS runs of SPAN words spread over the whole text.
DOCS, DOCS_A_LANG, SPANS, SPAN = 12_000, 250, 4, 16
#: A word of more characters than LONGEST is cut into units of UNIT characters, the rest last.
LONGEST, UNIT = 24, 12
FEATURES = 1 << 15  # hashed ones; each language's lexicon has one more
#: A lexicon has the words seen at least so often with at least that share in one language.
LEXICON_MIN, LEXICON_SHARE = 3, 0.9
EPOCHS, BATCH, RATE = 5, 64, 0.2
#: Words of a block; words of a text that are held at once (a longer text goes through in slabs, twice).
BLOCK, SLAB = 128, 1 << 16
_CACHE = 500_000


def units(word: str) -> list[str]:
    return [word[k : k + UNIT] for k in range(0, len(word), UNIT)] if len(word) > LONGEST else [word]


def bare(word: str) -> str:
    """A lower-case word without what stands around its letters; empty if it has no letter."""
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


class _FeatureIds(dict):
    """Hashed numbers of feature strings; the commonest few hundred thousand are remembered."""

    def __missing__(self, f: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        i = self[f] = xxhash.xxh32_intdigest(f) % FEATURES
        return i


_IDS = _FeatureIds()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a bare word; none for the empty word."""
    if not word:
        return []
    w = f"<{word}>"
    own = ["p" + w[:2], "p" + w[:3], "p" + w[:4], "s" + w[-2:], "s" + w[-3:], "s" + w[-4:], *map("".join, zip(w, w[1:], w[2:], strict=False)), *map("".join, zip(w, w[1:], strict=False)), *w]
    ids = list(map(_IDS.__getitem__, dict.fromkeys(own)))
    if word in lexicon:
        ids.append(FEATURES + lexicon[word])
    return ids


def _padded(words: list[str], lexicon: dict[str, int], none: int) -> np.ndarray:
    """Feature ids of words, one row each, filled up with `none`."""
    rows = [features(w, lexicon) for w in words]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), max(1, size.max(initial=0))), none, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.fromiter(chain.from_iterable(rows), np.int64, int(size.sum()))
    return out


def emissions(words: list[str], model: dict) -> np.ndarray:
    """The sum of the weights of each word's features."""
    rows = [features(w, model["lexicon"]) for w in words]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(size.sum()))
        out[some] = np.add.reduceat(model["weights"][flat], (np.cumsum(size) - size)[some], axis=0)
    return out


def train(spans: list[tuple[str, list[str]]], seed: int = 11) -> dict:
    """Fit the field on (language, words) runs; runs are joined in random order, so that languages switch inside sequences."""
    langs = sorted({x for x, _ in spans})
    index = {x: i for i, x in enumerate(langs)}
    seen: dict[str, Counter] = {}
    for x, words in spans:
        for w in words:
            seen.setdefault(bare(w), Counter())[index[x]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if w and sum(c.values()) >= LEXICON_MIN and c.most_common(1)[0][1] >= LEXICON_SHARE * sum(c.values())}
    rng = np.random.default_rng(seed)
    none = FEATURES + len(langs)  # the feature of free places, without weight
    weights = np.zeros((none + 1, len(langs)))
    trans = np.zeros((len(langs), len(langs)))
    grads = np.full(weights.shape, 1e-6), np.full(trans.shape, 1e-6)
    vocabulary = sorted(seen)
    number = {w: i for i, w in enumerate(vocabulary)}
    table_ = _padded(vocabulary, lexicon, none)
    runs = [(index[x], np.array([number[bare(w)] for w in words])) for x, words in spans if words]
    for _ in range(EPOCHS if len(langs) > 1 else 0):
        order = rng.permutation(len(runs))
        parts = np.split(order, np.cumsum(rng.integers(1, 5, len(order)))[:-1].clip(max=len(order)))
        seqs = [(np.concatenate([runs[k][1] for k in p]), np.concatenate([np.full(len(runs[k][1]), runs[k][0]) for k in p])) for p in parts if len(p)]
        for lo in range(0, len(seqs), BATCH):
            batch = seqs[lo : lo + BATCH]
            t = max(len(w) for w, _ in batch)
            words, gold = np.zeros((len(batch), t), np.int64), np.full((len(batch), t), -1)
            for i, (w, y) in enumerate(batch):
                words[i, : len(w)], gold[i, : len(w)] = w, y
            here = gold >= 0
            feats = table_[words]
            emit = np.where(here[..., None], weights[feats].sum(2), 0.0)
            marginal, pairs = _forward_backward(emit, trans, here)
            err = marginal
            i, j = np.nonzero(here)
            err[i, j, gold[i, j]] -= 1
            g_w = np.stack([np.bincount(feats[i, j].ravel(), np.repeat(err[i, j, k], feats.shape[2]), none + 1) for k in range(len(langs))], 1) / len(batch)
            g_w[none] = 0
            g_w += 1e-4 * weights * (g_w != 0)
            true = np.zeros_like(trans)
            both = here[:, 1:]
            np.add.at(true, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            g_t = (pairs - true) / len(batch)
            for w, g, s in ((weights, g_w, grads[0]), (trans, g_t, grads[1])):
                s += g * g
                w -= RATE * g / np.sqrt(s)
    weights[none] = 0
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": trans, "lexicon": lexicon}


def _forward_backward(emit: np.ndarray, trans: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected counts of transitions, of padded sequences."""
    b, t, n = emit.shape
    a, e = np.exp(trans), np.exp(emit - emit.max(2, keepdims=True))
    f, g = np.empty_like(e), np.empty_like(e)
    now = np.ones((b, n))
    for i in range(t):
        new = (now @ a if i else now) * e[:, i]
        now = np.where(here[:, i, None], new / new.sum(1, keepdims=True), now)
        f[:, i] = now
    back = np.ones((b, n))
    pairs = np.zeros_like(trans)
    for i in range(t - 1, -1, -1):
        g[:, i] = back
        if i:
            x = e[:, i] * back
            joint = f[:, i - 1, :, None] * a * x[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[here[:, i]].sum(0)
            new = x @ a.T
            back = np.where(here[:, i, None], new / new.sum(1, keepdims=True), back)
    m = f * g
    return m / m.sum(2, keepdims=True), pairs


class Tagger:
    """Marginals of whole texts with a trained field; one of a Python worker."""

    def __init__(self, model: dict):
        self.m = model
        self.n = len(model["langs"])
        self.a = np.exp(model["trans"] - model["trans"].max(initial=0))
        self.cache: dict[str, int] = {}
        self.runs: list[np.ndarray] = []
        self.emit = np.ones((0, self.n), np.float32)
        self.real = np.zeros(0, bool)

    def _learn(self, words: set[str]) -> None:
        """Numbers of words; a word of several units has a negative one, which leads to the numbers of these."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
            self.runs.clear()
            self.emit, self.real = self.emit[:0], self.real[:0]
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        long = [w for w in new if len(w) > LONGEST]
        if long:
            cut = {w: units(w) for w in long}
            self._learn({u for us in cut.values() for u in us})
            for w, us in cut.items():
                self.cache[w] = -1 - len(self.runs)
                self.runs.append(np.fromiter(map(self.cache.__getitem__, us), np.int64, len(us)))
            new = [w for w in new if len(w) <= LONGEST and w not in self.cache]
        plain = [bare(w) for w in new]
        score = np.concatenate([emissions(plain[lo : lo + 4000], self.m) for lo in range(0, len(plain), 4000)] or [np.zeros((0, self.n), np.float32)])
        self.cache.update(zip(new, range(len(self.emit), len(self.emit) + len(new)), strict=True))
        self.emit = np.concatenate([self.emit, np.maximum(np.exp(score - score.max(1, keepdims=True)), 1e-12)])
        self.real = np.concatenate([self.real, np.fromiter(map(bool, plain), bool, len(plain))])

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Mean marginals of each text's words with letters; zeros where there are none."""
        out = np.zeros((len(texts), self.n))
        if not self.n:
            return out
        split = [t.lower().split() if t else [] for t in texts]
        self._learn({w for t in split for w in t})
        size = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        del split
        far = np.flatnonzero(ids < 0)
        if len(far):
            runs = [self.runs[-1 - i] for i in ids[far]]
            np.add.at(size, np.searchsorted(np.cumsum(size), far, side="right"), [len(r) - 1 for r in runs])
            parts, at = [], 0
            for i, r in zip(far.tolist(), runs, strict=True):
                parts += [ids[at:i], r]
                at = i + 1
            ids = np.concatenate([*parts, ids[at:]])
        ends = np.cumsum(size)
        short = size <= SLAB
        out[short] = self._votes(ids[np.repeat(short, size)], size[short])
        for k in np.flatnonzero(~short):
            out[k] = self._long(ids[ends[k] - size[k] : ends[k]])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Votes of a long text by slabs: their products first, vectors at their edges, then each with these."""
        slabs = [ids[lo : lo + SLAB] for lo in range(0, len(ids), SLAB)]
        one = np.ones(self.n)
        enter, leave, whole = [one], [one], []
        for k, x in enumerate(slabs):
            total = np.eye(self.n)
            e, here, *_ = self._grid(x, np.array([len(x)]))
            for p in self._products(e, here, np.zeros(int(k == 0), int)):
                total = total @ p
                total /= total.max()
            whole.append(total)
        for p in whole[:-1]:
            v = enter[-1] @ p
            enter.append(v / v.sum())
        for p in whole[:0:-1]:
            v = p @ leave[-1]
            leave.append(v / v.sum())
        edges = zip(slabs, enter, reversed(leave), strict=True)
        return sum(self._votes(x, np.array([len(x)]), (a, b, k == 0))[0] for k, (x, a, b) in enumerate(edges))

    def _grid(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words in rows of BLOCK: their emissions, which places hold one, which a real one; each text's first row and rows. No text is empty."""
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        words = np.full((int(blocks.sum()), BLOCK), -1)
        words[np.repeat(first, size) + place // BLOCK, place % BLOCK] = ids
        here = words >= 0
        return np.where(here[..., None], self.emit[words], 1).astype(np.float64), here, here & self.real[words], first, blocks

    def _products(self, e: np.ndarray, here: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of each row; start: rows that begin a text, whose first word no transition leads to."""
        prod = np.broadcast_to(np.eye(self.n), (len(e), self.n, self.n)).copy()
        for t in range(BLOCK):
            new = prod @ self.a
            if not t:
                new[start] = prod[start]
            new *= e[:, t, None, :]
            new /= new.max((1, 2), keepdims=True)
            prod = np.where(here[:, t, None, None], new, prod)
        return prod

    def _votes(self, ids: np.ndarray, size: np.ndarray, edges: tuple[np.ndarray | float, np.ndarray | float, bool] = (1.0, 1.0, True)) -> np.ndarray:
        """Sums of the marginals of each text's words with letters; edges: the vectors before and behind, and whether texts begin here."""
        out = np.zeros((len(size), self.n))
        who = np.flatnonzero(size)
        if not len(who):
            return out
        e, here, real, first, blocks = self._grid(ids, size[who])
        enter, leave = np.ones((len(e), self.n)), np.ones((len(e), self.n))
        enter[first], leave[first + blocks - 1] = edges[:2]
        start = first if edges[2] else first[:0]
        if blocks.max() > 1:
            prod = self._products(e, here, start)
        for k in range(1, int(blocks.max())):
            b = first[blocks > k] + k
            v = np.einsum("bi,bij->bj", enter[b - 1], prod[b - 1])
            enter[b] = v / v.sum(1, keepdims=True)
            b = (first + blocks)[blocks > k] - 1 - k
            v = np.einsum("bij,bj->bi", prod[b + 1], leave[b + 1])
            leave[b] = v / v.sum(1, keepdims=True)
        f = np.empty_like(e)
        for t in range(BLOCK):
            new = enter @ self.a
            if not t:
                new[start] = enter[start]
            new *= e[:, t]
            enter = np.where(here[:, t, None], new / new.sum(1, keepdims=True), enter)
            f[:, t] = enter
        for t in range(BLOCK - 1, -1, -1):
            f[:, t] *= leave
            new = (e[:, t] * leave) @ self.a.T
            leave = np.where(here[:, t, None], new / new.sum(1, keepdims=True), leave)
        f /= f.sum(2, keepdims=True)
        f[~real] = 0
        out[who] = np.add.reduceat(f.sum(1), first, axis=0)
        return out


def _spans(df: DataFrame) -> list[tuple[str, list[str]]]:
    """Runs of words of the rows (id, lang, text), in a fixed order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            runs = []
            for t in texts:
                w = [u for x in (t or "").lower().split() for u in units(x)]
                starts = sorted({round(k * max(0, len(w) - SPAN) / max(1, SPANS - 1)) for k in range(SPANS)})
                runs.append(["\n".join(w[s : s + SPAN]) for s in starts])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(runs, pa.list_(pa.string()))], ["id", "lang", "runs"])

    rows = df.mapInArrow(run, "id string, lang string, runs array<string>").collect()
    return [(r.lang, x.split("\n")) for r in sorted(rows, key=lambda r: (r.lang, r.id, r.runs)) for x in r.runs if x]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A field learned from rows with a language: a bounded sample by a hash of the id, its size following no table's."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null and id is not null")
    counts = src.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return train([])
    each = max(1, min(DOCS_A_LANG, DOCS // len(counts)))
    u = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], each / r["count"])])
    return train(_spans(src.where(u < share[F.col("lang")]).limit(2 * max(DOCS, len(counts)))))


def predict(df: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score, the mean marginal of that language over the text's words; kept columns of
    these two names give way.

    A null text, one without letters, and any text under a model of no language give `und` and 0. Equal shares
    go to the language first in code-point order. Row by row: no shuffle; beyond a text's words, memory is that of a
    slab; repeated rows stay.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = [src.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part, texts in text_slices(batches, most=2 << 20):
            share = tagger.shares(texts)
            best = share.argmax(1) if tagger.n else np.zeros(len(texts), int)
            top = share.max(1, initial=0)
            pred = [tagger.m["langs"][b] if s > 0 else "und" for b, s in zip(best, top, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(np.clip(top, 0, 1))], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    out = src.mapInArrow(run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "lang_pred string, score double"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
