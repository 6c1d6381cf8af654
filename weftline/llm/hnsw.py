"""A hierarchical navigable small-world graph in numpy; searches go in lock step over many queries.

Vectors are unit vectors. Nodes enter in batches: a batch searches the graph so far, compares its own members
directly, and is then linked, so that near copies within a batch find each other too.
"""

from __future__ import annotations

import io

import numpy as np

M, M0, EF_BUILD, BATCH, AT_ONCE = 12, 24, 48, 256, 4


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if ids.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    return ids, sims


class Graph:
    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float32)
        self.rows: list[np.ndarray] = []  # of each layer: a node's row, or -1
        self.links: list[np.ndarray] = []  # of each layer: neighbours of its nodes, -1 for none
        self.entry = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        g = cls(vectors)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
        level[:1] = level.max(initial=0)
        for k in range(level.max(initial=0) + 1):
            who = np.flatnonzero(level >= k)
            row = np.full(n, -1, np.int32)
            row[who] = np.arange(len(who))
            g.rows.append(row)
            g.links.append(np.full((len(who), M if k else M0), -1, np.int32))
        at = 0
        while at < n:
            size = min(BATCH, max(16, at // 2), n - at)
            g._insert(np.arange(at, at + size), level)
            at += size
        return g

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        at = np.full(len(new), self.entry)
        for k in range(len(self.links) - 1, -1, -1):
            here = level[new] >= k
            ids, sims = np.empty((len(new), 0), np.int64), np.empty((len(new), 0), np.float32)
            if new[0] > 0:
                ids, sims = self.search_layer(q, at, k, EF_BUILD if here.any() else 1)
                at = ids[np.arange(len(ids)), sims.argmax(1)]
            if not here.any():
                continue
            among = np.where(here[None, :] & here[:, None], own, np.float32(-2))
            a, b = _top(np.broadcast_to(new, among.shape), among, min(EF_BUILD // 2, len(new)))
            cand, s = np.hstack([ids, a])[here], np.hstack([sims, b])[here]
            cand = np.where(s > -1.5, cand, -1)
            chosen = self._select(cand, s, self.links[k].shape[1] // 2 if k == 0 else self.links[k].shape[1])
            who = new[here]
            self.links[k][self.rows[k][who], : chosen.shape[1]] = chosen
            src, col = np.nonzero(chosen >= 0)
            self._link_back(k, chosen[src, col], who[src])

    def _select(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, those nearer to the node than to any chosen before; free places go to the nearest others."""
        order = np.argsort(-np.where(cand >= 0, sims, -9), axis=1, kind="stable")[:, : 2 * EF_BUILD]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(cand), most), -1, np.int64)
        for lo in range(0, len(cand), BATCH):
            c, s = cand[lo : lo + BATCH], sims[lo : lo + BATCH]
            v = self.x[np.maximum(c, 0)]
            near = np.matmul(v, v.transpose(0, 2, 1))
            best = np.full(c.shape, -9, np.float32)
            take = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                ok = (c[:, j] >= 0) & (best[:, j] < s[:, j]) & (take.sum(1) < most)
                take[:, j] = ok
                best = np.where(ok[:, None], np.maximum(best, near[:, j]), best)
            rank = np.where(c < 0, 9e9, np.where(take, 0, 1e6) + np.arange(c.shape[1]))
            at = np.argsort(rank, axis=1, kind="stable")[:, :most]
            out[lo : lo + BATCH, : at.shape[1]] = np.take_along_axis(c, at, 1)
        return out

    def _link_back(self, k: int, target: np.ndarray, source: np.ndarray) -> None:
        links, most = self.links[k], self.links[k].shape[1]
        sim = np.einsum("ij,ij->i", self.x[target], self.x[source])
        order = np.lexsort((-sim, target))
        target, source, sim = target[order], source[order], sim[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, count)
        keep = nth < most
        more = np.full((len(who), most), -1, np.int64)
        more[np.repeat(np.arange(len(who)), count)[keep], nth[keep]] = source[keep]
        old = links[self.rows[k][who]]
        both = np.hstack([old, more])
        both = np.where(both == who[:, None], -1, both)
        s = np.einsum("tcd,td->tc", self.x[np.maximum(both, 0)], self.x[who])
        # a neighbour from both sides stands once
        ordered = np.argsort(both, axis=1, kind="stable")
        srt = np.take_along_axis(both, ordered, 1)
        again = np.zeros(both.shape, bool)
        np.put_along_axis(again, ordered, np.hstack([np.zeros((len(who), 1), bool), srt[:, 1:] == srt[:, :-1]]), 1)
        both = np.where(again, -1, both)
        links[self.rows[k][who]] = self._select(both, s, most)

    def search_layer(self, q: np.ndarray, at: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ef nearest nodes of a layer for each query, -1 and -2 where there are fewer."""
        n, links, rows = len(self.x), self.links[k], self.rows[k]
        beam = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -2, np.float32)
        beam[:, 0], sims[:, 0] = at, np.einsum("ij,ij->i", self.x[at], q)
        fresh = np.zeros((len(q), ef), bool)
        fresh[:, 0] = True
        seen = np.zeros((len(q), n), bool)
        seen[np.arange(len(q)), at] = True
        live = np.arange(len(q))
        while len(live):
            s = np.where(fresh[live], sims[live], -9)
            few = min(AT_ONCE, ef)
            pick = np.argpartition(-s, few - 1, axis=1)[:, :few]
            good = np.take_along_axis(s, pick, 1) > -3
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            node = np.where(good, np.take_along_axis(beam[live], pick, 1), -1)
            fresh[live[:, None], pick] = False
            near = np.where(node[:, :, None] >= 0, links[rows[np.maximum(node, 0)]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            new = np.full(near.shape, -2, np.float32)
            new[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[live[r]])
            ids = np.hstack([beam[live], near])
            all_s = np.hstack([sims[live], new])
            unseen = np.hstack([fresh[live], near >= 0])
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            beam[live], sims[live], fresh[live] = (np.take_along_axis(z, top, 1) for z in (ids, all_s, unseen))
        return beam, sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            ids, sims = self.search_layer(q, at, k, 4)
            at = ids[np.arange(len(ids)), sims.argmax(1)]
        return self.search_layer(q, at, 0, ef)

    def dump(self) -> bytes:
        """The links; vectors go apart."""
        f = io.BytesIO()
        layers = {f"r{k}": r for k, r in enumerate(self.rows)} | {f"l{k}": x for k, x in enumerate(self.links)}
        np.savez(f, depth=len(self.rows), **layers)
        return f.getvalue()

    @classmethod
    def load(cls, links: bytes, vectors: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(links))
        g = cls(vectors)
        g.rows = [z[f"r{k}"] for k in range(int(z["depth"]))]
        g.links = [z[f"l{k}"] for k in range(int(z["depth"]))]
        return g
