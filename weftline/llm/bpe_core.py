"""Byte-level BPE on ragged arrays: tables of a tokenizers file, and merging of many byte strings at once."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex

#: Fixed value: the split pattern of byte-level BPE files with use_regex, in the public format's wording.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
_SHIFT = 20
#: Bytes from which a string is merged in linked arrays, where a round costs its own places and not the string's length.
LONG = 2048


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BPETables:
    """What encoding and decoding need of a tokenizers JSON file (ByteLevel pre-tokenizer, BPE model)."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model, pre = j["model"], j["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or j["normalizer"]:
            raise ValueError("only byte-level BPE files without normalizer and prefix space are read")
        symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        raw = lambda t: bytes(of_symbol[c] for c in t) if all(c in of_symbol for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = raw(t)
        for t, i in self.special.items():
            self.token_bytes[i] = raw(t)
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        keys, made = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            keys.append(vocab[a] << _SHIFT | vocab[b])
            made.append(vocab[a + b])
        key, rank = np.unique(np.array(keys, np.int64), return_index=True)
        self.keys = np.append(key, np.int64(2**62))
        self.ranks = np.append(rank.astype(np.int32), NONE)
        self.made = np.array(made, np.int32)
        inside = np.zeros((256, 256), bool)  # byte pairs that some token holds
        for t in self.token_bytes[: len(vocab)]:
            if len(t) > 1:
                x = np.frombuffer(t, np.uint8)
                inside[x[:-1], x[1:]] = True
        self.inside = inside
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; special strings stand alone."""
        if self.split is None or not self.split.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings end to end, and how many each has.

        Rank-synchronous: in every round each string applies its own lowest-rank pair at all places, left to
        right, all strings at once. A string without a pair left leaves the arrays.
        """
        long = [i for i, x in enumerate(strings) if len(x) >= LONG]
        if not long:
            return self._merge_short(strings)
        flat, n = self._merge_short([b"" if len(x) >= LONG else x for x in strings])
        parts, at = [], 0
        ends = np.cumsum(n)
        for i in long:
            parts += [flat[at : ends[i]], self._merge_long(strings[i])]
            at, n[i] = ends[i], len(parts[-1])
        return np.concatenate([*parts, flat[at:]]), n

    def _merge_long(self, string: bytes) -> np.ndarray:
        """One string: its lowest rank's places are merged all at once, then those of the next; only their neighbours are ranked again."""
        sym = self.first[np.frombuffer(string, np.uint8)]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank = np.append(self.rank(sym[:-1], sym[1:]), NONE)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            new, first = np.unique(rank[at], return_index=True)
            for r, x in zip(new.tolist(), np.split(at, first[1:]), strict=True):
                if r not in places:
                    heapq.heappush(heap, r)
                places.setdefault(r, []).append(x)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            new = np.append(True, after[at[:-1]] != at[1:])  # of equal pairs that overlap, every second one from the left
            run = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            rank[gone], alive[gone] = NONE, False
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left = before[at]
            touched = np.unique(np.append(at, left[left >= 0]))
            rank[touched] = NONE
            pair = touched[after[touched] < n]
            rank[pair] = self.rank(sym[pair], sym[after[pair]])
            put(pair)
        return sym[alive]

    def _merge_short(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(strings)
        size = np.fromiter(map(len, strings), np.int64, n)
        out_n = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(size)
        sym = self.first[np.frombuffer(b"".join(strings), np.uint8)]
        count = size[live]
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        if len(live):
            rank[np.cumsum(count) - 1] = NONE
        while len(live):
            start = np.cumsum(count) - count
            low = np.minimum.reduceat(rank, start)
            over = low == NONE
            if over.any() and (over.sum() * 4 >= len(over) or over.all()):
                gone = np.repeat(over, count)
                done.append((live[over], sym[gone]))
                out_n[live[over]] = count[over]
                sym, rank, live, count, low = sym[~gone], rank[~gone], live[~over], count[~over], low[~over]
                continue
            owner = np.repeat(np.arange(len(live)), count)
            hit = np.flatnonzero((rank == low[owner]) & (rank != NONE))
            if len(hit) > 1:  # of equal pairs that overlap, every second one from the left
                new = np.append(True, np.diff(hit) != 1)
                run = np.flatnonzero(new)
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(count) - 1] = True
            ends = last[hit + 1]
            last[hit] |= ends
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            count = count - np.bincount(owner[hit], minlength=len(live))
            at = (np.cumsum(keep) - 1)[hit]
            sym, rank, last = sym[keep], rank[keep], last[keep]
            for p in (at, at[at > 0] - 1):
                p = p[~last[p]]
                rank[p] = self.rank(sym[p], sym[p + 1])
            rank[last] = NONE
        flat = np.empty(int(out_n.sum()), np.int32)
        begin = np.cumsum(out_n) - out_n
        for who, ids in done:
            k = out_n[who]
            flat[np.repeat(begin[who] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return flat, out_n

    def fragments(self, pieces: list[bytes]) -> list[list[bytes]]:
        """Pre-tokens, each cut between every two bytes that no token of the vocabulary holds side by side."""
        whole = b"".join(pieces)
        x = np.frombuffer(whole, np.uint8)
        if len(x) < 2:
            return [[p] for p in pieces]
        end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = ~self.inside[x[:-1], x[1:]]
        cut[end[:-1][(end[:-1] > 0) & (end[:-1] < len(x))] - 1] = False
        at = np.flatnonzero(cut) + 1
        inner = np.searchsorted(at, end, side="left")  # cuts before each piece's end
        some = np.flatnonzero(np.diff(inner, prepend=0))
        out = [[p] for p in pieces]
        cuts = at.tolist()
        for k in some.tolist():
            lo, hi = (int(end[k - 1]) if k else 0), int(end[k])
            edges = [lo, *cuts[inner[k - 1] if k else 0 : inner[k]], hi]
            out[k] = [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out


_loaded: dict[bytes, BPETables] = {}


def tables(spec: bytes) -> BPETables:
    """One set of tables per Python worker."""
    key = hashlib.sha256(spec).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BPETables(spec)
    return _loaded[key]


def read_spec(path: str) -> bytes:
    """A tokenizer file as bytes, read on the driver; its size is that of the vocabulary, a few MB."""
    with open(path, "rb") as f:
        return f.read()
