"""Token counts of byte-level BPE by rank-synchronous array merging.

A batch of distinct pre-tokens is one ragged numpy array of symbol ids.  Each
round finds every sequence's lowest-rank pair by a segmented minimum, applies
that pair at all its places in that sequence (left to right, no overlaps) and
compacts the array; sequences without a mergeable pair leave with their count.

Defined cases: null text counts as empty; empty text has 0 tokens; a special
string inside a text is one token, as the vocabulary's library treats it by
default; a null id stays null; repeated rows give repeated results; where a
pair overlaps itself the leftmost is merged first; a very long text, also one
of a single pre-token, is counted as a whole; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from loomspark.llm.common import map_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens of byte-level BPE, as the vocabulary's README states the pattern.  # fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, which the pattern's \s stands for.  # fixed value
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct strings that a worker remembers before it starts anew: a bound on memory, not on work.
REMEMBERED = 400_000
NO_PAIR = np.int32(2**31 - 1)


class Merger:
    """Counts of the symbols that survive all merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, ranks = np.unique(keys, return_index=True)
        # an open-addressed table: a lookup is one or two gathers, whatever the number of merges
        self.bits = max(16, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int32)
        left, rank, at = keys, ranks.astype(np.int32), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            chosen = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[chosen]], self.ranks[at[chosen]] = left[chosen], rank[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, rank, at = left[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.merged = new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        at = self._slot(keys)
        out = np.full(len(keys), NO_PAIR, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each of ``tokens`` (none of them empty)."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), size)
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        fresh = np.flatnonzero(owner[:-1] == owner[1:])
        while True:
            rank[fresh] = self.rank(symbols[fresh], symbols[fresh + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NO_PAIR
            out[owner[starts[over]]] = size[over]
            if over.all():
                return out
            if over.any():
                keep = np.repeat(~over, size)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                size, lowest = size[~over], lowest[~over]
            hits = np.flatnonzero(rank == np.repeat(lowest, size))
            # in a run of overlapping hits (aaaa) every second one merges, from the left
            run = np.r_[True, np.diff(hits) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            symbols[hits] = self.merged[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            rank[hits] = -1
            before = hits[hits > 0] - 1
            before = np.where(keep[before], before, before - 1)
            rank[before[before >= 0]] = -1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.flatnonzero(rank == -1)
            rank[changed] = NO_PAIR
            changed = changed[changed + 1 < len(owner)]
            fresh = changed[owner[changed] == owner[changed + 1]]


class Counter:
    """Token counts of whole texts; what it knows of strings is kept between batches up to a bound."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.units = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pattern = regex.compile(PATTERN)
        self.plain = regex.compile(r" ?[A-Za-z]+")
        self.known: dict[str, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None

    def _learn(self, units: set[str]) -> None:
        whole, rest = [], {}
        for u in units:
            if self.plain.fullmatch(u):
                whole.append(u)
            else:
                rest[u] = self.pattern.findall(u)
        parts = {p for ps in rest.values() for p in ps if p not in self.known}
        fresh = list(parts.union(u for u in whole))
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            self.known.update(zip(some, self.merger.counts([s.encode() for s in some]).tolist()))
        get = self.known.__getitem__
        self.known.update([(u, sum(map(get, ps))) for u, ps in rest.items()])

    def count(self, texts: list[str]) -> list[int]:
        sums, split = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                sums[i] = len(parts) - 1
            split.append([self.units.findall(p) for p in parts])
        unknown = {u for ps in split for us in ps for u in us}.difference(self.known)
        if unknown:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                unknown = {u for ps in split for us in ps for u in us}
            self._learn(unknown)
        get = self.known.__getitem__
        for i, ps in enumerate(split):
            for us in ps:
                sums[i] += sum(map(get, us))
        return sums


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per document: bytes, tokens and whether it exceeds ``limit`` tokens.  One map stage, no shuffle."""

    def run(ids, texts):
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        texts = [t or "" for t in texts]
        n = _COUNTERS[vocabulary].count(texts)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_text(docs, run, SCHEMA, "doc_id", "text")
