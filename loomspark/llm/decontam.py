"""Benchmark decontamination: CGK random walks, bit sampling, exact edit checks.

Texts and items are sequences of lower-case words.  An item of n words is held
against windows of n words; a window is contaminated if its edit distance to
the item is at most (1 - similarity) * n words.

* Windows: such a window shares a run of q words with the item (q follows from
  n and the distance by the pigeonhole principle), so only windows around runs
  of item words are looked at.  This loses nothing.
* Embedding: a CGK walk copies the word under its pointer and moves on by a
  bit that depends on step and word; 3 n steps map edit distance to Hamming
  distance.
* Bit sampling: a table is a walk with some sampled steps; windows and items
  that agree there, and in length, are candidates.  Tables are added for each
  class of lengths until the target recall is measured on items of the class
  that are edited up to the limit.  A class that would need too many walks
  has none: its windows are held against all items that they share a run with.
* Every candidate is verified by the exact edit distance.

Items go through in blocks of bounded size, each against all documents.  The
index of a block is made once, on the driver, and broadcast; windows are
embedded and verified in batches of bounded numbers of words, whatever the
longest item.

Defined cases: null text counts as empty and is clean; null or wordless items
match nothing; a null document id is reported as null; of equally near windows
the first is reported; repeated rows give one result row; without documents or
items there are no rows; a very long text is as many windows as it has; other
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.common import keep_rows, pieces

WORD = re.compile(r"\w+")
LEAK = "doc_id long, item_id long, distance int, similarity double, start long, end long"
#: Characters of items in a block, which is broadcast.
BLOCK = 8_000_000
#: Words of windows that are embedded at once, and cells of an edit distance table that are filled at once.
WINDOWS, CELLS = 1_000_000, 4_000_000
SAMPLED, PER_WALK = 2, 3
#: Edited items of a class of lengths that recall is measured on, and the most walks that are made for it.
EDITED, MOST_WALKS = 256, 200
#: Lengths of a class differ by less than this factor, and walks after which it is told whether MOST_WALKS can do.
CLASS, TRIED = 1.1, 8
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def limit_of(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def run_length(n: int, similarity: float) -> int:
    """Words of a run that survives any edits within the limit; 4 at most, which is enough to be rare."""
    k = limit_of(n, similarity)
    return max(1, min(4, -(-(n - k) // (k + 1))))


def class_of(n: np.ndarray, similarity: float) -> np.ndarray:
    """Classes of lengths; items without any edits allowed, which every table finds, are class -1."""
    free = np.floor((1 - similarity) * n + 1e-9) < 1
    return np.where(free, -1, np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS) + 1e-9)).astype(np.int64)


def walk(rows: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings, 3 * (row width) steps, of padded rows of word numbers."""
    m, width = rows.shape
    out = np.full((m, 3 * width), -1, np.int32)
    at, line = np.zeros(m, np.int64), np.arange(m)
    for j in range(3 * width):
        here = at < size
        if not here.any():
            break
        word = np.where(here, rows[line, np.minimum(at, width - 1)], -1)
        out[:, j] = word
        key = word.astype(np.int64).view(np.uint64) * GOLD + np.uint64(seed * 1_000_003 + j * 7919 + 1)
        at += (mixed(key) & np.uint64(1)).astype(np.int64) & here
    return out


def edit_distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of padded rows, all rows at once, in a band along the diagonal; what is above ``most`` is told as ``most`` + 1."""
    m, big, band = len(a), most + 1, 2 * most + 1
    ramp = np.arange(band, dtype=np.int32)
    row = np.broadcast_to(np.where(ramp >= most, ramp - most, big), (m, band)).astype(np.int32)
    lined = np.full((m, max(a.shape[1], b.shape[1]) + band), -2, np.int32)
    lined[:, most : most + b.shape[1]] = b
    out = np.where(na == 0, np.minimum(nb, big), big)
    for i in range(1, a.shape[1] + 1):
        # place j of the band is column i - most + j
        new = row + (lined[:, i - 1 : i - 1 + band] != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if i <= most:
            new[:, : most - i], new[:, most - i] = big, i
        row = np.minimum(np.minimum.accumulate(new - ramp, axis=1) + ramp, big)
        at = nb - i + most
        done = np.flatnonzero((na == i) & (at >= 0) & (at < band))
        out[done] = row[done, at[done]]
    return out


class Items:
    """A block of items: word numbers, the runs that windows are found by, and the tables of sampled walks."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = 0.99, seed: int = 11):
        self.similarity = similarity
        found = [(i, WORD.findall((t or "").lower())) for i, t in items]
        found = [(i, w) for i, w in found if w]
        self.ids = [i for i, _ in found]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32) for _, w in found]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.limit = np.array([limit_of(n, similarity) for n in self.size], np.int64)
        runs = [(run_length(len(w), similarity), i, w) for i, w in enumerate(self.words)]
        self.runs = {}
        for q in sorted({q for q, _, _ in runs}):
            keys, item, off = [], [], []
            for own, i, w in runs:
                if own == q:
                    k = self.run_keys(w, q)
                    keys.append(k)
                    item.append(np.full(len(k), i))
                    off.append(np.arange(len(k)))
            keys, item, off = np.concatenate(keys), np.concatenate(item), np.concatenate(off)
            order = np.argsort(keys, kind="stable")
            self.runs[q] = keys[order], item[order], off[order]
        self.seed = seed
        classes = class_of(self.size, similarity)
        self.members = {int(c): np.flatnonzero(classes == c) for c in np.unique(classes)}
        self.tables = {c: self.needed(m, recall) for c, m in self.members.items()}
        self.index = {c: [] for c in self.members}
        for c, members in self.members.items():
            rows, walked = self.rows_of(members), {"size": self.size[members]}
            for t in range(self.tables[c]):
                key = self.keys(rows, self.size[members], t, walked)
                order = np.argsort(key, kind="stable")
                self.index[c].append((key[order], members[order]))

    def rows_of(self, some: np.ndarray) -> np.ndarray:
        """Padded rows of some items, as wide as the longest of them."""
        return self.padded([self.words[i] for i in some], int(self.size[some].max(initial=1)))

    @staticmethod
    def padded(words: list[np.ndarray], width: int) -> np.ndarray:
        out = np.full((len(words), width), -1, np.int32)
        for r, w in enumerate(words):
            out[r, : len(w)] = w
        return out

    @staticmethod
    def run_keys(w: np.ndarray, q: int) -> np.ndarray:
        n = len(w) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        bad = np.zeros(n, bool)
        for k in range(q):
            h = mixed(h + w[k : k + n].astype(np.int64).view(np.uint64) * GOLD + np.uint64(k + 1))
            bad |= w[k : k + n] < 0
        h[bad] = np.uint64(0)
        return h

    def samples(self, table: int, n: np.ndarray) -> np.ndarray:
        """Sampled steps of a table in walks of 3 n steps; a walk has moved past n words after about 2 n."""
        u = np.random.default_rng((self.seed, table)).random(SAMPLED)
        return (u[None, :] * 2 * n[:, None]).astype(np.int64)

    def keys(self, rows: np.ndarray, n: np.ndarray, table: int, walked: dict | None = None) -> np.ndarray:
        number = table // PER_WALK
        if walked is None or number not in walked:
            done = walk(rows, (rows >= 0).sum(axis=1) if walked is None else walked["size"], self.seed + number)
            if walked is not None:
                walked[number] = done
        else:
            done = walked[number]
        picked = np.take_along_axis(done, self.samples(table, n), axis=1)
        h = mixed(n.astype(np.uint64) * GOLD)
        for k in range(SAMPLED):
            h = mixed(h + picked[:, k].astype(np.int64).view(np.uint64) * GOLD + np.uint64(k))
        return h

    def needed(self, members: np.ndarray, recall: float) -> int:
        """Tables that find items of a class edited up to the limit: those missed are at most half of what the target recall allows; 0 if MOST_WALKS do not."""
        rng = np.random.default_rng((self.seed, len(members), int(self.size[members].min())))
        which, edited = [], []
        for i in rng.permutation(np.tile(members, -(-EDITED // len(members))))[:EDITED].tolist():
            w = self.words[i].tolist()
            for _ in range(int(self.limit[i])):
                at, what = int(rng.integers(0, max(1, len(w)))), rng.integers(0, 3)
                if what == 0 and w:
                    w[at] = int(rng.integers(0, max(2, len(self.number))))
                elif what == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, int(rng.integers(0, max(2, len(self.number)))))
            which.append(i)
            edited.append(np.array(w[: self.size[i]], np.int32))
        own, n = self.rows_of(np.array(which)), self.size[which]
        rows = self.padded(edited, own.shape[1])
        found = np.zeros(len(which), bool)
        one, two = ({"size": (r >= 0).sum(axis=1)} for r in (own, rows))
        for t in range(MOST_WALKS * PER_WALK):
            found |= self.keys(own, n, t, one) == self.keys(rows, n, t, two)
            if (t + 1) % PER_WALK == 0:
                one, two = {"size": one["size"]}, {"size": two["size"]}  # a walk's tables follow one another
                missed, walks = 1 - found.mean(), (t + 1) // PER_WALK
                if missed <= (1 - recall) / 2:
                    return t + 1
                # misses fall by no more than the same share with each further walk
                if walks == TRIED and missed ** (MOST_WALKS / TRIED) > (1 - recall) / 2:
                    break
        return 0

    def windows(self, w: np.ndarray) -> set[tuple[int, int]]:
        """(start, length) of windows of a text that share a run with an item of that length."""
        out: set[tuple[int, int]] = set()
        for q, (keys, item, off) in self.runs.items():
            h = self.run_keys(w, q)
            at = np.searchsorted(keys, h)
            hit = np.flatnonzero((keys[np.minimum(at, len(keys) - 1)] == h) & (h != 0))
            for p in hit.tolist():
                k = at[p]
                while k < len(keys) and keys[k] == h[p]:
                    n, first = int(self.size[item[k]]), p - int(off[k])
                    out.add((first, n))
                    k += 1
        grown: set[tuple[int, int]] = set()
        for first, n in out:
            slack = limit_of(n, self.similarity)
            grown.update((s, n) for s in range(max(0, first - slack), min(len(w) - 1, first + slack) + 1))
        return grown

    def sharing(self, w: np.ndarray, n: int) -> set[int]:
        """Items of n words that share a run with a window: all that it can match are among them."""
        keys, item, _ = self.runs[q := run_length(n, self.similarity)]
        h = self.run_keys(w, q)
        h = np.unique(h[h != 0])
        spans = zip(np.searchsorted(keys, h, "left").tolist(), np.searchsorted(keys, h, "right").tolist())
        return {int(j) for a, b in spans for j in item[a:b] if self.size[j] == n}

    def match(self, windows: list[tuple[int, int, np.ndarray]], n: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, start) of the verified windows (text, start, words), n: the item length of each."""
        size = np.array([len(w) for _, _, w in windows], np.int64)
        classes = class_of(n, self.similarity)
        found = []
        for c in np.unique(classes).tolist():
            of = np.flatnonzero(classes == c)
            rows = self.padded([windows[i][2] for i in of], int(n[of].max()))
            pairs = set()
            walked: dict = {"size": size[of]}
            for t, (keys, order) in enumerate(self.index[c]):
                if t % PER_WALK == 0:
                    walked = {"size": size[of]}  # a walk's tables follow one another
                h = self.keys(rows, n[of], t, walked)
                low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                for i in np.flatnonzero(high > low).tolist():
                    pairs.update((i, int(x)) for x in order[low[i] : high[i]])
            if not self.tables[c]:
                for i, k in enumerate(of.tolist()):
                    pairs.update((i, j) for j in self.sharing(windows[k][2], int(n[k])))
            own = n[of]
            pairs_left = sorted(p for p in pairs if self.size[p[1]] == own[p[0]])
            most = int(self.limit[members].max(initial=0)) if len(members := self.members[c]) else 0
            step = max(1, CELLS // max(64, rows.shape[1] + 2 * most))
            for k in range(0, len(pairs_left), step):
                left, right = np.array(pairs_left[k : k + step]).T
                distance = edit_distances(rows[left], size[of][left], self.rows_of(right), self.size[right], most)
                for i, j, d in zip(of[left].tolist(), right.tolist(), distance.tolist()):
                    if d <= self.limit[j]:
                        found.append((windows[i][0], j, d, windows[i][1]))
        return found


def scan(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) in code points: the nearest window of each item in each text."""
    windows, lengths, held = [], [], 0
    best: dict[tuple[int, int], tuple[int, int]] = {}

    def settle():
        for i, j, d, s in items.match(windows, np.array(lengths, np.int64)) if windows else ():
            best[i, j] = min(best.get((i, j), (d, s)), (d, s))
        windows.clear()
        lengths.clear()

    get = items.number.get
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower())
        w = np.fromiter((get(x, -1) for x in found), np.int32, len(found))
        for s, n in items.windows(w):
            windows.append((i, s, w[s : s + n]))
            lengths.append(n)
            held += n
            if held > WINDOWS:
                settle()
                held = 0
    settle()
    out = []
    places: dict[int, list] = {}
    for (i, j), (d, s) in sorted(best.items()):
        if i not in places:
            places[i] = [m.span() for m in WORD.finditer(texts[i])]
        spans = places[i]
        last = min(s + int(items.size[j]), len(spans)) - 1
        out.append((i, j, d, spans[s][0], spans[last][1]) if s < len(spans) else (i, j, d, 0, len(texts[i])))
    return out


def item_blocks(benchmark: DataFrame, similarity: float, recall: float):
    """Broadcast indexes, each made once from about BLOCK characters of items."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = size // BLOCK + 1
    for b in range(blocks):
        some = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in some], similarity, recall))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs`` without any item, with all their columns."""
    for block in item_blocks(benchmark, similarity, recall):

        def test(texts, block=block):
            items = block.value
            leaking = {i for i, *_ in scan(items, [t or "" for t in texts])} if items.ids else set()
            return [i not in leaking for i in range(len(texts))]

        docs = keep_rows(docs, test, most=8 << 20)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, distance, similarity, start, end): contaminated documents only, each with each of its items once."""
    arrow = to_arrow_schema(StructType.fromDDL(LEAK))
    out = None
    for block in item_blocks(benchmark, similarity, recall):

        def run(batches, block=block):
            items = block.value
            if not items.ids:
                return
            for piece in pieces(batches, "text", most=8 << 20):
                ids = piece.column(0).to_pylist()
                rows = []
                for i, j, d, a, e in scan(items, [t or "" for t in piece.column(1).to_pylist()]):
                    rows.append({"doc_id": ids[i], "item_id": items.ids[j], "distance": d, "similarity": 1 - d / int(items.size[j]), "start": a, "end": e})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        part = docs.select("doc_id", "text").mapInArrow(run, LEAK)
        out = part if out is None else out.union(part)
    # rows that repeat an id and an item: the nearest
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "similarity", "start", "end")).alias("m")).select("doc_id", "item_id", "m.distance", "m.similarity", "m.start", "m.end")
