"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints come from three-word shingles (any width may be asked for); the
pipeline takes four words of bits over the sets of five-word shingles, compares
strips of text length, and holds every candidate pair against each other's
whole sets.
Documents with the same fingerprint (in the pipeline: the same set of
shingles) are one class at once (``groupBy`` with a map-side minimum), so a
group of copies of any size is a single row afterwards.  The classes are laid
into *cells*, by the population counts of equal parts of the fingerprint or by
text length, such that only cells next to each other can hold links.  Cells
are cut into chunks of bounded size by a hash, and a join on the table of
cells, whose size is bounded by the width of a fingerprint, deals every chunk
to the pairs that it is in; nothing on the driver grows with the data.
Inside a chunk pair the rows lie in tiles, in order of the population counts of
the four 16-bit quarters; a tile pair is skipped when these counts differ by
more than the radius in sum (a lower bound of the Hamming distance), and the
rest is compared by exclusive-or and bit counts.  Each chunk pair hands on a
spanning forest of its links, never all pairs of a group; components then
contract by alternating large-star and small-star steps, whose state is
checkpointed.

Defined cases: null text counts as empty; a text without words has
fingerprint zero, which is linked like any other; fewer words than the shingle
width give one shingle of the whole sequence; a null id keeps its row and its
class, and is never the smallest id; repeated rows fall into one class; an
empty table gives no rows; a very long text is one fingerprint like any other;
other columns are ignored, and kept by ``first_of_each`` under any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.common import cut_lineage, fresh, giving_back, map_text, runs

#: A chunk has about this many times the square root of all distinct fingerprints: 70,000 rows of 33 million, 16 MB of 30 billion.
CHUNK = 12
#: Bytes of shingle sets that a chunk's rows may have, where they are compared.
SETS = 48 << 20
#: Sets compared at once, and links of small chunk pairs that are handed on together.
BATCH, TOGETHER = 64, 20_000
#: Parts of a fingerprint whose population counts can make up a cell.
PARTS = (1, 2, 4)
#: What a chunk pair costs by itself, in rows.
EACH = 300
#: Rows of a tile, and tiles that are compared with a tile at once.
TILE, AT_ONCE = 256, 16
FIRST = np.uint64(0xFFFF)
#: Chance to miss a pair of the similarity; set sizes up to which the chance of a bit is counted out.
LOSS, COUNTED = 1e-6, 128


def stirred(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of a fingerprint; word 0 takes them as they are."""
    if not word:
        return h
    h = (h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """Majority of each bit over the shingle hashes; a tie is 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    buffer = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(buffer, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: len(words) - width]].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(buffer[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, key: Column | None = None) -> DataFrame:
    """(doc_id, row, n, same, f0, ...): an identity of the row, distinct shingles, a digest of their set, and the fingerprint's words as signed 64-bit numbers.

    A single word counts repeats of a shingle; several words tell the similarity of sets.
    """

    def run(ids, rows, texts):
        out = {"doc_id": ids, "row": rows, "n": [], "same": []} | {f: [] for f in names(words)}
        for text in texts:
            h = shingle_hashes(text, width)
            h = np.unique(h) if words > 1 else h
            out["n"].append(len(h) if words > 1 else 0)
            out["same"].append(xxhash.xxh3_128_digest(h.tobytes()) if words > 1 else None)
            for k, f in enumerate(names(words)):
                out[f].append(signed(majority(stirred(h, k))))
        return out

    keyed = docs.select("doc_id", (F.lit(None).cast("string") if key is None else key).alias("row"), "text")
    return map_text(keyed, run, "doc_id long, row string, n long, same binary, " + ", ".join(f"{f} long" for f in names(words)), "doc_id", "row", "text")


class Forest:
    """Union-find over the rows of a chunk pair, joined link by link and flattened block by block."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links that join two trees so far apart."""
        new = np.flatnonzero(self.up[u] != self.up[v])
        if not len(new):
            return []
        pairs = np.stack([self.up[u[new]], self.up[v[new]]])
        new = new[np.unique(pairs, axis=1, return_index=True)[1]]
        kept = []
        for a, b in zip(u[new].tolist(), v[new].tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((a, b))
        while (flat := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = flat
        return kept


def counts(f: np.ndarray) -> np.ndarray:
    """Population counts of parts: a single word's quarters, or the words."""
    if f.shape[1] > 1:
        return np.bitwise_count(f).astype(np.int16)
    return np.stack([np.bitwise_count((f[:, 0] >> np.uint64(s)) & FIRST) for s in (0, 16, 32, 48)], axis=1).astype(np.int16)


def tiled(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the parts' counts; then each tile's least and largest counts."""
    q = counts(f)
    order = np.lexsort(q.T[::-1])
    starts = np.arange(0, len(f), TILE)
    return order, np.minimum.reduceat(q[order], starts, axis=0), np.maximum.reduceat(q[order], starts, axis=0)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs within ``radius`` bits, and their bits: two words for all, further words where these are within ``half``."""
    d = np.bitwise_count(a[:, :1] ^ b[:, 0][None, :])
    if a.shape[1] > 1:
        d = d + np.bitwise_count(a[:, 1:2] ^ b[:, 1][None, :])
    x, y = np.nonzero(d <= (half if a.shape[1] > 2 else radius))
    d = d[x, y].astype(np.int32)
    if a.shape[1] > 2 and len(x):
        d += np.bitwise_count(a[x, 2:] ^ b[y, 2:]).sum(axis=1, dtype=np.int32)
        near = d <= radius
        x, y, d = x[near], y[near], d[near]
    return x, y, d


def tile_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, bits) of the pairs within ``radius``, some tiles at a time.

    Rows of ``right`` are counted on from those of ``left``; None: pairs within ``left``.
    """
    same = right is None
    right = left if same else right
    lo, lmin, lmax = tiled(left)
    ro, rmin, rmax = (lo, lmin, lmax) if same else tiled(right)
    a_all, b_all, shift = left[lo], right[ro], 0 if same else len(left)
    for i in range(len(lmin)):
        gap = np.maximum(0, np.maximum(rmin - lmax[i], lmin[i] - rmax)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        near = near[near >= i] if same else near
        a = a_all[i * TILE : (i + 1) * TILE]
        for k in range(0, len(near), AT_ONCE):
            at = (near[k : k + AT_ONCE, None] * TILE + np.arange(TILE)).ravel()
            at = at[at < len(b_all)]
            x, y, d = near_pairs(a, b_all[at], radius, half)
            u, v = lo[i * TILE + x], ro[at[y]] + shift
            apart = u != v
            yield u[apart], v[apart], d[apart]


def links(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius`` bits."""
    forest = Forest(len(left) + (0 if right is None else len(right)))
    for u, v, _ in tile_pairs(left, right, radius, radius):
        yield from forest.join(u, v)


@lru_cache(200_000)
def bit_chance(common: int, one: int, other: int) -> float:
    """Chance that a bit differs between two sets with so many common shingles and so many of their own; a tie is 0."""

    def binomial(n):
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def is_one(own):  # by the number of ones among the common shingles
        above = np.r_[np.cumsum(binomial(own)[::-1])[::-1], 0.0]
        least = (common + own) // 2 + 1 - np.arange(common + 1)
        return above[np.clip(least, 0, own + 1)]

    a, b = is_one(one), is_one(other)
    return float(binomial(common) @ (a * (1 - b) + b * (1 - a)))


def most_bits(bits: int, chance: float) -> int:
    """The least number that is exceeded with a chance of LOSS at most, if each of ``bits`` differs with ``chance``."""
    left, k = 1.0, -1
    while left > LOSS:
        k += 1
        left -= math.comb(bits, k) * chance**k * (1 - chance) ** (bits - k)
    return k


@dataclass(frozen=True)
class Limits:
    """Bits between texts of a similarity whose smaller set lies in ``strip``.

    All are within ``radius`` and ``half`` (of two words), but for a chance of
    LOSS each.  The chance of a bit is exact for each pair of set sizes (ties
    make it larger for small sets); it falls with size, so sets beyond COUNTED
    take that of sizes just under it.
    """

    similarity: float
    words: int
    strip: int = 0

    @property
    def chance(self) -> float:
        return strip_chance(self.similarity, self.strip)

    @cached_property
    def radius(self) -> int:
        return most_bits(64 * self.words, self.chance)

    @cached_property
    def half(self) -> int:
        return most_bits(128, self.chance)


@lru_cache(1000)
def strip_chance(similarity: float, strip: int) -> float:
    """The largest chance of a bit at or above the similarity."""
    low, high = (math.ceil(similarity**-k - 1e-6) for k in (strip, strip + 1))
    if high > COUNTED:
        low, high = int(COUNTED * similarity), COUNTED
    most = 0.0
    for m in range(max(1, low), max(low + 1, high)):
        for n in range(m, int(m / similarity + 1e-9) + 1):
            common = math.ceil(similarity * (m + n) / (1 + similarity) - 1e-9)
            if common <= m:
                most = max(most, bit_chance(common, m - common, n - common))
    return most


def candidates(left: np.ndarray, right: np.ndarray | None, limits: Limits) -> np.ndarray:
    """The rows that are in a pair within the limits."""
    found = np.zeros(len(left) + (0 if right is None else len(right)), bool)
    for u, v, _ in tile_pairs(left, right, limits.radius, limits.half):
        found[u] = found[v] = True
    return np.flatnonzero(found)


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` have the similarity to ``one``; all are sorted and distinct."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    fit = np.flatnonzero((size > 0) & (np.minimum(size, len(one)) + 1e-9 >= similarity * np.maximum(size, len(one))))
    if not len(fit):
        return fit
    every = np.concatenate([others[i] for i in fit])
    common = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(common, np.r_[0, np.cumsum(size[fit])[:-1]], dtype=np.int64)
    return fit[both + 1e-9 >= similarity * (len(one) + size[fit] - both)]


def verified(left: np.ndarray, right: np.ndarray | None, sets: list[np.ndarray], limits: Limits) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose sets have the similarity; each of its links is such a pair."""
    forest = Forest(len(sets))
    for u, v, _ in tile_pairs(left, right, limits.radius, limits.half):
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(u) != 0]) if len(u) else []
        for a, b in zip(cuts, [*cuts[1:], len(u)]):
            one = u[a]
            for k in range(a, b, BATCH):
                some = v[k : min(b, k + BATCH)]
                some = some[forest.up[some] != forest.up[one]]
                if len(some):
                    good = some[alike(sets[one], [sets[i] for i in some], limits.similarity)]
                    yield from forest.join(np.full(len(good), one), good)


# -- cells, chunks and their pairs --------------------------------------------------

PAIR = ("low", "low_chunk", "high", "high_chunk")


def count_cell(word: Column, parts: int, radius: int) -> Column:
    """The population counts of equal parts of a word as one number; counts that differ by the radius stay apart in every part."""
    width, base = 64 // parts, 64 // parts + 1 + 2 * radius
    out = F.lit(0).cast("long")
    for i in range(parts):
        part = F.shiftrightunsigned(word, i * width)
        part = part if parts == 1 else part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out * base + F.bit_count(part) + radius
    return out


def steps(parts: int, radius: int) -> list[int]:
    """Differences between the numbers of cells whose counts differ by the radius at most in sum."""
    base = 64 // parts + 1 + 2 * radius
    return sorted(sum(o * base ** (parts - 1 - i) for i, o in enumerate(offset)) for offset in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, offset)) <= radius)


def chunk_rows(n: int) -> int:
    return max(TILE, int(CHUNK * n**0.5))


def best_parts(classes: DataFrame, radius: int) -> tuple[int, int]:
    """The number of parts whose cells deal each row to the fewest chunk pairs, and all rows.

    Reads the number of rows of each cell of four parts: at most 17 ** 4 of them, whatever the data.
    """
    finest = max(PARTS)
    fine = classes.select(count_cell(F.col("f0"), finest, radius).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()
    if not fine:
        return PARTS[0], 0
    cell, n = np.array([tuple(r) for r in fine], np.int64).T
    base, total = 64 // finest + 1 + 2 * radius, int(n.sum())
    digits = np.stack([cell // base ** (finest - 1 - i) % base - radius for i in range(finest)])
    best = None
    for parts in PARTS:
        if len(steps(parts, radius)) > 1000:
            continue
        grouped_digits = digits.reshape(parts, finest // parts, -1).sum(axis=1)
        own_base = 64 // parts + 1 + 2 * radius
        code = sum((d + radius) * own_base ** (parts - 1 - i) for i, d in enumerate(grouped_digits))
        codes, at = np.unique(code, return_inverse=True)
        rows = np.bincount(at, weights=n)
        chunks, uses = np.ceil(rows / chunk_rows(total)), np.zeros(len(codes))
        for s in steps(parts, radius):
            other = np.searchsorted(codes, codes + s)
            there = codes[np.minimum(other, len(codes) - 1)] == codes + s
            uses[there] += chunks[other[there]]
        cost = float(((rows + EACH * chunks) * uses).sum())
        if best is None or cost < best[0]:
            best = cost, parts
    return best[1], total


def dealt(rows: DataFrame, chunks: DataFrame, differences: list[int]) -> DataFrame:
    """``rows`` (cell, node, f0, ...), each once for every chunk pair that its chunk is in: (low, low_chunk, high, high_chunk, side, ...).

    ``chunks``: (cell, k) of all cells, a table bounded by the number of cells
    that there can be; a pair's lower cell, or lower chunk of a cell, is side 0.
    """
    own = rows.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int"))
    near = own.withColumn("other", F.explode(F.array(*[F.col("cell") + F.lit(d) for d in differences])))
    partner = chunks.select(F.col("cell").alias("other"), F.col("k").alias("other_k"))
    met = near.join(F.broadcast(partner), "other").withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("other_k") - 1)))
    lower = (F.col("cell") < F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("chunk") <= F.col("other_chunk")))
    sides = [F.when(lower, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in zip(PAIR, ("cell", "chunk", "other", "other_chunk"), ("other", "other_chunk", "cell", "chunk"))]
    rest = [c for c in rows.columns if c != "cell"]
    return met.select(*sides, F.when(lower, 0).otherwise(1).alias("side"), *rest)


def by_pair(pairs: DataFrame, words: int, compare: Callable, schema: str) -> DataFrame:
    """``compare(low cell, left, right or None, table)`` for every chunk pair; ``table`` has its rows, left before right.

    ``compare`` gives a dict of arrays.  A chunk pair is bounded, and so are the results that wait.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = [*PAIR, "side", *[c for c in pairs.columns if c not in (*PAIR, "side")]]

    def run(batches):
        waiting, held = [], 0
        for table in runs(batches, len(PAIR)):
            low, low_chunk, high, high_chunk = (table.column(i)[0].as_py() for i in range(len(PAIR)))
            alone = (low, low_chunk) == (high, high_chunk)
            side = table.column("side").to_numpy()
            if len(side) < 2 or not alone and (side[0] == 1 or side[-1] == 0):
                continue  # nothing to compare with
            f = np.stack([table.column(n).to_numpy().view(np.uint64) for n in names(words)], axis=1)
            cut = int((side == 0).sum())
            found = compare(low, f if alone else f[:cut], None if alone else f[cut:], table)
            size = len(next(iter(found.values())))
            if size:
                fixed = dict(zip(PAIR, (low, low_chunk, high, high_chunk)))
                waiting.append(pa.RecordBatch.from_arrays([pa.array(found[n] if n in found else np.full(size, fixed[n]), arrow.field(n).type) for n in arrow.names], schema=arrow))
                held += size
            if held > TOGETHER:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, held = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return pairs.select(*columns).repartition(*PAIR).sortWithinPartitions(*PAIR, "side").mapInArrow(giving_back(run), schema)


def forest_of(found: list[tuple[int, int]], table: pa.Table) -> dict:
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    node = table.column("node").to_numpy()
    return {"u": node[u], "v": node[v]}


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning forest, chunk pair by chunk pair, of all links between the ``node`` of ``classes``."""
    parts, total = best_parts(classes, radius)
    rows = classes.select(count_cell(F.col("f0"), parts, radius).alias("cell"), "node", "f0")
    chunks = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(chunk_rows(total))).cast("int").alias("k"))  # at most 17 ** 4 rows
    return by_pair(dealt(rows, chunks, steps(parts, radius)), 1, lambda low, left, right, table: forest_of(list(links(left, right, radius)), table), "u long, v long")


def similar_links(classes: DataFrame, docs: DataFrame, width: int, limits: Limits) -> DataFrame:
    """(u, v): a spanning forest, chunk pair by chunk pair, of the ``node`` whose shingle sets have the similarity.

    Fingerprints choose the rows that have a candidate; these come again with
    their sets, and every pair that becomes a link is verified by them.
    """
    words, ratio = limits.words, 1 / limits.similarity
    rows = classes.select(F.col("strip").cast("long").alias("cell"), "node", *names(words))
    # strips are lengths: a set of strip p has up to ratio ** (p + 1) hashes, and there are as many strips as the logarithm of the longest text
    most = F.greatest(F.lit(8.0), F.least(F.lit(float(chunk_rows(classes.count()))), F.lit(SETS / 8) / F.pow(F.lit(ratio), F.col("cell") + 1)))
    chunks = rows.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / F.floor(most)).cast("int").alias("k"))

    def choose(low, left, right, table):
        at = candidates(left, right, replace(limits, strip=low))
        return {"side": table.column("side").to_numpy()[at], "node": table.column("node").to_numpy()[at]}

    again = cut_lineage(by_pair(dealt(rows, chunks, [-1, 0, 1]), words, choose, "low long, low_chunk int, high long, high_chunk int, side int, node long"))
    needed = cut_lineage(classes.join(again.select("node").distinct(), "node").select("node", *names(words), F.col("row").alias("of")))
    texts = docs.select(row_key().alias("row"), "text").join(needed.select("node", "of"), F.col("row") == F.col("of")).select("node", "text").dropDuplicates(["node"])
    sets = map_text(texts, lambda nodes, found: {"node": nodes, "hashes": [np.unique(shingle_hashes(t, width)).tobytes() for t in found]}, "node long, hashes binary", "node", "text")

    def verify(low, left, right, table):
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        return forest_of(list(verified(left, right, hashes, replace(limits, strip=low))), table)

    return by_pair(again.join(needed.drop("of").join(sets, "node"), "node"), words, verify, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable, by large-star and small-star steps until nothing changes.

    Each step groups by node; a hub's neighbours are reduced to their minimum
    by map-side aggregates and the minimum is joined back, so no task ever
    holds a hub's neighbours as one group.
    """
    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = cut_lineage(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        was, now = (x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() for x in (e, new))
        e = new
        if was == now:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame, key: list[str], link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` with root and component_id: the smallest id that links lead to, or null if all ids there are null.  Rows of equal ``key`` are one class."""
    prints = cut_lineage(prints)
    rest = [c for c in prints.columns if c not in (*key, "doc_id", "row")]
    classes = cut_lineage(prints.groupBy(*key).agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *[F.min(c).alias(c) for c in rest]).withColumn("node", F.monotonically_increasing_id()))
    linked = components(link(classes)).withColumnRenamed("node", "member")
    roots = classes.join(linked, classes.node == linked.member, "left").select(*key, "least", F.coalesce("root", "node").alias("root"))
    of_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    label = roots.join(of_root, "root").select(*key, "root", "component_id")
    # a hot class is one row on the right; AQE splits its rows on the left
    return prints.join(label, key, "left")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): links are fingerprints of one word within ``radius`` bits."""
    found = grouped(fingerprints(docs, width).select("doc_id", "row", "f0"), ["f0"], lambda classes: near_links(classes, radius))
    return found.select("doc_id", F.col("f0").alias("fp"), "component_id")


def first_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id (null ids come last).

    Links are texts whose sets of shingles have the similarity.  Only texts
    whose numbers of distinct shingles allow it are compared, by strips of that
    ratio; fingerprints of several words choose candidates, and every link is
    verified by the sets.
    """
    limits = Limits(similarity, words)
    n = F.greatest("n", F.lit(1)).cast("double")
    strip = F.floor(F.log(n) / F.lit(-math.log(similarity)) + 1e-9).cast("int")
    prints = fingerprints(docs, width, words, row_key()).withColumn("strip", strip).drop("n")
    found = grouped(prints, ["same"], lambda classes: similar_links(classes, docs, width, limits))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    row, place = fresh(docs, "row_", "place_")
    chosen = found.groupBy("root").agg(least.alias("m")).select(F.col("m.row").alias(row))
    kept = docs.withColumn(row, row_key()).join(chosen, row, "left_semi")
    # rows that repeat both id and text: one of them; the join has dealt them by this key
    once = kept.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0))))
    return once.filter(F.col(place) == 1).select(*docs.columns)


def row_key() -> Column:
    """An identity of id and text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
