"""Toxicity by noisy-channel deobfuscation.

1. A character language model: four-gram counts over all documents, summed by
   Spark; the alphabet is folded to 28 classes, so the model has a fixed size.
2. Restoration: a token with digits or signs among letters or of signs alone,
   letters that are repeated three times or more, or letters that stand apart,
   becomes a lattice: each sign may be itself or a letter, a run of a letter or
   a sign may be one or two, separators may vanish or end a word.  Letters that stand apart are one
   lattice from the first to the last, over any white space between them.
   Viterbi decoding over the last three classes finds the likeliest letters
   and words under channel and language model.  A token
   without any of these has one path only: itself.
3. A lexicon of words and word beginnings is learned from a bounded sample of
   labelled documents by greedy cover: at each step the feature that explains
   most toxic documents not explained so far, among features that are precise.
   Copies of a text count once.
4. A document's score is 1 - prod(1 - p) over its distinct lexicon features in
   the restored text, with a base rate.

Learning sees labels of rows whose crc32 of the id is not 0 modulo 5; a score
sees nothing but the text.

Defined cases: null and empty texts get the base rate; without labels (or none
that are toxic) every document gets the base rate; null labels are ignored; of
several labels of a document the larger counts; a null id is never learned
from; repeated rows give repeated results; of equally likely restorations the
first option of the lattice stands; a very long text is read as a whole, token
by token; an empty table gives no rows; other columns are ignored by
``toxicity`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.common import cut_lineage, giving_back, keep_rows, map_text, pieces

SCHEMA = "doc_id long, score double"
#: Most labelled documents that the lexicon is learned from.
SAMPLE = 16_000
#: How the lexicon is chosen: toxic documents of a feature, and their share of all that have it.
LEAST_DOCS, PRECISION = 4, 0.92
#: Toxic documents that a feature must be in to be taken for fewer than LEAST_DOCS of its own.
CLEAR = 8
BASE = 0.02
LETTERS = 26
OTHER, ALPHABET = 27, 28  # 26: outside of words
# fixed values: signs that stand for letters
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
SEPARATORS = ".-_*~'"
AMBIGUOUS = re.compile(r"[^\W\d_][0-9@$!|+€£(]|[0-9@$!|+€£(][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*~][^\W\d_]|^(?=.*[@$!|+€£(])[0-9@$!|+€£(]{3,}$", re.I)
APART = re.compile(r"(?<!\S)(?:[\w@$!|+€£(](?:[.\-_*~]|\s+)){2,}[\w@$!|+€£(](?!\w)")
EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
SWAP, DROP, KEEP = math.log(0.15), math.log(0.3), math.log(0.5)
#: A sign that stays; a separator that ends a word: inside a token, a single one between letters apart, and wider white space between these.
STAY, END, GAP, WIDE = math.log(0.05), math.log(0.3), math.log(0.1), math.log(0.5)


def fold() -> np.ndarray:
    """Character classes of the code points below 0x250: accents go, letters are 0 to 25."""
    table = np.full(0x251, 26, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= base <= "z":
            table[c] = ord(base) - 97
        elif chr(c).isalpha():
            table[c] = OTHER
    table[0x250] = OTHER
    return table


FOLD = fold()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return FOLD[np.minimum(codes, 0x250)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): four-gram counts of all whole texts; at most 28 ** 4 rows."""
    arrow = to_arrow_schema(StructType.fromDDL("gram int, n long"))

    def run(batches):
        total = np.zeros(ALPHABET**4, np.int64)
        for piece in pieces(batches, "text"):
            c = classes(" " + "   ".join(t or "" for t in piece.column(0).to_pylist()) + " ").astype(np.int32)
            total += np.bincount(((c[:-3] * ALPHABET + c[1:-2]) * ALPHABET + c[2:-1]) * ALPHABET + c[3:], minlength=len(total))
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[k : k + 50_000], pa.int32()), pa.array(total[seen[k : k + 50_000]], pa.int64())], schema=arrow)

    return docs.select("text").mapInArrow(giving_back(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(class | three classes before), interpolated with shorter contexts; of a fixed size."""
    counts = np.zeros(ALPHABET**4)
    for r in gram_counts(docs).collect():  # bounded by the alphabet
        counts[r.gram] = r.n
    full = counts.reshape((ALPHABET,) * 4)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(4):
        c = full.sum(axis=tuple(range(3 - order)))
        p = (c + 4 * p) / (c.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model

    def lattice(self, token: str, apart: bool = False) -> list[list[tuple[str, float]]]:
        """Options of each step: letters to put out and the channel's log probability; ``apart``: single letters with separators."""
        steps, i = [], 0
        while i < len(token):
            c = token[i]
            j = i
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            if c.isalpha():
                if run >= 3:
                    steps.append([(c, KEEP), (c + c, KEEP)])
                else:
                    steps += [[(c, 0.0)]] * run
            elif c in SIGNS:
                letters = SIGNS[c]
                for _ in range(min(run, 2)):
                    steps.append([(x, SWAP) for x in letters] + [("", SWAP + DROP), (c, STAY)])
            elif apart and (c.isspace() or c in SEPARATORS):
                while j < len(token) and token[j].isspace():
                    j += 1
                end = WIDE if j - i > 1 or c in "\n\r" else GAP
                steps.append([("", math.log(1 - math.exp(end))), (" ", end)])
            elif c in SEPARATORS:
                steps.append([("", DROP), (" ", END)])
            else:
                steps.append([(" ", 0.0)])
            i = j
        return steps

    def decode(self, token: str, apart: bool = False) -> str:
        model = self.model
        states = {(26, 26, 26): (0.0, ("", None))}
        for options in [*self.lattice(token, apart), [(" ", 0.0)]]:
            new: dict = {}
            for (a, b, c), (score, path) in states.items():
                for letters, cost in options:
                    s, x, y, z = score + cost, a, b, c
                    for letter in letters:
                        k = int(FOLD[min(ord(letter), 0x250)])
                        s += float(model[x, y, z, k])
                        x, y, z = y, z, k
                    if (x, y, z) not in new or s > new[x, y, z][0]:
                        new[x, y, z] = (s, (letters, path) if letters else path)
            states = new
        path = max(states.values(), key=lambda v: v[0])[1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)).strip()

    def restored(self, token: str) -> str | None:
        """The likeliest letters of a lower-case token, or None where only the token itself is possible."""
        if not AMBIGUOUS.search(token):
            return None
        found = self.decode(token)
        return found if found != token else None

    def restore(self, text: str) -> str:
        """The text with all that is obfuscated restored."""
        joined = APART.sub(lambda m: self.decode(m[0].lower(), True), text)
        return re.sub(r"\S+", lambda m: self.word(m[0]), joined)

    def word(self, token: str) -> str:
        core = EDGES.sub("", token)
        found = self.restored(core.lower()) if core else None
        return token if found is None else token.replace(core, found, 1)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in (4, 5, 6, 7, 8) if len(word) >= k)]


class Reader:
    """Features of whole texts; what it knows of tokens is kept between texts up to a bound."""

    MOST = 300_000

    def __init__(self, model: np.ndarray, lexicon: dict[str, float] | None = None):
        self.restorer, self.lexicon, self.known = Restorer(model), lexicon, {}

    def of_token(self, token: str) -> tuple[str, ...]:
        word = EDGES.sub("", token).lower()
        again = self.restorer.restored(word)
        found = features(word) if again is None else [f for w in again.split() for f in features(w)]
        return tuple(found if self.lexicon is None else [f for f in found if f in self.lexicon])

    def of_run(self, run: str) -> tuple[str, ...]:
        """Features of the words that letters apart are."""
        found = [f for w in self.restorer.decode(run.lower(), True).split() if (core := EDGES.sub("", w)) for f in features(core)]
        return tuple(found if self.lexicon is None else [f for f in found if f in self.lexicon])

    def read(self, text: str) -> set[str]:
        if len(self.known) > self.MOST:
            self.known.clear()
        known, out = self.known, set()
        tokens = set(text.split())
        tokens.update(" " + m[0] for m in APART.finditer(text))  # a blank tells runs from tokens
        for token in tokens:
            found = known.get(token)
            if found is None:
                found = known[token] = self.of_run(token[1:]) if token[0] == " " else self.of_token(token)
            if found:
                out.update(found)
        return out


def learn(docs: DataFrame, labels: DataFrame, model) -> dict[str, float]:
    """Lexicon features with their chance of being toxic, from at most about ``SAMPLE`` labelled documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return {}
    part = min(1.0, SAMPLE / n)
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30)))
    # about SAMPLE rows of 12 bytes: a bound that does not grow with the data
    read = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy(F.md5("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    read = cut_lineage(read.select("toxic", "text"))
    counted = "feature string, a long, b long"
    arrow = to_arrow_schema(StructType.fromDDL(counted))

    def count(batches):
        reader = Reader(model.value)
        a, b = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (a if toxic else b).update(reader.read(text or ""))
        # what no toxic text of this partition has only counts against features of other partitions
        names = list(a.keys() | b.keys())
        for k in range(0, len(names), 50_000):
            some = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([a[x] for x in some], pa.int64()), pa.array([b[x] for x in some], pa.int64())], schema=arrow)

    totals = read.mapInArrow(giving_back(count), counted).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    good = totals.filter((F.col("a") >= LEAST_DOCS) & (F.col("a") >= PRECISION * (F.col("a") + F.col("b")))).collect()  # bounded by the sample
    weight = {r.feature: (r.a, r.b) for r in good}
    if not weight:
        return {}

    def cover(batches):
        reader = Reader(model.value, dict.fromkeys(weight, 1.0))
        for batch in batches:
            rows = [{"found": sorted(reader.read(t or ""))} for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("found", pa.list_(pa.string()))]))

    sets = [set(r.found) for r in read.mapInArrow(giving_back(cover), "found array<string>").collect()]  # at most SAMPLE rows
    return greedy_cover(sets, weight)


def greedy_cover(sets: list[set[str]], weight: dict[str, tuple[int, int]]) -> dict[str, float]:
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for f in s:
            where[f].add(i)
    out = {}
    while where:
        f = min(where, key=lambda f: (-len(where[f]), weight[f][1], -len(f), f))
        docs = where.pop(f)
        a, b = weight[f]
        if not docs:
            break
        if len(docs) < LEAST_DOCS and (a < CLEAR or b):
            continue
        out[f] = (a + 0.5) / (a + b + 1)
        for i in docs:
            for g in sets[i]:
                if g != f and g in where:
                    where[g].discard(i)
    return out


def score_texts(docs: DataFrame, lexicon: dict[str, float], model) -> DataFrame:
    """(doc_id, score) of every whole text; one map stage, no shuffle."""
    state: dict[str, Reader] = {}

    def run(ids, texts):
        reader = state.setdefault("reader", Reader(model.value, lexicon))
        return {"doc_id": ids, "score": [chance(reader.read(t or ""), lexicon) for t in texts]}

    return map_text(docs, run, SCHEMA, "doc_id", "text")


def chance(found: set[str], lexicon: dict[str, float]) -> float:
    clean = 1 - BASE
    for f in sorted(found):
        clean *= 1 - lexicon[f]
    return 1 - clean


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    lexicon = learn(docs, labels, model)
    state: dict[str, Reader] = {}

    def test(texts):
        reader = state.setdefault("reader", Reader(model.value, lexicon))
        return [chance(reader.read(t or ""), lexicon) < limit for t in texts]

    return keep_rows(docs, test, end=state.clear)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(language_model(docs))  # 28 ** 4 floats
    scored = score_texts(docs, learn(docs, labels, model), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
