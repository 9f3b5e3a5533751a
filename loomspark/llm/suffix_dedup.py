"""Repeated passages: bytes covered by a 50-byte string that starts in an earlier document.

1. Documents are dealt to *pieces* by a hash of their id.  Every 50-byte string
   holds an anchor, the 24-gram with the least hash among its 27; equal strings
   hold equal anchors at equal places.  A piece sends each distinct pair
   (anchor, its 76-byte context) once, with its smallest id, to the anchor's
   shard, so copies are pre-aggregated before the shuffle.
2. A shard merges its pieces' sorted arrays.  Contexts whose smallest id is in
   another piece are answered as *known*.  Where one anchor has several
   contexts, strings inside them may still agree: these contexts are asked for.
   Contexts are told apart by the hashes of their anchor and of themselves, so
   that two different ones would have to agree in both.
3. Shards of contexts get suffix arrays: Larsson-Sadakane refinement in numpy,
   from ranks of eight bytes on, only inside groups that are still unsorted.
   Kasai's common prefixes, which run along all contexts at once, cut the
   array into classes of equal 50-byte strings; a string is removed where its
   class has a smaller id.  An anchor with very many contexts (the edge of a
   passage that a large part of all documents share) is cut into parts, each
   a shard of its own: a first suffix array gives each part's classes with
   their smallest ids, these are merged over the parts by their bytes, and
   where another part has a smaller id, the string joins the part's contexts
   for the array that decides.
4. Pieces look their anchors up in the sorted answers by binary search, mark
   bytes and hash what is left.

All steps work on whole texts and bounded memory: a piece, a shard, or a block
of contexts.  The result is that of comparing all strings with all others.

Defined cases: null text counts as empty; texts under 50 bytes lose nothing; a
null id keeps its row, loses nothing and takes nothing from others; rows that
repeat an id do not take from each other; an empty table gives no rows; very
long texts are cut by nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.common import cut_lineage, dealt_by, release, text_bytes

SIZE, GRAM = 50, 24
SPAN = SIZE - GRAM + 1  # strings that hold a gram; also the grams of a string
SIDE = SIZE - GRAM  # context bytes on either side of a gram
CONTEXT = SIZE + SIDE
#: Contexts of a part of an anchor.
MANY = 20_000
#: Bytes of contexts that are sorted at once; a task holds about 60 times as much.
BLOCK = 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick(values[i : i + width]) for every i, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out, done = pick(out[:-done], out[done:]), done * 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = np.frombuffer(data[o : o + 8 * m].tobytes(), "<u8")
    return out


def stir(h: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ more) * MIX[k % 3]
    return h ^ (h >> np.uint64(31))


class Piece:
    """Anchors of some texts: document (its place in the piece), byte position, gram hash and context hash."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.buffer = np.zeros(CONTEXT + sum(len(t) + CONTEXT for t in texts) + 8, np.uint8)
        self.start = np.zeros(len(texts), np.int64)
        at = CONTEXT
        for i, t in enumerate(texts):
            self.start[i] = at
            self.buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += len(t) + CONTEXT
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        long = np.flatnonzero((self.size >= SIZE) & np.array([i is not None for i in ids], bool)) if texts else np.zeros(0, np.int64)
        self.doc = self.at = np.zeros(0, np.int64)
        self.gram = self.context = np.zeros(0, np.uint64)
        if not len(long):
            return
        w = words(self.buffer)
        n = len(w) - 16
        h = stir(stir(stir(np.full(n, MIX[0]), w[:n], 0), w[8 : 8 + n], 1), w[16 : 16 + n], 2)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, self.start[long], 1)
        np.add.at(inside, self.start[long] + self.size[long] - SIZE + 1, -1)
        inside = np.cumsum(inside)[:n] > 0
        low = slide(h, SPAN, np.minimum)
        low = np.where(inside[: len(low)], low, np.uint64(0))
        pad = np.zeros(SPAN - 1, np.uint64)
        high = slide(np.concatenate([pad, low, pad]), SPAN, np.maximum)[:n]
        self.at = np.flatnonzero(h == high)
        self.doc = np.searchsorted(self.start, self.at, "right") - 1
        self.gram = h[self.at]
        left = np.minimum(SIDE, self.at - self.start[self.doc])
        right = np.minimum(SIZE, self.start[self.doc] + self.size[self.doc] - self.at)
        c = stir(self.gram, (left * 64 + right).astype(np.uint64), 1)
        for k, o in enumerate([*range(-SIDE, SIZE - 8, 8), SIZE - 8]):
            c = stir(c, w[self.at + o], k)
        self.context = c

    def id(self) -> np.ndarray:
        return np.array([0 if i is None else i for i in self.ids], np.int64)[self.doc]

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct context: an anchor with its smallest id; then each anchor's context number and that id."""
        own = self.id()
        if not len(own):
            return self.at, self.at, own
        order = np.argsort(self.context)
        new = np.r_[True, np.diff(self.context[order]) != 0]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(own[order], np.flatnonzero(new))
        first = np.empty(len(least), np.int64)
        at = np.flatnonzero(own == least[number])
        first[number[at[::-1]]] = at[::-1]
        return first, number, least


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers byte plane by byte plane, which compresses better."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)


def from_planes(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 8, len(data) // (8 * n))
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]


def by_key(batches, columns: int):
    """Rows of sorted batches gathered by their first column: (key, list of rows)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


# -- 1: pieces send their anchors ---------------------------------------------

SENT = "shard long, piece long, n long, payload binary"


def send(bits: int):
    arrow = schema_of(SENT)

    def run(batches):
        for piece, rows in by_key(batches, 3):
            p = Piece([r[1] for r in rows], [(r[2] or "").encode() for r in rows])
            first, _, least = p.firsts()
            order = np.argsort(p.gram[first], kind="stable")
            first, least = first[order], least[order]
            gram, context = p.gram[first], p.context[first]
            shard = (gram >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, np.diff(shard) != 0]) if len(shard) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                out.append({"shard": int(shard[a]), "piece": piece, "n": int(b - a), "payload": planes(np.diff(gram[a:b], prepend=np.uint64(0)), context[a:b], least[a:b])})
            if out:
                yield to_batch(out, arrow)

    return run


# -- 2: shards answer ---------------------------------------------------------

ANSWER = "piece long, kind int, payload binary"
KNOWN, ASKED, PARTED = 0, 1, 2


def answer():
    arrow = schema_of(ANSWER)

    def run(batches):
        for _, rows in by_key(batches, 4):
            parts = [from_planes(r[3], 3) for r in rows]
            gram, context, least = (np.concatenate(x) for x in zip(*((np.cumsum(g), c, d) for g, c, d in parts)))
            least = least.view(np.int64)
            piece = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
            order = np.lexsort((context, gram))
            gram, context, least, piece = gram[order], context[order], least[order], piece[order]
            new_gram = np.r_[True, np.diff(gram) != 0]
            head = np.flatnonzero(new_gram | np.r_[True, np.diff(context) != 0])
            number = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(context)]))
            known = least > np.minimum.reduceat(least, head)[number]
            of = np.cumsum(new_gram[head]) - 1  # which anchor a context is of
            first = np.flatnonzero(new_gram[head])
            several = np.diff(np.r_[first, len(head)])[of][number]
            part = (np.arange(len(head)) - first[of])[number] // MANY
            kind = np.where(known, KNOWN, np.where(several > MANY, PARTED, ASKED))
            keep = np.flatnonzero(known | (several > 1))
            keep = keep[np.argsort(piece[keep] * 4 + kind[keep], kind="stable")]
            code = piece[keep] * 4 + kind[keep]
            cuts = np.flatnonzero(np.r_[True, np.diff(code) != 0]) if len(code) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(code)]):
                own = keep[a:b]
                payload = np.stack([context[own], part[own].view(np.uint64)], axis=1) if code[a] % 4 == PARTED else context[own]
                out.append({"piece": rows[code[a] // 4][1], "kind": int(code[a] % 4), "payload": payload.tobytes()})
            if out:
                yield to_batch(out, arrow)

    return run


# -- 3: contexts that were asked for, and their suffix arrays -----------------

ASKED_FOR = "shard long, piece long, context long, doc_id long, parted boolean, bytes binary"
FOUND = "piece long, kind int, payload binary"
MARKS = 3


def replies(rows: list[tuple]) -> dict[int, np.ndarray]:
    out = {}
    for kind in (KNOWN, ASKED):
        parts = [np.frombuffer(r[2], np.uint64) for r in rows if r[1] == kind]
        out[kind] = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    parts = [np.frombuffer(r[2], np.uint64).reshape(-1, 2) for r in rows if r[1] == PARTED]
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    out[PARTED] = both[np.argsort(both[:, 0])]
    return out


def held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array, by binary search."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def piece_of(rows: list[tuple]) -> tuple[list[tuple], Piece]:
    docs = [r for r in rows if r[1] == -1]
    return [r for r in rows if r[1] >= 0], Piece([r[3] for r in docs], [(r[4] or "").encode() for r in docs])


def show():
    arrow = schema_of(ASKED_FOR)

    def run(batches):
        for piece, rows in by_key(batches, 5):
            said, p = piece_of(rows)
            said = replies(said)
            first, _, least = p.firsts()
            context, gram = p.context[first], p.gram[first]
            parted, number = said[PARTED].T
            shard = gram.copy()
            of_part = held(context, parted)
            shard[of_part] = stir(gram[of_part], number[np.searchsorted(parted, context[of_part])], 2)
            out = []
            for i in np.flatnonzero(held(context, said[ASKED]) | of_part).tolist():
                a, d = int(p.at[first[i]]), p.doc[first[i]]
                low = max(a - SIDE, int(p.start[d]))
                high = min(a + SIZE, int(p.start[d] + p.size[d]))
                out.append({"shard": int(shard[i].view(np.int64)), "piece": piece, "context": int(context[i].view(np.int64)), "doc_id": int(least[i]), "parted": bool(of_part[i]), "bytes": p.buffer[low:high].tobytes()})
            for k in range(0, len(out), 20_000):
                yield to_batch(out[k : k + 20_000], arrow)

    return run


def refine(data: np.ndarray, n: int) -> np.ndarray:
    """Larsson-Sadakane: the first ``n`` suffixes of ``data`` (zeros follow them) in order.

    A rank is the place where its group begins, so groups that are already
    single never move, and only the others are sorted again at each doubling.
    """
    key = words(data)[:n].byteswap()
    order = np.argsort(key)
    same = key[order]
    start = np.r_[True, same[1:] != same[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    h = 8
    while True:
        size_one = start & np.r_[start[1:], True]
        todo = np.flatnonzero(~size_one)
        if not len(todo):
            break
        at = order[todo]
        group, second = rank[at], rank[np.minimum(at + h, n)]
        inner = np.argsort(group * (n + 2) + second + 1)
        at, group, second = at[inner], group[inner], second[inner]
        order[todo] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        start[todo] = new
        rank[at] = np.maximum.accumulate(np.where(new, todo, 0))
        h *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, begin: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes (up to ``most`` bytes) of neighbours in ``order``; runs along all texts, which begin at ``begin``, at once."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    length = np.diff(np.r_[begin, n])
    by_length = np.argsort(-length, kind="stable")
    begin, length = begin[by_length], length[by_length]
    h = np.zeros(len(begin), np.int64)
    for j in range(int(length.max(initial=0))):
        alive = int(np.searchsorted(-length, -j, "left"))
        at = begin[:alive] + j
        other = before[at]
        h = np.where(other >= 0, np.maximum(h[:alive] - 1, 0), 0)
        go = np.flatnonzero(other >= 0)
        while len(go):
            go = go[(h[go] < most)]
            go = go[data[at[go] + h[go]] == data[other[go] + h[go]]]
            h[go] += 1
        common[at] = h
    return common[order]


def string_classes(contexts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """By suffix array: the places of 50-byte strings, the class of each, the least id of each class, and of each byte its context and offset."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    data = np.frombuffer(b"".join(contexts) + b"\0" * (SIZE + 16), np.uint8)
    n = int(size.sum())
    order = refine(data, n)
    common = kasai(data, order, begin, SIZE)
    owner = np.repeat(np.arange(len(contexts)), size)
    offset = np.arange(n) - begin[owner]
    whole = (offset + SIZE <= size[owner])[order]
    number = np.cumsum(common < SIZE)
    number, place = number[whole], order[whole]
    least = np.full(int(number.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids[owner[place]])
    return place, number, least, owner, offset


def marks_of(contexts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Of each context, bits of the places from which 50 bytes also stand in a context of a smaller id."""
    place, number, least, owner, offset = string_classes(contexts, ids)
    gone = place[ids[owner[place]] > least[number]]
    out = np.zeros(len(contexts), np.int64)
    np.bitwise_or.at(out, owner[gone], np.int64(1) << offset[gone])
    return out


def blocks(batches, solve, arrow: pa.Schema):
    """``solve`` of rows (shard, piece, context, doc_id, bytes) sorted by shard, some whole shards at a time."""
    block, size = [], 0
    for _, rows in by_key(batches, 5):
        block += rows
        size += sum(len(r[4]) for r in rows)
        if size > BLOCK:
            if found := solve(block):
                yield to_batch(found, arrow)
            block, size = [], 0
    if block and (found := solve(block)):
        yield to_batch(found, arrow)


def sort_contexts():
    arrow = schema_of(FOUND)

    def solve(rows):
        marks = marks_of([r[4] for r in rows], np.array([r[3] for r in rows], np.int64))
        return [{"piece": r[1], "kind": MARKS, "payload": np.array([r[2], m], np.int64).tobytes()} for r, m in zip(rows, marks.tolist()) if m and r[1] is not None]

    return lambda batches: blocks(batches, solve, arrow)


CLASSES = "shard long, doc_id long, bytes binary"


def part_classes():
    """The classes of each part by its suffix array, with their least ids.  A shard is a block of its own: its number stands in its rows."""
    arrow = schema_of(CLASSES)

    def solve(rows):
        contexts = [r[4] for r in rows]
        ids = np.array([r[3] for r in rows], np.int64)
        place, number, least, owner, offset = string_classes(contexts, ids)
        one = np.unique(number, return_index=True)[1]
        return [{"shard": rows[c][0], "doc_id": int(m), "bytes": contexts[c][o : o + SIZE]} for c, o, m in zip(owner[place[one]].tolist(), offset[place[one]].tolist(), least[number[one]].tolist())]

    def run(batches):
        for _, rows in by_key(batches, 5):
            found = solve(rows)
            for k in range(0, len(found), 20_000):
                yield to_batch(found[k : k + 20_000], arrow)

    return run


def with_other_parts(asked: DataFrame) -> DataFrame:
    """The contexts of parted anchors, and the strings of each part that another part has with a smaller id (these have no piece)."""
    own = asked.filter("parted").drop("parted")
    classes = cut_lineage(own.repartition("shard").sortWithinPartitions("shard").mapInArrow(part_classes(), CLASSES))
    least = classes.groupBy("bytes").agg(F.min("doc_id").alias("least"))
    smaller = classes.join(least, "bytes").filter("least < doc_id")
    return own.union(smaller.select("shard", F.lit(None).cast("long"), F.lit(None).cast("long"), "least", "bytes"))


# -- 4: pieces mark and remove -------------------------------------------------


def finish():
    arrow = schema_of(RESULT)

    def run(batches):
        for _, rows in by_key(batches, 5):
            said, p = piece_of(rows)
            yield to_batch(removed(p, replies(said), [r[2] for r in said if r[1] == MARKS]), arrow)

    return run


def removed(p: Piece, said: dict[int, np.ndarray], marks: list[bytes]) -> list[dict]:
    first, number, least = p.firsts()
    own = p.id()
    gone = np.zeros(len(p.buffer) + 1, np.int32)
    n = p.start[p.doc] + p.size[p.doc] - SIZE  # last place of a string
    covered = held(p.context[first], said[KNOWN])[number] | (own > least[number])
    low, high = np.maximum(p.at - SIDE, p.start[p.doc])[covered], np.minimum(p.at, n)[covered]
    some = low <= high
    np.add.at(gone, low[some], 1)
    np.add.at(gone, high[some] + SIZE, -1)
    if marks:
        context, bits = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2).T
        order = np.argsort(context.view(np.uint64), kind="stable")
        context, bits = context.view(np.uint64)[order], bits[order]
        anchors = np.flatnonzero(~covered)
        at = np.searchsorted(context, p.context[anchors])
        hit = held(p.context[anchors], context)
        anchors, at = anchors[hit], at[hit]
        for x in range(SPAN):
            on = anchors[(bits[at] >> x) & 1 == 1]
            s = np.maximum(p.at[on] - SIDE, p.start[p.doc[on]]) + x
            np.add.at(gone, s, 1)
            np.add.at(gone, s + SIZE, -1)
    mask = np.cumsum(gone)[:-1] > 0
    out = []
    for i, (key, text) in enumerate(zip(p.ids, p.texts)):
        m = mask[p.start[i] : p.start[i] + len(text)]
        count = int(m.sum())
        kept = np.frombuffer(text, np.uint8)[~m].tobytes() if count else text
        spans = int((np.diff(np.r_[False, m].astype(np.int8)) == 1).sum()) if count else 0
        out.append({"doc_id": key, "n_bytes": len(text), "n_removed": count, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document."""
    size = text_bytes(docs)
    pieces, bits = max(512, size >> 20), max(9, (size >> 20).bit_length())  # pieces and shards of bounded size, so more of them with the data
    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece"), "doc_id", "text")
    sent = dealt_by(texts, size, "piece").sortWithinPartitions("piece").mapInArrow(send(bits), SENT)
    answers = cut_lineage(dealt_by(sent, size, "shard").sortWithinPartitions("shard").mapInArrow(answer(), ANSWER))
    release(docs.sparkSession)
    asked = cut_lineage(with_answers(texts, answers, size).mapInArrow(show(), ASKED_FOR))
    release(docs.sparkSession)
    contexts = asked.filter("not parted").drop("parted")
    if asked.filter("parted").limit(1).count():
        contexts = contexts.union(with_other_parts(asked))
    found = cut_lineage(dealt_by(contexts, size, "shard").sortWithinPartitions("shard").mapInArrow(sort_contexts(), FOUND))
    return with_answers(texts, answers.union(found), size).mapInArrow(finish(), RESULT)


def with_answers(texts: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """Each piece's texts and the answers to it, together and in a row."""
    own = texts.select("piece", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "doc_id", "text")
    said = answers.select("piece", "kind", "payload", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return dealt_by(own.union(said), size, "piece").sortWithinPartitions("piece")
