"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths.  The hash of those
that some mapping reads from (paths of roles and texts; all others are
ignored) selects a declarative mapping, which yields canonical (role, text)
turns.  A record that mixes layouts goes by the first mapping, in their order,
whose paths it has.  Tables of any layout, also those that spread a
conversation over rows, go through their records.
The template marks each turn as ``### role: text</turn>`` and a line
feed; inside roles and texts, backslashes and the control strings get a
backslash in front, so that formatting can be read back exactly.

Formatting streams: rows are dealt by conversation, sorted, and written piece
by piece, so a conversation of any length is never one object.  A long one
becomes several parts with running offsets.  Digests of a conversation are
sequential, so one task reads it, however long it is, in bounded memory.

Defined cases: null text and null role count as empty; rows that share a turn
are ordered by role and text; repeated rows are repeated turns; a null
conversation id is a conversation of its own; an empty table gives no rows; a
record that no mapping fits gives no turns and keeps its fingerprint; a
member without a text (a tool call) is an empty turn; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

from loomspark.llm.common import pieces

CONTROL = re.compile(r"\\|###|</turn>|: ")
ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
MARK = re.compile(r"\\(?:\\|###|</turn>|: )|</turn>|: ")
HEAD, TAIL = "### ", "</turn>\n"
#: Characters after which a conversation goes on in another part.
PART = 1 << 20
PARTS = "conv_id long, part long, start long, formatted string, mask array<struct<start:long,end:long>>"
#: The role whose text is under the loss mask.
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"{HEAD}{escape(role)}: ", escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted string; start and end span the escaped text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn at {at}")
        role, start = None, at + len(HEAD)
        for m in MARK.finditer(formatted, start):
            if m[0] == ": " and role is None:
                role, start = unescape(formatted[start : m.start()]), m.end()
            elif m[0] == "</turn>":
                yield role, unescape(formatted[start : m.start()]), start, m.start()
                at = m.start() + len(TAIL)
                break
        else:
            raise ValueError("a turn without an end")


# -- layouts -----------------------------------------------------------------


def paths(value, prefix: str = "", nulls: bool = True) -> set[str]:
    """Nested field paths of a record; list members share one path.  ``nulls``: also those of fields that are null."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if nulls or v is not None for p in (paths(v, f"{prefix}.{k}" if prefix else k, nulls) or {f"{prefix}.{k}" if prefix else k})}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, prefix + "[]", nulls)} or {prefix + "[]"}
    return {prefix}


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """The same of a table's columns."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return {prefix}


def fingerprint(found: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(found)))


def text_of(value) -> str:
    """A text, or the texts of a list of parts."""
    if isinstance(value, list):
        return "".join(text_of(v.get("text") if isinstance(v, dict) else v) for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Mapping:
    """``each``: a list whose members have ``role`` and ``text``; ``fixed``: (role, field) pairs in order; ``optional`` ones of these fields may be missing.

    With ``key`` and ``order`` a record is one turn: role, text, its conversation and its place there; its role stays as written.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    key: str = ""
    order: str = ""

    def spoken(self) -> set[str]:
        """The paths that are always there."""
        own = {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"} if self.each else {self.role, self.text} if self.order else set()
        return own | ({f for _, f in self.fixed} - set(self.optional))

    def layouts(self) -> Iterator[set[str]]:
        parts = f"{self.each}[].{self.text}"  # a text may be a list of parts
        for chosen in product((False, True), repeat=len(self.optional)):
            own = self.spoken() | {f for f, on in zip(self.optional, chosen) if on}
            yield own
            if self.each:
                yield own - {parts} | {parts + "[].text"}
                yield own | {parts + "[].text"}

    def turns(self, record: dict) -> list[tuple[int | None, str, str]]:
        if self.order:
            return [(record.get(self.order), record.get(self.role) or "", text_of(record.get(self.text)))]
        found = [(role, text_of(record[f])) for role, f in self.fixed if record.get(f) not in (None, "")]
        if self.each:
            found += [(text_of(m.get(self.role)), text_of(m.get(self.text))) for m in record.get(self.each) or [] if isinstance(m, dict)]
        return [(i, ROLES.get(r, r), t) for i, (r, t) in enumerate(found)]


# fixed values: names of roles and layouts that are in common use
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("messages", each="messages", role="role", text="content", fixed=(("system", "system"),), optional=("system",)),
    Mapping("conversations", each="conversations", role="from", text="value", fixed=(("system", "system"),), optional=("system",)),
    Mapping("turns", each="turns", role="role", text="text"),
    Mapping("dialogue", each="dialogue", role="speaker", text="utterance"),
    Mapping("prompt-completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt-response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("instruction-response", fixed=(("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=("context",)),
    Mapping("question-answer", fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping("row-text", key="conv_id", order="turn", role="role", text="text"),
    Mapping("row-content", key="conversation_id", order="turn", role="role", text="content"),
    Mapping("row-message", key="thread_id", order="position", role="author", text="message"),
)
BY_FINGERPRINT = {fingerprint(layout): m for m in reversed(MAPPINGS) for layout in m.layouts()}
#: All paths that mappings read from.
SPOKEN = {p for m in MAPPINGS for layout in m.layouts() for p in layout}


@lru_cache(10_000)
def first_that_fits(found: frozenset[str]) -> Mapping | None:
    return next((m for m in MAPPINGS if any(layout <= found for layout in m.layouts())), None)


def mapping_of(given: set[str], every: set[str]) -> Mapping | None:
    """By the fingerprint of the paths that hold something, then of all; then the first that fits."""
    given, every = given & SPOKEN, every & SPOKEN
    return BY_FINGERPRINT.get(fingerprint(given)) or BY_FINGERPRINT.get(fingerprint(every)) or first_that_fits(frozenset(given)) or first_that_fits(frozenset(every))


TURNS = "conv_id long, fingerprint string, layout string, turn long, role string, text string"


def canonical_turns(records: DataFrame, column: str = "record", key: str = "conv_id") -> DataFrame:
    """(conv_id, fingerprint, layout, turn, role, text) of JSON records; a record that no mapping fits gives one row without a turn."""
    arrow = to_arrow_schema(StructType.fromDDL(TURNS))

    def run(batches):
        for piece in pieces(batches, column):
            rows = []
            for conv, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                try:
                    record = json.loads(text) if text else {}
                except ValueError:
                    record = {}
                record = record if isinstance(record, dict) else {}
                every = paths(record)
                mapping = mapping_of(paths(record, nulls=False), every)
                for turn, role, said in (mapping.turns(record) if mapping else None) or [(None, None, None)]:
                    rows.append((conv, fingerprint(every), mapping.name if mapping else None, turn, role, said))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return records.select(key, column).mapInArrow(run, TURNS)


def table_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout, by way of its records; columns that no mapping reads are not."""
    found = schema_paths(df.schema)
    mapping = mapping_of(found, found)
    if mapping is None:
        raise ValueError(f"no mapping has the fields {sorted(found)}")
    key, read = mapping.key or key, {p.split(".")[0].split("[")[0] for p in SPOKEN} | ({mapping.order} if mapping.order else set())
    conv = F.col(key).cast("long") if key in df.columns else F.lit(None).cast("long")
    record = F.to_json(F.struct(*[c for c in df.columns if c in read]), {"ignoreNullFields": "false"})
    return canonical_turns(df.select(conv.alias("conv_id"), record.alias("record"))).filter("layout is not null").select("conv_id", "turn", "role", "text")


# -- formatting --------------------------------------------------------------


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, start, formatted, mask): parts of each conversation in order; offsets count from its first part's start."""
    rows = table_turns(turns).filter("role is not null")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    arrow = to_arrow_schema(StructType.fromDDL(PARTS))

    def run(batches):
        conv, part, start, at, texts, mask = None, 0, 0, 0, [], []
        begun = False

        def close():
            return {"conv_id": conv, "part": part, "start": start, "formatted": "".join(texts), "mask": mask}

        for batch in batches:
            rows, held = [], 0
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if begun and c != conv:
                    rows.append(close())
                    part = start = at = 0
                    texts, mask = [], []
                elif at - start >= PART:
                    rows.append(close())
                    part, start, texts, mask = part + 1, at, [], []
                conv, begun = c, True
                piece, a, b = format_turn(role, text)
                if role == LEARNED:
                    mask.append({"start": at + a, "end": at + b})
                texts.append(piece)
                at += len(piece)
                held += len(piece)
                if held > 8 * PART:
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if begun:
            yield pa.RecordBatch.from_pylist([close()], schema=arrow)

    return dealt.mapInArrow(run, PARTS)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its parts, which lie in order behind each other; hashes grow turn by turn."""
    arrow = to_arrow_schema(StructType.fromDDL(READ_BACK))

    def run(batches):
        held = None

        def close():
            return {k: held[k] for k in ("conv_id", "n_turns", "loss_chars", "formatted_chars")} | {"turns_sha256": held["turns"].hexdigest(), "loss_sha256": held["loss"].hexdigest()}

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if held:
                        rows.append(close())
                    held = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                text = row["formatted"]
                for role, said, _, _ in parse_turns(text):
                    held["n_turns"] += 1
                    held["turns"].update(f"{role}\n{said}\n".encode())
                for span in row["mask"]:
                    learned = unescape(text[span["start"] - row["start"] : span["end"] - row["start"]])
                    held["loss_chars"] += len(learned)
                    held["loss"].update(learned.encode())
                held["formatted_chars"] += len(text)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema=arrow)

    return parts.mapInArrow(run, READ_BACK)
