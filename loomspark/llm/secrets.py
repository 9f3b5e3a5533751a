"""Secret scans: fixed patterns plus sliding-window entropy of candidate strings.

A candidate is a maximal run of token characters.  For each character class,
the candidate's maximal runs of that class are scanned by a window whose
character counts are updated in place as it moves (one character leaves, one
comes in), and so is its Shannon entropy.  Windows that reach the class's
threshold join into spans, unless an allow-listed pattern covers them; windows
that overlap a known string are left out before they join.

Defined cases: null text counts as empty and has no secrets; a null id stays
null; repeated rows give repeated results; spans of equal starts lie in the
order of their kinds; a window exactly at a threshold is hot; a very long text
is scanned as a whole, in time that grows with it; an empty table gives no
rows; other columns are ignored.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from loomspark.llm.common import map_text

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of a window; candidates are at least as long.
WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Bits a character that a window of a class must reach, and what else a window must hold: digits and letters.
CLASSES = {"hex": (re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}"), 3.0), "word": (re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}"), 3.7), "base64": (re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"), 3.9)}
#: Strings that look random but are known to be public.
ALLOWED = (re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/=]+"))
#: Strings that no window may overlap.
KNOWN = re.compile(r"(?i)example|abcdefghij|0123456789")
#: c * log2(c) for all counts of a window.
CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def hot_windows(text: str, threshold: float, known: bytearray | None = None) -> list[tuple[int, int]]:
    """Joined windows of ``text`` whose entropy reaches the threshold and that hold a digit and a letter; none begins where ``known`` is set."""
    counts: dict[str, int] = {}
    weight, digits, spans = 0.0, 0, []
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += CLOG[n + 1] - CLOG[n]
        digits += c.isdigit()
        if i >= WINDOW:
            gone = text[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            weight += CLOG[n - 1] - CLOG[n]
            digits -= gone.isdigit()
        if i >= WINDOW - 1 and weight <= most and 0 < digits < WINDOW and not (known and known[i - WINDOW + 1]):
            start = i - WINDOW + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def entropy_spans(text: str, candidates: list[re.Match]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for m in candidates:
        own, barred = [], None
        for x in KNOWN.finditer(m[0]):
            barred = barred or bytearray(len(m[0]))
            low = max(0, x.start() - WINDOW + 1)
            barred[low : x.end()] = b"\1" * (x.end() - low)
        for pattern, threshold in CLASSES.values():
            for run in pattern.finditer(m[0]):
                own += [(run.start() + a, run.start() + b) for a, b in hot_windows(run[0], threshold, barred and barred[run.start() : run.end()])]
        if not own:
            continue
        known = [x.span() for p in ALLOWED for x in p.finditer(m[0])]
        own = sorted((a, b) for a, b in own if not any(x <= a and b <= y for x, y in known))
        joined: list[list[int]] = []
        for a, b in own:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        found += [(m.start() + a, m.start() + b) for a, b in joined]
    return found


def base_spans(text: str, candidates: list[re.Match]) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k in low for k in KEYWORDS) else [],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else [],
        "hex": [(c.start() + m.start(), c.start() + m.end()) for c in candidates for m in HEX.finditer(c[0])],  # such a run lies in one candidate
    }


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Base spans by kind; entropy spans that no base span covers."""
    text = text or ""
    candidates = list(CANDIDATE.finditer(text))
    base = base_spans(text, candidates)
    flat = sorted(s for spans in base.values() for s in spans)
    starts, furthest = [a for a, _ in flat], list(accumulate((b for _, b in flat), max))

    def covered(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return k > 0 and furthest[k - 1] >= b

    return base, [s for s in entropy_spans(text, candidates) if not covered(*s)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans; one map stage, no shuffle."""

    def run(ids, texts):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
        for text in texts:
            base, more = scan(text)
            flat = [(k, a, b) for k, spans in base.items() for a, b in spans]
            for k in base:
                out[f"n_{k}"].append(len(base[k]))
            out["n_entropy"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(digest(flat).encode()).hexdigest())
            out["spans"].append(digest(flat + [("entropy", a, b) for a, b in more]))
        return {"doc_id": ids} | out

    return map_text(docs, run, SCHEMA, "doc_id", "text")


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every found span replaced."""
    if text is None:
        return None
    base, more = scan(text)
    out, at = [], 0
    for a, b in sorted([s for spans in base.values() for s in spans] + more):
        if b <= at:
            continue
        out += [text[at : max(a, at)], mask if a >= at else ""]
        at = b
    return "".join(out) + text[at:]
