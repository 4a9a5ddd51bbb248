"""Secret scans: fixed patterns, and windows of high character entropy.

Candidate strings are runs of key characters. Over each a window slides, whose
character counts change by one character in and one out, so that its Shannon
entropy costs a constant per step. A candidate whose best window reaches the
threshold of its character class becomes a span, unless an allow-list rule
knows it as harmless.
"""

from __future__ import annotations

import re
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import ASCII_LOWER, add_columns, free_of, map_rows, sha256_hex, span_text, to_points, unpacked

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"]
BASE_KINDS = 3

#: Matched on lower-cased bytes: of ASCII letters either case counts, and no other character lower-cases to one.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: A run of at least 24 is the whole run, because its leftmost match starts the run.
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Least entropy in bits of a window of WINDOW characters, by character class.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.7, "entropy_base64": 3.9}
#: Harmless strings: UUIDs, letters alone such as words and paths of them, digits alone such as dates; and strings with a placeholder in them.
ALLOWED = [
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(rb"[A-Za-z_/=+-]+"),
    re.compile(rb"[0-9_/=+-]+"),
]
PLACEHOLDER = re.compile(rb"example|sample|placeholder|changeme|your_|xxxx|dummy", re.IGNORECASE)

#: c * log2(c) for the counts within a window.
PLOGP = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def best_entropy(data: bytes, width: int = WINDOW) -> float:
    """The largest Shannon entropy of a window of ``width`` bytes, by incremental counts; 0 for shorter data."""
    if len(data) < width:
        return 0.0
    counts = [0] * 256
    total = 0.0
    best = -1.0
    for i, new in enumerate(data):
        c = counts[new]
        total += PLOGP[c + 1] - PLOGP[c]
        counts[new] = c + 1
        if i >= width - 1:
            if best < 0 or total < best:
                best = total
            old = data[i - width + 1]
            c = counts[old]
            total += PLOGP[c - 1] - PLOGP[c]
            counts[old] = c - 1
    return log2(width) - best / width


def character_class(data: bytes) -> int:
    if not data.translate(None, b"0123456789abcdefABCDEF"):
        return 3
    return 4 if data.isalnum() else 5


def allowed(data: bytes) -> bool:
    return any(rule.fullmatch(data) for rule in ALLOWED) or PLACEHOLDER.search(data) is not None


def entropy_spans(data: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of high entropy that no pattern span overlaps."""
    found = []
    for m in free_of(CANDIDATE.finditer(data), taken):
        value = m.group()
        if allowed(value):
            continue
        kind = character_class(value)
        if best_entropy(value) >= THRESHOLDS[KINDS[kind]]:
            found.append((m.start(), m.end(), kind))
    return found


def byte_spans(data: bytes) -> list[tuple[int, int, int]]:
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data.translate(ASCII_LOWER)) if len(m.group(2)) >= 6]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    return spans + entropy_spans(data, spans)


def find_secrets(data: bytes | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind."""
    return to_points(data, byte_spans(data)) if data else []


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every whole text, one row per row of ``docs``; a missing text is empty."""

    def make(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for doc_id, data in zip(b["doc_id"], b["text"]):
                spans = find_secrets(data)
                base = [s for s in spans if s[2] < BASE_KINDS]
                row = (doc_id, *(sum(s[2] == k for s in base) for k in range(BASE_KINDS)), sha256_hex(span_text(base, KINDS).encode()), span_text(spans, KINDS))
                for values, x in zip(out.values(), row):
                    values.append(x)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(data: bytes | None) -> tuple[str | None, int]:
    """The text with every span, overlapping ones joined, replaced by ``[SECRET]``; and how many were replaced."""
    if not data:
        return (None if data is None else ""), 0
    parts, at, n = [], 0, 0
    for start, end, _ in sorted(byte_spans(data)):
        if start >= at:
            parts += [data[at:start], b"[SECRET]"]
            n += 1
        at = max(at, end)
    parts.append(data[at:])
    return b"".join(parts).decode("utf-8", "replace"), n


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; texts with secrets have them replaced, and n_chars where it is a column counts anew."""
    found = add_columns(docs, ["text"], redacted, "clean string, replaced long")
    changed: dict[str, Column] = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        was = F.col("row.n_chars")
        changed["n_chars"] = F.when(F.col("replaced") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(was)
    return unpacked(found, docs.columns, **changed)
