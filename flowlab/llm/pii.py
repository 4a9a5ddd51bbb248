"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

The fixed patterns' spans are the seeds; the words around them are lexical
patterns. Words that stand where a pattern has its seeds are instances: strings
with a digit, runs of digit groups, handles and names can be identifiers, any other
word only speaks against the pattern. Patterns and instances form a bipartite graph
over which Spark passes confidence back and forth: a pattern trusts the share of its
instances that are trusted, an instance trusts its patterns. Trusted instances show
further patterns where else they stand, until nothing new appears.

The texts are scanned once for the seeds, and twice per step: for what stands
in the slots of new patterns, and for the places of new identifiers. Patterns that parts of the
texts refute are not looked for in all of them. A scan knows what to
look for by a bitmap of fixed size; joins drop its false hits. Rows are known by
their place in a scan: the input must give the same rows in the same partitions every
time, as files and checkpoints do.
"""

from __future__ import annotations

import bisect
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_rows, point_offsets, to_points
from flowlab.session import settle

KINDS = ["email", "ip", "card", "phone", "context"]
BASE_KINDS = 4

LOCAL_SET = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken as whole runs: a match from inside a run would also have matched from its start.
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = b"0123456789"
MARKS = DIGITS + b"@"
SPACES = re.compile(rb"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Digit groups that may be parts of one identifier, and words that may be parts of one name.
GROUP = re.compile(rb"[A-Za-z]*[0-9][A-Za-z0-9]*(?:[-./][A-Za-z0-9]+)*")
NAME = re.compile(rb"[A-Z][A-Za-z'-]*|[A-Z]\.")
#: A handle: letters joined by a mark.
HANDLE = re.compile(rb"[A-Za-z\x80-\xff][._@/'-][A-Za-z\x80-\xff]")

#: Confidence in thousandths: of seeds, of instances found by context, and the least of a pattern to pass on.
SURE = 1000
FOUND = 900
MIN_CONFIDENCE = 700
#: The least distinct instances of a pattern, and the damping of an unsupported pattern.
MIN_SUPPORT = 3
PRIOR = 1
#: Of so many rows one is tried before all rows are scanned, step by step.
TRIALS = (64, 8)
#: Positions of the bitmap that a scan takes along: two megabytes.
FILTER_BITS = 1 << 24
#: Words whose properties a task keeps.
KNOWN_WORDS = 300_000
#: Parts that the instances of a pattern, and the patterns of an instance, are dealt in for joins.
SALTS = 16


def email_spans(data: bytes) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping matches, found from each ``@``: the local part is the run of its characters before it."""
    spans, last, at = [], 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > last and data[start - 1] in LOCAL_SET:
            start -= 1
        m = DOMAIN.match(data, at + 1) if start < at else None
        if m:
            last = m.end()
            spans.append((start, last, 0))
        at = data.find(b"@", max(at + 1, last))
    return spans


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def byte_spans(data: bytes) -> list[tuple[int, int, int]]:
    spans = email_spans(data)
    for m in IP.finditer(data):
        parts = [p.lstrip(b"0") or b"0" for p in m.group().split(b".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append((m.start(), m.end(), 1))
    for m in CARD.finditer(data):
        digits = m.group().translate(None, b" -")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(data):
        if 10 <= len(m.group().translate(None, b"+ ().-")) <= 15:
            spans.append((m.start(), m.end(), 3))
    return spans


@functools.lru_cache(maxsize=100_000)
def shape(value: bytes) -> str:
    """Digits as 9, letters as a, runs of four and more shortened: the form of an identifier."""
    text = re.sub(rb"[A-Za-z]", b"a", re.sub(rb"[0-9]", b"9", value)).decode("utf-8", "replace")
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", text)


FULL = (1 << 64) - 1
#: What a mixed hash stands for.
FORM, LEFT, BOTH, PLACE, HEAD = 1, 2, 3, 4, 5


def hashed(tag: str, value: bytes) -> int:
    """Hash of a word of any length."""
    return xxhash.xxh64_intdigest(tag.encode() + b"\0" + value)


def mixed(tag: int, *hashes):
    """One hash of several in their order: of numbers, or place by place of arrays of unsigned longs."""
    out = tag
    for h in hashes:
        out = ((out ^ h) * 0x9E3779B97F4A7C15) & FULL
        out = out ^ (out >> 32)
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: Coarse hashes of words come from numbers of their bytes and of the bytes' places; bytes beyond the last place do not count.
PLACES = 64
_numbers = np.random.default_rng(7).integers(1, 1 << 63, 256 + PLACES, np.uint64)
BYTE_NUMBER, PLACE_NUMBER = _numbers[:256] | np.uint64(1), np.append(_numbers[256:] | np.uint64(1), np.uint64(0))
#: What a byte is: white space, a letter or digit, and in shapes.
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
IS_PUNCTUATION = np.isin(np.arange(256), list(PUNCTUATION))
IS_DIGIT, IS_MARK = np.isin(np.arange(256), list(DIGITS)), np.isin(np.arange(256), list(MARKS))
FORM_OF = np.array([97 if chr(c).isalpha() and c < 128 else 57 if 48 <= c < 58 else c for c in range(256)], np.uint64)
#: Bytes of a text whose words are hashed at once, and of short texts that are looked at together.
PIECE, TOGETHER = 1 << 20, 1 << 18


@functools.lru_cache(maxsize=100_000)
def coarse(word: bytes) -> int:
    """The coarse hash of one word without regard to A-Z and a-z, equal to that of ``coarse_words``."""
    own = np.frombuffer(word.lower()[:PLACES], np.uint8)
    return int((BYTE_NUMBER[own] * PLACE_NUMBER[: len(own)]).sum(dtype=np.uint64)) if len(own) else 0


def coarse_form(value: bytes) -> int:
    """The first three bytes of a value as in its shape, and whether it holds a digit or ``@``, as its shape then does."""
    own = FORM_OF[np.frombuffer(value[:3], np.uint8)].tolist()
    return sum(c << (8 * k) for k, c in enumerate(own)) + ((len(value.translate(None, MARKS)) < len(value)) << 24)


def parts(word: bytes) -> tuple[int, int]:
    """Where the possible instance in a word begins and ends: behind the last ``:`` or ``=``, without outer punctuation."""
    end = len(word.rstrip(PUNCTUATION))
    cut = max(word.rfind(b":", 0, end), word.rfind(b"=", 0, end)) + 1
    return end - len(word[cut:end].lstrip(PUNCTUATION)), end


def could_identify(value: bytes) -> bool:
    """Whether a string can be an identifier: it holds a digit, is a handle or begins with a capital."""
    if len(value.translate(None, DIGITS)) < len(value) or HANDLE.search(value):
        return True
    return value[:4].decode("utf-8", "ignore")[:1].isupper()


#: Instances of groups and of names, as bits of ``facts``.
GROUPS, NAMES = 1, 2


def facts(word: bytes) -> tuple[int, int, int, int]:
    """Where a word's instance lies, and whether its end may be followed, and its beginning preceded, by another group or name."""
    a, b = parts(word)
    own, following = word[a:], word[:b]
    ends = begins = 0
    if len(word.translate(None, DIGITS)) < len(word):
        ends, begins = GROUPS * (GROUP.fullmatch(own) is not None), GROUPS * (GROUP.fullmatch(following) is not None)
    if not word.islower():
        ends, begins = ends + NAMES * (NAME.fullmatch(own) is not None), begins + NAMES * (NAME.fullmatch(following) is not None)
    return a, b, ends, begins


class Facts(dict):
    """``facts`` of the words that were asked for."""

    def __missing__(self, word: bytes) -> tuple[int, int, int, int]:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = facts(word)
        return found


FACTS = Facts()


class Text:
    """The words of a text, and the mentions that begin at them."""

    def __init__(self, data: bytes, base: list[tuple[int, int, int]], bounds: list[tuple[int, int]] | None = None):
        self.data = data
        self.bounds = [m.span() for m in WORD.finditer(data)] if bounds is None else bounds
        self.starts = [a for a, _ in self.bounds]
        self.taken = bytearray(len(self.bounds))
        self.runs: dict[tuple[int, int], int] = {}
        for start, end, _ in base:
            for i in range(self.word_at(start), self.word_at(end - 1) + 1):
                self.taken[i] = 1

    def word_at(self, spot: int) -> int:
        return bisect.bisect_right(self.starts, spot) - 1

    def word(self, i: int) -> bytes:
        if not 0 <= i < len(self.bounds):
            return b""
        a, b = self.bounds[i]
        return self.data[a:b]

    def joined(self, i: int, kind: int) -> bool:
        """Whether words i and i + 1 are parts of one instance: of one kind, a single blank between them."""
        if i < 0 or i + 1 >= len(self.bounds) or not FACTS[self.word(i)][2] & FACTS[self.word(i + 1)][3] & kind:
            return False
        return not self.taken[i] and not self.taken[i + 1] and self.data[self.bounds[i][1] : self.bounds[i + 1][0]] == b" "

    def last(self, i: int, kind: int) -> int:
        """The last word of the run that word i belongs to; a run is followed once."""
        j = i
        while (found := self.runs.get((j, kind))) is None and self.joined(j, kind):
            j += 1
        end = j if found is None else found
        self.runs.update(((k, kind), end) for k in range(i, j + 1))
        return end

    def around(self, start: int, end: int) -> tuple[list[tuple[int, int]], int]:
        """The hashed patterns of a span, each with a coarse hash, and the coarse hash of the word before.

        That is the word before and the punctuation in front of the span or, where the span's
        word begins with more than punctuation, that beginning.
        """
        i, j = self.word_at(start), self.word_at(end - 1)
        lead, rest = self.data[self.bounds[i][0] : start].lower(), self.data[end : self.bounds[j][1]]
        inside = bool(lead.strip(PUNCTUATION))
        first, before = self.word(i - 1 - (not inside)).lower(), b"" if inside else self.word(i - 1).lower()
        if not inside and not before:
            return [], 0
        after = rest or self.word(j + 1).lower()
        place = mixed(PLACE, hashed("word", before) if before else 0, hashed("lead", lead))
        near, value = coarse(before), self.data[start:end]
        found = [(mixed(FORM, place, hashed("shape", shape(value).encode())), mixed(FORM, near, coarse_form(value)))]
        if first:
            found.append((mixed(LEFT, place, hashed("word", first)), mixed(LEFT, near, coarse(first))))
        if after:
            found.append((mixed(BOTH, place, hashed("word", after)), mixed(BOTH, near, coarse(after))))
        return found, mixed(PLACE, near)

    def instance(self, i: int) -> tuple[int, int] | None:
        """The instance that begins with word i, if one does: digit groups from their first, names from here on."""
        if i >= len(self.bounds) or self.taken[i] or self.joined(i - 1, GROUPS):
            return None
        a, b, ends, _ = FACTS[self.word(i)]
        if a >= b:
            return None
        start, end = self.bounds[i][0] + a, self.bounds[i][0] + b
        for kind in (GROUPS, NAMES) if ends else ():
            j = self.last(i, kind)
            if j > i:
                return start, self.bounds[j][0] + FACTS[self.word(j)][1]
        return start, end


MENTION = "array<struct<start:long,stop:long,value:long,head:long,near:long,able:boolean,gate:long,patterns:array<struct<pattern:long,coarse:long>>>>"


def _mention(text: Text, start: int, end: int, gate: int, patterns: list[tuple[int, int]]) -> dict:
    value = text.data[start:end]
    head = value.split(None, 1)[0]
    return {"start": start, "stop": end, "value": signed(hashed("value", value)), "head": signed(hashed("head", head)), "near": signed(mixed(HEAD, coarse(head))), "able": could_identify(value), "gate": signed(gate), "patterns": [{"pattern": signed(p), "coarse": signed(c)} for p, c in patterns]}


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every whole text in code points, and the seeds with their patterns."""

    def make(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "row_no", "base", "mentions")}
            for doc_id, row_no, data in zip(b["doc_id"], b["row_no"], b["text"]):
                data = data or b""
                base = byte_spans(data)
                text = Text(data, base) if base else None
                out["doc_id"].append(doc_id)
                out["row_no"].append(row_no)
                out["base"].append([{"start": s, "stop": e, "kind": k} for s, e, k in to_points(data, base)])
                out["mentions"].append([_mention(text, s, e, *reversed(text.around(s, e))) for s, e, _ in base])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(_numbered(docs), make, f"doc_id {kind}, row_no long, base array<struct<start:long,stop:long,kind:int>>, mentions {MENTION}")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())


#: What stands between texts that are looked at together; no context reaches beyond it.
BETWEEN = b"\0\0between\0\0texts\0\0"


class Vocabulary(dict):
    """Numbers of words, and columns with what a slot at a word, or beside it, depends on.

    low: the word in lower case; lead: what is in front of the instance.
    """

    #: Bits of ``flags``: an instance is there, more than punctuation in front of it, a wanted instance may begin
    #: here; then, two bits each, ``facts``' ends and begins; a plain word, never an identifier nor part of a base span.
    VALID, INSIDE, HEAD, ENDS, BEGINS, PLAIN = 1, 2, 4, 3, 5, 128

    def __init__(self, packed: np.ndarray, values: bool):
        self.packed, self.view, self.values = packed, memoryview(packed), values
        self.no_lead = hashed("lead", b"")
        self.pairs: list[np.ndarray] = []
        self.forms: dict[bytes, tuple[int, int, int]] = {}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.forms.clear()
        self.low, self.lead, self.flags = array("Q"), array("Q"), array("B")

    def has(self, keys: np.ndarray) -> np.ndarray:
        spots = (keys & (FILTER_BITS - 1)).astype(np.int64)
        return (self.packed[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0

    def wanted(self, key: int) -> bool:
        spot = key & (FILTER_BITS - 1)
        return self.view[spot >> 3] >> (spot & 7) & 1 == 1

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.flags)
        if not word or word == BETWEEN:
            self.low.append(0)
            self.lead.append(self.no_lead)
            self.flags.append(0)
            return n
        self.low.append(hashed("word", word.lower()))
        if word.isalpha() and word.islower():
            self.lead.append(self.no_lead)
            self.flags.append(self.VALID + self.PLAIN + self.HEAD * self.wanted(hashed("head", word)))
            return n
        a, b, ends, begins = facts(word)
        lead = word[:a].lower()
        self.lead.append(hashed("lead", lead) if a else self.no_lead)
        head = self.wanted(hashed("head", word[a:b])) or (ends > 0 and self.wanted(hashed("head", word[a:])))
        plain = a < b and b"@" not in word and len(word.translate(None, DIGITS)) == len(word) and not could_identify(word[a:b])
        self.flags.append(plain * self.PLAIN + (a < b) * self.VALID + (a > 0 and bool(lead.strip(PUNCTUATION))) * self.INSIDE + head * self.HEAD + (ends << self.ENDS) + (begins << self.BEGINS))
        return n

    def form(self, word: bytes) -> tuple[int, int, int]:
        """The shape of a word's instance, what is behind it, and the instance as a value."""
        found = self.forms.get(word)
        if found is None:
            a, b = parts(word)
            self.forms[word] = found = (hashed("shape", shape(word[a:b]).encode()), hashed("word", word[b:]) if b < len(word) else 0, hashed("value", word[a:b]))
        return found


def coarse_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, and their coarse hashes."""
    all_bounds, start = [], 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        if stop < len(data):
            # A piece ends with white space, so that no word is cut.
            blank = SPACES.search(data, stop)
            stop = blank.end() if blank else len(data)
        piece = np.frombuffer(data[start:stop].lower(), np.uint8)
        word = ~IS_SPACE[piece]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            long = np.minimum(ends - starts, PLACES)
            at = np.cumsum(long) - long
            place = np.arange(int(long.sum())) - np.repeat(at, long)
            hashes = np.add.reduceat(BYTE_NUMBER[piece[np.repeat(starts, long) + place]] * PLACE_NUMBER[place], at)
            all_bounds.append((starts + start, ends + start, hashes))
        start = stop
    if not all_bounds:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*all_bounds))


def moved(values: np.ndarray, by: int) -> np.ndarray:
    """``values`` of the place ``by`` places on; zero beyond the ends."""
    out = np.zeros_like(values)
    if abs(by) < len(values):
        if by > 0:
            out[:-by] = values[by:]
        else:
            out[-by:] = values[:by]
    return out


def possible_words(data: bytes, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words begin and end, and those at which a wanted instance may begin by the coarse hashes of all words.

    Words with punctuation at an end pass by the word before, but for one closing sign, those with ``:`` or
    ``=`` always; so do words that may belong together, by the word before. Where values are wanted, words with
    punctuation at an end always pass, and no word before counts.
    """
    starts, ends, near = coarse_words(data)
    if not len(starts):
        return starts, ends, starts
    own = np.frombuffer(data, np.uint8)
    head, tail = own[starts], own[ends - 1]
    odd = IS_PUNCTUATION[head] | IS_PUNCTUATION[tail]
    inner = np.zeros(len(starts), bool)
    for mark in (b":", b"="):
        if mark in data:
            inner[np.searchsorted(starts, np.flatnonzero(own == mark[0]), "right") - 1] = True
    if known.values:
        return starts, ends, np.flatnonzero(inner | known.has(mixed(HEAD, near)) | odd)
    before = moved(near, -1)
    gate = known.has(mixed(PLACE, before))
    gate[0] = False
    hit = inner
    at = np.flatnonzero(gate & ~hit)
    if len(at):
        nexts = np.minimum(at + 1, len(starts) - 1)
        capital = (head >= 65) & (head <= 90)
        # Groups that belong together hold digits; a word is then taken for one if it begins or ends with a digit or a letter.
        grouped = _holds(IS_DIGIT, own, starts, ends, at) & _holds(IS_DIGIT, own, starts, ends, nexts)
        # Where one sign closes a longer word, that is what stands behind the instance.
        closed = odd[at] & ~IS_PUNCTUATION[head[at]] & (tail[at] != 64) & (ends[at] - starts[at] > 3)
        closed &= ~IS_PUNCTUATION[own[ends[at] - 2]]
        behind = np.where(closed, BYTE_NUMBER[tail[at]] * PLACE_NUMBER[0], moved(near, 1)[at])
        form = FORM_OF[head[at]] | np.where(_holds(IS_MARK, own, starts, ends, at), np.uint64(1 << 24), np.uint64(0))
        for k in (1, 2):
            there = starts[at] + k < ends[at]
            form = form | np.where(there, FORM_OF[own[np.minimum(starts[at] + k, len(own) - 1)]] << np.uint64(8 * k), np.uint64(0))
        close = before[at]
        hit[at] = (
            (odd[at] & ~closed) | (capital[at] & (capital[nexts] | IS_PUNCTUATION[head[nexts]])) | grouped
            | known.has(mixed(FORM, close, form)) | known.has(mixed(LEFT, close, moved(near, -2)[at])) | known.has(mixed(BOTH, close, behind))
        )
    return starts, ends, np.flatnonzero(hit)


def _holds(wanted: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the words ``at`` hold a wanted byte."""
    spots = np.flatnonzero(wanted[own])
    return np.searchsorted(spots, starts[at]) < np.searchsorted(spots, ends[at])


NO_PAIRS = np.empty((0, 2), np.uint64)


def likely_slots(data: bytes, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words begin and end, those at which an instance may begin whose value, or one of whose patterns, is wanted, and pairs of plain words.

    No wanted one is left out, also if ``data`` is several texts with BETWEEN between them. A plain
    word in a slot only speaks against its pattern: distinct (pattern, value) say all about it. Possible words are looked up in arrays, first by their place, then
    by their patterns. Where further words may belong to the instance, the place decides. A wanted
    value is known by its first word alone, as is one of several words.
    """
    starts, ends, possible = possible_words(data, known)
    if not len(possible):
        return starts, ends, possible, NO_PAIRS

    def words(by: int) -> list[bytes]:
        there = possible + by
        inside = (there >= 0) & (there < len(starts))
        there = np.where(inside, there, 0)
        return [data[a:b] if ok else b"" for a, b, ok in zip(starts[there].tolist(), ends[there].tolist(), inside.tolist())]

    def column(values: array, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(values, values.typecode)[at]

    own = words(0)
    if known.values:
        flags = column(known.flags, np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        return starts, ends, possible[(flags & (known.VALID | known.HEAD | known.PLAIN)) == known.VALID | known.HEAD], NO_PAIRS
    codes, second, first_, next_ = (np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in (own, words(-1), words(-2), words(1)))
    lead, flags, previous = column(known.lead, codes), column(known.flags, codes), column(known.low, second)
    inside, valid = (flags & known.INSIDE) > 0, (flags & known.VALID) > 0
    before = np.where(inside, np.uint64(0), previous)
    place = mixed(PLACE, before, lead)
    hit, pairs = valid & ((flags & known.HEAD) > 0) & ((flags & known.PLAIN) == 0), NO_PAIRS
    at = np.flatnonzero(valid & ~hit & (inside | (before > 0)))
    if len(at):
        forms, rest, values = np.array([known.form(own[i]) for i in at.tolist()], np.uint64).T
        first = np.where(inside, previous, column(known.low, first_))[at]
        after = np.where(rest > 0, rest, column(known.low, next_)[at])
        longer = (flags[at] >> known.ENDS) & (column(known.flags, next_)[at] >> known.BEGINS) & 3
        patterns = [mixed(FORM, place[at], forms), mixed(LEFT, place[at], first), mixed(BOTH, place[at], after)]
        there = [known.has(patterns[0]), known.has(patterns[1]) & (first > 0), known.has(patterns[2]) & (after > 0)]
        plain = (flags[at] & known.PLAIN) > 0
        hit[at] |= ~plain & ((longer > 0) | there[0] | there[1] | there[2])
        pairs = np.concatenate([np.stack([p[t & plain], values[t & plain]], 1) for p, t in zip(patterns, there)])
    return starts, ends, possible[hit], pairs


def texts_with_slots(texts: list[bytes], known: Vocabulary) -> Iterator[tuple[int, list[int], list[tuple[int, int]]]]:
    """Number, likely slots and word bounds of the texts that have slots; short texts are looked at together.

    Pairs of plain words are kept in ``known.pairs``.
    """
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) < TOGETHER:
            size += len(texts[last]) + 1
            last += 1
        between = b"\n" + BETWEEN + b"\n"
        starts, ends, slots, pairs = likely_slots(between.join(texts[first:last]), known)
        known.pairs.append(pairs)
        if len(slots):
            begins = np.cumsum([0, *(len(t) + len(between) for t in texts[first:last])])
            words, own = np.searchsorted(starts, begins), np.searchsorted(slots, np.searchsorted(starts, begins))
            for k in range(last - first):
                if own[k] < own[k + 1]:
                    a, b = words[k], words[k + 1] - (k + 1 < last - first)
                    yield first + k, (slots[own[k] : own[k + 1]] - a).tolist(), [*zip((starts[a:b] - begins[k]).tolist(), (ends[a:b] - begins[k]).tolist())]
        first = last


def bitmap(keys: DataFrame) -> list[tuple[int, bytes]]:
    """The column ``key`` as bits; at most FILTER_BITS of them, however many keys there are."""
    spot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts_ = keys.select(F.bitmap_bucket_number(spot).alias("part"), F.bitmap_bit_position(spot).alias("bit"))
    return [(r["part"] - 1, bytes(r["bits"])) for r in parts_.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()]


def scan_for(docs: DataFrame, keys: DataFrame, values: bool) -> DataFrame:
    """(row_no, start, stop, value, head, near, able, gate, pattern, coarse) of instances whose value or pattern may be among ``keys``.

    An instance found by its value comes with all its patterns. Base spans are not repeated.
    Plain words in slots come as distinct (pattern, value) of a batch, without a place.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(keys))

    def make(batches):
        packed = np.zeros(FILTER_BITS // 8, np.uint8)
        for part, data in held.value:
            packed[part * 4096 : (part + 1) * 4096] = np.frombuffer(data, np.uint8)
        vocabulary = Vocabulary(packed, values)

        for b in batches:
            out = {c: [] for c in ("row_no", "mentions", "pattern", "value")}
            if len(vocabulary) > KNOWN_WORDS:
                vocabulary.empty()
            texts = [t or b"" for t in b["text"]]
            for k, slots, bounds in texts_with_slots(texts, vocabulary):
                row_no, data = b["row_no"][k], texts[k]
                text, found = Text(data, byte_spans(data), bounds), []
                for i in slots:
                    span = text.instance(i)
                    if span is None:
                        continue
                    patterns, gate = text.around(*span)
                    if not vocabulary.wanted(hashed("value", data[slice(*span)])):
                        patterns = [p for p in patterns if vocabulary.wanted(p[0])]
                    if patterns:
                        found.append(_mention(text, *span, gate, patterns))
                spots = sorted({x for m in found for x in (m["start"], m["stop"])})
                at = dict(zip(spots, point_offsets(data, spots)))
                out["row_no"].append(row_no)
                out["mentions"].append([m | {"start": at[m["start"]], "stop": at[m["stop"]]} for m in found])
            pairs = np.unique(np.concatenate([*vocabulary.pairs, NO_PAIRS]), axis=0).view(np.int64).tolist()
            vocabulary.pairs.clear()
            out["row_no"] += [None] * len(pairs)
            out["mentions"] += [None] * len(pairs)
            out["pattern"] = [None] * (len(out["row_no"]) - len(pairs)) + [p for p, _ in pairs]
            out["value"] = [None] * (len(out["row_no"]) - len(pairs)) + [v for _, v in pairs]
            yield out

    found = map_rows(_numbered(docs), make, f"row_no long, mentions {MENTION}, pattern long, value long")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    own = F.array(F.struct(F.col("pattern"), zero.alias("coarse")))
    plain = F.struct(none.alias("start"), none.alias("stop"), F.col("value"), zero.alias("head"), zero.alias("near"), F.lit(False).alias("able"), zero.alias("gate"), own.alias("patterns"))
    return _laid_out(found.withColumn("mentions", F.when(F.col("pattern").isNotNull(), F.array(plain)).otherwise(F.col("mentions"))))


def _laid_out(found: DataFrame) -> DataFrame:
    each = found.select("row_no", F.explode("mentions").alias("m"))
    return each.select("row_no", "m.start", "m.stop", "m.value", "m.head", "m.near", "m.able", "m.gate", F.explode("m.patterns").alias("p")).select("*", "p.pattern", "p.coarse").drop("p")


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _copied(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))


def score_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) of confident patterns, in thousandths, and (value) of the instances they reach.

    ``edges``: distinct (pattern, value, able, seed), all instances of every pattern. A pattern's
    score is the summed trust of its distinct instances over their number plus PRIOR; a seed
    counts SURE, another instance that can be an identifier and has a confident pattern counts
    FOUND, any other nothing. Reached instances only become more, so the rounds end where
    none is new. Joins deal a pattern's instances, and an instance's patterns, in SALTS parts.
    """
    edges = settle(edges)
    reached, before = None, 0
    while True:
        trust = F.when(F.col("seed"), SURE).when(F.col("found"), FOUND).otherwise(0)
        marked = edges.withColumn("found", F.lit(False)) if reached is None else _salted(edges, "pattern").join(_copied(reached.withColumn("found", F.lit(True))), ["value", "salt"], "left")
        sums = marked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(trust).alias("trust")).where(F.col("n") >= MIN_SUPPORT)
        scores = settle(sums.select("pattern", F.expr(f"trust div (n + {PRIOR})").alias("score")).where(F.col("score") >= MIN_CONFIDENCE))
        reached = settle(_salted(edges.where("able AND NOT seed"), "value").join(_copied(scores), ["pattern", "salt"], "left_semi").select("value").distinct())
        now = reached.count()
        if now == before:
            return scores, reached
        before = now


def unrefuted(docs: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates, (pattern, gate, coarse), that may be confident while no more than ``known``, (pattern, value), is trusted.

    What else stands in a pattern's slots, in whatever part of the texts, only lowers its score: with
    n distinct instances in that part and k known ones the score over all texts is at most SURE * k div (n + PRIOR).
    So a part refutes patterns for good, and common words refute most in a small one; the others are tried on a larger part.
    """
    for share in TRIALS:
        if candidates.isEmpty():
            break
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
        keys = candidates.select(F.explode(F.array("pattern", "gate", "coarse")).alias("key"))
        there = scan_for(part, keys, False).select("pattern", "value", F.lit(False).alias("known"))
        edges = known.select("pattern", "value", F.lit(True).alias("known")).unionByName(there).groupBy("pattern", "value").agg(F.max("known").alias("known"))
        open_ = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("known").alias("k")).where(SURE * F.col("k") >= MIN_CONFIDENCE * (F.col("n") + PRIOR))
        candidates = settle(candidates.join(open_.select("pattern"), "pattern", "left_semi"))
    return candidates


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, base spans and all spans, one row per row of ``docs``.

    A missing or empty text has no spans; texts of any length are read in whole. Repeated
    rows have equal spans and count once, as patterns and instances are distinct. Added
    spans overlap no word of a base span; names that begin inside of a longer name may overlap
    it. Other columns are not read; an empty table gives no rows.
    """
    found = settle(scan(docs))
    seeds = _laid_out(found).select("pattern", "value", "head", "near", "gate", "coarse", "able", F.lit(True).alias("seed")).distinct()
    known = edges = settle(seeds)
    places, patterns, looked_for = None, None, None
    while True:
        counted = known.groupBy("pattern", "gate", "coarse").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= MIN_SUPPORT)
        new = settle(counted.select("pattern", "gate", "coarse") if patterns is None else counted.select("pattern", "gate", "coarse").join(patterns, "pattern", "left_anti"))
        new = unrefuted(docs, known, new)
        if new.isEmpty():
            break
        patterns = new.select("pattern") if patterns is None else patterns.unionByName(new.select("pattern"))
        keys = new.select(F.explode(F.array("pattern", "gate", "coarse")).alias("key"))
        own = _salted(scan_for(docs, keys, False), "value").join(_copied(new.select("pattern")), ["pattern", "salt"], "left_semi").drop("salt")
        places = settle(own if places is None else places.unionByName(own))
        instances = places.select("pattern", "value", "head", "near", "gate", "coarse", "able", F.lit(False).alias("seed"))
        edges = seeds.unionByName(instances).groupBy("pattern", "value").agg(F.max("able").alias("able"), F.max("seed").alias("seed"))
        scores, reached = score_graph(_salted(edges, "value").join(_copied(patterns), ["pattern", "salt"], "left_semi").drop("salt"))
        fresh = instances.where("able").select("value", "head", "near").distinct().join(reached, "value", "left_semi")
        fresh = settle(fresh if looked_for is None else fresh.join(looked_for, "value", "left_anti"))
        if fresh.isEmpty():
            break
        looked_for = fresh.select("value") if looked_for is None else looked_for.unionByName(fresh.select("value"))
        keys = fresh.select(F.explode(F.array("value", "head", "near")).alias("key"))
        seen = _salted(scan_for(docs, keys, True), "pattern").join(_copied(fresh.select("value")), ["value", "salt"], "left_semi")
        known = settle(known.unionByName(seen.select("pattern", "value", "head", "near", "gate", "coarse", "able", F.lit(False).alias("seed"))).distinct())
    spans = "array<struct<start:long,stop:long,kind:int>>"
    if places is None:
        return found.select("doc_id", "row_no", "base", F.col("base").alias("spans"))
    added = (
        _salted(places.where("able"), "row_no")
        .join(_copied(scores.select("pattern")), ["pattern", "salt"], "left_semi")
        .groupBy("row_no")
        .agg(F.collect_set(F.struct("start", "stop", F.lit(BASE_KINDS).alias("kind"))).alias("new"))
    )
    all_spans = F.sort_array(F.concat("base", F.coalesce("new", F.array().cast(spans))))
    return found.select("doc_id", "row_no", "base").join(added, "row_no", "left").select("doc_id", "row_no", "base", all_spans.alias("spans"))


def _digest_text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    """Base spans of one kind; a second parameter of the lambda would be the span's place in the array."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every whole text, one row per row of ``docs``; nulls, odd texts and repeated rows as in ``pii_spans``."""
    by_start = F.array_sort("base", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["kind"] - b["kind"]).cast("int")))
    all_spans = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["kind"] - b["kind"]).cast("int")))
    return pii_spans(docs).select("doc_id", *map(_count, range(BASE_KINDS)), F.sha2(_digest_text(by_start).cast("binary"), 256).alias("base_sha256"), _digest_text(all_spans).alias("spans"))
