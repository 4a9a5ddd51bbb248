"""Secrets and personal data: base spans against plain regular expressions, and what the methods add."""

import hashlib
import random
import re
from math import log2

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlab.llm import pii, secrets

DIGITS = re.compile("[^0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


SECRET = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(DIGITS.sub("", m.group())) <= 19 and luhn(DIGITS.sub("", m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(DIGITS.sub("", m.group())) <= 15),
]


def plain(text, patterns):
    found = [(m.start(), k, m.end(), name) for k, (name, p, keep) in enumerate(patterns) for m in re.finditer(p, text or "", re.ASCII) if keep(m)]
    return ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(found))


def base_of(module, text):
    data = text.encode()
    spans = [s for s in module.byte_spans(data) if s[2] < module.BASE_KINDS]
    from flowlab.llm.common import span_text, to_points

    return span_text(to_points(data, spans), module.KINDS)


PIECES = ["pass", "password", "passwd", "token", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "AKIA", "ABCDEFGHIJKLMNOP1234", "é", "ſecret", "K", "0123456789abcdef", "deadbeef", "\n", "@", "a.b", ".com", "1.2", ".3.4", "256", "+1", "(555)", "-", "4785380592391139", "4111 1111 1111 1111", "💥"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_of(secrets, text) == plain(text, SECRET)
    assert base_of(pii, text) == plain(text, PERSONAL)


def test_counts_are_those_of_each_kind(spark):
    texts = {1: "a@b.c 1.2.3.4 and 5.6.7.8", 2: "4785380592391139 then +1 555 123 4567 or +1 555 123 4568", 3: None, 4: "x@y.zz x@y.zz x@y.zz"}
    rows = pii.pii_report(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    got = {r["doc_id"]: [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] for r in rows}
    assert got == {1: [1, 2, 0, 0], 2: [0, 0, 1, 2], 3: [0, 0, 0, 0], 4: [3, 0, 0, 0]}


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=20, max_size=60))
def test_incremental_entropy(data):
    def entropy(window):
        return -sum(window.count(c) / len(window) * log2(window.count(c) / len(window)) for c in set(window))

    want = max(entropy(data[i : i + 20]) for i in range(len(data) - 19))
    assert secrets.best_entropy(data) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("see Zk3x9QvB7mT2pLw8RfYc1n here", "entropy_alnum"),
        ("see aB3/xY9+qW7_zK2=pL5-mN8tR4 here", "entropy_base64"),
        ("see A3F29C7D1B8E4F60A5D2 here", "entropy_hex"),
        ("id 123e4567-e89b-12d3-a456-426614174000 end", None),
        ("Donaudampfschifffahrtsgesellschaft", None),
        ("usr/local/share/applications/editor", None),
        ("EXAMPLEaB3xY9qW7zK2pL5mN8", None),
        ("1234567890123456789012345", None),
        ("aaaaaaaaaaaaaaaaaaaaaaaa1", None),
    ],
)
def test_entropy_spans_and_allow_list(text, kind):
    added = [secrets.KINDS[k] for _, _, k in secrets.find_secrets(text.encode()) if k >= secrets.BASE_KINDS]
    assert added == ([kind] if kind else [])


def test_reports_on_whole_table(spark, documents, texts):
    for report, patterns in ((secrets.secret_report(documents), SECRET), (pii.pii_report(documents), PERSONAL)):
        got = {r["doc_id"]: r["base_sha256"] for r in report.collect()}
        assert got == {i: hashlib.sha256(plain(t, patterns).encode()).hexdigest() for i, t in texts.items()}


def test_odd_rows(odd, nothing):
    for report in (secrets.secret_report, pii.pii_report):
        rows = report(odd).collect()
        assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows)
        assert report(nothing).count() == 0


def test_redaction_keeps_columns(spark, odd):
    rows = spark.createDataFrame([(1, 'x token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" y', 9, "z"), (2, None, None, None), (3, "plain é", 7, "w")], "doc_id long, text string, n_chars long, clean string")
    got = {r["doc_id"]: tuple(r) for r in secrets.redact_secrets(rows).collect()}
    assert got == {1: (1, 'x [SECRET]" y', 13, "z"), 2: (2, None, None, None), 3: (3, "plain é", 7, "w")}
    assert secrets.redact_secrets(odd).columns == odd.columns


def test_contexts_discover_identifiers(spark):
    """Numbers in the seeds' context are found, the same kind of number elsewhere is not."""
    texts = [f"please send mail to user{i}@mail.example.com today" for i in range(8)]
    texts += ["please send mail to staff-4711x today", "the year 1999 was fine", "please send mail to nobody today"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(rows).collect()}
    assert got[8] == "context:20:31" and got[9] == "" and got[10] == ""
    assert all(got[i].startswith("email:20:") for i in range(8))


def test_contexts_discover_names_groups_and_long_values(spark):
    """Handles, names, digit groups and values of any length in the slot of seeds; plain words and other places stay."""
    long = "x" * 80 + "7"
    texts = [f"account holder contact: user{i}@mail.example.com (verified)" for i in range(20)]
    texts += [f"account holder contact: {v} (verified)" for v in ("jane.doe", "Jane Doe", "DE89 3704 0044 0532 0130 00", long, "nobody")]
    texts += ["DE89 3704 0044 0532 0130 00 is said elsewhere by Jane Doe", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(rows).collect()}
    for i, length in ((20, 8), (21, 8), (22, 27), (23, len(long))):
        assert got[i] == f"context:24:{24 + length}"
    assert [got[i] for i in (24, 25, 26, 27)] == ["", "", "", ""]


def test_identifiers_show_further_patterns(spark):
    """A handle found by its context elsewhere makes a second context known, and that one a handle no seed is near."""
    texts = [f"please send mail to user{i}@mail.example.com today" for i in range(24)]
    texts += [f"please send mail to han.dle-{c} today" for c in "abcdefgh"]
    texts += [f"ticket opened by han.dle-{c} yesterday" for c in "abcdefgh"] + ["ticket opened by new.one yesterday", "seen new.one here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.createDataFrame([(99, texts[-2])], "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(rows).collect()}
    assert all(got[i] == "context:20:29" for i in range(24, 32)) and all(got[i] == "context:17:26" for i in range(32, 40))
    assert got[40] == got[99] == "context:17:24" and got[41] == ""


def plain_graph(edges):
    """Least fixed point of scores and reached values over all (pattern, value, able, seed)."""
    found = set()
    while True:
        of = {}
        for p, v, _, seed in edges:
            of.setdefault(p, []).append(1000 if seed else 900 if v in found else 0)
        scores = {p: sum(t) // (len(t) + 1) for p, t in of.items() if len(t) >= 3}
        scores = {p: x for p, x in scores.items() if x >= 700}
        new = {v for p, v, able, seed in edges if able and not seed and p in scores}
        if new == found:
            return scores, found
        found = new


def test_graph_scores_are_those_of_the_plain_form(spark):
    rng = random.Random(5)
    edges = {}
    for p in range(40):
        share = 0.6 + 0.4 * rng.random()
        for _ in range(rng.randrange(1, 60)):
            v = rng.randrange(150) if rng.random() < share else 150 + rng.randrange(60)
            edges[p, v] = (p, v, v % 5 > 0, v < 150)
    want_scores, want_found = plain_graph(list(edges.values()))
    assert 0 < len(want_scores) < 40 and want_found
    scores, found = pii.score_graph(spark.createDataFrame(list(edges.values()), "pattern long, value long, able boolean, seed boolean"))
    assert {r["pattern"]: r["score"] for r in scores.collect()} == want_scores
    assert {r["value"] for r in found.collect()} == want_found


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "x1" * 100_000):
        pii.byte_spans(text.encode())
        secrets.byte_spans(text.encode())


def test_first_look_misses_no_wanted_slot(texts):
    """All words taken as slots against the array form: places of wanted patterns, and pairs of plain words."""
    own = [(t or "").encode() for t in texts.values()][:60] + [b"", b"one", "ünï the x=y: the Q9 17 the J. Doe".encode()]
    spans, patterns = [], set()
    for data in own:
        text = pii.Text(data, pii.byte_spans(data))
        found = [(i, text.instance(i)) for i in range(len(text.bounds))]
        spans.append([(i, span, *text.around(*span)) for i, span in found if span])
        patterns |= {(*p, gate) for i, _, around, gate in spans[-1] if i % 29 == 1 for p in around}
    packed = np.zeros(pii.FILTER_BITS, np.uint8)
    packed[[k & (pii.FILTER_BITS - 1) for p in patterns for k in p]] = 1
    known = pii.Vocabulary(np.packbits(packed, bitorder="little"), False)
    slots = {k: set(found) for k, found, _ in pii.texts_with_slots(own, known)}
    pairs = {tuple(p) for p in np.concatenate(known.pairs).tolist()}
    wanted, seen = {p[0] for p in patterns}, 0
    for k, (data, found) in enumerate(zip(own, spans)):
        for i, span, around, _ in found:
            hits = [p for p, _ in around if p in wanted]
            seen += len(hits)
            value = pii.hashed("value", data[slice(*span)])
            assert not hits or i in slots.get(k, ()) or all((p, value) in pairs for p in hits)
    assert seen > 100
