"""Byte-level BPE, the token file and the language model against their libraries and plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlab.llm import bpe, katz, tokenfile
from flowlab.llm.common import expand, squeeze

LETTERS = st.text(st.sampled_from(list("aB'sté1 \n\t\x1c\xa0 .,!😀東ſK")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_words_encode_like_the_text(text):
    encode = bpe.encoding(None).encode_ordinary
    head, tail = bpe.split_words(text)
    assert [i for w in [head, *(" " + t for t in tail)] for i in encode(w)] == encode(text)


def digests(text):
    ids = bpe.encoding(None).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_on_whole_table(documents, texts):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(documents, chunk_bytes=60_000, buckets=5).collect()}
    assert got == {i: digests(t) for i, t in texts.items()}


def test_round_trip_of_odd_rows(odd, nothing):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd).collect())
    assert got == sorted((str(r["doc_id"]), *digests(r["text"])) for r in odd.collect())
    assert bpe.round_trip(nothing).count() == 0


def test_decode_joins_bytes(documents, texts):
    decoded = bpe.decode(bpe.tokenised(documents).select("doc_id", "ids"))
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in decoded.collect()} == {i: t or "" for i, t in texts.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=50), st.lists(st.floats(allow_nan=False), max_size=20))
def test_squeeze(whole, real):
    a, b = expand(squeeze(np.array(whole, np.int64), np.array(real, float)))
    assert a.tolist() == whole and b.tolist() == real


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.integers(0, 3 * tokenfile.BLOCK), st.data())
def test_packing_and_random_access(bits, count, data):
    ids = np.random.default_rng(count).integers(0, 1 << bits, count)
    packed, offsets = tokenfile.pack(ids, bits)
    assert len(packed) == -(-count * bits // 8)
    assert tokenfile.unpack(packed, bits, count).tolist() == ids.tolist()
    a, b = sorted((data.draw(st.integers(0, count)), data.draw(st.integers(0, count))))
    assert tokenfile.ids_between(packed, offsets.tolist(), bits, count, a, b).tolist() == ids[a:b].tolist()


def test_id_bits():
    assert [tokenfile.id_bits(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def file_rows(rows):
    """What the file must say, from one call of the tokenizers library per text."""
    tokenizer = tokenfile.WordEncoder(None).tokenizer
    encoded = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    start = 0
    for i, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        yield i, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


@pytest.mark.parametrize("segment_ids", [1, 5_000, 1 << 20])
def test_token_file(spark, documents, texts, tmp_path, segment_ids):
    tokenfile.write_tokens(documents, str(tmp_path / "file"), shards=5, segment_ids=segment_ids)
    assert sorted(map(tuple, tokenfile.read_documents(spark, str(tmp_path / "file")).collect())) == sorted(file_rows(texts.items()))


def test_token_file_of_odd_rows(odd, nothing):
    got = tokenfile.token_file_report(odd, shards=3).collect()
    want = list(file_rows([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokenfile.token_file_report(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(LETTERS.map(lambda t: t + " <|endoftext|> x<|startoftext|>y"))
def test_words_encode_like_the_text_with_marks(text):
    encoder = tokenfile.word_encoder(None)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist() == want


def plain_model(rows):
    """Katz scores by dictionaries."""
    lower = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in enumerate(t for _, t in rows)}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", t), " "] for i, t in lower.items()}
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    one, two = Counter(), Counter()
    for i, words in tokens.items():
        if not held[i]:
            one.update(words)
            two.update(zip([" ", *words], words))
    total = sum(one.values())

    def factors(counts):
        sizes = np.zeros(katz.K + 2, np.int64)
        for c in counts.values():
            if c <= katz.K + 1:
                sizes[c] += 1
        return [*katz.discounts(sizes), *[1.0] * (max(counts.values(), default=0) + 1)]

    d1, d2 = factors(one), factors(two)
    left = sum((1 - d1[c]) * c for c in one.values() if c <= katz.K)
    unknown, scale = (left / total, 1.0) if left > 0 else (1 / (total + 1), total / (total + 1))
    p1 = {w: scale * (d1[c] if c <= katz.K else 1.0) * c / total for w, c in one.items()}
    seen = defaultdict(list)
    for (a, b), c in two.items():
        seen[a].append((b, c))
    back, keep = {}, {}
    for a, pairs in seen.items():
        free = sum((1 - d2[c]) * c for _, c in pairs if c <= katz.K) / one[a]
        keep[a] = 1.0 if free > 0 else one[a] / (one[a] + 1)
        back[a] = (free if free > 0 else 1 / (one[a] + 1)) / (1 - sum(p1[b] for b, _ in pairs))

    def probability(a, b):
        c = two.get((a, b), 0)
        return keep[a] * (d2[c] if c <= katz.K else 1.0) * c / one[a] if c else back.get(a, 1.0) * p1.get(b, unknown)

    for a in list(seen)[:50]:
        assert sum(probability(a, b) for b in one) + back[a] * unknown == pytest.approx(1.0)
    for i, words in tokens.items():
        base = sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in words)
        score = sum(math.log10(probability(a, b)) for a, b in zip([" ", *words], words))
        yield rows[i][0], held[i], len(words), sum(one[w] > 0 for w in words), total, base, score


def close(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:5]), round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_language_model(documents, texts):
    close(katz.language_scores(documents, chunk_bytes=50_000, buckets=4).collect(), plain_model(list(texts.items())))


def test_language_model_of_odd_rows(odd, nothing):
    close(katz.language_scores(odd, buckets=3).collect(), plain_model([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert katz.language_scores(nothing).count() == 0


def test_language_model_with_one_hot_context(spark):
    rows = [(i, " ".join(f"the w{(i * 7 + j * j) % 60}" for j in range(40))) for i in range(60)]
    close(katz.language_scores(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=4_000, buckets=6).collect(), plain_model(rows))


def test_language_model_has_more_buckets_for_more_text(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 11 + j * j) % 700}" for j in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert katz.bucket_count(docs) == katz.bucket_count(docs.where("false")) == katz.BUCKETS
    size = sum(len(t) for _, t in rows)
    monkeypatch.setattr(katz, "BUCKET_BYTES", size // 90)
    used = []
    monkeypatch.setattr(katz, "word_table", lambda chunks, buckets, make=katz.word_table: used.append(buckets) or make(chunks, buckets))
    close(katz.language_scores(docs, chunk_bytes=8_000).collect(), plain_model(rows))
    assert used == [katz.bucket_count(docs)] and used[0] >= 90
