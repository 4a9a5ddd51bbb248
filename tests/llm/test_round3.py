"""Row counts, groups and sizes that an operator may not exceed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlab.llm import common, pii, tokenfile


def test_common_words_refute_patterns_before_all_texts_are_scanned(spark, monkeypatch, tmp_path):
    """Slots full of plain words give no pair for each of them in the scan of all texts, and the spans stay the same."""
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnprst"]
    texts = [f"please ask {w} today about it" for w in words] + [f"please ask u{k}@site.org today about it" for k in range(4)]
    texts += [f"ticket ref: K{k}-99{k} by mail to m{k}@shop.com thanks" for k in range(6)] + [f"by mail to {n} thanks" for n in ("Q77-1", "Q78-1")]
    spark.createDataFrame([*enumerate(texts * 2)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pairs, scan_for = [], pii.scan_for

    def counted(rows, keys, values):
        found = scan_for(rows, keys, values)
        if rows is docs and not values:
            pairs.append(found.where("start IS NULL").select("pattern", "value").distinct().count())
        return found

    monkeypatch.setattr(pii, "scan_for", counted)
    monkeypatch.setattr(pii, "TRIALS", (4,))
    got = sorted(map(tuple, pii.pii_report(docs).collect()))
    assert pairs and max(pairs) < 20
    monkeypatch.setattr(pii, "TRIALS", ())
    assert got == sorted(map(tuple, pii.pii_report(docs).collect()))


def test_new_words_of_several_texts_are_learned_in_one_go(monkeypatch):
    encoder = tokenfile.WordEncoder(None)
    texts = [f"alpha{k} beta, gamma{k}. delta" for k in range(50)] + ["", "x <|endoftext|> y", "caf\u00e9 \u4e2d\u6587"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    calls, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: calls.append(len(words)) or learn(words))
    got = encoder.encode_all([t.encode() for t in texts] + [None])
    assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [*want, []] and len(calls) == 1
    monkeypatch.setattr(tokenfile, "CACHED_WORDS", 20)
    encoder.known.clear()
    for at in range(0, len(texts), 5):
        got = encoder.encode_all([t.encode() for t in texts[at : at + 5]])
        assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == want[at : at + 5] and len(encoder.known) <= 20


def test_a_batch_is_laid_out_in_pieces(spark):
    """Six texts of two megabytes in one Arrow batch are never Python objects all at once."""
    docs = spark.range(6, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 2 << 20)").alias("text"))
    made = common.map_rows(docs, lambda batches: ({"n": [len(b["text"])]} for b in batches), "n int").collect()
    assert sum(r["n"] for r in made) == 6 and max(r["n"] for r in made) <= 2
    added = common.add_columns(docs, ["text"], lambda t: (len(t),), "size int").select("row.doc_id", "size").collect()
    assert sorted(map(tuple, added)) == [(k, 2 << 20) for k in range(6)]
