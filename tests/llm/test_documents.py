"""Quality rules, near-duplicates, decontamination, toxicity, web pages and the pipeline."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from flowlab.llm import decontam, html, quality, queries, simhash, toxicity
from flowlab.llm import pii, secrets  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\t", "#", "|", "\xa0", " "]), max_size=60).map("".join))
def test_counts(text):
    assert quality.text_counts(text.encode())[:5] == plain_counts(text)


def test_quality_report(spark, sf, documents, texts, odd, nothing, labels):
    report = quality.quality_report(documents, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in report} == {i: plain_counts(t) for i, t in texts.items()}
    for r in report:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] == 0)
    assert quality.quality_report(odd, labels).count() == odd.count()
    assert quality.quality_report(nothing, labels.where("false")).count() == 0
    kept = quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 6, 6, 7]


def test_rules_are_learned_in_order_and_precise():
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({f: rng.random(3000) for f in quality.FEATURES})
    frame["label"] = (~((frame["symbol_rate"] > 0.8) | (frame["pipe_rate"] > 0.9) & (frame["end_rate"] < 0.5))).astype(int)
    frame["prune"] = rng.random(3000) < 0.33
    rules = quality.learn_rules(frame)
    assert {c.feature for rule in rules for c in rule} <= {"symbol_rate", "pipe_rate", "end_rate"} and len(rules) >= 2
    x = {f: frame[f].to_numpy() for f in quality.FEATURES}
    rejected = np.any([quality._covered(r, x, len(frame)) for r in rules], axis=0)
    assert (rejected == (frame["label"] == 0)).mean() > 0.99
    frame["label"] = rng.integers(0, 2, 3000)
    assert quality.learn_rules(frame) == []


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """(doc_id, fingerprint) rows to component ids by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted((str(i), f"{f:016x}", str(least.get(find(f)))) for i, f in rows)


def test_near_duplicates(documents, texts, odd, nothing):
    for frame, rows in ((documents, list(texts.items())), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        got = sorted(tuple(map(str, r)) for r in simhash.near_duplicates(frame).collect())
        assert got == classes([(i, plain_fingerprint(t)) for i, t in rows])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({c for _, _, c in classes([(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]) if c != "None"} | {"None"})


def test_keep_one_decides_per_component(spark):
    """Rows without id, and different texts under one id, are documents of their own."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(500)], 60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (5, texts[3]), (5, texts[4]), (2, texts[5]), (5, texts[5])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, kept.collect()), key=key) == sorted([(None, texts[0]), (None, texts[1]), (3, texts[2]), (5, texts[3]), (5, texts[4]), (2, texts[5])], key=key)


def random_prints(rng, count):
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    out = []
    for _ in range(count):
        f = int(rng.choice(centres)) if rng.random() < 0.6 else int(rng.integers(0, 2**63))
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("plan", [[5], [4], [3], [2]])
def test_links_are_complete_for_every_plan(spark, monkeypatch, plan):
    prints = random_prints(np.random.default_rng(plan[0]), 500)
    parts = simhash.group_bits(np.array([[p >> b & 1 for b in range(64)] for p in prints], float), plan[0])
    spare = 4 + 1 - plan[0]
    chosen = [(g, 0) for g in parts]
    for k in range(spare):
        chosen[k % plan[0]] = (chosen[k % plan[0]][0], chosen[k % plan[0]][1] + 1)
    monkeypatch.setattr(simhash, "plan", lambda *a, **k: chosen)
    if plan[0] < 4:
        monkeypatch.setattr(simhash, "HOT_KEY", 3)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = simhash.components(simhash.links(nodes)).collect()
    root = {r["node"]: r["root"] for r in got}
    mine = Counter(frozenset([r, *(k for k, v in root.items() if v == r)]) for r in set(root.values()))
    want = Counter()
    left = {simhash.signed(p) for p in prints}
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
            left -= near
            front += near
        if len(group) > 1:
            want[frozenset(group)] += 1
    assert mine == want


def test_plan_covers_the_distance():
    sample = np.array(random_prints(np.random.default_rng(1), 800), np.uint64)
    for count in (10, 10**5, 10**7, 10**10):
        parts = simhash.plan(sample, count)
        assert sum(t + 1 for _, t in parts) == 5 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)
    assert sum(t + 1 for _, t in simhash.plan(np.empty(0, np.uint64), 0)) == 5


def levenshtein(a, b):
    """Least edits of a to a stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_edit_distance(spark, sf, documents, texts):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = decontam.Words()
    items = {r["item_id"]: (lambda c: c[c > 0])(words.codes(r["text"].encode())) for r in benchmark.collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(documents, benchmark).collect()}
    want = {}
    for i, t in texts.items():
        c = words.codes((t or "").encode())
        c = c[c > 0]
        for k, item in items.items():
            d = decontam.semi_global(item, c)[0]
            if d <= decontam.allowed_edits(len(item)):
                want[i, k] = d
    assert got == want and want


def test_semi_global_distance():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)).astype(np.uint32), rng.integers(1, 5, rng.integers(0, 25)).astype(np.uint32)
        assert decontam.semi_global(a, b)[0] == levenshtein(a.tolist(), b.tolist())
        d, start, end = decontam.best_stretch(a, b)
        assert levenshtein(a.tolist(), b[start:end].tolist()) == d


def test_edited_items_are_found():
    """Recall of the tables with as many edits as are allowed, and no match for unrelated texts."""
    rng = np.random.default_rng(2)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [" ".join(rng.choice(vocabulary, rng.integers(12, 60))) for _ in range(80)]
    index = decontam.Index(list(range(80)), [t.encode() for t in items])
    documents, want = [], set()
    for k in range(200):
        noise = decontam.Words().codes(" ".join(rng.choice(vocabulary, 120)).encode())
        item = index.items[k % 80]
        copy = decontam.edited(item, decontam.allowed_edits(len(item)), rng)
        documents.append(np.concatenate([noise[:50], copy, noise[50:]]))
        want.add((k, k % 80))
    found = {(d, k) for d, k, *_ in index.search(documents)}
    assert len(found & want) / len(want) >= 0.97 and found <= want | {(d, k) for d, k in found if k != d % 80 and items[k] == items[d % 80]}
    assert index.search([d[:50] for d in documents]) == []


def test_leaks_of_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b c d e f g h i j k l"), (4, "A, b; c d e f g h i j k L."), (5, "quite unlike all of these texts here")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["start"], r["stop"]) for r in decontam.find_leaks(odd, benchmark).collect())
    assert got == sorted((d, k, 0, 0, 23) for d in (6, 6, 7) for k in (3, 4))
    left = decontam.without_leaks(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontam.find_leaks(nothing, benchmark).count() == 0
    assert decontam.without_leaks(odd, benchmark.where("false")).count() == odd.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity_report(docs, marks).join(marks, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    positive, negative = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    better = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
    assert right / len(rows) > 0.87 and better > 0.8 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_odd_rows(odd, nothing, labels):
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity_report(nothing, labels.where("false")).count() == 0


def test_toxicity_features():
    marker = toxicity.Marker({"lowei*": 3.0})
    names = dict(zip(toxicity.FEATURES, marker.features(b"You are an IDIOT and an 1d10t, st*pid loweine! fine day")))
    assert names["insults"] == 1 and names["learned"] == 1 and names["obfuscated_insults"] == 2
    assert names["insult_near_you"] > 0 and names["shouted"] > 0 and names["exclaims"] > 0
    assert marker.features(None) == marker.features(b" \n") == (0.0,) * len(toxicity.FEATURES)


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def shop_page(k):
    """A host without telling elements: its template shows only over several pages."""
    return page(f'<div class="top"><a href="/">Home {k}</a><a href="/b">Shop and much more to see here</a></div><div class="col"><div class="text"><p>First &amp; foremost {k}</p><p>long  text {k} {"word " * 30}</p></div></div><div class="foot"><span>(c) {k}</span></div>')


def test_main_text(spark):
    rows = [
        (1, "https://a.example/x", page('<nav><a>menu</a></nav><div class="ad">buy</div><article><header><h1>Head</h1></header><p>one <b>bold</b>&nbsp;two<br>three<p>four</p><div class="comments"><p>reader</p></div><aside>side</aside></article><footer>foot</footer>')),
        (2, "https://a.example/y", page("<nav><a>menu</a></nav><article><h1>Other</h1><p>a &lt; b</p><script>var x='</p>'</script><!-- no --></article>")),
        (3, "https://a.example/z", "<article><p>cut of"),
        (4, "https://a.example/w", None),
        (5, None, ""),
        (6, "https://a.example/v", "no markup < at all"),
        (None, "https://a.example/u", page("<nav><a>only a menu</a></nav>")),
        *((10 + k, "https://shop.example/p", shop_page(k)) for k in range(6)),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS mains")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got[1][0] == "Head\none bold two\nthree\nfour"
    assert got[2][0] == "Other\na < b" and got[3][0] == "cut of" and got[4] == got[5] == ("", 0) and got[6][0] == "no markup < at all" and got[None] == ("", 0)
    for k in range(6):
        assert got[10 + k][0] == f"First & foremost {k}\nlong text {k} " + " ".join(["word"] * 30)
    assert all(n == len(t) for t, n in got.values())
    assert html.extract(pages.where("false")).count() == 0


def test_article_in_marked_wrappers():
    """A wrapper is known by the article text it holds, not by its name; what is beside or in the article still goes."""
    for name in ("wrapper has-sidebar", "content no-sidebar", "nav-open", "long-form", "search share"):
        for inner in ("article", "main"):
            source = page(f'<div class="sidebar">beside</div><div class="{name}"><{inner}><h1>Head</h1><p>the text of it</p><div class="comments">a reader</div></{inner}></div><div class="related"><article>another one</article></div>')
            assert html.main_text(source, frozenset()) == "Head\nthe text of it", (name, inner)
    inside = page('<article><div class="long-form"><p>most of the text</p></div><p>end</p><div class="share">tell</div></article>')
    assert html.main_text(inside, frozenset()) == "most of the text\nend"
    assert html.main_text(page("<form><main><article><p>text</p></article></main><div class=alert>x</div></form>"), frozenset()) == "text"
    assert html.main_text(page('<main>the post itself<div class="related"><article>teaser</article></div></main>'), frozenset()) == "the post itself"
    deep = page("<article><div><div><div><div><div><header><h1>Deep</h1></header></div></div></div></div></div><p>text</p></article><header>site</header>")
    assert html.main_text(deep, frozenset()) == "Deep\ntext"


def texts_of(spark, sources):
    pages = spark.createDataFrame([(k, "https://one.example/p", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html.extract(pages).collect(), key=lambda r: r["page_id"])]


def test_slot_keeps_heading_and_list(spark):
    """Without telling elements the slot has all of the article's text, and an article has what stands around its body."""
    words = [f"{'abcdefgh'[k]}long " * 20 for k in range(6)]
    plain = [page(f"<div class=x><h1>Title {k}</h1><p>{w}</p><ul><li>first {k}</li><li>second {k}</li></ul></div>") for k, w in enumerate(words)]
    assert texts_of(spark, plain) == [f"Title {k}\n{w.strip()}\nfirst {k}\nsecond {k}" for k, w in enumerate(words)]
    body = [page(f"<article><h1>Title {k}</h1><p>lead {k}</p><div itemprop=articleBody><p>{w}</p></div></article>") for k, w in enumerate(words)]
    assert texts_of(spark, body) == [f"Title {k}\nlead {k}\n{w.strip()}" for k, w in enumerate(words)]


def test_template_text_inside_the_slot_goes(spark):
    """A block on a host's pages is template; copies of one page make none, nor is a page left empty."""
    notice = "<p>Read our letter every week</p>"
    hosts = [page(f"<article><h1>Title {k}</h1><p>one {k}</p>{notice}<p>two {k}</p></article>") for k in range(5)]
    assert texts_of(spark, hosts) == [f"Title {k}\none {k}\ntwo {k}" for k in range(5)]
    copies = [hosts[0]] * 4 + [page("<article><p>other text</p></article>")]
    assert texts_of(spark, copies) == ["Title 0\none 0\nRead our letter every week\ntwo 0"] * 4 + ["other text"]
    assert texts_of(spark, [*hosts, page(f"<article>{notice}</article>")])[5] == "Read our letter every week"


def test_main_text_of_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    import html as entities

    for r in html.extract(pages).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", sources[r["page_id"]], re.DOTALL).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pages_that_never_close():
    for source in ("<!--" * 50_000, "<div>" * 20_000, "<a title='" * 20_000, "<script>" * 20_000, "&" * 50_000, "<p>" * 30_000 + "x"):
        html.main_text(source, frozenset())


def test_pipeline_stages(spark, sf, documents):
    """Every stage against what its operator's own report says of its input."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scans", "byte-level bpe"]
    stage = dict(corpus_pipeline.STAGES)
    labels, benchmark = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    good = stage["quality rules"](spark, documents, sf).cache()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.quality_report(documents, labels).where("kept").collect()}
    single = stage["simhash near-dedup"](spark, good, sf).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in simhash.near_duplicates(good).collect()})
    clean = stage["benchmark decontamination"](spark, single, sf).cache()
    assert {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in decontam.find_leaks(single, benchmark).collect()}
    safe = stage["secret scans"](spark, clean, sf).cache()
    assert safe.count() == clean.count() and secrets.secret_report(safe).where("n_hex > 0").count() == 0
    for frame in (good, single, clean, safe):
        assert frame.columns == documents.columns
    from tests.llm.test_tokens import digests

    final = stage["byte-level bpe"](spark, safe, sf)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in final.drop("ids").collect()} == {r["doc_id"]: digests(r["text"]) for r in safe.collect()}
    assert corpus_pipeline.run(spark, sf).count() == safe.count()


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", name).group(1)) for name in queries.QUERIES) == list(range(1, 14))
