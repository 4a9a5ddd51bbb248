"""Main text of web pages by deducing each host's template.

A token of a page is an element with its path of tags and classes, or a block of
text with the path of its element. Over the pages of a host, tokens that occur
equally often on every page share an occurrence vector and form an equivalence
class; a vector is compared by the sum of hashes of (page, count), so that Spark
sums it without gathering pages. Classes with two and more tokens (a block counts
its words) on enough pages are valid; their blocks are the template's text. The
path of a token is its place in the template. The template's slot with the article
is found by its element's meaning, else it is the deepest element that keeps
nearly all text outside links and template. The text is what stands in that slot
without the template's blocks and without parts whose element or class marks them
as no part of the article.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.session import settle, work_path

#: A class is valid if its tokens are on this share of a host's pages, and has this many tokens.
MIN_SHARE, MIN_TOKENS = 0.5, 2
#: Least number of different pages that a block of a template is on.
MIN_PAGES = 3
#: The slot without a telling element is the deepest one with this share of a host's text outside links and template, and with all headings.
KEPT_SHARE = 0.95
#: A marked element with this share of a page's article text is a wrapper around it.
WRAPPER_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp object canvas math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label nobr".split())
#: Elements that are no part of an article wherever they stand; those of the second set only outside of one.
DROPPED = frozenset("nav aside footer form button select option menu dialog fieldset input head".split())
DROPPED_OUTSIDE = frozenset("header".split())
#: Of these, and of marked elements, those that hold the article are wrappers.
WRAPPERS = frozenset("form fieldset header".split())
HEADINGS = frozenset("h1 h2".split())
#: Names in class, id and role that mark the same.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|site-?header|comments?|commentlist|discussion|disqus|replies|reply|cookies?|consent|gdpr|notices?|popup|modal|overlay|alert"
    r"|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|teaser|widget|toolbar|pagination|pager|skip|contentinfo|complementary|navigation|search|form|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Of these names, those that have much text by their nature: they are wrappers only around a telling element.
WORDY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|comments?|commentlist|discussion|disqus|replies|reply|cookies?|consent|gdpr|newsletter|related|recommend\w*|teaser|footer|contentinfo|disclaimer)(?:$|[\s_-])", re.IGNORECASE)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
#: Kinds of telling elements, the strongest last.
MAIN, ARTICLE, BODY = 1, 2, 3


def url_host(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower()


class Element:
    """An element of a page. ``hard`` elements are dropped with all they hold, ``soft`` ones unless they turn out as wrappers."""

    __slots__ = ("tag", "path", "depth", "above", "hard", "soft", "wordy", "kind", "article", "link", "head", "dropped", "inside", "chars", "links", "heads", "all_chars", "strongest", "told")

    def __init__(self, tag, path, above, hard, soft, wordy, kind):
        self.tag, self.path, self.above, self.hard, self.soft, self.wordy, self.kind = tag, path, above, hard, soft, wordy, kind
        self.depth = above.depth + 1 if above else 0
        self.article = kind > 0 or above is not None and above.article
        self.link = tag == "a" or above is not None and above.link
        self.head = tag in HEADINGS or above is not None and above.head
        self.dropped = self.inside = False
        self.chars = self.links = self.heads = self.all_chars = self.strongest = 0
        self.told = None


def _attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): (m.group(2) or "").strip("\"'") for m in ATTRIBUTE.finditer(text)}


def _kind(tag: str, attrs: dict[str, str]) -> int:
    if "articlebody" in attrs.get("itemprop", "").lower():
        return BODY
    if tag == "article" or attrs.get("role", "").lower() == "article":
        return ARTICLE
    return MAIN if tag == "main" or attrs.get("role", "").lower() == "main" else 0


class Page:
    """A page's elements and text blocks in order, and which of them are dropped or inside the main slots."""

    def __init__(self, source: str, mains: frozenset[int] | None = None):
        self.mains = mains
        #: Every block as the element around it and its pieces of text with theirs.
        self.blocks: list[tuple[Element, list[tuple[Element, str]]]] = []
        self.parts: list[tuple[Element, str]] = []
        root = Element("", 0, None, False, False, False, 0)
        self.elements, self.stack = [root], [root]
        self._read(source)
        self._break()
        self._wrappers()
        self.found = self._place(mains)

    def _break(self) -> None:
        """Ends the running block."""
        if self.parts:
            around = self.stack[-1]
            while around.tag in INLINE and around.above:
                around = around.above
            self.blocks.append((around, self.parts))
            self.parts = []

    def _pop(self) -> None:
        self.stack.pop()

    def _wrappers(self) -> None:
        """Soft elements that hold the article, by their share of its text, are not dropped.

        With telling elements, these hold one of a stronger kind than all outside of soft
        elements, and most of the text in telling ones; else most of the text outside links.
        """
        if not any(e.soft for e in self.elements):
            return
        for _, parts in self.blocks:
            for e, t in parts:
                if not e.link:
                    e.all_chars += _size(t)
        for e in self.elements:
            e.told = [0] * (BODY + 1)
        for e in reversed(self.elements):
            if e.kind:
                e.told[e.kind] = e.all_chars
                e.strongest = max(e.strongest, e.kind if e.all_chars else 0)
            if e.above:
                e.above.all_chars += e.all_chars
                e.above.strongest = max(e.above.strongest, e.strongest)
                for k in range(1, BODY + 1):
                    e.above.told[k] += e.told[k]
        root = self.elements[0]
        free = 0
        for e in self.elements[1:]:
            e.dropped = e.above.dropped or e.hard or e.soft
            if e.kind and not e.dropped and e.all_chars:
                free = max(free, e.kind)
        for e in self.elements[1:]:
            if not e.soft:
                continue
            k = e.strongest
            if k > free:
                whole = root.all_chars if e.wordy else max(root.told)
                wrapper = e.told[k] >= WRAPPER_SHARE * whole and not (e.wordy and free)
            else:
                host = e.above
                while host.above and not host.kind:
                    host = host.above
                # Outside of a page's telling elements nothing but these is looked for.
                wrapper = not e.wordy and (host.kind > 0 or root.strongest == 0) and e.all_chars > WRAPPER_SHARE * host.all_chars
            e.soft = not wrapper

    def _place(self, mains: frozenset[int] | None) -> bool:
        """Sets what is dropped and what is inside the slots; whether a slot has been found."""
        found = False
        for e in self.elements:
            above = e.above
            e.dropped = e.hard or e.soft or above is not None and above.dropped
            e.inside = above is not None and above.inside or (e.kind > 0 if mains is None else e.path in mains)
            found = found or e.inside and not e.dropped
        return found

    def tokens(self) -> dict[tuple[int, bool], list[int]]:
        """By path and whether it is a block: count, characters, those in links, those of headings, depth, dropped, kind, path above, words."""
        for _, parts in self.blocks:
            for e, t in parts:
                if not e.dropped:
                    size = _size(t)
                    e.chars += size
                    e.links += size if e.link else 0
                    e.heads += size if e.head and not e.link else 0
        found: dict[tuple[int, bool], list[int]] = {}
        for e in reversed(self.elements):
            above = e.above
            if above:
                above.chars += e.chars
                above.links += e.links
                above.heads += e.heads
            own = found.setdefault((e.path, False), [0, 0, 0, 0, e.depth, int(e.dropped), e.kind, above.path if above else 0, 1])
            own[0] += 1
            own[6] = max(own[6], e.kind)
            own[1] += e.chars
            own[2] += e.links
            own[3] += e.heads
        for around, parts in self.blocks:
            left = [(e, t) for e, t in parts if not e.dropped]
            text = _joined(left)
            if text:
                sizes = [(_size(t), e) for e, t in left]
                own = found.setdefault((block_token(around, text), True), [0, 0, 0, 0, around.depth, 0, 0, around.path, text.count(" ") + 1])
                own[0] += 1
                own[1] += sum(n for n, _ in sizes)
                own[2] += sum(n for n, e in sizes if e.link)
                own[3] += sum(n for n, e in sizes if e.head and not e.link)
        return found

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].kind and tag in ("p", "div", "li"):
                return

    def _open(self, tag: str, text: str) -> None:
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") or tag not in INLINE:
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 9), -1):
                own = self.stack[k].tag
                if own == "p" or own == tag and tag in ("li", "tr", "td", "th", "option") or {own, tag} <= {"dt", "dd"}:
                    while len(self.stack) > k:
                        self._pop()
                    break
                if own not in INLINE:
                    break
        if tag in VOID:
            return
        attrs = _attributes(text) if text else {}
        above = self.stack[-1]
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
        kind = _kind(tag, attrs)
        if kind == BODY:
            # The article around the body has the headings too.
            around = next((e for e in reversed(self.stack) if e.kind >= ARTICLE), None)
            if around:
                around.kind, kind = BODY, ARTICLE
        path = xxhash.xxh3_64_intdigest(f"{above.path} {tag} {DIGITS.sub('0', attrs.get('class', ''))}".encode("utf-8", "replace")) >> 1
        slot = self.mains is not None and path in self.mains
        marked = not kind and not slot and tag not in ("html", "body") and bool(MARKED.search(names))
        hard = above.hard or tag in DROPPED and tag not in WRAPPERS or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        soft = marked or tag in DROPPED and tag in WRAPPERS or tag in DROPPED_OUTSIDE and not above.article
        e = Element(tag, path, above, hard, soft and not hard, marked and bool(WORDY.search(names)), kind)
        e.article = e.article or slot
        self.stack.append(e)
        self.elements.append(e)

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].hard:
            self.parts.append((self.stack[-1], text))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                self._text(source[at:])
                return
            if start > at:
                self._text(source[at:start])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), start):
                end = source.find(">", start)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(source, start) or LOOSE_TAG.match(source, start)
            if m is None:
                if re.match(r"</?[a-zA-Z]", source[start : start + 3]):
                    return  # a tag that never ends
                self._text("<")
                at = start + 1
                continue
            at = m.end()
            tag = m.group(2).lower()
            if tag in RAW:
                if not m.group(1):
                    if tag not in ("svg", "math") or not m.group(3).endswith("/"):
                        closing = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                        at = n if closing is None else closing.end()
                continue
            if tag not in INLINE:
                self._break()
            if m.group(1):
                self._close(tag)
            else:
                self._open(tag, m.group(3))

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """The blocks inside the slots that are not the template's; all of them on a page whose slots hold nothing else."""
        own, more = [], []
        for around, parts in self.blocks:
            left = [(e, t) for e, t in parts if not e.dropped]
            text = _joined([(e, t) for e, t in left if e.inside])
            if text:
                (more if template and block_token(around, _joined(left)) in template else own).append((len(own) + len(more), text))
        return "\n".join(t for _, t in own or more)


def _size(text: str) -> int:
    return sum(map(len, text.split()))


def _joined(parts: list[tuple[Element, str]]) -> str:
    return " ".join(html.unescape("".join(t for _, t in parts)).split())


def block_token(around: Element, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{around.path} {text}".encode("utf-8", "replace")) >> 1


def main_text(source: str | None, mains: frozenset[int], template: frozenset[int] = frozenset()) -> str:
    """The blocks inside the host's main slots, without the template's; on a page without them, inside the page's own telling elements, else all that is not dropped."""
    if not source:
        return ""
    page = Page(source, mains)
    if not page.found:
        page = Page(source)
        if not page.found:
            page = Page(source, frozenset([0]))
    return page.text(template)


NUMBERS = "n chars links heads depth dropped kind above words".split()
TOKEN = "host string, page long, token long, block boolean, " + ", ".join(f"{c} long" for c in NUMBERS)


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per page and token. Pages are told apart by their source, so copies of a page count once."""

    def run(batches):
        for b in batches:
            rows = []
            for url, source in zip(*(b.column(c).to_pylist() for c in ("url", "html"))):
                page = xxhash.xxh3_64_intdigest((source or "").encode("utf-8", "replace")) >> 1
                host = url_host(url)
                rows += [(host, page, *token, *own) for token, own in Page(source or "").tokens().items()]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * len(NUMBERS)]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names=["host", "page", "token", "block", *NUMBERS])

    return pages.select("url", "html").mapInArrow(run, TOKEN)


def deduced(tokens: list[dict]) -> tuple[list[int], list[int]]:
    """A host's main slots and its template's blocks, from its tokens on enough pages."""
    elements = {t["token"]: t for t in tokens if not t["block"]}
    text = {k: t["chars"] - t["links"] for k, t in elements.items()}
    heads = {k: t["heads"] for k, t in elements.items()}
    blocks = [t for t in tokens if t["block"] and t["size"] >= MIN_TOKENS]
    for t in blocks:
        k = t["above"]
        while k in elements:
            text[k] -= t["chars"] - t["links"]
            heads[k] -= t["heads"]
            if k == 0:
                break
            k = elements[k]["above"]
    valid = [k for k, t in elements.items() if k and t["size"] >= MIN_TOKENS and t["dropped"] <= 0.5]
    kind = max((elements[k]["kind"] for k in valid), default=0)
    if kind:
        mains = [k for k in valid if elements[k]["kind"] == kind]
    else:
        whole = [k for k in valid if text[0] > 0 and text[k] >= KEPT_SHARE * text[0] and heads[k] >= heads[0]]
        mains = [max(whole, key=lambda k: (elements[k]["depth"], k), default=0)]
    return mains, [t["token"] for t in blocks]


def templates(tokens: DataFrame) -> DataFrame:
    """(host, mains, template): the tokens of each host's main slots and of its template's blocks."""
    summed = tokens.groupBy("host", "token", "block").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"),
        F.count("*").alias("rows"),
        # Elements occur on every page; only for blocks, and for the page itself, copies are told.
        F.countDistinct(F.when(F.col("block") | (F.col("token") == 0), F.col("page"))).alias("pages"),
        *[F.sum(c).alias(c) for c in ("chars", "links", "heads")],
        F.avg("dropped").alias("dropped"),
        *[F.max(c).alias(c) for c in ("depth", "kind", "above", "words")],
    )
    # Three tables are read from these sums; settled, the pages are parsed for them once.
    own = settle(summed.where((~F.col("block")) | (F.col("pages") >= MIN_PAGES)))
    classes = own.groupBy("host", "vector").agg(F.sum("words").alias("size"))
    roots = own.where("token = 0 AND NOT block").select("host", F.col("rows").alias("all_rows"), F.col("pages").alias("all_pages"))
    often = F.when(F.col("block"), F.col("pages") >= MIN_SHARE * F.col("all_pages")).otherwise(F.col("rows") >= MIN_SHARE * F.col("all_rows"))
    frequent = own.join(roots, "host").where(often).join(classes, ["host", "vector"])
    # Tokens on half of a host's pages are at most twice as many as a page has.
    listed = frequent.groupBy("host").agg(F.collect_list(F.struct("token", "block", "size", "chars", "links", "heads", "dropped", "depth", "kind", "above")).alias("tokens"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = [deduced(t) for t in b.column("tokens").to_pylist()]
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([m for m, _ in made], numbers), pa.array([t for _, t in made], numbers)], names=["host", "mains", "template"])

    return listed.mapInArrow(run, "host string, mains array<long>, template array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Missing or empty html and pages without an article give an empty text; pages without
    url share the host of the empty name; repeated rows give repeated results. The
    templates, some numbers per host, are written and read again, so that Spark
    broadcasts them only if their size on disk allows it.
    """
    spark = pages.sparkSession
    target = work_path(spark, "templates")
    templates(page_tokens(pages)).write.parquet(target)
    found = spark.read.parquet(target).withColumnRenamed("host", "page_host")
    kind, key = to_arrow_type(pages.schema["page_id"].dataType), pages.schema["page_id"].dataType.simpleString()

    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:.*?://)?([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":.*$", ""))
    joined = pages.select("page_id", "url", "html", host.alias("host")).join(found, F.col("host") == F.col("page_host"), "left").select("page_id", "url", "html", "mains", "template")

    def run(batches):
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("html", "mains", "template"))
            texts = [main_text(source, frozenset(mains or ()), frozenset(template or ())) for source, mains, template in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(kind), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")
