"""Operator 3, HTML extraction: the maximum-scoring subsequence of a page's tokens.

A page is read as a stream of words and tags.  Words score positive and tags
negative, and one linear scan finds the contiguous region with the greatest sum; its
text, block by block, is the main text.  The weights come from labelled pages: pages
that mark their content themselves (one ``article``, or else one ``main``).  A tag
costs the more, the more often it lies outside the content or on its border; a word
gains what its surroundings (nearest block, and whether inside a marked part) held of
content, so words where labelled pages only had boilerplate score below zero.  Without labelled
pages FIXED default weights hold.

What is never main text (menus, forms, scripts, ...: FIXED tags and roles
below) is cut out of the stream with all it holds, so it neither scores nor shows
within the region.  A class or id only says so if the whole name does ("ad", "site-menu", not
"ad-free" or "no-sidebar"), and then only outside marked content; within it, only classes of adverts and
readers' comments do, and never ids, which name sections.  An element that is named so but holds
most of the words of a page that marks no content (or of the marked content) is its wrapper and stays; readers'
comments stay only if there is nothing else.  Character references are decoded, white space in a block becomes
one space, blocks are joined by a line feed; ``br`` is white space; nothing is capped.

The weights are counted on ``SAMPLE_PAGES`` pages at most (by hash of the page), all
pages are extracted whole, row by row.  Null and empty pages, and pages without words,
give the empty text; broken markup is read as far as it goes.  Repeated rows and further
columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import read_table

SAMPLE_PAGES = 5_000           # pages that the weights are counted on, at most (expected)
WORD, TAG, PROSE_TAG = 1.0, -1.0, -0.1  # of words, tags and tags of prose that labelled pages don't show
TAG_LEAST, TAG_OUTSIDE = -0.05, -40.0   # of tags always and never within the content

# Names of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object xmp".split())
CUT = frozenset("nav footer aside button select dialog menu audio video canvas map".split()) | RAW
HOLDERS = frozenset(("form", "fieldset"))      # cut like elements that their class names: not one that holds the page or its content
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead title tr ul").split())
INLINE_CUT = frozenset("script style noscript template button select svg math object canvas map audio video".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong u s small sub sup code q cite span br a li ul ol blockquote pre".split())
CONTENT = frozenset(("article", "main"))
FREE = frozenset(("cut", "/cut")) | {f"{end}{tag}" for tag in CONTENT for end in ("", "/")}      # tags without a weight
CUT_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar comments comment disqus replies discussion respond "
    "related recommended recommendations share sharing social pagination pager widget widgets login search").split())
PLACE_NAMES = frozenset((      # say where a named element is, not what it holds
    "site page top main left right bottom primary secondary global block box container wrapper wrap area section inner list "
    "bar links link button buttons icon icons form item items header").split())
READER_NAMES = frozenset("comments comment disqus replies".split())
CUT_IN_CONTENT = READER_NAMES | frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "popup modal overlay newsletter paywall").split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")


@cache
def _end_tag(tag: str) -> re.Pattern:
    """Where a raw element's end tag starts; matched in the page itself, since lower case can be longer."""
    return re.compile("</" + re.escape(tag), re.I | re.A)


@dataclass
class Weights:
    """Weight per tag key and per (state, surroundings); states: A in a marked part, O outside one, N no part is marked."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[tuple[str, str], float] = field(default_factory=dict)

    def tag(self, key: str) -> float:
        name = key.split(".")[0]
        for k in (key, name):
            if (w := self.tags.get(k)) is not None:
                return w
        return PROSE_TAG if name.lstrip("/") in PROSE else TAG

    def word(self, state: str, around: str) -> float:
        for key in ((state, around), (state, "*")):
            if (w := self.words.get(key)) is not None:
                return w
        return WORD


def _attributes(raw: str) -> tuple[str, list[frozenset[str]], list[frozenset[str]], str, bool]:
    """First class, the parts of each class and of each id, role, hidden."""
    first, classes, ids, role, hidden = "", [], [], "", False
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                (classes if name == "class" else ids).extend(frozenset(_NAME.findall(v)) for v in value.split())
                if name == "class" and value.split():
                    first = value.split()[0]
            elif name == "role":
                role = value
            else:
                hidden |= value == "true" or name == "hidden" and m[0].strip().lower() == "hidden"
    return first, classes, ids, role, hidden


def _is_cut(tag: str, role: str, hidden: bool, in_content: bool) -> bool:
    """Whether an element is cut for its tag, role or being hidden."""
    if tag in ("html", "body") or tag in CONTENT:
        return False
    if tag == "header":
        return not in_content
    return tag in CUT or role in CUT_ROLES or hidden


def _named(tag: str, classes: list[frozenset[str]], ids: list[frozenset[str]], in_content: bool) -> str:
    """What an element's class or id says it is: "cut", "reader" (readers' comments) or "" (nothing)."""
    if tag in ("html", "body"):
        return ""
    allowed = READER_NAMES if tag in CONTENT else CUT_IN_CONTENT if in_content else CUT_NAMES
    for parts in classes if in_content else classes + ids:
        if not parts <= allowed | PLACE_NAMES:
            continue
        if parts & READER_NAMES:
            return "reader"
        if parts & allowed or "header" in parts and not in_content and tag not in ("h1", "h2") and tag not in CONTENT:
            return "cut"
    return ""


def _without_named(out: list[tuple], spans: list[tuple[int, int, str, bool]], marked: bool) -> list[tuple]:
    """The stream without the elements cut by name; ``spans``: (start, end, what, in content) in the order of their starts."""
    if not spans:
        return out
    words = [0]
    for x in out:
        words.append(words[-1] + (x[2] if x[0] == "w" else 0))
    inside = sum(x[2] for x in out if x[0] == "w" and x[3] == "A")
    kept, at = [], 0
    for start, end, what, in_content in spans:
        if start < at:
            continue                                       # within one that is cut
        held, total = words[end] - words[start], inside if in_content else words[-1]
        if held == total or what != "reader" and (in_content or not marked) and 2 * held > total:
            continue                                       # the wrapper
        kept += [*out[at:start], ("t", "cut", True), ("t", "/cut", True)]
        at = end
    return kept + out[at:]


# Items of a page: ("t", key, is block) for tags, ("w", raw text, words, state, surroundings, in a link) for text.
def items(html: str) -> list[tuple]:
    """The page's stream, without what is cut out."""
    low = html.lower()
    marked = "<article" in low or "<main" in low
    out: list[tuple] = []
    stack: list[tuple[str, str]] = []                      # (tag, key) of open elements
    named: list[tuple[int, int, str, bool]] = []           # open elements that may be cut by name: depth, start, what, in content
    spans: list[tuple[int, int, str, bool]] = []           # the closed ones: start, end, what, in content
    paragraphs, blocks, links = [], [], [0]                # depths of open paragraphs and other blocks; open links
    content, cut_at, at, n = 0, -1, 0, len(html)           # open content elements; depth of the cut element, if any

    def close(depth: int) -> None:
        nonlocal content, cut_at
        while len(stack) > depth:
            tag, key = stack.pop()
            content -= tag in CONTENT
            links[0] -= tag == "a"
            for depths in (paragraphs, blocks):
                if depths and depths[-1] == len(stack):
                    depths.pop()
            if len(stack) == cut_at:
                cut_at = -1
                if tag not in INLINE_CUT:
                    out.append(("t", "/cut", True))
            elif cut_at < 0:
                out.append(("t", "/" + key, tag in BLOCK))
            if named and named[-1][0] == len(stack):
                _, start, what, in_content = named.pop()
                spans.append((start, len(out), what, in_content))

    def text(raw: str) -> None:
        if raw and cut_at < 0:
            words = len(raw.split())
            around = next((key for tag, key in reversed(stack) if tag in BLOCK), "")
            out.append(("w", raw, words, ("A" if content else "O") if marked else "N", around, links[0] > 0))

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing, raw = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            top = cut_at if cut_at >= 0 else named[-1][0] if named else -1
            if depth >= 0 and not (0 <= top and depth < top and tag not in BLOCK):
                close(depth)
            continue
        if tag in BLOCK and stack:                         # end tags that may be left out
            if stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
                close(len(stack) - 1)
            elif paragraphs and (not blocks or paragraphs[-1] > blocks[-1]):
                close(paragraphs[-1])                      # a block ends the paragraph that is open around it, whatever lies between
            elif tag == "body" and stack[-1][0] == "head":
                close(len(stack) - 1)
        if tag in CONTENT and cut_at >= 0 and stack[cut_at][0] not in CONTENT:
            close(cut_at)                                  # something cut out was never closed
        if tag in CONTENT and named and stack[named[0][0]][0] not in CONTENT and not content:
            close(named[0][0])
        first, classes, ids, role, hidden = _attributes(raw)
        key = f"{tag}.{first}" if first else tag
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            if cut_at < 0:
                out.append(("t", key, tag == "hr"))
                if tag == "br":
                    out.append(("w", " ", 0, "N", "", False))
            continue
        if tag in RAW:
            end = _end_tag(tag).search(html, at)
            at = html.find(">", end.end()) + 1 if end else n
            at = at or n
            if cut_at < 0 and tag not in INLINE_CUT:
                out.append(("t", "/cut", True))
            continue
        what = "" if cut_at >= 0 else "cut" if tag in HOLDERS else _named(tag, classes, ids, content > 0) if classes or ids else ""
        if cut_at < 0 and _is_cut(tag, role, hidden, content > 0):
            cut_at = len(stack)
            if tag not in INLINE_CUT:
                out.append(("t", "cut", True))
        elif cut_at < 0:
            if what:
                named.append((len(stack), len(out), what, content > 0))
            out.append(("t", key, tag in BLOCK))
        if tag in BLOCK:
            (paragraphs if tag == "p" else blocks).append(len(stack))
        links[0] += tag == "a"
        stack.append((tag, key))
        content += tag in CONTENT
    spans += [(start, len(out), what, in_content) for _, start, what, in_content in named]
    return _without_named(out, sorted(spans, key=lambda s: (s[0], -s[1])), marked)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest positive sum (the first, then the shortest, of ties)."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _down_links(page: list[tuple], scores: list[float]) -> None:
    """On a page that marks nothing, words of blocks that are mostly links count against the region."""
    start = words = linked = 0
    for i, x in enumerate([*page, ("t", "", True)]):
        if x[0] == "w":
            words, linked = words + (x[2] if x[3] == "N" else 0), linked + (x[2] if x[5] and x[3] == "N" else 0)
        elif x[2]:
            if 2 * linked > words:
                for j in range(start, i):
                    if page[j][0] == "w":
                        scores[j] = -WORD * page[j][2]
            start, words, linked = i, 0, 0


def extract(html: str | None, weights: Weights) -> str:
    """The main text of a page."""
    page = items(html or "")
    scores = [0.0 if x[0] == "t" and x[1].split(".")[0] in FREE else weights.tag(x[1]) if x[0] == "t"
              else x[2] * weights.word(x[3], x[4]) for x in page]
    _down_links(page, scores)
    a, b = best_region(scores)
    blocks, parts = [], []
    for x in page[a:b] + [("t", "", True)]:
        if x[0] == "w":
            if x[3] != "O":                                # between several marked parts
                parts.append(x[1])
        elif x[2]:
            block = " ".join(entities.unescape("".join(parts)).split())
            if block:
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def count_keys(html: str | None) -> tuple[Counter, Counter]:
    """Of a labelled page: tags and words inside and outside its marked part, (kind, state, key) -> number."""
    inside, outside = Counter(), Counter()
    low = (html or "").lower()
    mark = next((m for m in ("article", "main") if len(re.findall(rf"<{m}[\s>]", low)) == 1), None)
    if mark is None:
        return inside, outside
    depth = 0
    for x in items(html):
        if x[0] == "w":
            side = inside if depth else outside
            for key in (x[4], "*"):
                side["w", x[3], key] += x[2]
                side["w", "N", key] += x[2]
        elif x[1] not in ("cut", "/cut"):
            name = x[1].lstrip("/").split(".")[0]
            border = name == mark
            if border:
                depth = 0 if x[1].startswith("/") else 1
            side = inside if depth and not border else outside
            for key in {x[1], x[1].split(".")[0]}:
                side["t", "", key] += 1
    return inside, outside


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        inside, outside = Counter(), Counter()
        for page in pdf["html"]:
            i, o = count_keys(page)
            inside.update(i)
            outside.update(o)
        keys = list(inside.keys() | outside.keys())
        if not keys:
            continue
        yield pd.DataFrame({"kind": [k[0] for k in keys], "state": [k[1] for k in keys], "key": [k[2] for k in keys],
                            "inside": [float(inside[k]) for k in keys], "outside": [float(outside[k]) for k in keys]})


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from the labelled pages of a sample of bounded size."""
    total = pages.count()
    sample = pages.select(F.col(html_col).alias("html"))
    if total > sample_pages:
        part = int(1_000_000 * sample_pages / total)
        sample = sample.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < part)
    rows = (sample.mapInPandas(_counts, "kind string, state string, key string, inside double, outside double")
            .groupBy("kind", "state", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
            .collect())                                    # the keys of the sampled pages
    weights = Weights()
    for r in rows:
        n = r.inside + r.outside
        if not n:
            continue
        if r.kind == "t":
            weights.tags[r.key] = TAG_LEAST + (TAG_OUTSIDE - TAG_LEAST) * r.outside / n
        elif r.state != "N":
            weights.words[r.state, r.key] = WORD * (2 * r.inside / n - 1)
        elif r.key != "*":                                 # pages that mark nothing: a block counts as far as it leaned to content
            weights.words["N", r.key] = WORD * max(0.1, 2 * r.inside / n - 1)
    return weights


def extract_udf(weights: Weights):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p, weights) for p in pages], dtype=object)
    return run


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    text = pages.select("page_id", "url", extract_udf(learn(pages))(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
