import html
import itertools
import re

import pytest
from pyspark.sql import types as T

from pulse.llm import html_text as op
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.001"
PLAIN = op.Weights()
BODY = "<h1>A &amp; B</h1><p>one  two\n three <b>fo</b>ur<br>five &nbsp; six</p><p>seven eight</p>"
TEXT = "A & B\none two three four five six\nseven eight"


def in_article(page):
    """The plain reading of a page whose one article holds only headings, paragraphs and inline tags."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1]) if m else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_best_region_against_brute_force():
    for scores in itertools.product([-2.0, -1.0, 0.0, 1.0, 3.0], repeat=5):
        a, b = op.best_region(list(scores))
        best = max([0.0] + [sum(scores[i:j]) for i in range(5) for j in range(i + 1, 6)])
        assert sum(scores[a:b]) == best


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title></head><body><nav><a>m</a></nav><article>{BODY}</article><footer>f</footer></body></html>",
    f"<article>{BODY}<aside>see also this</aside></article><div class='comments'>words words words words words words</div>",
    f"<header>Site</header><main>{BODY}</main><form>name <input> <button>go</button></form><section id=comments><p>me too me too me too",
    f"<script>if (a < b) x = '<p>no</p>';</script><div class=\"cookie-notice\">we use cookies on this site <div>ok</div></div>{BODY}",
    f"<div class=ad>buy now buy now<article>{BODY}</article>",
    f"<body><ul class=menu><li>a<li>b</ul><div id=content>{BODY}</div><div class='sidebar'>x<div>y</div></div><!-- c --></body>",
    f"<table><tr><td><nav>menu</nav></td></tr></table><ARTICLE title=\"a > b\">{BODY}<style>p{{}}</style></ARTICLE>",
])
def test_page_shapes(page):
    assert op.extract(page, PLAIN) == TEXT


def test_edges():
    for page in (None, "", "   ", "<p>", "<nav>only a menu</nav>", "<!-- never closed", "<script>x"):
        assert op.extract(page, PLAIN) == ""
    assert op.extract("just text &lt;here&gt; &#233;", PLAIN) == "just text <here> é"
    assert op.extract("1 < 2 & 3 > 2", PLAIN) == "1 < 2 & 3 > 2"
    long = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    assert op.extract(long, PLAIN).count("\n") == 49_999
    assert op.extract("<div " * 20_000 + "\"'" * 10_000 + "x", PLAIN) is not None


def test_pages(spark):
    pages = {r.page_id: r for r in read_table(spark, SF, "pages").collect()}
    got = op.op3_html_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == in_article(pages[r.page_id].html)


def test_learned_weights_and_clashing_names(spark):
    page = "<body><div class=intro>some words here</div><article><p>the text of it</p></article><p>tail</p></body>"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("html", "text", "key", "inside")])
    pages = spark.createDataFrame([(page, "t", "k", "i")] * 5 + [(None, "t", "k", "i"), ("", "t", "k", "i")], schema)
    weights = op.learn(pages)
    assert weights.tag("p") > weights.tag("div.intro") == op.TAG_OUTSIDE
    assert weights.word("A", "p") > 0 > weights.word("O", "div.intro")
    assert [r[0] for r in pages.select(op.extract_udf(weights)("html")).collect()] == ["the text of it"] * 5 + ["", ""]
    assert op.learn(spark.createDataFrame([], schema)).tags == {}


def test_letters_whose_lower_case_is_longer():
    dotted = "\u0130" * 9
    page = f"<p>{dotted} one</p><script>a</SCRIPT ><p>two</p><style>b</Style><b>three</b><title>c</title><p>four</p><script>"
    assert op.extract(page, PLAIN) == f"{dotted} one\ntwo\nthree\nfour"


@pytest.mark.parametrize("page", [
    f"<body class='menu-open'><div class='page no-sidebar'>{BODY}</div></body>",
    f"<div class='ad-free no-header' id=search-results>{BODY}</div>",
    f"<div class=social>{BODY}</div>",
    f"<div id=page class='site widget'><div class='sidebar'>a b</div><div class=promo>{BODY}</div></div>",
    f"<div class=header><h2>Site</h2></div><div class='left-sidebar'>a b c</div>{BODY}<div class='social-links'>x y</div>",
    f"<main><div class=banner>{BODY}</div></main><div id=comments>{'me too ' * 40}</div>",
    f"<div class='post'>{BODY}</div><div class='comments-area'>{'me too ' * 40}</div>",
    f"<article>{BODY}<div class=ad>buy <b>now</b></div><div class='comments'>me too</div></article>",
])
def test_wrappers_and_named_parts(page):
    assert op.extract(page, PLAIN) == TEXT


def test_sections_of_the_content_stay():
    page = ("<article><h1>One of these</h1><section id='discussion'><h2 id='search'>Two of these</h2><p>three three three four</p></section>"
            "<div class='related-work'><p>five five five six</p></div><div class='discussion'><p>seven seven seven</p></div>"
            "<p class='notice'>eight eight eight</p></article>")
    assert op.extract(page, PLAIN) == ("One of these\nTwo of these\nthree three three four\nfive five five six\nseven seven seven\n"
                                       "eight eight eight")


WORDS = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="module")
def learned(spark):
    return op.learn(read_table(spark, SF, "pages"))


def test_a_form_around_the_page_or_its_content_is_its_wrapper(learned):
    assert op.extract(f"<body><form><p>{WORDS}</p><p>more text</p></form></body>", learned) == f"{WORDS}\nmore text"
    page = f"<body><form><div>Menu</div><article><p>{WORDS}</p><form>Your mail <input></form></article></form></body>"
    assert op.extract(page, learned) == WORDS
    assert op.extract(f"<body><p>{WORDS}</p><form><p>Search this site</p></form></body>", learned) == WORDS


def test_all_marked_articles_are_kept_and_nothing_between(learned):
    for c in ("", " class='post'"):
        page = f"<body><p>Top</p><article{c}><p>{WORDS}</p></article><div>between</div><article{c}><p>{WORDS} two</p></article><p>end</p></body>"
        assert op.extract(page, learned) == f"{WORDS}\n{WORDS} two"


def test_blocks_of_links_on_unmarked_pages_are_left_out(learned):
    links = "".join(f"<li><a href='{i}'>Page number {i}</a></li>" for i in range(6))
    page = f"<body><ul>{links}</ul><div><p>{WORDS} <a href=x>a link</a> within.</p></div><div><a href=c>Imprint</a> <a href=d>Contact us</a></div></body>"
    assert op.extract(page, learned) == f"{WORDS} a link within."


def test_a_block_ends_the_open_paragraph_through_any_inline_tags(learned):
    inline = "<b><i><u><s><em><strong>"
    assert op.extract(f"<body><p>{inline}{WORDS}<div>next block</div></body>", op.Weights()) == f"{WORDS}\nnext block"
