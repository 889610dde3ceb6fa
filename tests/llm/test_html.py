"""Main text of pages: one page per kind of thing that is not the article, and the rules one by one."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lexlake.llm import block_rules as br

SF = "/root/testdata/sf0.001"
PROSE = (
    "The river that runs by the old mill was low in the summer, and the people of the village walked across it with "
    "their shoes in their hands, as it was the shortest way to the market on the other side of the valley."
)
MORE = (
    "In the autumn the rain came back, and for weeks it was not safe to cross at all, so that they had to go by the long "
    "road, which took the better part of the morning and left them with little of the day for what they had to do."
)
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact"))
AROUND = [
    f"<nav><ul>{LINKS}</ul></nav>",
    "<header><p>The Valley Times, for all who live in the valley and in the hills</p></header>",
    f'<div class="sidebar"><p>{PROSE[::-1]}</p></div>',
    f'<div id="cookie-notice"><p>We use cookies so that it is as good as it can be for you. {MORE}</p><button>OK</button></div>',
    '<div class="ad">Buy the shoes that the whole of the valley is talking about, now for half of the price!</div>',
    "<form><label>Your name</label><input name=n><p>By this you agree to the rules of the house</p></form>",
    "<script>var a = '<p>the of and</p>';</script><style>p{}</style><noscript>Please turn it on</noscript>",
    f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{MORE}</p></article></section>',
    f"<aside><p>{PROSE}</p></aside>",
    "<footer>&copy; the people of the valley &middot; <a href='/l'>legal</a></footer>",
    f'<div role="complementary">{PROSE}</div>',
    f"<div hidden>{PROSE}</div>",
    f"<div><h2>Leserkommentare (3)</h2><div><p>{PROSE}</p></div></div>",
    "<!-- the of and <p>in</p> -->",
]


@pytest.mark.parametrize("thing", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", '<div class="post has-sidebar">{}</div>'])
def test_what_is_left_out(thing, wrap):
    article = wrap.format(f"<h1>A river</h1><p>{PROSE}</p><p>It rained.</p><p>{MORE}</p>")
    want = f"A river\n\n{PROSE}\n\nIt rained.\n\n{MORE}"
    page = "<!DOCTYPE html><html><head><title>A river</title></head><body>{}</body></html>"
    assert br.main_text(page.format(article + thing)) == want
    assert br.main_text(page.format(thing + article)) == want
    if "</article>" in article and "<p>{}" not in thing:
        inside = article.replace("<p>It rained", thing + "<p>It rained")
        if "omments" not in thing and "ommentare" not in thing and not thing.startswith("<header"):
            assert br.main_text(page.format(inside)) == want


def test_open_blocks_inherit():
    # a short block goes with the nearest decided one, a heading with what it heads
    page = f"<div><p>{PROSE}</p><p>A short one.</p><h3>See too</h3><ul>{LINKS}</ul></div>"
    assert br.main_text(page) == f"{PROSE}\n\nA short one."
    page = f"<ul>{LINKS}</ul><p>By one of us</p><h2>The river</h2><p>{PROSE}</p>"
    assert br.main_text(page) == f"The river\n\n{PROSE}"
    # nothing is decided: only a marked article is believed
    assert br.main_text("<article><h1>Short</h1><p>One line.</p></article>") == "Short\n\nOne line."
    assert br.main_text("<div><p>One line.</p></div>") == ""
    # long, but no prose, among prose
    code = "xq-zz 77 klm vv " * 20
    assert br.main_text(f"<p>{PROSE}</p><p>{MORE}</p><div>{code}</div>") == f"{PROSE}\n\n{MORE}"
    # no stop words are known for this page: length decides
    han = "河流经过老磨坊，夏天水很浅。" * 12
    assert br.main_text(f"<ul>{LINKS}</ul><div><p>{han}</p></div>") == han
    # a form around the whole page
    assert br.main_text(f"<form><h1>A river</h1><p>{PROSE}</p></form>") == f"A river\n\n{PROSE}"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &amp;amp; &amp &nosuch; &am", "a & b <c> ééé &amp; & &nosuch; &am"),
        ("one\n\t two&nbsp;&#160;three<br>four", "one two three four"),
        ("one<br><br>two", "one\n\ntwo"),
        ("in<b>side</b> <i>a</i> w<!-- x -->ord", "inside a word"),
        ("<p>one<p>two<li>three<td>four", "one\n\ntwo\n\nthree\n\nfour"),
        ("a < b and c<3 </ d", "a < b and c<3 </ d"),
        ("x<p class='a>b' title=\"</article>\">y</p>z", "x\n\ny\n\nz"),
        ("x<P CLASS=q/>y</P\n>z", "x\n\ny\n\nz"),
        ("x<svg><p>no</p></svg>y<svg/>z<button>no</button>", "xyz"),
        ("x<script>if (a</b) '</p>'</script >y<script>never closed <p>no", "xy"),
        ("x<!-- no --!> <p>no</p>", "x"),
        ("x<?php no ?><![CDATA[no]]>y", "xy"),
        ("x<p", "x"),
        ("x<p class='never closed>no</p>no", "x"),
        ("x</i></p></section>y", "x\n\ny"),
        ("<a href=1>link", ""),
        ("", ""),
    ],
)
def test_markup(inner, text):
    assert br.main_text(f"<nav>menu</nav><article>{inner}") == text


def test_long_odd_pages_take_linear_time():
    for part in ("<svg>", "<p ", "<a b='", "<!--", "</x", "<div>", "</div>", "<b><p>", "&#1", "<p a=b "):
        br.main_text("<article>" + part * 60_000)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in br.extracted(pages).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        # the article of these pages holds h1, p, b and br alone
        article = re.search(r"<article>(.*?)(?:</article>|<[^>]*$|$)", row.html or "", re.S)
        parts = re.split(r"</?(?:h1|p)>", article[1] if article else "")
        plain = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
        assert got[row.page_id].text == "\n\n".join(p for p in plain if p)
        assert got[row.page_id].n_chars == len(got[row.page_id].text) and got[row.page_id].url == row.url


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", None), (2, None, ""), (None, None, f"<p>{PROSE}</p>"), (None, None, f"<p>{PROSE}</p>"), (3, "u", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame(rows, schema)
    for df in (pages, pages.select("*", *[F.lit("own").alias(c) for c in ("text", "n_chars", "block")])):
        got = br.extracted(df)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, len(PROSE))] * 2 + [(1, 0), (2, 0), (3, 999_999)]
        assert br.extracted(df.where("false")).collect() == []
