"""Main text of pages: layouts with and without names, HTML that is broken, odd rows, and the given pages against their article."""

import html
import re
import time

import pytest

from gleaner.llm import main_text, queries
from gleaner.llm.main_text import main_text as text_of

from .test_llm import DATA

LONG = [f"Paragraph {k} of the article goes on for a while, with commas, a reason and an end that is not a link." for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in LONG)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(9)) + "</ul>"
WANT = " ".join(["The title", *LONG])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{MENU}</nav><article><h1>The title</h1>{BODY}</article><footer>Imprint</footer></body>",
        f"<body><header><h1>Site</h1></header><main><h1>The title</h1>{BODY}</main><aside><p>{LONG[0]}</p></aside>",
        f"<div>{MENU}</div><div><h1>The title</h1><div>{BODY}</div></div><div>All rights reserved</div>",
        f"<div class=wrapper><div id=sidebar><p>{LONG[1] * 5}</p></div><div id=content><h1>The title</h1>{BODY}</div><div id=comments><div><p>{LONG[2] * 9}</p></div></div></div>",
        f"<article><header><h1>The title</h1></header>{BODY}<section class='comments'><article class=comment><p>{LONG[3] * 9}</p></article></section><footer>by X</footer></article>",
        f"<article><h1>The title</h1><form><label>{LONG[0]}</label><textarea>{LONG[0]}</textarea></form>{BODY}<div class='ad-slot top'>Buy</div></article><div class=cookie-notice><p>{LONG[4] * 3}</p></div>",
        f"<article><h1>The title</h1><section>{''.join(f'<p>{p}</p>' for p in LONG[:2])}</section><section>{''.join(f'<p>{p}</p>' for p in LONG[2:])}</section></article>",
        f"<div><h1>The title</h1><section>{''.join(f'<p>{p}</p>' for p in LONG[:3])}</section><section>{''.join(f'<p>{p}</p>' for p in LONG[3:])}</section></div><div>{MENU}</div>",
        f"<html><head><title>The <b>title</title><style>p{{}}</style><script>var t='</p>' + \"<article>\"</script></head><table><tr><td>{MENU}<td><h1>The title</h1>{BODY}</table>",
        f"<body class='has-sidebar no-comments'><div class='article-with-sidebar'><h1>The title</h1>{BODY}</div><div role=contentinfo>Imprint</div><div hidden>{LONG[1]}</div>",
    ],
)
def test_layouts(page):
    assert text_of(page) == WANT


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain text &amp; no tags", "plain text & no tags"),
        ("<p>one<p>two<br>three<b>four</p>five</b> six", "one two threefour five six"),
        ("<p>a &lt;b&gt; &#8364; &#x41; &copy &unknown; &amp;amp;</p>", "a <b> € A © &unknown; &amp;"),
        ("<p>1 < 2 <3 <> </> <!-- a > b -->x<!-->y<!---->z<?php 1 ?></p>", "1 < 2 <3 <> xyz"),
        ("<p>kept <a title='a > b' href=x>link</a> <span class=ad>no</span>end</p><!-- never ends <p>gone", "kept link end"),
        ("<p>kept</p><p title='never ends>gone", "kept"),
        ("<p>kept</p><script>gone <p>gone</p>", "kept"),
        ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", "one two deep three"),
        ("<table><tr><td>a<td>b<tr><td>c</table></td></tr>d", "a b c d"),
        ("<tr><td>no table</td></tr>", "no table"),
        ("<p>wide space&nbsp;\t\n\x0cand <pre> more\n lines </pre></p>", "wide space and more lines"),
        ("<nav>only a menu</nav><script>x</script>", ""),
        ("<h1>A<h2>B</h1>C</h2></div></p></body></html>D", "A B C D"),
        ("<svg><text>no</text></svg><p>yes<p><p>", "yes"),
        ("<a href=1>one<a href=2>two<p>three</a>four</p>", "onetwo threefour"),
    ],
)
def test_broken_html(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("part", ["<div>", "<p>", "<b>", "<a>x", "</p>", "<table><td>", "<li>", "<ul><li>", "<!--", "<", "<a href='", "&", "<header><article>", "<tr>", "<td>", "<div><a>x</a><a>y</a><a>z</a>", "</b><b><p>", "<script>"])
def test_time_is_in_proportion(part):
    began = time.time()
    text_of("<article><p>x" + part * 20_000)
    assert time.time() - began < 15


def test_articles_of_the_given_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.QUERIES["op12_main_text"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert got[r.page_id] == (r.url, want, len(want))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x\U0001f600</p>"), (3, "v", "<p>same"), (3, "v", "<p>same"), (4, "w", "<p>" + "long words " * 200_000)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or -1, r.url, r.text[:20], r.n_chars) for r in main_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (-1, "u", "x\U0001f600", 2), (3, "v", "same", 4), (3, "v", "same", 4), (4, "w", "long words long word", 2_199_999)], key=str)
    assert main_text.extract(pages.where("page_id = 99")).collect() == []
