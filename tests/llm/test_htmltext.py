"""Main texts against plain searches of the given pages, and small pages of every kind."""

from __future__ import annotations

import html
import re
import time

import pytest

from fieldloom.llm import htmltext
from fieldloom.llm.htmltext import article_text


def test_given_pages_against_a_plain_search(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in htmltext.extracted(pages).collect()}
    assert len(found) == pages.count()
    for page in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page["html"], re.DOTALL)[1]
        plain = " ".join(html.unescape(re.sub(r"<(/?p|br|/?h1)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"], found[page["page_id"]]["url"]) == (plain, len(plain), page["url"])


LONG = "Some words that stand in a row and make a paragraph of the main text, long enough to surge above all menus around it."

PAGES = {
    "article": ("<body><nav><li>Home</nav><article><h1>T</h1><p>Be.<p>a<b>b</b>c &lt;d&gt; e&nbsp;f</article><footer>x</footer>", "T Be. abc <d> e f"),
    "no element marks it": (f"<div id=menu><a href=/>Home</a></div><div><p>{LONG}<p>Short.<p>{LONG}</div><div><a href=1>one</a><br><a>two</a><br><a>three</a><br><a>4</a></div>", f"{LONG} Short. {LONG}"),
    "main": (f"<p>{LONG}</p><main><p>Only this.</p></main>", "Only this."),
    "parts inside": (
        "<article>One.<aside>no</aside><div class='ad-box'>no</div><form><p>no</form><script>var a='<p>no</p>'</script><style>no</style><!-- <p>no --><p>Two."
        "<section id=comments><article>no</article></section><div role=navigation>no</div><p hidden>no</p><p style='display: none'>no<p>Three.</article>", "One. Two. Three."),
    "header": ("<header><h1>Site</h1></header><div class='header'>no</div><article><header><h1>Title</h1></header><p>Text.</article>", "Title Text."),
    "never closed": ("<nav><ul><li>no<div class=ad>no<article><p>Text", "Text"),
    "cut off in a tag": ("<article><p>Text</p><p cla", "Text"),
    "cut off in a reference": ("<article><p>a &am", "a &am"),
    "cut off in a script": ("<article><p>Text<script>no no", "Text"),
    "no sidebar": (f"<div class='page no-sidebar'><p>{LONG}</p></div>", LONG),
    "links in a paragraph": (f"<p>{LONG} <a href=/>A link</a>, then more.</p>", f"{LONG} A link, then more."),
    "plain text": ("just a < b and c", "just a < b and c"),
    "quoted tags": ("<article data-x='</article>'><p title=\"a > b\">Text</p></article>after", "Text"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_small_pages(name):
    page, text = PAGES[name]
    assert article_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<div>", "<p class=ad>", "<", "<!--", "<script>", "<nav><article>", "&amp", "x " * 9])
def test_time_in_proportion_to_the_page(piece):
    def took(n):
        began = time.process_time()
        article_text(piece * n)
        return time.process_time() - began

    small = min(took(20_000) for _ in range(3))
    assert took(160_000) < 40 * small + 0.5


def test_rows_of_any_kind(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<article>a</article>", "x", 1), (1, "u", "<article>a</article>", "x", 1), (None, None, None, None, None), (2, None, "<p>" + "w " * 300_000, "", 0)]
    found = sorted(htmltext.extracted(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r["page_id"] or 0, r["n_chars"]))
    assert [(r["page_id"], r["n_chars"]) for r in found] == [(None, 0), (1, 1), (1, 1), (2, 599_999)]
    assert htmltext.extracted(spark.createDataFrame([], schema)).collect() == []
