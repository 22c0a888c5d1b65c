import html as entities
import re

import numpy as np
from cases import ordered

from marketpulse.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><div id=cookie-notice>We use <b>cookies</b></div>
<nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav><!-- <p>no comment</p> -->
<main><article><h1>A &amp; B</h1><p>First &lt;paragraph&gt; with a fair amount of text, and&nbsp;more of it.<p>Second   para
<b>bold<br>after</b></p><div class="ad">Buy now</div><ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table>
<form><label>Mail</label><input></form><aside>aside</aside><p>Short.</p></article>
<section class="comments"><article class="comment"><p>A reader's comment, long enough to look like content, it is.</p>
</article></section></main><footer>&copy; all rights</footer></body></html>"""
TEXT = "A & B\nFirst <paragraph> with a fair amount of text, and more of it.\nSecond para bold after\nOne\nTwo\nc1\nc2\nShort."


def test_article_of_a_page():
    assert htmltext.main_text(PAGE) == TEXT


def test_page_without_container_is_cut_by_its_ratios():
    links = "<ul>" + "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(12)) + "</ul>"
    body = "".join(f"<p>Paragraph {k} holds a sentence that is long enough to be text, more or less.</p>" for k in range(6))
    found = htmltext.main_text(f"<body><div>{links}</div><h2>Head</h2>{body}<div>{links}</div></body>")
    assert found.split("\n")[0] == "Head" and len(found.split("\n")) == 7 and "link" not in found


def test_broken_and_empty_pages():
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("  just \n text ") == "just text"
    assert htmltext.main_text("<article><p>open <b>bold <p>next") == "open bold\nnext"
    assert htmltext.main_text("<article><p>a</div></span></p></article></article>") == "a"
    assert htmltext.main_text("<article><p>cut <!-- never closed") == "cut"
    assert htmltext.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "word " * 200_000
    assert htmltext.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_smoothing_keeps_constants():
    assert np.allclose(htmltext.smooth(np.full(7, 3.0)), 3.0)
    assert len(htmltext.smooth(np.zeros(1))) == 1


def expected(page):
    article = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)[^>]*>", article)
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, expected(r.html), len(expected(r.html))) for r in pages.collect()]
    assert ordered(htmltext.extract(pages).collect()) == ordered(rows)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", PAGE, None, None), (2, "v", "", "x", 1), (2, "v", "", "x", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert ordered(got.collect()) == ordered([(1, None, "", 0), (None, "u", TEXT, len(TEXT)), (2, "v", "", 0), (2, "v", "", 0)])
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0
