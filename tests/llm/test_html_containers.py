"""Pages with several containers, nested ones, and ones that are not the article."""

import pytest

from marketpulse.llm import htmltext


def text(k):
    return f"Paragraph {k} holds a sentence that is long enough to be text, more or less, and so on."


def paragraphs(*numbers):
    return "".join(f"<p>{text(k)}</p>" for k in numbers)


def test_sibling_articles_are_all_kept():
    page = "".join(f"<article><h2>Part {k}</h2>{paragraphs(*range(3 * k, 3 * k + 3))}<p>End {k}.</p></article>" for k in range(3))
    parts = [[f"Part {k}", *map(text, range(3 * k, 3 * k + 3)), f"End {k}."] for k in range(3)]
    assert htmltext.main_text(f"<body>{page}</body>").split("\n") == sum(parts, [])


def test_outermost_container_is_taken_whole():
    page = f"<main><h1>T</h1><div class=content>{paragraphs(0, 1, 2)}</div><p>end</p></main>"
    assert htmltext.main_text(page).split("\n") == ["T", text(0), text(1), text(2), "end"]
    entries = "".join(f"<div class=entry>{paragraphs(k, k + 1)}</div>" for k in (0, 2, 4))
    assert htmltext.main_text(f"<div class=post>{entries}</div>").split("\n") == [text(k) for k in range(6)]


def test_teaser_does_not_replace_the_text():
    teaser = "<article><h3>Other</h3><p>A short teaser.</p></article>"
    content = f"<div class=content>{paragraphs(*range(8))}</div>"
    for page in (teaser + content, content + teaser):
        assert htmltext.main_text(page).split("\n") == [text(k) for k in range(8)]


def test_many_containers_on_one_page():
    page = "".join(f"<article>{paragraphs(k)}</article>" for k in range(300))
    assert htmltext.main_text(page).split("\n") == [text(k) for k in range(300)]


def test_threshold_decides_before_containers():
    page = f"<body><article><p>A short note of little weight.</p></article><div>{paragraphs(*range(8))}</div></body>"
    assert htmltext.main_text(page).split("\n") == [text(k) for k in range(8)]


ARTICLE = "<h1>Title</h1><p>" + "Word of the long article text. " * 20 + "</p><p>Second paragraph here.</p>"
LAYOUTS = [
    '<div class="layout has-sidebar"><article>%s</article><div class="sidebar">menu of things</div></div>',
    '<div class="page no-sidebar">%s</div>',
    '<div class="content with-toc">%s<div class="toc">1 2 3</div></div>',
    '<div id="search-results-page"><main>%s</main></div>',
    '<div class="search-page"><main>%s<div class="comments"><p>A reader says so.</p></div></main></div>',
    '<form id="aspnetForm"><input name="q"><article>%s</article><div class="site-footer">imprint</div></form>',
    '<form id="aspnetForm"><div>%s</div><div class="related-posts"><p>See this too</p></div></form>',
    '<div class="widget-area"><main>%s</main></div><div class="comments-area"><article>A reader says so.</article></div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_wrappers_of_everyday_layouts(layout):
    page = f"<html><body><nav>Home</nav>{layout % ARTICLE}<footer>Imprint</footer></body></html>"
    expected = ["Title", " ".join(["Word of the long article text."] * 20), "Second paragraph here."]
    assert htmltext.main_text(page) == "\n".join(expected)


def test_wrappers_that_stay_marked():
    body = "".join(f"<p>{'Plain text of the page. ' * 10}</p>" for _ in range(5))
    for name in ("comments", "comment-list", "discussion"):  # however long, never the article
        assert htmltext.main_text(f'<body><div class="{name}">{body}</div><p>The page.</p></body>') == "The page."
    advert = f'<div class="ad">{body}</div><article><p>Short.</p></article>'
    assert htmltext.main_text(f"<body>{advert}</body>") == "Short."
    assert htmltext.main_text(f'<body><div hidden><article>{body}</article></div><p>The page.</p></body>') == "The page."
