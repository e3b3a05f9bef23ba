"""Pages written by hand, apart from the labelled pages that the field is trained on: (html, main text)."""

import time

import pytest

from learnmill.llm import html

ARTICLE = "<h1>Rain in the valley</h1><p>It rained for three days. The river rose.</p><p>Nobody was hurt.</p>"
TEXT = "Rain in the valley It rained for three days. The river rose. Nobody was hurt."
PAGES = {
    "title first": ("<article><h1>Title here</h1><p>Main text is here, with several words.</p><p>Second para of text here.</p></article>", "Title here Main text is here, with several words. Second para of text here."),
    "two letters": ("<body><p>A</p><p>B</p></body>", "A B"),
    "one paragraph": ("<p>Only text.</p>", "Only text."),
    "plain text": ("Some plain text.\n\nMore of it here", "Some plain text. More of it here"),
    "plain words": ("Plain words", "Plain words"),
    "one in an article": ("<article><p>One paragraph in an article.</p></article>", "One paragraph in an article."),
    "modal after a menu": ("<nav><ul><li><a href=/>Start</a></li></ul></nav><article><p>First para is a sentence.</p><div class=modal>Please join our list today.</div><p>Second para of it.</p></article>", "First para is a sentence. Second para of it."),
    "modal alone": ("<article><p>First para is a sentence.</p><div class=modal>Please join our list today.</div><p>Second para of it.</p></article>", "First para is a sentence. Second para of it."),
    "overlay": (f"<div class='overlay'><p>Sign up today and save.</p></div><main>{ARTICLE}</main>", TEXT),
    "hidden": ("<article><p>First para is a sentence.</p><div hidden>Not for eyes of readers.</div><p>Second para of it.</p></article>", "First para is a sentence. Second para of it."),
    "display none": (f'<main>{ARTICLE}<p style="display: none">Track me, please do.</p></main>', TEXT),
    "comments under a heading": (
        "<article><h1>News of day</h1><p>Something happened today in town.</p><ol><li>First step is this.</li><li>Second step is that.</li></ol></article><h2>Comments</h2><ol><li><p>Great post, thanks!</p></li><li><p>I disagree with you.</p></li></ol><footer>© me</footer>",
        "News of day Something happened today in town. First step is this. Second step is that.",
    ),
    "comments by class": (f'<div id="content"><article>{ARTICLE}</article><ol class="commentlist"><li><cite>Ann</cite><p>I was there and it was wet.</p></li></ol></div>', TEXT),
    "blog": (
        '<html><body class="has-sidebar home"><div id="page"><header id="masthead"><p class="site-title"><a href="/">My Blog</a></p><nav class="main-navigation"><ul><li><a href="/">Home</a></li></ul></nav></header>'
        f'<div id="content" class="site-content"><main id="main"><article id="post-1" class="post"><header class="entry-header"><h1 class="entry-title">Rain in the valley</h1></header><div class="entry-content">{ARTICLE[27:]}</div>'
        '<footer class="entry-footer"><span class="tags-links">Tagged <a href="/t">rain</a></span></footer></article><div id="comments" class="comments-area"><h2 class="comments-title">Two thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely, thanks a lot.</p></li></ol></div></main></div>'
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=x>Soup</a></li></ul></section></aside><footer id="colophon" class="site-footer"><div>Proudly made by us.</div></footer></div></body></html>',
        TEXT,
    ),
    "table layout": (f"<table><tr><td class=menu><a href=/a>One</a><br><a href=/b>Two</a></td><td class=content>{ARTICLE}</td></tr></table>", TEXT),
    "adverts inside": (f'<section class="content"><h1>Rain in the valley</h1><div class="ad-slot">Buy boots now!</div><p>It rained for three days. The river rose.</p><aside class="promo"><p>Win a trip to the sea.</p></aside><p>Nobody was hurt.</p></section>', TEXT),
    "forms and buttons": (f'<form class="search"><label>Find</label><input name=q></form><div class="post">{ARTICLE}</div><form><p>Write to us</p><textarea>x</textarea><button>Send</button></form>', TEXT),
    "scripts and references": ("<style>p{}</style><script>if (a<b) document.write('<p>no</p>')</script><article><p>Fish &amp; chips cost &pound;5 &#x2014; or less.</p><noscript><p>Turn it on.</p></noscript></article>", "Fish & chips cost £5 — or less."),
    "unclosed": ("<nav><a href=/>Start<a href=/x>News</nav><article><h1>Rain in the valley<p>It rained for three days. The river rose.<p>Nobody was hurt.", TEXT),
    "cookie line": (f"<div id='cookie-consent'><span>This site uses cookies.</span> <button>OK</button></div>{ARTICLE}", TEXT),
    "related": (f"<article>{ARTICLE}</article><h3>Related</h3><ul><li><a href=/1>Snow on the hill</a></li><li><a href=/2>Wind at sea</a></li></ul>", TEXT),
    "no text": ("<nav><ul><li><a href=/>Start</a></li></ul></nav><footer>&copy; 2020 Us. All rights reserved.</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_layouts(name):
    page, want = PAGES[name]
    assert html.extract(page, html.trained()) == want


@pytest.mark.parametrize("page", ["<button>" * 100_000, "<button>x" * 50_000, "<div>x" * 50_000, "<select>x</select" * 50_000, '<a href="' * 100_000 + ">", "<div></p>x" * 50_000, "<!--" * 100_000, "<" * 200_000, "<ul><li>x" * 30_000])
def test_time_grows_with_the_length_alone(page):
    html.trained()
    began = time.time()
    html.extract(page, html.trained())
    assert time.time() - began < 3


def test_awkward_tables(spark):
    page = PAGES["blog"][0]
    rows = [(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, page, "t", 5), (2, "v", f"<article><p>{'long words here. ' * 60_000}</p></article>", "t", 5)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = [(x["page_id"], x["text"]) for x in html.main_text(spark.createDataFrame(rows, schema)).collect()]
    assert got[:3] == [(1, TEXT), (1, TEXT), (None, TEXT)] and len(got[3][1]) == 17 * 60_000 - 1
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0
