import html
import random
import re
import time

import pytest

from tidemark.llm import html_extract as h
from tidemark.llm.queries import op3_html_extraction

WEIGHTS = h.weights_of({("word", "p"): [900, 10], ("word", "h1"): [50, 1], ("word", "a"): [20, 80], ("tag", "p"): [100, 1], ("tag", "/p"): [100, 1], ("tag", "nav"): [0, 50], ("tag", "footer"): [0, 50], ("tag", "article"): [0, 50], ("tag", "/article"): [0, 50], ("tag", "div"): [1, 80], ("tag", "/div"): [1, 80]})


def test_query_gives_each_article(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op3_html_extraction(spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>Best of all our many pages</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make all of it better for you.</p></div>
<aside><p>Something that stands beside the text and has many words in it too.</p></aside>
<main><article><header><h1>The  title &amp; more</h1></header><p>First para&shy;graph with <b>bold</b> and <a href="#">a link</a>,<br>two lines.
<p>Second one: x &lt; y&nbsp;z.</p><div class="ad"><p>Buy this now, it is really cheap and really good!</p></div><!-- <p>hidden</p> -->
<figure><figcaption>A caption of a picture.</figcaption></figure><form><p>Write your name here please.</p><button>Send</button></form>
<ul><li>Point one<li>Point two</ul><p>Last words of the article.</article>
<section id="comments"><h3>3 comments</h3><p>I think that this is a very good article, thank you so much for it!</p></section></main>
<div class="related"><p>Other articles that you may like to read after this one.</p></div><footer><p>&copy; 2024 All of the rights are reserved.</p></footer></body></html>"""


def test_parts_that_are_no_article_are_left_out():
    assert h.extract(PAGE, WEIGHTS).split("\n") == ["The title & more", "First para­graph with bold and a link, two lines.", "Second one: x < y z.", "A caption of a picture.", "Point one", "Point two", "Last words of the article."]


def test_article_without_semantic_elements():
    page = "<body><div class=menu><a>One</a><a>Two</a></div><div><a href=1>Link</a> <a href=2>Other</a></div><div><p>" + "Words of the text follow here. " * 5 + "</p><p>" + "And some more of them come now. " * 5 + "</p></div><div><a>Next page</a></div></body>"
    got = h.extract(page, WEIGHTS)
    assert got.startswith("Words of the text") and got.endswith("come now.") and "Link" not in got and "Next" not in got


def test_odd_pages(spark):
    odd = [None, "", "   ", "<p>", "<<<>>>", "no markup at all", "<p>open <b>never closed", "</p></div>text</section>", "<script>only", "<!-- never closed <p>x</p>", "<p a='>'>quoted</p>", "<article></article>", "&amp;&#65;&nosuch;"]
    out = [h.extract(p, WEIGHTS) for p in odd]
    assert out == ["", "", "", "", "<<<>>>" if out[4] else "", "no markup at all", "open never closed", "text", "", "", "quoted", "", "&A&nosuch;"]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(odd)], "page_id long, html string, n_chars string")
    weights = h.fit(df)
    assert h.extract_pages(df, weights).count() == len(odd) and h.extract_pages(df.limit(0), h.fit(df.limit(0))).count() == 0
    assert [f.dataType.simpleString() for f in h.extract_pages(df, weights).schema if f.name == "n_chars"] == ["bigint"]


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph number {i} of the page.</p>" for i in range(30_000)) + "</article>"
    assert h.extract(page, WEIGHTS).count("\n") == 29_999


def test_best_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = h.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


WRAPPERS = ['<div class="layout has-sidebar">', '<div class="content no-comments">', '<div class="article-header-wrap">', '<div class="two-column side-by-side">', "<form action=/search>", '<div class="page-comments-menu">']


@pytest.mark.parametrize("open_tag", WRAPPERS)
@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<div>", "</div>")])
def test_wrappers_are_no_boxes(open_tag, marks):
    close = "</form>" if "form" in open_tag else "</div>"
    body = "".join(f"<p>This is paragraph {i} of the text, with enough words to be found as such.</p>" for i in range(6))
    page = f"<html><body>{open_tag}<nav><a href=/>Home</a><a href=/a>About</a></nav><div class=ad><p>Buy it now, it is cheap and good!</p></div>{marks[0]}<h1>A title</h1>{body}{marks[1]}<section class=comments><p>A comment by a reader of the page, who says so.</p></section><footer>All rights reserved.</footer>{close}</body></html>"
    lines = h.extract(page, WEIGHTS).split("\n")
    assert lines == ["A title", *(f"This is paragraph {i} of the text, with enough words to be found as such." for i in range(6))]


def test_names_are_learned(spark):
    beside = '<div class="zq-strip"><p>' + "Words that stand beside the text of a page and aren't any part of it. " * 3 + "</p></div>"
    page = lambda i: f'<body><div class="frame-header"><article><h1>Title {i}</h1><p>{"The text of the page, in so many words. " * 9}</p></article></div>{beside}</body>'
    pages = spark.createDataFrame([(i, page(i)) for i in range(40)], "page_id long, html string")
    weights = h.fit(pages)
    assert weights["name", "zq-strip"] < 0 < weights["name", "frame-header"]
    new = f'<body><div class="frame-header"><p>{"Another text of the page, in so many words. " * 9}</p>{beside}<p>{"It goes on after the strip, in so many words. " * 9}</p></div></body>'
    got = h.extract(new, weights)
    assert "beside" not in got and "Another text" in got and "goes on" in got


def test_pages_without_content_stay_empty():
    assert h.extract("<body><nav><a href=/>Home page of them all</a></nav><footer>" + "Words in a footer. " * 30 + "</footer></body>", WEIGHTS) == ""
    assert h.extract("<body><article></article><div class=cookie-notice><p>We use cookies here.</p></div></body>", WEIGHTS) == ""


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a "', "<script ", "<!--", "<", "</b>", "<b><div>", "<a b='x>' ", '<a b="y>" c= ', "<p><i></b>", "<li><b>", "<div class=ad>", "<![CDATA[", "<title", "&", "<svg><g>", "</div>"])
def test_broken_pages_of_a_megabyte_take_seconds(unit):
    for page in (unit * (1_000_000 // len(unit)), "<b><div>" + unit * (1_000_000 // len(unit)) + "<p>The end.</p>"):
        begun = time.process_time()
        h.extract(page, WEIGHTS)
        assert time.process_time() - begun < 12


def brute(page, weights):
    """Every run tried; the longest first one of the greatest sum."""
    made = h.Page(page)
    inner = made.left_out(weights)
    score = lambda e: (0 if inner[e[1]] and made.content[e[1]] else weights.get(("tag", e[0]), weights["tag", None])) if e[0] else 0 if inner[e[1]] else len(e[2].split()) * weights.get(("word", made.names[e[1]]), weights["word", None])
    s = [score(e) for e in made.events]
    best, span = 0, (0, 0)
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > best + 1e-9:
                best, span = total, (i, j + 1)
    text, lines = "", []
    for name, at, own in made.events[slice(*span)]:
        if inner[at]:
            continue
        if name and name.strip("/") != "br" and name.strip("/") not in h._UNBROKEN:
            lines.append(text)
            text = ""
        text += own if not name else " " if name.strip("/") == "br" else ""
    return [" ".join(html.unescape(x).split()) for x in [*lines, text]]


def test_extract_against_brute_force():
    rng = random.Random(6)
    units = ["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<div class=ad>", "<article>", "</article>", "<b>", "</b>", "<br>", "some words of text ", "one ", "&amp; ", "<li>", "<script>x</script>", "<!-- c -->", "<header>", "</header>"]
    for _ in range(400):
        page = "".join(rng.choice(units) for _ in range(rng.randint(0, 30)))
        assert h.extract(page, WEIGHTS) == "\n".join(x for x in brute(page, WEIGHTS) if x)


PROSE = "The text goes on for a while here, with enough words in it to be a paragraph of its own. "


@pytest.mark.parametrize("part", ['<div class="article-header"><h1>A title of its own</h1></div>', f'<section class="related-work"><p>{PROSE}</p></section>', f'<p class="notice-period">{PROSE}</p>', f'<div class="legal-analysis"><p>{PROSE}</p></div>', f'<section id="discussion"><p>{PROSE}</p></section>', f'<div class="comment-culture"><p>{PROSE}</p></div>'])
def test_words_of_names_alone_remove_no_article_text(part):
    page = f"<body><nav><a href=/>Home</a></nav><article>{part}<p>{PROSE * 3}</p><p>{PROSE}</p></article></body>"
    want = [" ".join(x.split()) for x in re.split(r"<[^>]+>", part + f"<p>{PROSE * 3}</p><p>{PROSE}</p>") if x.strip()]
    assert h.extract(page, WEIGHTS).split("\n") == want
    # A list of links under such a name is a box all the same.
    links = part.split(">")[0] + ">" + '<a href="/x">Read our other story</a> <a href="/y">And another one</a></div>'
    if 'id="discussion"' not in part and "header" not in part:
        assert "another" not in h.extract(page.replace(part, links), WEIGHTS)


@pytest.mark.parametrize("beside", [f'<div class="discussion"><p>Ann: {PROSE * 2}</p><p>Bob: {PROSE}</p></div>', f'<article class="teaser"><h2>Another story</h2><p>{PROSE}</p></article>', f'<div class="zq"><p>{PROSE}</p></div>'])
def test_what_stands_beside_the_marked_content_is_left_out(beside):
    body = f"<h1>A title</h1><p>{PROSE * 3}</p><p>{PROSE}</p>"
    want = ["A title", (PROSE * 3).strip(), PROSE.strip()]
    for page in (f"<body><main>{body}</main>{beside}</body>", f"<body>{beside}<main><article>{body}</article>{beside}</main></body>"):
        assert h.extract(page, WEIGHTS).split("\n") == want
    # Several articles of about the same size are all of the content.
    several = "".join(f"<article><h2>Story {i}</h2><p>{PROSE * 2}</p></article>" for i in range(4))
    assert h.extract(f"<body><main>{several}</main></body>", WEIGHTS).count("Story") == 4
    # Marks around next to nothing don't hide the text.
    assert h.extract(f"<body><article>Ad</article><div><p>{PROSE * 4}</p></div></body>", WEIGHTS).endswith((PROSE * 4).strip())


def test_held_out_pages_without_marks(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    counts = {}
    for page in pages[::2]:
        h.count(page, counts)
    weights = h.weights_of(counts)
    bare = lambda page: re.sub(r"<(/?)article>", r"<\1div>", page)
    same = [h.extract(bare(page), weights) == h.extract(page, weights) for page in pages[1::2]]
    assert sum(same) >= 0.9 * len(same)
