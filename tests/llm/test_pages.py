"""Main text of pages."""

import html as std_html
import re

import pytest

from ridgeline.llm import pages, queries

SF_DIR = "/root/testdata/sf0.01"

UNSEEN = """<html><head><title>T t t</title><style>p{}</style></head><body>
<header><a href=x>Home</a> site name here</header><div id="cookie-notice">We use cookies ok</div>
<div class="sidebar"><ul><li><a>one</a><li><a>two</a></ul></div>
<div class="content"><h2>My title</h2><p>First para with some w<b>or</b>ds &lt;ok&gt;\n a &amp; b.</p>
<div class="ad">Buy now</div><p>Second paragraph of several words here.<p>Third one, long&nbsp;enough.</div>
<form><label>Your name</label><input></form>
<section class="comments"><h3>Comments</h3><p>Nice post from a reader who writes.</p></section>
<footer>&copy; me</footer><script>var a="<p>zzz"</script></body></html>"""


def article(page):
    """The article of a test page, by its own element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"</?(b|i|a)>", "", b) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    blocks = [" ".join(std_html.unescape(b).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_whole_table(spark):
    found = {r.page_id: r for r in queries.op6_html(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == article(r.html)
        assert found[r.page_id].n_chars == len(found[r.page_id].text) and found[r.page_id].url == r.url


def test_unseen_layout(spark):
    weights = pages.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))
    text = pages.extract_text(UNSEEN, weights)
    assert text == (
        "My title First para with some words <ok> a & b. Second paragraph of several words here. Third one, long enough."
    )


def test_rows_of_every_kind(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "<p></p><!-- x"), (4, "u", "just text, no tags & more"),
        (5, "u", "<article>open <b>bold"), (5, "u", "<article>open <b>bold"), (None, "u", "<script>x</script>a < b"),
        (7, "u", "<main><p>" + "long text " * 50000), (8, "u", "</p></div><a 'x\">y</a> <p>words of text here"),
    ]
    table = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, text int")
    found = pages.main_text(table).collect()
    texts = {}
    for r in found:
        texts.setdefault(r.page_id, []).append(r.text)
    assert len(found) == len(rows) and all(r.text is not None for r in found)
    assert texts[1] == texts[2] == texts[3] == [""]
    assert texts[4] == ["just text, no tags & more"]
    assert texts[5] == ["open bold"] * 2 and texts[None] == ["a < b"]
    assert texts[7] == [" ".join(["long text"] * 50000)]
    assert pages.main_text(table.limit(0)).count() == 0


PARAGRAPHS = "".join(f"<p>Paragraph {i} holds a few plain words of a story, and then some more.</p>" for i in range(12))
STORY = " ".join(f"Paragraph {i} holds a few plain words of a story, and then some more." for i in range(12))
FRAME = '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav>{}<footer>A notice of rights</footer>'
WRAPPED = [
    f'<body><div id="content">{PARAGRAPHS}</div></body>',
    f'<body class="has-sidebar single"><article>{PARAGRAPHS}</article></body>',
    f'<body class="has-sidebar single"><div>{PARAGRAPHS}</div></body>',
    f'<div id="main" class="no-ads search-enabled">{PARAGRAPHS}</div>',
    f'<body class="has-sidebar with-toolbar comments-open"><main>{PARAGRAPHS}</main></body>',
    f'<form id="aspnetForm">{PARAGRAPHS}</form>',
    f'<div class="page menu-closed">{PARAGRAPHS}</div>',
    f'<div class="sidebar-left layout"><div class="widget-area wide">{PARAGRAPHS}</div></div>',
    f'<div class="sidebar"><article class="post related">{PARAGRAPHS}</article></div>',
    f'<form><main class="search">{PARAGRAPHS}</main></form>',
    '<body class="menu">' + FRAME.format(f'<div class="search-page">{PARAGRAPHS}</div>'),
]


@pytest.fixture(scope="module")
def both_weights(spark):
    table = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    return [pages.fit(table), pages.fit(table.limit(0))]


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_say_nothing(both_weights, page):
    for weights in both_weights:
        assert pages.extract_text(page, weights) == STORY


def test_furniture_goes_whatever_its_size(both_weights):
    note = "<p>A reader writes that this was a nice story to read.</p>"
    for weights in both_weights:
        for comments in (
            f'<section class="comments">{"<article>" + note * 30 + "</article>"}</section>',
            f'<article class="comment">{note * 30}</article>' * 2,
            f'<div id="comments"><article class="comment">{note}</article></div>',
        ):
            assert pages.extract_text(f"<article>{PARAGRAPHS}</article>{comments}", weights) == STORY
            assert pages.extract_text(f"<main><article>{PARAGRAPHS}</article>{comments}</main>", weights) == STORY
        page = f'<div class="content">{PARAGRAPHS}</div><div id="comments">{note * 30}</div>'
        assert pages.extract_text(page, weights) == STORY
        within = PARAGRAPHS.replace("</p><p>Paragraph 6", '</p><div class="ad">Buy it now</div><p>Paragraph 6')
        assert pages.extract_text(f'<article class="post content">{within}</article>', weights) == STORY
        assert pages.extract_text("<nav>" + note + "</nav>", weights) == ""


def test_deep_nesting_is_linear(both_weights):
    page = "<div class=a>" * 3000 + PARAGRAPHS
    assert pages.extract_text(page, both_weights[0]) == STORY
