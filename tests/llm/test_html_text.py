import html
import re

import pytest

from quillsql.llm import html_text, queries

MODEL = html_text.fit(html_text.labelled_pages())


def test_query_against_the_tables_own_markup(spark, sf_dir):
    """The tables' pages have one article each: its blocks, cut out by hand."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op7_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


CASES = [
    ("", ""), (None, ""), ("<nav><a>only</a> menus here</nav>", ""), ("just text &lt;b&gt; a < 3", "just text <b> a < 3"),
    ("<body class='sidebar-right'><header>Site</header><div id=cookie-notice>We use cookies</div><main><h1>T &amp; t</h1><p>One&nbsp;<b>two</b>\n three<br>four<p>five<ul><li>a<li>b</ul></main><footer>(c)</footer>", "T & t\nOne two three four\nfive\na\nb"),
    ("<article><p>Before the advert comes text.</p><div class='ad-box'>Buy now cheap</div><p>After.</p><section id='comments'><p>nice article, thank you very much for it</p></section></article>", "Before the advert comes text.\nAfter."),
    ("<article><p>x<script>if (a<b) '</p>'</script>y</p><style>p{}</style><!-- z --><form><label>q</label></form></article>", "xy"),
    ("<div class='post-content'><p>Main words of the post.</p><aside>see also</aside></div><div class='comment-body'>a reader's long comment about the post above</div>", "Main words of the post."),
    ("<p>unclosed <b>bold <i>text</p><p>next", "unclosed bold text\nnext"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert html_text.main_text(page, MODEL) == text


def test_best_region_is_the_best():
    import random

    r = random.Random(1)
    for _ in range(200):
        scores = [r.choice([-3, -1, 0, 1, 2]) for _ in range(r.randrange(12))]
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        start, end = html_text.best_region(scores)
        assert sum(scores[start:end]) == max(0, best)


def test_long_and_broken_pages_end():
    for page in ("<b>" * 100_000 + "</i>" * 50 + "<p>x" * 20_000, "<" * 200_000, '<a "' * 5_000 + ">", "<div>" * 50_000 + "x", "<script>" + "x" * 100_000):
        html_text.main_text(page, MODEL)


def test_odd_rows(spark):
    rows = [(1, "u", None, "clash"), (2, None, "<p>a b</p>", "clash"), (2, None, "<p>a b</p>", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = html_text.extract(df, MODEL).collect()
    assert sorted((r.page_id, r.main_text, r.main_chars) for r in got) == [(1, "", 0), (2, "a b", 3), (2, "a b", 3)]
    assert html_text.extract(df.limit(0), MODEL).count() == 0


ARTICLE = "<article><h1>The title</h1><p>Long main text of the article with enough words to count.</p></article>"
TEXT = "The title\nLong main text of the article with enough words to count."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div id="page" class="site">{ARTICLE}</div>', TEXT), (f'<div class="wrap has-sidebar">{ARTICLE}</div>', TEXT), (f'<div class="comments-open">{ARTICLE}</div>', TEXT),
        (f'<div class="share thread">{ARTICLE}<aside>see also</aside></div>', TEXT), (f'<div class="body"><div class="sidebar-left">{ARTICLE}</div></div>', TEXT),
        ('<div class="widget"><p>Plain page of words that has no content element.</p></div><div class="menu">a b</div>', "Plain page of words that has no content element."),
        ('<article><header class="entry-header"><h1>Title words</h1></header><p>Long main text here it is.</p></article>', "Title words\nLong main text here it is."),
        (f'{ARTICLE}<ol class="commentlist"><li><article class="comment">short answer</article></li></ol>', TEXT),
        (f'<main>{ARTICLE}<div class="related"><article>teaser</article></div></main>', TEXT),
    ],
)
def test_misnamed_boxes_keep_the_article(page, text):
    assert html_text.main_text(page, MODEL) == text
