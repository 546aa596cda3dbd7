"""HTML extraction: the given pages against a plain reading of their marks, varied pages, defined results."""

import random
import re
import time
from html import unescape

import pytest

from treeline.llm import htmltext, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text int, n_chars string"
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def prose(n, word="word"):
    return " ".join(f"{word}{i}" for i in range(n))


def read(html, weights=htmltext.Weights()):
    return htmltext.main_text(html, weights)


def test_given_pages_against_their_marks(spark):
    rows = {r.page_id: r for r in queries.op12_html_text(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S).group(1).replace("<br>", " ")
        blocks = (unescape(re.sub("<[^>]+>", "", b)).split() for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(" ".join(b) for b in blocks if b)
        assert (rows[page.page_id].text, rows[page.page_id].n_chars, rows[page.page_id].url) == (want, len(want), page.url)


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', "<div class='x7'>{}</div>", "<td>{}</td>"])
def test_articles_amid_everything_else(around):
    body = f"<h1>Title</h1><p>{prose(12, 'a')}</p><aside><p>{prose(30, 'b')}</p></aside><p>{prose(15, 'c')}<p>{prose(9, 'd')}"
    html = (
        f'<html><head><title>{prose(9)}</title><style>p{{}}</style></head><body class="has-sidebar"><header>{prose(20)}</header>{NAV}'
        f'<div class="cookie-notice"><p>{prose(40)}</p></div>{around.format(body)}<div class="sidebar"><p>{prose(40)}</p></div>'
        f'<form action="/s">{prose(30)}<input name="q"></form><section id="comments"><p>{prose(90)}</p></section>'
        f"<script>var x = '<p>{prose(50)}</p>'</script><footer>{prose(30)}</footer></body></html>"
    )
    want = "\n".join(["Title", prose(12, "a"), prose(15, "c"), prose(9, "d")])
    assert read(html) == want


def test_text_of_blocks():
    html = f"<body>{NAV}<p> A &amp; B &lt;i&gt; \n\t c<b>d</b>e&nbsp;f <br>g {prose(9)}</p><!-- <p>no</p> --><blockquote>q</blockquote><p>a < b {prose(5)}"
    assert read(html) == f"A & B <i> cde f g {prose(9)}\nq\na < b {prose(5)}"
    assert read(f'<p title="a>b">x<a href=y>link</a> {prose(3)}<img alt="no"></p>') == f"xlink {prose(3)}"
    assert read(f"<p>{prose(4)}</p><sc") == prose(4)
    assert read(f"<p>{prose(4)}</p><script>never closed <p>{prose(9)}</p>") == prose(4)


def test_noise_inside_marked_content_does_not_cut_it():
    html = f'<main><p>{prose(5)}</p><div class="ad-box"><p>{prose(99)}</p></div><p>end</p></main>'
    assert read(html) == f"{prose(5)}\nend"


def test_a_form_around_the_page_is_read_only_if_nothing_else_is():
    assert read(f"<form id='f'>{NAV}<p>{prose(20)}</p></form>") == prose(20)
    assert read(f"<form>{prose(20)}</form><p>{prose(3)}</p>") == prose(3)


@pytest.mark.parametrize("seed", range(20))
def test_best_stretch_against_all_stretches(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-2, -1, -0.5, 0, 1, 2]) for _ in range(rng.randrange(0, 25))]
    sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
    best = max(sums.values(), default=0)
    first, end = htmltext.best_stretch(scores)
    assert (sum(scores[first:end]) == best) if best > 0 else (first, end) == (0, 0)


def test_weights_from_labelled_pages(spark):
    weights = htmltext.learn(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    assert weights.word > weights.linked > 0 and all(v < 0 for v in weights.tags.values())
    assert weights.tags["li"] < weights.tags["p"] and "footer" not in weights.tags


@pytest.mark.parametrize("piece", ['<a "', "<", "<div>", "</b>", "<p><b>w ", "<!--", '<a href="', "<li>x", "<td><tr>", "&", "<nav>"])
def test_hostile_pages_take_linear_time(piece):
    started = time.perf_counter()
    read(piece * 50_000)
    assert time.perf_counter() - started < 10


def test_defined_results(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", NAV), (None, "v", f"<p>{prose(3)}"), (None, "v", f"<p>{prose(3)}"), (4, None, "just text")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, htmltext.extract(pages).collect()), key=repr)
    text = prose(3)
    want = [(1, None, "", 0), (2, "u", "", 0), (3, "u", "", 0), (None, "v", text, len(text)), (None, "v", text, len(text)), (4, None, "just text", 9)]
    assert got == sorted(want, key=repr)
    assert htmltext.extract(pages.limit(0)).collect() == []
