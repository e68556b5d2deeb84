import re
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from oscilla.llm import html, html_train


@pytest.fixture(scope="module")
def labeller():
    return html.Labeller.load()


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_tables_against_the_markup(spark, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in html.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article(p["html"])
        assert got[p["page_id"]]["n_chars"] == len(article(p["html"]))


def test_invented_layouts_not_trained_on(labeller):
    blocks, pages = html_train.accuracy(labeller, range(2_000_000, 2_000_200))
    assert blocks > 0.99 and pages > 0.9


def test_leaves():
    page = (
        "<!-- <p>no</p> --><p>a&amp;b &lt;c&gt; <b>d</b>e<br>f<p class='x y' id=z>g\n\t h&nbsp;i<script>var t='</p><p>';</script>j<style>k{}</style>"
        "<ul><li>one<li>two</ul><td>t</td>3 < 4 <textarea>q</textarea><img src='>'>r<p/>s"
    )
    got = html.leaves(page)
    assert [b.text for b in got] == ["a&b <c> de f", "g h i", "j", "one", "two", "t", "3 < 4", "r", "s"]
    assert {"c:x", "c:y", "i:z"} <= set(got[1].path)


@pytest.mark.parametrize("page", ["", "   ", "plain", "<", "<p", "</p></div>", "<p>" * 3000 + "x", "<div>" * 3000 + "x", "<!-- open", "<script>open", "&#0;&#xffffffff;&bogus;", "\x00<p>퟿"])
def test_broken_pages(labeller, page):
    assert isinstance(html.main_texts([page], labeller)[0], str)


def test_padding_and_company_do_not_matter(labeller):
    pages = [html_train.example(s)[0] for s in range(3_000_000, 3_000_012)]
    together = labeller.probabilities(pages)
    for p, t in zip(pages, together, strict=True):
        assert np.allclose(labeller.probabilities([p])[0], t, atol=1e-4)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    H = html.HIDDEN
    model = html.Labeller({"x": rng.normal(0, 0.1, (html.SLOTS, 8 * H)), "h": rng.normal(0, 0.2, (2, H, 4 * H)), "o": rng.normal(0, 0.3, 2 * H + 1)})
    for k in ("x", "h", "o"):
        setattr(model, k, getattr(model, k).astype(np.float64))
    data = [html_train.example(s) for s in (1, 2)]
    pages, labels = [x for x, _ in data], [y for _, y in data]
    _, grad = html_train.gradients(model, pages, labels)
    for name, at in (("h", (0, 1, 2)), ("h", (1, 3, 50)), ("o", (5,)), ("x", (pages[0][0][0][0], 3)), ("x", (pages[1][0][0][0], 5 * H))):
        w = getattr(model, name)
        old, e = w[at], 1e-2
        w[at] = old + e
        up, _ = html_train.gradients(model, pages, labels)
        w[at] = old - e
        down, _ = html_train.gradients(model, pages, labels)
        w[at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-5)


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>Some words of a story, told at length.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted([tuple(r) for r in html.extract(pages).collect()], key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "Some words of a story, told at length.", 38)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["<svg class='i' />", "<math/>", "<object data='x'>", "<audio src=x>", "<canvas>", "<template>"])
def test_elements_without_a_closing_tag_hide_nothing(tag):
    assert [b.text for b in html.leaves(f"<p>one</p>{tag}<p>two</p><p>three</p>")] == ["one", "two", "three"]


def test_formulas_and_listings_are_text():
    page = "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><xmp>a <b> c</xmp><svg><text>no</text></svg><p>end</p>"
    assert [b.text for b in html.leaves(page)] == ["so x=2 holds", "a <b> c", "end"]


@pytest.mark.parametrize("around", ["<footer>", "<aside>", "<section id='comments'>", "<div class='cookie'>"])
def test_text_nested_deeply_keeps_its_ancestors(labeller, around):
    prose = "The reon of thest hearing ateded the leco in a raon that isle and then or ment. " * 3
    junk = f"{around}{'<div>' * 20}<p>{prose}</p>{'</div>' * 20}</{around[1:].split()[0].rstrip('>')}>"
    page = f"<html><body><article><h1>Anea reesti</h1>{f'<p>{prose}</p>' * 4}</article>{junk}</body></html>"
    found = html.leaves(page)
    assert html._names(around[1:].split()[0].rstrip(">"), around)[-1] in found[-1].path
    assert html.main_texts([page], labeller)[0].count("reon of thest") == 12


def test_every_word_and_name_of_a_block_counts():
    long = " ".join(f"w{k}" for k in range(60))
    first, second = (html.vectors(html.leaves(f"<p>{long} {end}</p>"))[0][0] for end in ("alpha", "omega"))
    assert first != second
    assert "c:cookie" in html.leaves("<div class='a b c d e f g h i cookie'>x</div>")[0].path


def test_quotes_that_nothing_closes():
    import time

    assert [b.text for b in html.leaves('One. <a title="x>Two</a> three')] == ["One. Two three"]
    assert [b.text for b in html.leaves("<p class='a>b' id=\"c>d\">One<p title='>Two")] == ["One", "Two"]
    assert [b.text for b in html.leaves("<p>5\" and 6' <b>7\"</b> 8")] == ["5\" and 6' 7\" 8"]
    for page in ('<a "x ' * 20_000, "<a '>'" * 20_000, '<a "x ' * 20_001 + ">", "<p class='" * 20_000, "<a \"'>" * 20_000, "< " * 20_000):
        began = time.process_time()
        html.leaves(page)
        assert time.process_time() - began < 5


@pytest.mark.parametrize("head", ["<footer>", "<aside>", "<nav>", "<section id='comments'>", "<div class='cookie'>"])
@pytest.mark.parametrize("depth", [0, 10, 16])
def test_the_only_telling_ancestor_may_be_far_above(labeller, head, depth):
    prose = lambda k: " ".join(f"Solen verat {w} mon sched the analo rede {k}." for w in ("tion", "heran", "ingst", "ouver"))
    inner = "".join(f"<p>{prose(k)}</p>" for k in range(2))
    tag = re.match(r"<(\w+)", head)[1]
    page = f"<html><body><article><h1>Veran ed solen</h1><p>{prose(5)}</p><p>{prose(6)}</p><p>{prose(7)}</p></article>{head}{'<div>' * depth}{inner}{'</div>' * depth}</{tag}></body></html>"
    assert html.main_texts([page], labeller)[0].split("\n") == ["Veran ed solen", prose(5), prose(6), prose(7)]
