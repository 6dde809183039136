import itertools
import math

import pytest

from rasterloom.llm import html_extract

CASES = {
    None: "",
    "": "",
    "plain  text\n only": "plain text only",
    "<p>one<p>two &amp; three &eacute;<br>four": "one\ntwo & three é four",
    '<body><nav><ul><li><a href="/x">Home</a></ul></nav><article><h1>Title</h1><p><b>Lead.<br><p>Body text, with <i>marks</i>.</p></article><footer>&copy; x</footer>': "Title\nLead.\nBody text, with marks.",
    '<script>var t="</p>";if(a<b)x()</script><style>p{}</style><main>ok text</main>': "ok text",
    '<article><p>Long text here, yes.</p><form><p>sign up</p></form><div class="comments"><p>I like it, very, very much.</p></div><table><tr><td>a<td>b</table></article><aside><p>Much, much, much other text, with marks.</p></aside>': "Long text here, yes.\na\nb",
    '<body><div class="menu"><a href=x>Home</a></div><div id=content><h2>Head</h2><p>Long text, with commas. And more of it, really quite a lot.</p><p>Short.</p><ul><li>item one<li>item two</ul></div><div class="cookie-notice">We use cookies, as all do.</div><div>tiny</div>': "Head\nLong text, with commas. And more of it, really quite a lot.\nShort.\nitem one\nitem two",
    "<article><p>a <b>bold</b>, <i>x</i>y</p": "a bold, xy",
    "<article><p>x<!-- <p>no</p> -->y</p><p hidden>no</p></article>": "xy",
    "<div><p>": "",
}


@pytest.mark.parametrize("page", list(CASES))
def test_main_text(page):
    assert html_extract.main_text(page) == CASES[page]


def test_query(spark, tmp_path):
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(CASES)] + [(0, "u0", None, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html_extract.op6_html_extract(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == list(CASES.values())[r.page_id] and r.n_chars == len(r.text)


def test_long_page():
    page = "<article>" + "<p>Text, and more.</p>" * 20_000 + "</article>"
    assert html_extract.main_text(page).count("\n") == 19_999


LONG = "Long text, with commas. And more of it, really quite a lot."
WHOLE = {
    f'<div class="has-sidebar"><article><p>{LONG}</p></article></div>': LONG,
    f'<div class="content-sidebar-wrap"><main><p>{LONG}</p></main><div class="sidebar"><p>Other, other, other text.</p></div></div><footer>{LONG * 3}</footer>': LONG,
    f'<form id="aspnetForm"><div id="content"><p>{LONG}</p><p>{LONG}</p></div></form>': f"{LONG}\n{LONG}",
    f'<div class="overflow-hidden"><div><p>{LONG}</p></div></div><div class="menu"><p>Home</p></div>': LONG,
    f"<html><head><title>t</title><meta charset=utf-8><body><p>{LONG}</p>": LONG,
    f"<html><head><title>t <b></title><link href=x><p>{LONG}</p>": LONG,
    f"<head><title>t<body><p>{LONG}</p>": LONG,
    f"<head>\n<script>x</script>{LONG}": LONG,
    f"<article><video-player src=x></video-player><p>{LONG}</p><svg-icon/><p>{LONG}</p></article>": f"{LONG}\n{LONG}",
    f"<article><svg class=i /><p>{LONG}</p><video src=x><p>{LONG}</p></article>": f"{LONG}\n{LONG}",
    # These stay out, however long they are.
    f'<article><p>{LONG}</p></article><div id="comments"><p>{LONG * 5}</p></div>': LONG,
    f'<div id="text"><p>{LONG}</p></div><div class="cookie-consent"><p>{LONG * 5}</p></div><div class="footer"><p>{LONG * 5}</p></div>': LONG,
    f'<div id="text"><p>{LONG}</p></div><div class="related"><article><p>Teaser, yes.</p></article></div>': LONG,
    f'<article><p>{LONG}</p></article><div hidden><main><p>{LONG * 5}</p></main></div>': LONG,
}


@pytest.mark.parametrize("page", list(WHOLE))
def test_wrappers_and_open_heads_lose_nothing(page):
    assert html_extract.main_text(page) == WHOLE[page]


PROSE = "The first of many sentences, each of some length. It says a thing, and another thing; then it ends. "
SHORT = "Sign up now"
DECIDED = {
    # A word in a longer name does not take prose out of an article.
    f'<article><p>{PROSE}</p><div class="social-history"><p>{PROSE}</p></div></article>': 2,
    f'<article><p>{PROSE}</p><section class="related-work"><h2>Related work</h2><p>{PROSE}</p></section></article>': "h",
    f'<article><h1>Results</h1><section id="discussion-of-results"><p>{PROSE}</p><p>{PROSE}</p></section></article>': "r",
    f'<div id="x1"><div id="x2"><p>{PROSE}</p><p>{PROSE}</p></div><ul id="x3"><li><a href=a>One</a><li><a href=b>Two</a></ul></div>': 2,
    # Names say nothing here; the ratios do.
    f'<div class="a"><a href=1>Home</a> <a href=2>News</a></div><div class="b"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div class="c"><a href=3>About us</a></div><div class="d">Call 12</div>': 3,
    f'<div class="a"><ul><li>x<li>y<li>z</ul></div><div class="b"><div class="q"><p>{PROSE}</p></div><div class="q"><p>{PROSE}</p></div></div>': 2,
}


@pytest.mark.parametrize("page", list(DECIDED))
def test_ratios_decide(page):
    want = {2: [PROSE] * 2, 3: [PROSE] * 3, "h": [PROSE, "Related work", PROSE], "r": ["Results", PROSE, PROSE]}[DECIDED[page]]
    assert html_extract.main_text(page) == "\n".join(x.strip() for x in want)


def test_a_lone_discussion_is_kept():
    page = f'<article><h1>A study</h1><section class="discussion"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></section></article>'
    assert html_extract.main_text(page).endswith("\n".join([PROSE.strip()] * 3))


def test_references_do_not_meet_over_elements():
    assert html_extract.main_text("<p>&l<b>t;</b> and &am<i>p;</i> &amp;lt;</p>") == "&lt; and &amp; &lt;"


def test_ratios_by_their_definition():
    """The content paths of a page with unhelpful names, by the formula written out."""
    page = f'<div class="a"><p>{PROSE}</p><span>x</span></div><div class="b">Tiny, tiny.</div><div class="c"><p>{PROSE * 3}</p></div>'
    found = html_extract.blocks(page)
    assert [f for _, f, _, _, _ in found] == [1.0] * len(found)
    mass = {}
    for path, _, _, text, linked in found:
        mass.setdefault(path, []).append(len(text) - linked + 4 * sum(c in ".,;:!?" for c in text))
    ratio = {p: sum(m) / len(m) for p, m in mass.items()}
    around = {p[:1]: [x for q, m in mass.items() if q[:1] == p[:1] for x in m] for p in mass}
    holds = {p: sum(sum(m) for q, m in mass.items() if q[:-1] == p) for q in mass for p in [q[:-1]]}
    root = max(holds, key=lambda p: (holds[p], -len(p)))
    fused = {}
    for p, r in ratio.items():
        inside = [x for i in range(1, len(p)) for x in [sum(y) / len(y) for y in [[v for q, m in mass.items() if q[:i] == p[:i] for v in m]]]]
        fused[p] = (4.0 if p[: len(root)] == root else 1 / 16) * (r + max(inside, default=r)) / 2
    assert around
    order = [p for p, _ in itertools.groupby(path for path, *_ in found)]
    smooth = {}
    for p in fused:
        sides = []
        for i, q in enumerate(order):
            if q == p:
                sides.append(sum(math.log1p(fused[order[j]] if 0 <= j < len(order) else fused[p]) for j in (i - 1, i + 1)))
        smooth[p] = 0.7 * math.log1p(fused[p]) + 0.15 * sum(sides) / len(sides)
    want = [text for path, _, _, text, _ in found if fused[path] >= 2 and smooth[path] >= 0.55 * max(smooth.values())]
    assert html_extract.main_text(page) == "\n".join(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(none).count() == 0
    odd = spark.createDataFrame([(None, None, f"<p>{PROSE}")], "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.extract(odd).collect()] == [(None, None, PROSE.strip())]
