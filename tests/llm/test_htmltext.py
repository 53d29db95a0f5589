"""Main text of pages: cut, parser, planted boilerplate, whole query."""

import itertools
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairos.llm import htmltext as H
from kairos.llm.mincut import min_cut

WEIGHTS = H.weights({})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.data())
def test_cut_is_minimal(gain, data):
    n = len(gain)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 5)), max_size=14))

    def cost(lab):
        return sum(g for g, x in zip(gain, lab) if g > 0 and not x) - sum(g for g, x in zip(gain, lab) if g < 0 and x) + \
            sum(w for i, j, w in edges if lab[i] != lab[j])

    best = min(itertools.product([False, True], repeat=n), key=lambda lab: (cost(lab), sum(lab)))
    assert tuple(min_cut(gain, edges)) == best


def test_long_chain():
    n = 20_000
    gain = [3 if i % 3 else -4 for i in range(n)]
    assert sum(min_cut(gain, [(i, i + 1, 2) for i in range(n - 1)])) > 0


def blocks(s):
    return [b.text for b in H.Page(s).blocks]


@pytest.mark.parametrize("source, want", [
    ("", []), ("plain &amp text &lt;b&gt; &#x41;&nbsp;&copy", ["plain & text <b> A ©"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]), ("<p>one<br>two\n\t three</p>", ["one two three"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("x<!-- <p>no</p> -->y", ["xy"]),
    ("<script>var t=\"</p><p>x\";</script><style>p{}</style><p>z</p>", ["z"]), ("<p>a < b and 1<2</p>", ["a < b and 1<2"]),
    ("<p title='a>b'>q</p><p title=it's>r</p>", ["q", "r"]), ("<p>a</p><p cl", ["a"]), ("<p>a</p></p", ["a"]),
    ("<b><p>x</b> y</p>z", ["x y", "z"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<title>T</title><textarea><p>no</p></textarea>k", ["k"]), ("<head><meta><title>q</title><body>w", ["w"]),
    ("<script>never ended <p>x</p>", []), ("<!doctype html><?php x ?>a</ >b", ["ab"]), ("<svg><text>no</text></svg>v", ["v"])])
def test_blocks(source, want):
    assert blocks(source) == want


LONG = "This is a paragraph of the story, with enough words in it to look like prose to anyone. "
PAGE = f"""<html><body class="has-sidebar home"><header class="site"><h1>The Daily</h1><a href=/>Home</a></header>
<nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav><div class="cookie-notice"><p>{LONG}</p><button>Accept</button></div>
<div id="wrapper" class="sidebar-layout"><main><article><header><h1>A title</h1><p>By someone, 3 May</p></header><p>{LONG}</p><div class="ad">{LONG}</div>
<p>Short.</p><h2>More</h2><ul><li>first point of the list</li><li>second</li></ul><blockquote>Quoted &amp; kept</blockquote>
<aside><p>{LONG * 3}</p></aside><form action=x><label>Name</label><input></form><p>{LONG} <a href=#>link</a> end.</p>
<section id="comments"><h3>2 comments</h3><article class="comment"><p>{LONG * 4}</p></article></section></article></main>
<aside class="sidebar"><h3>Related</h3><p>{LONG}</p></aside></div><div class="footer-links"><a href=1>About us</a></div><footer><p>&copy; 2020 {LONG}</p></footer>"""
WANT = ["A title", LONG, "Short.", "More", "first point of the list", "second", "Quoted & kept", LONG + " link end."]


def test_planted():
    assert H.main_text(PAGE, WEIGHTS).split("\n") == [" ".join(w.split()) for w in WANT]


def test_no_semantic_tags():
    """Without hints the text decides, and neighbours pull along."""
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(6))
    page = f"<body><div>{menu}</div><div><h1>The title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=1>Imprint</a> <a href=2>Privacy</a></div></body>"
    assert H.main_text(page, WEIGHTS).split("\n") == ["The title", LONG.strip(), "Yes.", LONG.strip()]


class Article(HTMLParser):
    """Blocks of the article element: text split at the tags the pages use."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.cur = False, [], ""

    def cut(self):
        t = " ".join(self.cur.split())
        if t:
            self.out.append(t)
        self.cur = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside |= tag == "article"
        if tag == "br" and self.inside:
            self.cur += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.cur += data


def article(source):
    a = Article()
    a.feed(source)
    a.close()
    a.cut()
    return "\n".join(a.out)


def test_query(spark):
    import __spark_entry__ as entry
    from conftest import SF_MID
    got = {r.page_id: r for r in entry.queries()["op13_main_text"](spark, SF_MID).collect()}
    rows = spark.read.parquet(f"{SF_MID}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, article(r.html))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>x y z.</p>"), (3, "w", PAGE), (3, "w", PAGE), (4, "deep", "<div>" * 3000 + "<p>" + LONG * 2000),
            (5, "many", "<article>" + "<p>a b.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string").repartition(3)
    got = {(r.page_id, r.url): r for r in H.extract(df).collect()}
    assert got[1, "u"].text == got[2, None].text == "" and got[None, "v"].text == "x y z." and got[3, "w"].n_chars == len("\n".join(" ".join(w.split()) for w in WANT))
    assert got[4, "deep"].n_chars == len((LONG * 2000).strip()) and got[5, "many"].text.count("\n") == 4999
    assert H.extract(df).count() == 7 and H.extract(df.limit(0)).count() == 0
