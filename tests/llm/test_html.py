"""Main text: brute force over the test pages, templates of plain hosts, and broken markup."""

import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rfmlens.llm import html as H


def text(page, texts=(), main=None):
    return H.extract(H.read(page)[1], frozenset(texts), main)


def brute(page):
    """For pages of the test tables: the blocks of the one article."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.op7_html(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == brute(p.html) and got[p.page_id].n_chars == len(brute(p.html)) and got[p.page_id].url == p.url


@pytest.mark.parametrize("page, want", [
    ("", ""), ("  \n ", ""), ("plain text &copy; only", "plain text © only"), ("<<<>>", "<<<>>"), ("a <b", "a"), ("<p>x</p></div></p>y", "x\ny"),
    ("<article>a<script>if(a<b){\"</p>\"}</script>b<!-- c -->c<br>d &lt;x&gt;&nbsp; e</article> tail <p", "abc d <x> e"),
    ("<html><head><title>x</title><body><main><header><h1>T</h1><p>by me</header><p>para <span class=\"ad\">AD</span> end</p><aside>side</aside>"
     "<section id=comments>no</section><form>f <input></form></main><footer>z", "T\npara end"),
    ("<div class=nav>x</div><h1>T</h1><div class=a><p>one &amp; two<p>three<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></div>"
     "<div class=comments><p>c</div>", "T\none & two\nthree\na\nb\n1 2\n3"),
    ("<body class=has-sidebar><article class='post no-sidebar'>in <i>side</i></article><article class=comment>me too</article></body>", "in side"),
    ("<article><p>x</p><nav>n</nav><style>p{}</style><noscript>n</noscript><p>y &amp;amp; z</p></article><article>second</article>", "x\ny &amp; z\nsecond"),
    ("<div itemprop='articleBody'>body</div><div>other text that is longer than the body</div>", "body"),
    ("<div role=navigation>n</div><div role='main'>m</div>", "m"), ("<script>never closed <p>x", ""), ("<!-- never closed <p>x", ""),
    ("<textarea><p>no</textarea><p>yes", "yes"), ("<article title=\"a > b\">t</article>", "t"), ("<ARTICLE><P>T&eacute;xt</ARTICLE>", "Téxt"),
])
def test_pages(page, want):
    assert text(page) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/\"'=!-& abpdiv;#x1", max_size=200))
def test_any_markup_is_read(page):
    H.read(page)


def test_long_and_hostile_pages():
    assert len(text("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 50_000 * 5 - 1
    assert text("<div>" * 20_000 + "deep") == "deep"
    text("<a" * 100_000)
    text("<p>" * 50_000)


def plain(i, body):
    return (f"<html><body><div id=top>Our site</div><div id=w><div class=c><p>Read this first</p><p>{body}</p></div>"
            f"<div class=r><p>Latest: {i}</p></div><div>All rights kept</div></div></body></html>")


def test_template_of_a_host_without_marked_content(spark):
    bodies = [f"Text number {i} says something of its own, {i * 7} times." for i in range(12)]
    rows = [(i, f"http://h.example/{i}", plain(i, b), "x") for i, b in enumerate(bodies)]
    rows += [(100, None, "<p>no host</p>", "x"), (101, "not a url", None, "x"), (None, "http://H.example:80/z", plain(99, "Zed " * 20), "x"),
             (0, "http://h.example/0", plain(0, bodies[0]), "x"), (102, "http://h.example/a", "<article>Read this first</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in H.main_text(df).collect()))
    want = [(i, b) for i, b in enumerate(bodies)] + [(0, bodies[0]), (-1, ("Zed " * 20).strip()), (100, "no host"), (101, ""), (102, "Read this first")]
    assert got == sorted((i, b, len(b)) for i, b in want)
    assert H.main_text(df.where("false")).count() == 0


def test_equivalence_classes(spark):
    """A text is in the template only if its occurrences are those of a tag."""
    pages = [f"<div><p>always</p><b>x</b><div class=q>{'often' if i % 4 else f'own {i}'}</div></div>" for i in range(8)]
    rows = spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "row long, host string, html string")
    (t,) = H.templates(H.tokens(rows)).collect()
    by = {b.text: H.text_token(b) for p in pages for b in H.read(p)[1]}
    assert t.n == 8 and set(t.texts) == {by["always"], by["x"]}
