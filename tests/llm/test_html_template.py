"""Main text: what the template decides."""

import random
from collections import Counter

from rfmlens.llm import html as H


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in sorted(H.main_text(df).collect(), key=lambda r: r.page_id)]


def test_boilerplate_inside_an_article_is_template(spark):
    """op7_html: the template decides on marked pages too, and copies of one page keep their text."""
    body = [f"Report {i} is about a matter of its own." for i in range(6)]
    page = "<body><article><h1>Title {}</h1><p>Sign up for our letter today.</p><p>{}</p></article></body>"
    assert extracted(spark, [page.format(i, b) for i, b in enumerate(body)]) == [f"Title {i}\n{b}" for i, b in enumerate(body)]
    assert extracted(spark, [page.format(0, body[0])] * 4) == [f"Title 0\nSign up for our letter today.\n{body[0]}"] * 4


def test_every_slot_of_a_page_without_marked_content(spark):
    """op7_html: a text split over sibling containers is kept whole; slots of labels aren't."""
    page = ("<body><div class=top>Our site</div><div class=lead><p>Lead {0} of the day, told in short.</p></div>"
            "<div class=bodytext><p>Body {0} is longer than all the others are, and says so.</p></div><div class=stamp>Seen {0}</div>"
            "<div class=part-b><p>Part {0} ends what was begun above.</p></div></body>")
    want = "Lead {0} of the day, told in short.\nBody {0} is longer than all the others are, and says so.\nPart {0} ends what was begun above."
    assert extracted(spark, [page.format(i) for i in range(6)]) == [want.format(i) for i in range(6)]
    assert extracted(spark, [page.format(0)]) == ["Our site\n" + want.format(0).replace("\nPart", "\nSeen 0\nPart")]  # nothing to compare with


def test_host_with_three_types_of_pages(spark):
    """op7_html: a type of a third of the host's pages has its template."""
    page = "<body class=type{0}><div class=b><p>Notes of type {0}, as always.</p><p>Own text {1} of a page of this type.</p></div></body>"
    got = extracted(spark, [page.format("xyz"[i % 3], i) for i in range(12)])
    assert got == [f"Own text {i} of a page of this type." for i in range(12)]


def test_one_word_of_a_name_cuts_nothing():
    """op7_html: ids made from headings, and wrappers of the article."""
    text = lambda page: H.extract(H.read(page)[1], frozenset(), None)
    inner = "<h2 id=navigation>How to steer</h2><p>a</p><section id=related-work><p>b</p></section><div id=social-impact>c</div><section id=related>d</section>"
    for page in (f"<article>{inner}</article>", f"<div role=main>{inner}</div>", f"<div class=layout-two-sidebars><article>{inner}</article></div>",
                 f"<div class=sidebar><article>{inner}</article></div>", f"<div class=layout-two-sidebars><div class=x>{inner.replace('id=related>', '>')}</div></div>"):
        assert text(page) == "How to steer\na\nb\nc\nd"
    assert text("<article>a<div class=share>x</div></article><div class=sidebar><article>teaser</article></div>") == "a"
    assert text("<div class=related><article>teaser</article></div><div class=x>the longer text</div>") == "the longer text"


def test_one_word_of_a_name_cuts_what_repeats(spark):
    """op7_html: by position over the host's pages, but no wrapper of the text."""
    page = ("<body><div class=layout-two-sidebars><div class=x><p>Own text {0} of a page of this host, which is long.</p>{1}</div>"
            "<div class=share-box><p>Told {0} times to friends.</p></div></div></body>")
    got = extracted(spark, [page.format(i, "<div id=related-work><p>It was done before.</p></div>" * (i == 0)) for i in range(6)])
    assert got == [f"Own text {i} of a page of this host, which is long." + "\nIt was done before." * (i == 0) for i in range(6)]


def test_sections_named_alike_on_all_pages_keep_their_own_text(spark):
    """op7_html: inside of content only repeated text is cut, whatever an element's position or name; papers, manuals and Markdown sites."""
    paper = "<body><article><h1>Paper {0}</h1><p>We show {0}.</p><section class=related-work><p>Others did {0} before.</p><p>See also the survey.</p></section></article></body>"
    want = "Paper {0}\nWe show {0}.\nOthers did {0} before."
    assert extracted(spark, [paper.format(i) for i in range(6)]) == [want.format(i) for i in range(6)]
    manual = ("<body><div role=main><div class=section id=module-{0}><h1>Module {0}</h1><p>What it does in case {0}.</p><div class=section id=sharing-data>"
              "<h2>Sharing {0}</h2><p>How to share {0}.</p></div><div class=section id=menu-design><p>Menus of {0}.</p></div></div></div></body>")
    want = "Module {0}\nWhat it does in case {0}.\nSharing {0}\nHow to share {0}.\nMenus of {0}."
    assert extracted(spark, [manual.format(i) for i in range(6)]) == [want.format(i) for i in range(6)]
    notes = ("<body><div class=top>My notes</div><div class=text><h1>Note {0}</h1><p>A long enough remark on the matter number {0}, told at length.</p>"
             "<section id=related-work><p>Earlier remarks on {0} were made.</p></section></div></body>")
    want = "Note {0}\nA long enough remark on the matter number {0}, told at length.\nEarlier remarks on {0} were made."
    assert extracted(spark, [notes.format(i) for i in range(6)]) == [want.format(i) for i in range(6)]


def test_slots_of_few_pages_are_not_gathered(spark, monkeypatch):
    """What is told of a host has a bound: slots on less than a given share of its pages aren't labels."""
    monkeypatch.setattr(H, "HOT_SHARE", 2)
    page = "<body><div class=b><p>Own text {0} of a page of this host, which is long.</p></div><div class={1}>Seen {0}</div></body>"
    rows = spark.createDataFrame([(i, "h", page.format(i, "xyz"[i % 3])) for i in range(12)], "row long, host string, html string")
    assert H.templates(H.tokens(rows)).first().labels == []
    monkeypatch.setattr(H, "HOT_SHARE", 3)
    assert len(H.templates(H.tokens(rows)).first().labels) == 3


def test_classes_nest(spark):
    """op7_html: a text is no template for a tag of the same pages that lies in another class than the text does."""
    once = "Told once more, as agreed."
    page = lambda i: ("<body>" + f"<div class=a><p>Own text {i} of this page, long enough.</p>{f'<p>{once}</p>' * (i < 5)}</div>" * (i < 8)
                      + f"<div class=b><p>Other text {i} of this page, long enough.</p></div>" * (i < 5) + f"<p>End {i} of the page, as it is.</p></body>")
    rows = spark.createDataFrame([(i, "h", page(i)) for i in range(10)], "row long, host string, html string")
    assert not H.templates(H.tokens(rows)).first().texts
    assert all((once in t) == (i < 5) for i, t in enumerate(extracted(spark, [page(i) for i in range(10)])))
    beside = lambda i: page(i).replace("</div><div class=b>", "<div class=b></div></div><div class=b>", 1)
    rows = spark.createDataFrame([(i, "h", beside(i)) for i in range(10)], "row long, host string, html string")
    assert len(H.templates(H.tokens(rows)).first().texts) == 1  # now a tag of its class lies in the same slot


def slow_template(pages):
    """Valid text tokens of one host, from whole vectors."""
    count, around, text = [], {H.PAGE: 0}, {}
    for page in pages:
        tags, blocks, above = H.read(page)
        around |= {t: x[0] for t, x in above.items()}
        text |= {H.text_token(b): b.slot for b in blocks}
        count.append(Counter(tags) + Counter(H.text_token(b) for b in blocks) + Counter([H.PAGE]))
    vector = lambda t: tuple(c[t or H.PAGE] for c in count)
    pages_of = lambda t: sum(x > 0 for x in vector(t))
    classes = {(vector(t), vector(s)) for t, s in around.items()} | {(vector(t), vector(t)) for t in around}
    return {t for t, s in text.items() if pages_of(t) >= max(H.LEAST, H.SHARE * pages_of(s)) and (vector(t), vector(s)) in classes}


def test_templates_against_whole_vectors(spark):
    """op7_html: random hosts of optional, repeated and nested elements."""
    draw = random.Random(5)

    def shape(depth):
        """Name, text (of the page's own, or the same on all), how often on how many pages, and what is inside."""
        inner = [shape(depth - 1) for _ in range(draw.randint(1, 3))] if depth else []
        return draw.choice("abc"), draw.choice(["own {}", "same", "like"]), draw.choice([1, 1, 2]), draw.choice([2, 2, 3, 9]), inner

    def render(part, i):
        name, words, times, often, inner = part
        inside = "".join(render(x, i) for x in inner)
        return f"<div class={name}><p>{words.format(i)}</p>{inside}</div>" * times if i % often or often == 9 else inside

    shapes = [shape(2) for _ in range(20)]
    hosts = {f"h{k}": [render(x, i) for i in range(draw.randint(4, 16))] for k, x in enumerate(shapes)}
    rows = [(k * 100 + i, h, p) for k, (h, pages) in enumerate(hosts.items()) for i, p in enumerate(pages)]
    got = {r.host: set(r.texts or ()) for r in H.templates(H.tokens(spark.createDataFrame(rows, "row long, host string, html string"))).collect()}
    want = {h: slow_template(pages) for h, pages in hosts.items()}
    assert got == want and sum(map(bool, want.values())) > 5
