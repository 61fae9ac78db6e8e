"""Page extraction and licence scan on planted pages and texts, and held-out accuracy."""

import html
import re

import numpy as np

from prefloom.llm import license_scan as ls
from prefloom.llm import wrapper_extract as we

PAGES = "page_id long, url string, html string, host string, tree int, nodes string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, None) for i, u, h in rows], PAGES)


def texts(df):
    return {r.page_id: r.text for r in we.extract_pages(df).collect()}


def test_given_pages_against_their_articles(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in we.extract_pages(src).collect()}
    assert len(out) == src.count()
    for r in src.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert out[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert out[r.page_id].n_chars == len(out[r.page_id].text)


def test_boilerplate_and_markup(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><script>if (a < b) "<p>no"</script></head><body>
    <header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
    <main><h2>A &amp; B</h2><p>One<br>two &lt;b&gt; <b>bold<i>er</b></i>&nbsp;x<p>Three
       <ul><li>first<li>second</ul><!-- gone --><form><input value="q"><button>Go</button></form>
    <aside>side</aside><section id="comments"><p>reader says</section><div class="advert-box">buy</div>
    <p class="address">not an advert</p></main><footer>end</footer><style>p{}</style>"""
    got = texts(pages(spark, [(1, "http://a.org/x", page)]))[1]
    assert got.split("\n\n") == ["A & B", "One two <b> bolder x", "Three", "first", "second", "not an advert"]


def test_template_of_a_host_goes(spark):
    body = "<html><body><div><p>Welcome to our site</p><p>{}</p><p>{}</p><p>Read our other pages</p></div></body></html>"
    rows = [(i, f"https://u@News.example.com:80/{i}", body.format(f"story {i} begins", f"story {i} ends")) for i in range(8)]
    rows += [(20, "https://other.example/1", body.format("alone", "page")), (21, None, None), (22, "not a url", ""), (22, "not a url", ""), (23, "", "plain <b text")]
    df = pages(spark, rows)
    got = texts(df)
    assert got[3] == "story 3 begins\n\nstory 3 ends"
    assert got[20].startswith("Welcome") and got[21] == "" and got[22] == "" and got[23].startswith("plain")
    assert we.extract_pages(df).count() == len(rows) and we.extract_pages(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    """Equal pages count once: they keep their text, and real boilerplate of the host still goes."""

    def page(i, extra=""):
        return f"<html><body><div>Site motto here</div><article><p>Story {i} has its own long text.</p></article>{extra}</body></html>"

    rows = [(i, "http://a.org/x", page(0)) for i in range(6)] + [(6 + i, "http://a.org/y", page(i + 1)) for i in range(3)]
    rows += [(20 + i, None, page(9, f"<!-- {i} -->")) for i in range(5)] + [(30 + i, "http://b.org/", f"<div>Same line</div><p>Item {i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in we.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == "Story 0 has its own long text." for i in range(6))
    assert [got[6 + i] for i in range(3)] == [f"Story {i + 1} has its own long text." for i in range(3)]
    assert all(got[20 + i] == "Story 9 has its own long text." for i in range(5))
    assert [got[30 + i] for i in range(4)] == [f"Item {i}" for i in range(4)]


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    root = we.parse(deep)
    we.number(root)
    assert we.main_text(root, set()) == "x"
    other = we.from_skeleton(we.skeleton(root))
    assert len(we.align(other, root)) == 20002
    assert we.main_text(we.parse("a < b & c > d &#x41;&bogus; <unclosed"), set()).startswith("a < b & c > d A&bogus;")


def test_alignment_is_a_largest_match():
    a, b = we.parse("<p>1</p><ul></ul><p>2</p><div></div>"), we.parse("<h1></h1><p>1</p><p>2</p><table></table><div></div>")
    we.number(a), we.number(b)
    pairs = [(x.label, y.label) for x, y in we.align(a, b)]
    assert pairs.count(("p", "p")) == 2 and ("div", "div") in pairs and all(x == y for x, y in pairs)


def largest(a, b):
    """The size of a largest match by the plain recursion, all pairs of children."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest(x, y))
    return 1 + best[-1][-1]


def test_alignment_against_plain_recursion(monkeypatch):
    two, one = "<div><p>a</p><p>b</p><p>c</p></div>", "<div><ul><li>x</ul></div>"
    a, b = we.parse(f"<div>{one}{two}</div>"), we.parse(f"<div>{two}</div>")
    assert len(we.align(a, b)) == largest(a, b) == 9  # not the two nodes that pairing the first children gives
    r = np.random.default_rng(5)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return f"t{r.integers(3)}" if r.random() < 0.5 else ""
        tag = ["div", "section", "b"][r.integers(3)]
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.integers(0, 5))) + f"</{tag}>"

    shapes = we.Shapes()
    for cells in (1 << 20, 4):  # whole tables, and halves
        monkeypatch.setattr(we, "MATCH_CELLS", cells)
        for _ in range(120):
            a, b = (we.parse("".join(tree(4) for _ in range(4))) for _ in range(2))
            we.number(a), we.number(b), shapes.add(a), shapes.add(b)
            pairs = we.align(a, b, shapes)
            assert len(pairs) == largest(a, b) == shapes.score(a.shape, b.shape)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            assert sorted(pairs, key=lambda z: z[0].id) == sorted(pairs, key=lambda z: z[1].id)
            assert all(x.label == y.label for x, y in pairs)


def test_long_lists_are_aligned():
    a = we.parse("<p>x</p>" * 3000 + "<div>end</div>")
    b = we.parse("".join("<p>y</p>" if i % 3 else "<p><b>z</b></p>" for i in range(3000)) + "<div>end</div>")
    assert len(we.align(a, b)) == 1 + 3000 + 2000 + 2


def test_template_without_names_or_equal_lengths(spark):
    """No classes, no telling elements: what is constant goes, wherever a page's own paragraphs push it."""

    def page(i):
        own = "".join(f"<p>Page {i} paragraph {k}</p>" for k in range(1 + i % 4))
        extra = "<div><b>Now and then</b></div>" if i % 3 == 0 else ""
        return f"<body><div><p>Motto of the site</p>{extra}</div><div>{own}<p>Write to the editor</p></div></body>"

    rows = [(i, f"http://plain.org/{i}", page(i)) for i in range(12)] + [(3, "http://plain.org/3", page(3))]
    got = {r.page_id: r.text.split("\n\n") for r in we.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        own = [f"Page {i} paragraph {k}" for k in range(1 + i % 4)]
        assert [x for x in got[i] if x != "Now and then"] == own


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    """Two kinds of pages on one host, the smaller a quarter: each learns its own constant text."""

    def story(i):
        return f'<body><div class="s1"><p class="s2">Our stories</p><div class="s3"><p>Story {i}</p></div></div></body>'

    def shop(i):
        return f'<body><table class="t1"><tr><td class="t2">All prices are final</td><td class="t3">Item {i}</td></tr></table></body>'

    rows = [(i, "http://two.org/", story(i)) for i in range(15)] + [(100 + i, "http://two.org/", shop(i)) for i in range(5)]
    rows += [(7, "http://two.org/", story(7)), (7, "http://two.org/", shop(70))]  # a repeated row, an id with two texts
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in we.extract_pages(df).collect())
    want = [(i, f"Story {i}") for i in range(15)] + [(100 + i, f"Item {i}") for i in range(5)] + [(7, "Story 7"), (7, "Item 70")]
    assert got == sorted(want)


def test_license_held_out():
    r = np.random.default_rng(11)
    filler = [f"word{i}" for i in range(300)] + ["the", "of", "and", "version", "license", "public", "rights"]
    model = ls.fit([(" ".join(r.choice(filler, 12)), ls.NONE) for _ in range(800)], filler)
    held = [(ls._damaged(r, t.split(), filler[:300]), k) for k, v in ls.TEMPLATES.items() for t in v for _ in range(10)]
    plain = [" ".join(r.choice(filler[:300], r.integers(3, 40))) for _ in range(500)]
    w = ls._words_of([t for t, _ in held] + plain)
    p = model.probabilities(w)
    said = [ls.LABELS[i] for i in p.argmax(axis=1)]
    sure = p.max(axis=1) >= model.least
    right = [a == k for a, (_, k) in zip(said, held, strict=False)]
    assert np.mean(right) >= 0.95
    wrong = [a != k and a != ls.NONE and s for a, (_, k), s in zip(said, held, sure, strict=False)]
    assert np.mean(wrong) <= 0.01
    assert np.mean([a == ls.NONE for a in said[len(held) :]]) >= 0.99


def test_license_scan(spark):
    plain = [(i, f"some words about nothing number {i} in a row of plain text\nand one more line {i}", "x") for i in range(60)]
    rows = plain + [
        (100, "intro text here\nLicensed under the Apache License, Version 2.0.", "x"),
        (101, "Released under the MIT License.", "x"),
        (102, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", "x"),
        (103, None, "x"), (104, "", "x"), (104, "", "x"), (105, "a license to thrill and rights to wrong", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {r.doc_id: r for r in ls.license_summary(ls.scan_licenses(df)).collect()}
    assert [got[i].families for i in (100, 101, 102, 103, 104, 105)] == ["apache", "mit", "gpl,proprietary", "", "", ""]
    assert got[100].n_paragraphs == 2 and got[104].n_paragraphs == 0
    assert not any(got[i].n_confirmed for i in range(60))
    assert ls.license_summary(ls.scan_licenses(df)).count() == len(rows)
    assert ls.license_summary(ls.scan_licenses(df.limit(0))).count() == 0
