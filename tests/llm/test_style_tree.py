from pyspark.sql import functions as F

from riskframe.llm import style_tree
from tests.llm.tables import same

PAGES = "page_id long, url string, html string"


def text(html):
    return style_tree.Page(html).main_text(frozenset())


def test_article_alone():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One   <i>two</i>
    three<br>four<p>Next &lt;p&gt; &copy; x&nbsp;y</p><form><p>Name</p></form><aside>side</aside>
    <ul><li>a<li>b</ul><section id="comments"><p>nice!</p></section><div class="notice">cookie</div></article>
    <div class="sidebar"><p>links</p></div><footer>&copy; 2020</footer></body></html>"""
    assert text(html) == "Head & line\n\nOne two three four\n\nNext <p> © x y\n\na\n\nb"


def test_odd_markup():
    assert text("") == "" and text("plain &amp; text") == "plain & text"
    assert text("<p>a<p>b</div></p>c") == "a\n\nb\n\nc"
    assert text('<p title="a>b">x</p><p>1 < 2') == "x\n\n1 < 2"
    assert text("<article><p>a</article><p>b") == "a"
    assert text("<script>never closed <p>x") == ""
    assert text("<body class='no-sidebar'><p>kept</p><p hidden>gone</p></body>") == "kept"
    assert len(text("<article><p>" + "word " * 100_000)) == 499_999


def rows_of():
    page = "<html><body><div class=top><p>Welcome to our site</p></div><div class=text><p>{a}</p><p>{b}</p></div><div class=end><p>All rights</p></div></body></html>"
    rows = [(i, f"http://one.example/{i}", page.format(a=f"story {i} here", b="more of it " * (i % 5 + 1) + str(i))) for i in range(12)]
    rows += [(50 + i, f"http://few.example/{i}", page.format(a=f"story {i}", b="x")) for i in range(2)]
    return rows + [(90, None, None), (91, "http://one.example/x", ""), (92, "no address", "<article><p>a</p></article>")]


def test_shared_branches_are_cut(spark):
    got = {r.page_id: r for r in style_tree.extract(spark.createDataFrame(rows_of(), PAGES)).collect()}
    assert got[3].text == "story 3 here\n\n" + ("more of it " * 4 + "3")
    assert got[50].text.startswith("Welcome to our site") and got[50].text.endswith("All rights")  # too few pages to tell
    assert got[90].text == got[91].text == "" and got[92].text == "a"
    assert all(r.n_chars == len(r.text) for r in got.values())
    found = {(r.host, r.path): r.importance for r in style_tree.importance(spark.createDataFrame(rows_of(), PAGES)).collect()}
    top, body = found["one.example", "/html/body/div.top"], found["one.example", "/html/body/div.text"]
    assert top < 0.05 < 0.8 < body


def test_an_article_that_a_host_repeats_stays(spark):
    page = "<html><body><nav>m</nav><article><p>the same story</p></article><footer>f</footer></body></html>"
    rows = [(i, f"http://a.example/{i}", page) for i in range(9)]
    assert {r.text for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"the same story"}


def test_empty_clashes_and_large_cut(spark, monkeypatch):
    assert style_tree.extract(spark.createDataFrame([], PAGES)).collect() == []
    plain = spark.createDataFrame(rows_of(), PAGES)
    more = plain.select("*", *[F.lit("z").alias(c) for c in ("host", "path", "paths", "text", "n_chars", "importance")])
    want = style_tree.extract(plain)
    assert same(want, style_tree.extract(more))
    monkeypatch.setattr(style_tree, "MOST_SENT", 0)
    assert same(want, style_tree.extract(plain))


def test_a_repeated_notice_inside_an_article_goes(spark):
    page = "<html><body><{0}><div class=x><p>Follow us on all channels</p></div><div class=y><h2>Head {1}</h2><p>story {1} is long</p></div></{0}></body></html>"
    rows = [(i, f"http://{tag}.example/{i}", page.format(tag, i)) for tag in ("article", "main") for i in range(9)]
    got = {(r.page_id, r.text) for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(i, f"Head {i}\n\nstory {i} is long") for i in range(9)}


def test_copies_of_a_page_do_not_make_its_text_layout(spark):
    page = "<html><body><div class=text><p>story {0} here</p><p>more of {0}</p></div></body></html>"
    rows = [(i, f"http://one.example/{i}", page.format("a")) for i in range(9)]
    rows += [(20 + i, f"http://two.example/{i}", page.format("ab"[i % 2])) for i in range(60)]
    rows += [(100 + i, f"http://many.example/{i}", page.format("x" if i < 30 else i)) for i in range(36)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[r[0]].startswith("story ") and "\n\nmore of " in got[r[0]] for r in rows)


def test_role_words_do_not_silence_the_page():
    for name in ("layout no-sidebar", "with-sidebar", "ad-free", "page-has-banner", "post-share-enabled"):
        assert text(f'<body><nav>m</nav><div class="{name}"><article><p>story</p><div class="share">s</div></article></div></body>') == "story"
        assert text(f'<body><p>top</p><div class="{name}"><p>a long story of many words</p></div></body>') == "top\n\na long story of many words"
    assert text("<body><form><main><p>story</p></main></form></body>") == text("<body><form><p>story</p></form></body>") == "story"
    assert text("<body><article><p>story</p></article><div id=comments><article><p>long long comment</p></article></div></body>") == "story"
    assert text("<body><p>story</p><div id=comments><article><p>long long comment</p></article></div></body>") == "story"
    page = "<div class='layout with-sidebar'><p>a long story of words</p><div class=sidebar><p>links</p></div><div id=comments><p>nice! nice! nice! nice! nice! nice!</p></div></div>"
    assert text(page) == "a long story of words" and text("<div id=comments><p>all there is</p></div>") == "all there is"
    assert text("<body><p>a story</p><div class=ad><p>buy</p></div></body>") == "a story"


def test_names_in_an_article_are_the_authors():
    html = '<article><h2 id="social-history">Social history</h2><p>body text</p><section id="related-work"><p>Earlier work is this.</p></section></article>'
    assert text(html) == "Social history\n\nbody text\n\nEarlier work is this."
    assert text('<article><p>a</p><section id="related"><h2>Related</h2><p>by the author</p></section><ul id=share><li>x</ul></article>') == "a\n\nRelated\n\nby the author"
    assert text('<article><p>a</p><div class="share-buttons"><p>x</p></div><div class="js-newsletter-box">y</div><section class=related-posts><article>z</article></section></article>') == "a"


def test_comments_in_article_elements_go():
    html = '<main><article class="post">the post</article><ol class="commentlist"><li><article class="comment-body">I disagree.</article></ol></main>'
    assert text(html) == "the post"
    assert text('<div><article class="post">the post</article><article class="comment">no</article><article class="related-post">other</article></div>') == "the post"
    assert text('<article><p>a</p><p id="commentary">on it</p></article>') == "a\n\non it"


def test_a_short_article_does_not_silence_the_page():
    long = "a long text of words " * 20
    assert long.strip() in text(f'<article class="teaser">Teaser.</article><div id="content"><p>{long}</p></div>')
    assert text(f"<article><p>{long}</p></article><div><p>rest</p></div>") == long.strip()


def test_quotes_and_names_of_attributes():
    assert text("<p title=it's>Hello</p><p>World it's</p>") == "Hello\n\nWorld it's"
    html = '<article><p title="a hidden gem">1</p><p data-id="menu">2</p><p data-role="banner">3</p><p data-hidden>4</p><p>5</p><p hidden>6</p></article>'
    assert text(html) == "1\n\n2\n\n3\n\n4\n\n5"
    assert text('<p title="never closed>text goes on</p><p>x</p>') == "text goes on\n\nx"
    assert text("a < b <3 </ x> <!-- c --><!--> d <p>e <b") == "a < b <3 d\n\ne"


BROKEN = {
    "tags never closed": "<b " * 350_000,
    "after an open quote": '<p x="' + "<b " * 350_000,
    "nested": "<div>" * 200_000 + "x",
    "nested roles": "<div class=ad>x" * 60_000,
    "inline around paragraphs": "<b>" * 100_000 + "<p>x" * 100_000,
    "rules in inline": "<b>" * 100_000 + "x<hr>" * 100_000,
    "ends": "</p>" * 250_000,
    "comments": "<!--" * 250_000,
    "angles": "<" * 1_000_000,
}


def test_broken_markup_of_a_megabyte_takes_a_moment():
    import time

    for name, html in BROKEN.items():
        start = time.process_time()
        style_tree.Page(html).main_text({1})
        assert time.process_time() - start < 10, name  # about a second; a scan per tag would take hours


def plain_importance(rows):
    """Entropies over the distinct pages of each host, written out."""
    import math
    import re

    hosts: dict = {}
    for _, url, html in rows:
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", url or "")
        if host:
            page = style_tree.Page(html or "")
            seen = frozenset([("children", p, c) for p, c in page.children] + [("block", p, t) for p, t, _ in page.blocks])
            hosts.setdefault(host[1].lower(), set()).add(seen)
    out = {}
    for host, pages in hosts.items():
        nodes = {x[1] for page in pages for x in page if x[1]}
        entropy = lambda shares, n: -sum(s * math.log(s) for s in shares) / math.log(max(n, 2))
        on = {p: [page for page in pages if any(x[1] == p for x in page)] for p in nodes}
        for top in {"/".join(p.split("/")[: i + 1]) for p in nodes for i in range(1, p.count("/") + 1)} & nodes:
            shown: dict = {}
            for page in on[top]:
                for kind, p, what in page:
                    if kind == "children" and p == top:
                        shown[what] = shown.get(what, 0) + 1
            total = sum(shown.values())
            presentation = entropy([c / total for c in shown.values()], len(on[top])) if total else 0.0
            information = []
            for p in nodes:
                if p == top or p.startswith(top + "/"):
                    for block in {x for page in on[p] for x in page if x[0] == "block" and x[1] == p}:
                        c = sum(block in page for page in on[p])
                        information.append(1 - entropy([1 / c] * c, len(on[p])))
            if information:
                out[host, top] = len(on[top]), (1 - style_tree.CONTENT) * presentation + style_tree.CONTENT * sum(information) / len(information)
    return out


def test_importance_as_written_out(spark):
    import random

    import pytest

    rng = random.Random(7)
    pieces = ["<div class=a><p>{0}</p></div>", "<div class=b><ul><li>{1}<li>same</ul></div>", "<p>{2}</p>", "<section><h2>h</h2><p>{0} {1}</p></section>", "<div class=ad>buy {1}</div>"]
    rows = rows_of()
    for i in range(40):
        body = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))).format(rng.randrange(6), rng.randrange(3), i)
        rows.append((500 + i, f"https://H{i % 3}.example/{i}", f"<html><body>{body}<article><p>{i % 4}</p><div class=x>follow</div></article></body></html>"))
    got = {(r.host, r.path): (r.pages, r.importance) for r in style_tree.importance(spark.createDataFrame(rows, PAGES)).collect()}
    want = plain_importance(rows)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
