"""Main text: hand-made pages, minimum cut against brute force, the given pages."""

import html
import itertools
import random
import re
import time

from jobtext.llm import mainhtml

SMOKE = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><div>Site name</div></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all.</div><div id="page-wrap"><form><input name=q><label>Search here</label></form>
<article><header><h1>A &amp; B &lt;title&gt;</h1></header><p>First  para\n with <a href="x">a link</a> &eacute;&#33;<br>and more.<p>Second <b>bold</i> one
<div class="ad"><p>Buy this now, it is very good and long enough to look like text.</p></div><ul><li>item one<li>item two</ul><!-- <p>no</p> -->
<blockquote>Quoted 1 < 2 text.</blockquote><section class="comments"><article class="comment"><p>Nice post, I liked every word of it.</p></article></section></article>
<aside><h2>Related</h2><p>Another story that is quite long, with commas, and a full stop.</p></aside></div><footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_hand_made():
    got = mainhtml.extract(PAGE, mainhtml.PRIOR)
    assert got == ["A & B <title>", "First para with a link é! and more.", "Second bold one", "item one", "item two", "Quoted 1 < 2 text."]
    bare = "<div><a href=1>One</a> <a href=2>Two</a></div><div><p>" + "A long sentence, with some words in it. " * 5 + "</p><p>Short one here.</p><p>" + "More text follows, as it does. " * 5 + "</p></div><div><a href=3>Three</a></div>"
    assert [t[:5] for t in mainhtml.extract(bare, mainhtml.PRIOR)] == ["A lon", "Short", "More "]
    for broken in ("", "<", "<p", "<p>a", "</p>", "<!--", "<script>", "<a b='", "a<b>c</", '<p class="x>y</p>', "<" * 3000, "<p '" * 3000):
        mainhtml.extract(broken, mainhtml.PRIOR)


def test_drop_words_on_a_content_wrapper(spark):
    long = "A long sentence, with some words in it. " * 8
    rest = "<nav><ul><li><a href=/a>Home</a></ul></nav>", '<div class="ad">Buy now</div><aside><p>' + long + "</p></aside><footer><p>Rights reserved, all of them.</p></footer>"
    body = f"<h2>A heading of it</h2><p>1 {long}</p><p>Short one here.</p><p>2 {long}</p><p>3 {long}</p><p>4 {long}</p>"
    want = ["A heading of it", f"1 {long}".strip(), "Short one here.", f"2 {long}".strip(), f"3 {long}".strip(), f"4 {long}".strip()]
    page = lambda attr: f"<html><body>{rest[0]}<div {attr}>{body}</div>{rest[1]}</body></html>"
    attrs = [f'class="content {w}"' for w in ("has-sidebar", "header", "social", "notice", "widget", "comments-open")]
    for attr in attrs:
        assert mainhtml.extract(page(attr), mainhtml.PRIOR) == want, attr
    weights = [mainhtml.PRIOR, mainhtml.train(spark.read.parquet(f"{SMOKE}/pages.parquet"))]
    for w in weights:
        for firm in ("<nav>", "<aside>", "<form>", "<div hidden>"):
            assert mainhtml.extract(f"{firm}{body}</{firm.strip('<> ').split()[0]}>", w) == []
        assert mainhtml.extract(f'<section class="comments"><article class="comment"><p>1 {long}</p></article></section>', w) == []
    pages = spark.createDataFrame([(i, "u", page(a)) for i, a in enumerate(attrs)], "page_id long, url string, html string")
    assert {r.text for r in mainhtml.main_text(pages).collect()} == {"\n".join(want)}


def fitted(spark):
    return mainhtml.train(spark.read.parquet(f"{SMOKE}/pages.parquet"))


def test_boilerplate_in_paragraphs(spark):
    """Paragraphs beside an article, or beside more text, stay out whatever the classifier has learnt of paragraphs."""
    p = lambda k, n=6: f"<p>{k} " + "A long sentence, with some words in it. " * n + "</p>"
    texts = lambda *ks, n=6: [f"{k} " + ("A long sentence, with some words in it. " * n).strip() for k in ks]
    extra = [f'<div class="sidebar">{p("S")}</div>', f'<div class="cookie-notice">{p("C")}</div>', f"<footer>{p(1)}{p(2)}{p(3)}</footer>",
             f'<section id="comments">{p(1)}{p(2)}{p(3)}{p(4)}{p(5)}{p(6)}</section>', f'<div class="newsletter signup">{p("N")}{p("M")}</div>', f'<div role="dialog">{p("D")}</div>']
    for w in (mainhtml.PRIOR, fitted(spark)):
        assert mainhtml.extract(PAGE, w) == mainhtml.extract(PAGE, mainhtml.PRIOR)
        for x in extra:
            for body, inner in (("article", ""), ("article", f'<div class="ad">{p("AD")}</div>'), ("div", "")):
                many = p("A") + p("B") + inner + "".join(p(k) for k in "EFGHIJ")
                page = f"<html><body>{x}<{body}>{many}</{body}>{x}</body></html>"
                assert mainhtml.extract(page, w) == texts("A", "B", *"EFGHIJ"), (x, body)


def test_many_unmatched_tags():
    for page in ("<b>x" * 20_000 + "</i>" * 20_000, "<i><article>" + "<b>x" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<b>" * 20_000 + "<li>x" * 20_000):
        start = time.perf_counter()
        mainhtml.blocks(page)
        assert time.perf_counter() - start < 2


def test_training_does_not_depend_on_the_split(spark, monkeypatch):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    monkeypatch.setattr(mainhtml, "TRAIN_BLOCKS", 300)
    a, b = (mainhtml.train(pages.repartition(n)) for n in (1, 7))
    assert (a == b).all()


def test_min_cut():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i - 1, i, rng.choice([0.25, 1.0])) for i in range(1, n)] + [(i, j, 0.5) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.3]
        cost = lambda keep: sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        assert abs(cost(mainhtml.min_cut(odds, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


def test_given_pages_and_edges(spark):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    rows = mainhtml.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article|li|ul)[^>]*>", inner)]
        assert r.text == "\n".join(p for p in parts if p), r.page_id
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", PAGE, "t"), (2, "u", PAGE, "t"), (3, "u", "<p>x" * 20_000, "t")], "page_id long, url string, html string, text string")
    got = mainhtml.main_text(odd).collect()
    assert len(got) == 5 and sorted(r.text for r in got)[:2] == ["", ""]
    assert mainhtml.main_text(odd.limit(0)).count() == 0
