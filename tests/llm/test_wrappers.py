"""Main texts against the articles that pages were made from, and against templates merged one page at a time."""

import random
from html import escape
from html.parser import HTMLParser

import pytest

from silverquill.llm import dom, wrappers
from silverquill.llm.queries import queries

SCHEMA = "page_id long, url string, html string"


class Article(HTMLParser):
    """The blocks of the one article element of a page of the given table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [[]] * 0 if tag in ("b", "br") else [[]]

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag != "b":
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def article(html):
    reader = Article()
    reader.feed(html)
    reader.close()
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in reader.blocks) if t)


def test_query_on_the_given_table(spark):
    from ..oracle import DATA

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries()["op12_html_extraction"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == article(pages[r.page_id].html)


WORDS = [f"w{k}" for k in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sites(rng, pages=14):
    """(url, html, article) of hosts whose templates name their parts in different ways, or not at all."""
    shells = {
        "plain": lambda nav, ad, title, body, foot: f"<html><head><title>x</title></head><body><div><div>{nav}</div><div>{ad}</div></div><div><div><h1>{title}</h1>{body}<div>Read more about our terms and conditions of use here</div></div></div><div>{foot}</div></body></html>",
        "classes": lambda nav, ad, title, body, foot: f"<body><div class=navbar>{nav}</div><div id='page-1'><div class='post content'><h1>{title}</h1>{body}<div class='share-box'>Share!</div></div><div class=sidebar>{ad}</div><div id=comments><p>{ad} I like {nav}</p></div></div><div class=footer>{foot}</div></body>",
        "main": lambda nav, ad, title, body, foot: f"<!doctype html><body><header><h1>The site</h1>{nav}</header><main><article><header><h1>{title}</h1></header>{body}<aside>{ad}</aside><form><label>Your mail</label><input></form></article><section class=comments><article><p>{ad}</p></article></section></main><footer>{foot}</footer>",
        "layout": lambda nav, ad, title, body, foot: f"<body><form id=all><table><tr><td>{nav}<td><h1>{title}</h1>{body}</table></form>",
    }
    for host, shell in shells.items():
        for k in range(pages):
            title, paras = prose(rng, 6), [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 7))]
            paras[0] += " & <i>x</i>"
            body = "".join(f"<p>{escape(p).replace(' w', rng.choice([' w', '&nbsp;w', ' <b>w</b>w'.replace('w</b>w', '</b>w')]), 1)}" + rng.choice(["", "</p>"]) for p in paras)
            nav = "<ul>" + "".join(f"<li><a href=/{w}>{w}</a>" for w in rng.sample(WORDS, 5)) + "</ul>"
            html = shell(nav, f"<p>Buy {prose(rng, 4)} now</p>", escape(title), body, "Copyright of the site, all rights reserved")
            yield f"https://{host}.org/{k}?q#f", html, "\n\n".join(" ".join(t.split()) for t in (title, *paras))


def test_articles_of_differently_made_sites(spark):
    made = list(sites(random.Random(3)))
    df = spark.createDataFrame([(k, url, html) for k, (url, html, _) in enumerate(made)], SCHEMA).repartition(5)
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    wrong = [(made[k][0], got[k], text) for k, (_, _, text) in enumerate(made) if got[k] != text]
    assert not wrong, wrong[0]


@pytest.mark.parametrize("sent_whole", [0, 1 << 20])
def test_equals_templates_merged_page_by_page(spark, sent_whole):
    made = list(sites(random.Random(4), 25)) * 2
    found = {}
    parsed = [(url.split("/")[2], dom.parse(html)) for url, html, _ in made]
    for host, page in parsed:
        key, own = (host, dom.layout_of(page, wrappers.LAYOUTS)), dom.Template.of(page, dom.shape(page))
        found[key] = found[key].plus(own) if key in found else own
    want = [dom.extract(page, dom.shape(page), found[host, dom.layout_of(page, wrappers.LAYOUTS)]) for host, page in parsed]
    df = spark.createDataFrame([(k, url, html) for k, (url, html, _) in enumerate(made)], SCHEMA).repartition(7)
    got = sorted((r.page_id, r.text) for r in wrappers.main_texts(df, sent_whole).collect())
    assert [t for _, t in got] == want


def test_a_hot_host_is_many_rows_of_partial_templates(spark):
    rows = [(k, "http://hot.org/x", html) for k, (_, html, _) in enumerate(sites(random.Random(5), 30))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).selectExpr("'hot' host_key", "html")
    found = wrappers.templates(df).collect()
    assert len({(r.host_key, r.layout) for r in found}) == len(found)
    assert sum(dom.Template.read(r.template).pages for r in found) == len(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "no url", "just text &amp; more"), (3, "no url", "just text &amp; more"), (None, "http://a.b/", "<article><p>one<p>two</article>"),
        (4, "http://a.b/", "<div " * 5000), (5, "http://a.b/", "<div>" * 5000 + "deep" + "</div>" * 5000), (6, "http://a.b/", "<p>" + "long " * 100_000), (7, "http://a.b/", "<a href=\"x>never closed <p>text"),
        (8, "http://a.b/", "a < b &lt; c &am <!-- no <p>--> d<script>if (a<b) {'</p>'}</script>e"), (9, "http://a.b/", "<body><nav>menu</nav></body>"), (10, "http://a.b/", "x\u0000퟿&#0;&#xD800;é日本"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, host_key int")
    got = {}
    for r in wrappers.main_texts(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == got[2] == [""] and got[3] == ["just text & more"] * 2 and got[None] == ["one\n\ntwo"]
    assert got[4] == [""] and got[5] == ["deep"] and len(got[6][0]) == 499_999 and got[8] == ["a < b < c &am de"] and got[9] == [""]
    assert len(got) == 11
    assert wrappers.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_lists_and_unclosed_elements():
    page = dom.parse("<article><ul><li>a<li>b <i>c</i></ul><table><tr><td>1<td>2<tr><td>3</table><pre>x\n y</pre>tail<h2>h<p>p1<div>d</div>after</article>")
    assert dom.extract(page, dom.shape(page), None).split("\n\n") == ["a", "b c", "1", "2", "3", "x y", "tail", "h", "p1", "d", "after"]
    page = dom.parse("<head><title>t</title><noscript><div>n</div></noscript><p>shown <select><option>o</select>too<button>b</p></article>rest")
    assert dom.extract(page, dom.shape(page), None).split("\n\n") == ["shown too", "rest"]


def test_simple_tree_matching_is_the_best_alignment():
    rng = random.Random(1)

    def tree(depth):
        return dom.Shape(rng.choice("ab"), "", False, {}, 0, 0, [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    def plain(a, b):
        if a.key != b.key:
            return 0
        best = {}
        for i in range(len(a.kids) + 1):
            for j in range(len(b.kids) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + plain(a.kids[i - 1], b.kids[j - 1])) if i and j else 0
        return 1 + best[len(a.kids), len(b.kids)]

    seen = 0
    for _ in range(200):
        a, b = tree(3), tree(3)
        if a.key == b.key:
            same = [k.key for k in a.kids] == [k.key for k in b.kids]
            weight = dom.aligned(a, b)[0]
            assert weight <= plain(a, b) and (same or weight >= plain(a, b) - 2)
            seen += weight == plain(a, b)
    assert seen > 80
