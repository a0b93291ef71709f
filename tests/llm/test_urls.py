"""Canonical and redirect links read by the standard library's parser, resolved by its urljoin, and groups found by a plain search."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from silverquill.llm import urls

from ..oracle import duck, rows_of

SCHEMA = "page_id long, url string, html string"


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "link" and "canonical" in given.get("rel", "").lower().split():
            self.found.append(given.get("href", ""))
        if tag == "meta" and given.get("http-equiv", "").strip().lower() == "refresh":
            _, _, after = given.get("content", "").partition(";")
            after = after.strip()
            if after.lower().startswith("url"):
                after = after[3:].lstrip().removeprefix("=").strip()
            self.found.append(after.strip("\"'"))


def links_of(url, html):
    reader = Links()
    reader.feed(html)
    return {urljoin(url, x.strip()) for x in reader.found if x.strip()}


def cut(url):
    if "://" not in url:
        return None
    scheme, _, rest = url.partition("://")
    rest = rest.split("#")[0]
    end = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
    host, tail = rest[:end].lower(), rest[end:]
    path, _, query = tail.partition("?")
    return scheme.lower(), host, path, query


def verdicts(pages, rules=urls.RULES):
    def own(url):
        c = cut(url or "")
        fits = [(len(h) + len(p), v) for v, h, p in rules if c and (c[1] == h or c[1].endswith("." + h)) and c[2].startswith(p)]
        return max(fits)[1] if fits else None

    name = lambda u: None if cut(u) is None else (cut(u)[0], cut(u)[1], cut(u)[2] or "/", cut(u)[3])
    near, said = {}, {}
    for _, url, html in pages:
        here = name(url or "")
        if here is None:
            continue
        said.setdefault(here, set()).add(own(url))
        for to in links_of(url, html or ""):
            if name(to) is not None:
                said.setdefault(name(to), set()).add(own(to))
                near.setdefault(here, set()).add(name(to))
                near.setdefault(name(to), set()).add(here)
    found = {}
    for page_id, url, _ in pages:
        verdict, start = own(url), name(url or "")
        if verdict is None:
            seen, todo = {start}, [start]
            while todo:
                for x in near.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            group = {v for x in seen for v in said.get(x, ())}
            verdict = "block" if "block" in group and "allow" not in group else "allow"
        found[page_id] = verdict
    return found


BAD = "http://x.net/fr/bad"
CASES = [
    # (url, html, url of the page that the link names)
    ("https://a.org/1", '<link rel="canonical" href="https://f.org/q?a=1&amp;b=2">', "https://f.org/q?a=1&b=2"),
    ("https://f.org/a/b/c", "<link rel=canonical href=../../q>", "https://f.org/q"),
    ("https://f.org/x", '<meta content="0; URL=/r" http-equiv=Refresh>', "https://f.org/r"),
    ("https://f.org/y", "<link href='//g.org/x' REL='alternate Canonical'/>", "https://g.org/x"),
    ("https://f.org/z?k=1", '<link rel=canonical href="?k=2">', "https://f.org/z?k=2"),
    ("https://f.org/d/", "<link rel=canonical href='./e/./f/..'>", "https://f.org/d/e/"),
    ("https://f.org/u", "<link rel=canonical href='/go?u=http://h.org/x'>", "https://f.org/go?u=http://h.org/x"),
    ("https://f.org/v", "<link rel=canonical href='/&#x71;&#49;&lt;'>", "https://f.org/q1<"),
    ("https://f.org", "<link rel=canonical href='w'>", "https://f.org/w"),
]
UNLINKED = [
    ("https://f.org/c1", "<!-- <link rel=canonical href=/no> -->", "https://f.org/no"),
    ("https://f.org/c2", "<script>x = '<link rel=canonical href=/no2>'</script>", "https://f.org/no2"),
    ("https://f.org/c3", "<link rel=stylesheet href=/no3>", "https://f.org/no3"),
    ("https://f.org/c4", "<link rel=canonical href='mailto:a@b.c'>", "https://f.org/a@b.c"),
    ("https://f.org/c5", "<meta name=refresh content='0;url=/no5'>", "https://f.org/no5"),
]


@pytest.mark.parametrize("known", [True, False])
def test_links_of_every_form(spark, known):
    pages = []
    for url, html, to in CASES if known else UNLINKED:
        pages.append((len(pages), url, html))
        pages.append((len(pages), BAD + str(len(pages)), f"<link rel=canonical href='{to.replace('&', '&amp;').replace('<', '&lt;')}'>"))
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == verdicts(pages) and {got[k] for k in range(0, len(pages), 2)} == {"block" if known else "allow"}


def random_pages(rng, n):
    hosts = ["a.org", "b.org", "x.net", "example.com", "www.example.com"]
    path = lambda: "/" + rng.choice(["", "fr/", "en/", "d/e/"]) + rng.choice("abc")
    full = lambda: rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + path() + rng.choice(["", "", "?x=1&y=2"])
    for k in range(n):
        link = rng.choice([full, path, lambda: "../" + rng.choice("abc"), lambda: "./" + rng.choice("abc"), lambda: "//" + rng.choice(hosts) + path(), lambda: "?x=1&y=2", lambda: "../../" + rng.choice(["", "fr/a", ".."])])().replace("&", "&amp;")
        tag = rng.choice(["<link rel=canonical href='{}'>", "<LINK HREF=\"{}\" title='x' rel='x canonical'>", "<meta http-equiv=refresh content=\"5; url={}\">", "<meta content='0;URL={}' http-equiv='Refresh'>", "<!-- <link rel=canonical href='{}'> -->", "<a href='{}'>x</a>", ""]).format(link)
        yield k, rng.choice([full(), full(), full() + "#f", None if rng.random() < 0.1 else full()]), rng.choice([f"<html><head>{tag}</head><p>canonical", tag, tag])


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_equal_a_plain_search_and_the_sql(spark, seed):
    pages = list(random_pages(random.Random(seed), 250))
    df = spark.createDataFrame(pages, SCHEMA)
    got = urls.judge(df)
    want = verdicts(pages)
    assert {r.page_id: r.verdict for r in got.collect()} == want and set(want.values()) == {"allow", "block"}
    columns, rows = duck(urls.op2_sql(), {"pages": df.toPandas()})
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, rows)


def test_dots_and_references(spark):
    paths = ["/a/b/../c", "/../a", "/a/.", "/a/..", "/a/./b/", "/..a/b", "/", "/a/../../..", "/a//../b"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(urls.without_dots(F.col("p"))).collect()]
    assert got == [urljoin("http://h/x", p)[8:] for p in paths]
    texts = ["a&amp;b", "&amp;lt;", "&#38;amp;", "&#x41;&#66", "&nbsp;&", "&#0;&#x110000;", "&#233;&#x1F600;", "&&amp;&"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(urls.decoded(F.col("t"))).collect()]
    assert got == ["a&b", "&lt;", "&amp;", "AB", "&nbsp;&", "&#0;&#x110000;", "é😀", "&&&"]
