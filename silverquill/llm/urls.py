"""URL filters with redirect equivalence, in DataFrame functions only.

A url's identity is its scheme and host in lower case, path and query, without fragment (``loose`` identities, an option, also leave
out scheme, ``www.`` and ``m.``, tracking parameters and a closing slash or ``.html``). All canonical links and refresh redirects in
the pages are edges between identities, which 128-bit hashes stand for; their connected components are groups of aliases. A url that a rule fits keeps that rule's verdict. Any other
is blocked if its group holds a url blocked by a rule and none allowed by one (an explicit allow has
precedence), else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, materialize, spread_join, table

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MOST_INLINE = 256
"""Up to so many rules are tried in place on each row; more are joined by host suffix."""
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?</script|<style\b.*?</style|<title\b.*?</title|<textarea\b.*?</textarea"
"""What a browser takes no links from."""
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TARGET = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)"""
NUMBER = r"^#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?"
#: The character references of XML.
NAMED = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'"}
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"
SCHEME, HOST, PATH, QUERY = r"(?s)^(.*?)://", r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^[^?#]*\?([^#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host; empty for null and where there is no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def identity(url: Column, host: Column, path: Column, loose: bool = False) -> Column:
    """What equal urls have in common; null where there is no host and no path."""
    asked = F.regexp_extract(url, QUERY, 1)
    if loose:
        query = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
        short = F.regexp_replace(path, r"(/index\.html?|\.html?|/)$", "")
        same = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), short, F.lit("?"), F.array_join(F.array_sort(query), "&"))
    else:
        same = F.concat(ascii_lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.lit("?"), asked)
    return F.when((host != "") | (path != ""), same)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as (length, rule, verdict); null if none does."""
    every = F.array(*(F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules))
    fits = F.filter(every, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def with_rule(df: DataFrame, host: str, path: str, out: str, rules=RULES) -> DataFrame:
    """Add ``out``, the longest fitting rule. Long rule lists are joined on the suffixes of the distinct hosts."""
    if len(rules) <= MOST_INLINE:
        return df.withColumn(out, best_rule(F.col(host), F.col(path), rules) if rules else F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    listed = df.sparkSession.createDataFrame([(len(h) + len(p), h + p, v, h, p) for v, h, p in rules], "n int, rule string, verdict string, _h string, _p string")
    urls = df.select(F.col(host).alias("_host"), F.col(path).alias("_path")).distinct()
    suffixes = urls.withColumn("_h", F.explode(F.expr("transform(sequence(1, size(split(_host, '[.]'))), i -> substring_index(_host, '.', -i))")))
    best = suffixes.join(listed, "_h").where(F.startswith("_path", "_p")).groupBy("_host", "_path").agg(F.max(F.struct("n", "rule", "verdict")).alias(out))
    return df.join(best, (F.col(host) == F.col("_host")) & (F.col(path) == F.col("_path")), "left").drop("_host", "_path")


def decoded(text: Column) -> Column:
    """``text`` with its numeric character references and ``NAMED`` ones decoded, once."""

    def one(piece: Column) -> Column:
        hexed, number = F.regexp_extract(piece, NUMBER, 1), F.regexp_extract(piece, NUMBER, 2)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).otherwise(number.cast("long"))
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(piece.rlike(NUMBER) & code.between(1, 0x10FFFF), F.concat(sign, F.regexp_replace(piece, NUMBER, "")))
        for name, value in NAMED.items():
            out = out.when(piece.startswith(name), F.concat(F.lit(value), F.substring(piece, len(name) + 1, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), "")))


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1).isin(".", "..")
    every = F.concat(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.aggregate(every, F.array().cast("array<string>"), step), "/"))).otherwise(path)


def resolved(link: Column, url: Column, host: Column, path: Column) -> Column:
    """``link`` of a page (url, host, path) as an absolute url (RFC 3986, 5.2.2); null for schemes without a host."""
    scheme = F.regexp_extract(url, SCHEME, 1)
    base = F.concat(scheme, F.lit("://"), host)
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(path.contains("/"), F.lit("")).otherwise(F.lit("/")))

    def absolute(full: Column) -> Column:
        at = F.regexp_extract(full, PATH, 1)
        return F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), without_dots(at), F.regexp_extract(full, r"(?s)^[^?#]*(.*)$", 1))

    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), absolute(link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), absolute(F.concat(scheme, F.lit(":"), link)))
        .when(link.startswith("#"), F.concat(base, path, F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1), link))
        .when(own == "", F.concat(base, path, link))
        .when(link.startswith("/"), F.concat(base, without_dots(own), rest))
        .otherwise(F.concat(base, without_dots(F.concat(folder, own)), rest))
    )


def link_targets(url: Column, host: Column, path: Column, html: Column) -> Column:
    """The absolute urls that the page names as its canonical form or redirects to, each once; empty if it names none.

    Attributes may stand in any order and quoting; comments and scripts name nothing; character references are decoded; relative
    references are resolved against the page's url.
    """

    def attribute(tag: Column, name: str) -> Column:
        names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), ascii_lower)
        value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), (F.array_position(names, name) - 1).cast("int"))
        return F.when(F.array_contains(names, name), decoded(F.regexp_replace(value, r"""^["']|["']$""", ""))).otherwise("")

    def target(tag: Column) -> Column:
        canonical = F.array_contains(F.split(ascii_lower(attribute(tag, "rel")), r"[ \t\n\f\r]+"), "canonical")
        refresh = F.trim(ascii_lower(attribute(tag, "http-equiv"))) == "refresh"
        link = F.when(tag.rlike("(?i)^<link") & canonical, attribute(tag, "href")).when(tag.rlike("(?i)^<meta") & refresh, F.regexp_extract(attribute(tag, "content"), TARGET, 1)).otherwise("")
        return F.regexp_replace(link, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")

    tags = F.filter(F.regexp_extract_all(F.regexp_replace(html, UNSEEN, ""), F.lit(TAGS), F.lit(0)), lambda t: t.rlike("(?i)canonical|refresh"))
    links = F.filter(F.transform(tags, target), lambda x: x != "")
    found = F.array_distinct(F.filter(F.transform(links, lambda x: resolved(x, url, host, path)), lambda x: x.isNotNull()))
    return F.when(html.rlike("(?i)canonical|http-equiv"), found).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules=RULES, loose: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    Null urls and urls without ``://`` have an empty host and path, no aliases, and are judged alone
    (allow). Null html names no links; repeated rows are judged each; an empty table gives an empty one. Groups are
    found by distributed star contraction; a group's verdict is two partial maxima, and the join of its one row with its
    members cuts a large group among tasks (``spread_join``).
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("_tos", link_targets(F.col("url"), F.col("host"), F.col("path"), F.coalesce("html", F.lit("")))).drop("html")
    rows = rows.withColumn("_key", F.when((F.col("host") != "") | (F.col("path") != ""), F.md5(identity(F.col("url"), F.col("host"), F.col("path"), loose))))
    rows = materialize(with_rule(rows, "host", "path", "_own", rules).select("page_id", "host", "path", F.col("_own.rule").alias("rule"), F.col("_own.verdict").alias("_verdict"), "_key", "_tos"), "pages")

    named = rows.select("_key", F.explode("_tos").alias("_to")).distinct().withColumns({"_thost": host_of(F.col("_to")), "_tpath": path_of(F.col("_to"))})
    named = named.withColumn("_tkey", F.when((F.col("_thost") != "") | (F.col("_tpath") != ""), F.md5(identity(F.col("_to"), F.col("_thost"), F.col("_tpath"), loose))))
    named = materialize(with_rule(named, "_thost", "_tpath", "_other", rules).select("_key", "_tkey", F.col("_other.verdict").alias("_tverdict")), "links")
    linked = components(named.where("_key <> _tkey").select(F.col("_key").alias("a"), F.col("_tkey").alias("b")), "aliases")
    said = rows.where("_verdict is not null and _key is not null").select("_key", "_verdict").unionByName(named.where("_tverdict is not null and _tkey is not null").select(F.col("_tkey").alias("_key"), F.col("_tverdict").alias("_verdict"))).distinct().withColumn("_salt", F.lit(0))
    linked = materialize(linked.select(F.col("node").alias("_key"), "component"), "groups")
    grouped = lambda df: spread_join(df, linked, ["_key"], ["_salt"], "left").withColumn("_group", F.coalesce("component", "_key")).drop("component")
    groups = grouped(said).groupBy("_group").agg(F.max(F.col("_verdict") == "block").alias("_blocked"), F.max(F.col("_verdict") == "allow").alias("_allowed"))
    groups = groups.where("_blocked and not _allowed").select(F.col("_group").alias("_g"))
    open_ = rows.where("rule is null").withColumn("_salt", F.col("page_id"))
    placed = materialize(grouped(open_), "placed")
    judged = spread_join(placed, groups.select(F.col("_g").alias("_group"), F.lit(True).alias("_bad")), ["_group"], ["page_id"], "left").withColumn("verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return rows.where("rule is not null").withColumn("verdict", F.col("_verdict")).select(columns).unionByName(judged.select(columns))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op2_sql(loose: bool = False) -> str:
    """The same by a recursive search over the links."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    near = lambda u, h, p: f"""concat(regexp_replace({h}, '^(www|m)\\.', ''), regexp_replace({p}, '(/index\\.html?|\\.html?|/)$', ''), '?',
        array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, {q(QUERY)}, 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, {q(TRACKING)}))), '&'))"""  # noqa: E731
    same = lambda u, h, p: f"concat({low(f'regexp_extract({u}, {q(SCHEME)}, 1)')}, '://', {h}, CASE WHEN {p} = '' THEN '/' ELSE {p} END, '?', regexp_extract({u}, {q(QUERY)}, 1))"
    attr = lambda name: f"coalesce(vals[list_position(names, '{name}')], '')"
    code = "CASE WHEN regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6})', 1) <> '' THEN ('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6})', 1))::INT ELSE try_cast(regexp_extract(p, '^#([0-9]{1,7})', 1) AS INT) END"
    cases = " ".join(f"WHEN starts_with(p, '{n}') THEN concat({q(v)}, p[{len(n) + 1}:])" for n, v in NAMED.items())
    plain = lambda x: f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: CASE {cases} WHEN ({code}) BETWEEN 1 AND 1114111 THEN concat(chr({code}), regexp_replace(p, {q(NUMBER)}, '')) ELSE concat('&', p) END), ''))"
    key = lambda u, h, p: f"CASE WHEN {h} <> '' OR {p} <> '' THEN {(near if loose else same)(u, h, p)} END"
    return rf"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
a AS (SELECT *, {low(f"regexp_extract(url, {q(HOST)}, 1)")} AS host, regexp_extract(url, {q(PATH)}, 1) AS path FROM base),
tags AS (SELECT *, unnest(regexp_extract_all(regexp_replace(html, {q(UNSEEN)}, '', 'g'), {q(TAGS)})) AS tag FROM a WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
attrs AS (SELECT *, list_transform(regexp_extract_all(tag, {q(ATTRIBUTE)}, 1), lambda x: {low('x')}) AS names, list_transform(regexp_extract_all(tag, {q(ATTRIBUTE)}, 2), lambda x: {plain("regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')")}) AS vals FROM tags),
n AS (SELECT DISTINCT rid, page_id, url, host, path, trim(CASE WHEN {low('tag[2:5]')} = 'link' AND list_contains(string_split_regex({low(attr('rel'))}, '\s+'), 'canonical') THEN {attr('href')}
    WHEN {low('tag[2:5]')} = 'meta' AND trim({low(attr('http-equiv'))}) = 'refresh' THEN regexp_extract({attr('content')}, {q(TARGET)}, 1) END, E' \t\n\f\r') AS link FROM attrs),
b AS (SELECT *, regexp_extract(url, {q(SCHEME)}, 1) AS scheme, concat(regexp_extract(url, {q(SCHEME)}, 1), '://', host) AS root, concat(regexp_replace(path, '[^/]*$', ''), CASE WHEN contains(path, '/') THEN '' ELSE '/' END) AS dir,
    regexp_extract(link, '^[^?#]*') AS lpath FROM n WHERE link <> ''),
c AS (SELECT *, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN concat(scheme, ':', link)
    WHEN starts_with(link, '#') THEN concat(root, path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), link) WHEN lpath = '' THEN concat(root, path, link) WHEN starts_with(link, '/') THEN concat(root, link) ELSE concat(root, dir, link) END AS joined FROM b),
c2 AS (SELECT *, regexp_extract(joined, '^(.*?://[^/?#]*)', 1) AS front, regexp_extract(joined, {q(PATH)}, 1) AS raw, regexp_extract(joined, '^[^?#]*(.*)$', 1) AS back FROM c WHERE joined IS NOT NULL),
c3 AS (SELECT *, string_split(raw, '/')[2:] AS segs FROM c2),
c4 AS (SELECT *, concat(front, CASE WHEN lpath = '' OR NOT regexp_matches(raw, '/\.\.?(/|$)') THEN raw ELSE concat('/', array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_concat(segs, CASE WHEN segs[-1] IN ('.', '..') THEN [''] ELSE [] END), lambda s: [s])),
    lambda k, s: CASE WHEN s[1] = '.' THEN k WHEN s[1] = '..' THEN k[:greatest(len(k) - 1, 0)] ELSE list_concat(k, s) END), '/')) END, back) AS target FROM c3),
d AS (SELECT *, {low(f"regexp_extract(target, {q(HOST)}, 1)")} AS thost, regexp_extract(target, {q(PATH)}, 1) AS tpath FROM c4),
e AS (SELECT *, {key('url', 'host', 'path')} AS k, {key("target", 'thost', 'tpath')} AS tk FROM d),
rules(v, h, p) AS (VALUES {rules}),
g AS (SELECT e.*, (SELECT arg_max((concat(h, p), v), length(h) + length(p)) FROM rules WHERE (thost = h OR ends_with(thost, concat('.', h))) AND starts_with(tpath, p)) AS other FROM e),
f AS (SELECT a.*, {key('url', 'host', 'path')} AS k, (SELECT arg_max((concat(h, p), v), length(h) + length(p)) FROM rules WHERE (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p)) AS own FROM a),
edges AS (SELECT k AS x, tk AS y FROM e WHERE k <> tk UNION SELECT tk, k FROM e WHERE k <> tk),
reach(x, y) AS (SELECT x, x FROM edges UNION SELECT r.x, g.y FROM reach r JOIN edges g ON r.y = g.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
said AS (SELECT k, own[2] AS v FROM f WHERE own IS NOT NULL AND k IS NOT NULL UNION SELECT tk, other[2] FROM g WHERE other IS NOT NULL AND tk IS NOT NULL),
bad AS (SELECT coalesce(c, k) AS g FROM said LEFT JOIN comp ON k = x GROUP BY 1 HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow'))
SELECT page_id, host, path, own[1] AS rule, CASE WHEN own IS NOT NULL THEN own[2] WHEN coalesce(c, k) IN (SELECT g FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN comp ON k = x
"""
