"""Pages as trees of blocks, and templates of trees by simple tree matching (plain Python, used inside tasks).

A page becomes a tree of block elements; inline markup melts into the text of its block. A shape is such a tree with runs of
paragraphs, list items or rows as one node each, which knows the hashes of their texts. Two shapes are aligned by simple tree matching: the
heaviest order-keeping pairing of children with equal keys, level by level. Their template keeps the nodes that match and the
texts that both have; what is left after all pages of a host is constant, everything else varies.
"""

from __future__ import annotations

import json
import re
import zlib
from hashlib import blake2b
from html import unescape

DEEPEST = 100
"""Blocks nested deeper are children of the last block above."""
MOST_CELLS = 20_000
"""Child lists with a larger product are paired in order, key by key, without weighing."""
ENOUGH = 10
"""Distinct pages that must agree before a text counts as constant."""

#: Elements of HTML by their handling, and the words of class names that say what a block is for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
UNSEEN = set("noscript template iframe svg canvas object select button audio video map head datalist meter progress".split())
BLOCKS = set("address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FRAMES = set("article aside center details dialog dir div dl fieldset footer form header hgroup main menu nav ol search section table tbody td tfoot th thead tr ul".split())
IN_HEAD = set("title meta link style script base noscript template".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
HELD_BY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
TAG_ROLES = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "search": "form", "dialog": "notice"}
ARIA_ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice"}
ROLE_WORDS = {
    "menu": "nav navbar navigation menu menubar menus breadcrumb breadcrumbs pagination pager toolbar skip toc",
    "head": "header masthead topbar banner",
    "foot": "footer colophon copyright",
    "side": "sidebar aside related recommended recommendations trending widget widgets",
    "notice": "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription paywall",
    "ad": "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promotion promoted",
    "form": "login signup signin searchbox searchform",
    "share": "share sharing social",
    "comments": "comment comments commentlist disqus respond replies discussion",
}
ROLE_OF = {w: role for role, words in ROLE_WORDS.items() for w in words.split()}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-hidden|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KNOWN: dict[tuple[str, str], tuple[str, str, bool]] = {}


class Node:
    """A block: ``text`` for text (without children), else children; ``links`` is the number of its characters inside links."""

    __slots__ = ("key", "tag", "role", "main", "text", "links", "kids")

    def __init__(self, tag: str, key: str = "", role: str = "", main: bool = False, text: str = "", links: int = 0) -> None:
        self.tag, self.key, self.role, self.main, self.text, self.links, self.kids = tag, key or tag, role, main, text, links, []


def described(tag: str, attrs: str) -> tuple[str, str, bool]:
    """(key, role, main): what names the block, the role that takes it out of the text (if any), and whether it says it is the main part."""
    if (tag, attrs) in _KNOWN:
        return _KNOWN[tag, attrs]
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)} if attrs else {}
    names = [w for w in f"{found.get('id', '')} {found.get('class', '')}".split() if not any(c.isdigit() for c in w)]
    words = [w.lower() for w in _WORDS.findall(f"{found.get('id', '')} {found.get('class', '')}")]
    aria = found.get("role", "").lower()
    main = tag in ("article", "main") or aria in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    role = TAG_ROLES.get(tag) or ARIA_ROLES.get(aria) or next((ROLE_OF[w] for w in words if w in ROLE_OF), "")
    if tag in ("table", "tbody", "tr", "main") or (tag == "article" and role != "comments"):
        role = ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDES.search(found.get("style", "")):
        role = "hidden"
    if len(_KNOWN) > 20_000:
        _KNOWN.clear()
    _KNOWN[tag, attrs] = answer = (".".join([tag, *sorted(set(names))]), role, main and not role)
    return answer


def parse(html: str) -> Node:
    """The tree of ``html``; anything is a page, broken markup too."""
    root = Node("root")
    stack, deep, unseen, under = [root], 0, [], 0  # unseen: open elements whose content isn't shown; under: blocks open in them
    parts: list[str] = []
    links, link_depth = 0, 0  # link_depth: depth of the open link, 0 if there is none
    at, n, quoted = 0, len(html), True

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                stack[-1].kids.append(Node("#", text=text, links=min(links, len(text))))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal link_depth
        flush()
        del stack[depth:]
        if link_depth > depth:
            link_depth = 0

    def say(raw: str) -> None:
        nonlocal links
        if unseen:
            if unseen[-1] != "head" or not raw.strip():
                return
            unseen.clear()
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_depth:
            links += len(text.strip())

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4 if not html.startswith("<!-->", lt) else lt + 2)
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) if quoted else None
        if m is None:
            m = _PLAIN_TAG.match(html, lt)
            if m is not None and quoted and _TAG.match(html, lt) is None:
                quoted = False  # a quote that nothing closes: from here on tags end at the next >
        if m is None:
            if not re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):
                say("<")
                at = lt + 1
                continue
            break  # a tag that the page's end cuts
        at = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if unseen and unseen[-1] == "head" and name not in IN_HEAD and name != "head":
            unseen.clear()
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                at = n if end is None else end.start()
            continue
        if name in UNSEEN:
            if not closing and not attrs.endswith("/"):
                under = under if unseen else 0
                unseen.append(name)
            elif closing and name in unseen:
                while unseen.pop() != name:
                    pass
            continue
        if name in BLOCKS:
            if unseen:
                if not closing or under:
                    under += -1 if closing else 1
                    continue
                if not any(b.tag == name for b in stack):
                    continue
                unseen.clear()  # the block around ends what nothing closed
            if closing:
                if deep:
                    deep -= 1
                    flush()
                    continue
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name), 0)
                if depth:
                    close(depth)
                else:
                    flush()
                continue
            flush()
            if name not in ("td", "th", "caption"):
                for k in range(len(stack) - 1, 0, -1):  # a block ends the paragraph around it
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in FRAMES:
                        break
            if name in ENDED_BY:
                ends, stop = ENDED_BY[name], HELD_BY.get(name, {"table"})
                depth = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stop:
                        break
                    if stack[k].tag in ends:
                        depth = k
                if depth:
                    close(depth)
            if len(stack) > DEEPEST:
                deep += 1
                continue
            key, role, main = described(name, attrs)
            node = Node(name, key, role, main)
            stack[-1].kids.append(node)
            stack.append(node)
        elif name == "br":
            if not unseen:
                parts.append(" ")
        elif name in ("hr", "body", "html"):
            if not unseen:
                flush()
        elif name == "a" and not unseen:
            link_depth = 0 if closing else len(stack)
    flush()
    settle(root)
    return root


def settle(root: Node) -> None:
    """Take back roles that can't be meant: of a block around all main parts, or one and most of the text; of a notice, form or side around the page's heading and
    most of its text; of a header inside the main part."""
    seen: dict[int, tuple[int, int, bool]] = {}  # characters, main parts, whether it holds a heading

    def look(x: Node) -> tuple[int, int, bool]:
        size, mains, heading = len(x.text), int(x.main), x.tag == "h1"
        for kid in x.kids:
            s, m, h = look(kid)
            size, mains, heading = size + s, mains + m, heading or h
        seen[id(x)] = size, mains, heading
        return size, mains, heading

    total, every, _ = look(root)

    def mend(x: Node, inside: bool) -> None:
        if x.role and x.role not in ("hidden", "comments") and x.tag != "nav":
            size, mains, heading = seen[id(x)]
            most = 2 * size > total
            if (mains and (mains == every or most)) or (heading and most and x.role not in ("menu", "head", "foot")) or (inside and x.role == "head"):
                x.role = ""
        for kid in x.kids:
            mend(kid, inside or x.main)

    mend(root, False)


def texts_of(node: Node) -> list[str]:
    """All texts of a block, in order."""
    return [node.text] if node.tag == "#" else [t for kid in node.kids for t in texts_of(kid)]


def mark(node: Node) -> str:
    return blake2b("\n".join(texts_of(node)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Shape:
    """A node of a page or a template. ``texts``: hash and length of the run's texts (in a template: those that all pages have); ``mass`` and
    ``links``: characters, over all pages; ``members``: the page's blocks."""

    __slots__ = ("key", "role", "main", "texts", "mass", "links", "kids", "members")

    def __init__(self, key: str, role: str, main: bool, texts: dict[str, int], mass: int, links: int, kids: list[Shape], members: list[Node] | None = None) -> None:
        self.key, self.role, self.main, self.texts, self.mass, self.links, self.kids, self.members = key, role, main, texts, mass, links, kids, members or []

    def packed(self) -> list:
        return [self.key, self.role, int(self.main), self.texts, self.mass, self.links, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Shape:
        return Shape(x[0], x[1], bool(x[2]), x[3], x[4], x[5], [Shape.unpacked(k) for k in x[6]])


def shape(node: Node) -> Shape:
    """The shape of a page. Blocks without frames inside are leaves, and neighbours of one key are one run."""

    def framed(x: Node) -> bool:
        return x.tag in FRAMES or any(framed(k) for k in x.kids)

    kids: list[Shape] = []
    last = None
    for kid in node.kids:
        if framed(kid) and not kid.role:
            kids.append(shape(kid))
            last = None
            continue
        size, linked = _sizes(kid)
        texts = {} if kid.role else {mark(kid): size}
        if last is not None and (last.key, last.role) == (kid.key, kid.role):
            last.texts |= texts
            last.mass, last.links = last.mass + size, last.links + linked
            last.members.append(kid)
        else:
            last = Shape(kid.key, kid.role, kid.main, texts, size, linked, [], [kid])
            kids.append(last)
    return Shape(node.key, node.role, node.main, {}, sum(k.mass for k in kids), sum(k.links for k in kids), kids, [node])


def _sizes(node: Node) -> tuple[int, int]:
    size, linked = len(node.text), node.links
    for kid in node.kids:
        s, k = _sizes(kid)
        size, linked = size + s, linked + k
    return size, linked


def aligned(a: Shape, b: Shape, memo: dict | None = None) -> tuple[int, list[tuple[Shape, Shape]]]:
    """(weight, pairs of children) of the best alignment of two shapes with equal keys: matched nodes count one each."""
    memo = {} if memo is None else memo
    found = memo.get((id(a), id(b)))
    if found is not None:
        return found
    x, y = a.kids, b.kids
    if [k.key for k in x] == [k.key for k in y]:
        pairs = list(zip(x, y, strict=True))
    elif len(x) * len(y) > MOST_CELLS:
        pairs, j = [], 0
        where: dict[str, list[int]] = {}
        for i, k in enumerate(y):
            where.setdefault(k.key, []).append(i)
        for k in x:
            i = next((i for i in where.get(k.key, ()) if i >= j), None)
            if i is not None:
                pairs.append((k, y[i]))
                j = i + 1
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            above, row = best[i], best[i + 1]
            for j, q in enumerate(y):
                w = above[j] + aligned(p, q, memo)[0] if p.key == q.key else 0
                row[j + 1] = max(w, above[j + 1], row[j])
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
        pairs.reverse()
    found = memo[id(a), id(b)] = (1 + sum(aligned(p, q, memo)[0] for p, q in pairs), pairs)
    return found


def merged(a: Shape, b: Shape, memo: dict | None = None) -> Shape:
    memo = {} if memo is None else memo
    kids = [merged(p, q, memo) for p, q in aligned(a, b, memo)[1]]
    return Shape(a.key, a.role if a.role == b.role else "", a.main and b.main, {h: n for h, n in a.texts.items() if h in b.texts}, a.mass + b.mass, a.links + b.links, kids)


class Template:
    """What ``pages`` pages have in common; ``seen`` are the hashes of up to ``ENOUGH`` distinct ones."""

    __slots__ = ("pages", "seen", "top")

    def __init__(self, pages: int, seen: frozenset[str], top: Shape) -> None:
        self.pages, self.seen, self.top = pages, seen, top

    @staticmethod
    def of(page: Node, top: Shape) -> Template:
        return Template(1, frozenset([mark(page)]), top)

    def plus(self, other: Template) -> Template:
        return Template(self.pages + other.pages, frozenset(sorted(self.seen | other.seen)[:ENOUGH]), merged(self.top, other.top))

    def text(self) -> str:
        return json.dumps([self.pages, sorted(self.seen), self.top.packed()], separators=(",", ":"))

    @staticmethod
    def read(text: str) -> Template:
        pages, seen, top = json.loads(text)
        return Template(pages, frozenset(seen), Shape.unpacked(top))


def layout_of(page: Node, kinds: int) -> int:
    """Pages with the same blocks on the first two levels have the same number, below ``kinds``."""
    names = {f"{k.key}/{x.key}" for k in page.kids for x in k.kids if x.tag in FRAMES} | {k.key for k in page.kids if k.tag in FRAMES}
    return zlib.crc32("\n".join(sorted(names)).encode("utf-8", "surrogatepass")) % kinds


def varying(top: Shape, pages: int, sure: bool) -> dict[int, float]:
    """For each node the characters outside links that vary (``sure``: texts of all pages count as constant); 0 for nodes with a role."""
    found: dict[int, float] = {}

    def look(x: Shape) -> float:
        if x.role:
            found[id(x)] = 0.0
            return 0.0
        kept = sum(look(k) for k in x.kids)
        inside = sum(k.mass - k.links for k in x.kids)
        own = max(0, x.mass - x.links - inside) - (pages * sum(x.texts.values()) if sure else 0)
        found[id(x)] = kept + max(0.0, own)
        return found[id(x)]

    look(top)
    return found


def main_part(top: Shape, pages: int = 1, sure: bool = False) -> Shape:
    """The node that holds the article: one that says so and holds enough of the varying text, else down from the top while one
    frame holds most of it and no heading stands beside."""
    mass = varying(top, pages, sure)
    whole = mass[id(top)]
    named: list[Shape] = []

    def look(x: Shape) -> None:
        if x.role:
            return
        if x.main:
            named.append(x)
        for k in x.kids:
            look(k)

    look(top)
    if named:
        best = max(named, key=lambda x: mass[id(x)])
        inner = [x for x in named if x.key.startswith("article") and mass[id(x)] >= 0.6 * mass[id(best)]]
        if mass[id(best)] >= 0.3 * whole:
            return max(inner, key=lambda x: mass[id(x)]) if inner else best
    now = top
    while True:
        frames = [k for k in now.kids if not k.role and k.key.split(".")[0] in FRAMES - {"ul", "ol", "dl"}]
        best = max(frames, key=lambda k: mass[id(k)], default=None)
        if best is None or mass[id(best)] < 0.6 * mass[id(now)] or any(k.key.split(".")[0] in ("h1", "h2") and mass[id(k)] for k in now.kids):
            return now
        now = best


def extract(page: Node, top: Shape, template: Template | None) -> str:
    """The text of the page's article: its blocks joined by an empty line, without roles and without what is constant in ``template``."""
    dropped: set[int] = set()
    part = None
    if template is not None and template.pages > 1:
        sure = len(template.seen) >= ENOUGH
        wanted, memo = main_part(template.top, template.pages, sure), {}
        todo = [(template.top, top)]
        while todo:
            t, own = todo.pop()
            if t is wanted:
                part = own
            if sure and t.texts:
                dropped |= {id(m) for m in own.members if mark(m) in t.texts}
            todo += aligned(t, own, memo)[1]
    part = part or main_part(top)
    body = part.members[0] if part.members else page

    def blocks(x: Node, skip: set[int]) -> list[str]:
        if id(x) in skip or (x.role and x is not body):
            return []
        return [x.text] if x.tag == "#" else [t for k in x.kids for t in blocks(k, skip)]

    return "\n\n".join(blocks(body, dropped) or blocks(body, set()))
