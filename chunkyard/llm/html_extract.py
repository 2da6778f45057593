"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks. A logistic classifier over features of a block (what its elements and their names
say, share of links, length, sentence ends, depth) gives the odds that it is content; the costs of either label are its
terminal capacities. Blocks next to one another and blocks of one parent are tied by smoothness edges of the same
order. The minimum cut, found by maximum flow, labels the blocks. The classifier is fitted on generated layouts,
see training_pages().
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import arrow_map
from chunkyard.llm.quality import logistic

#: Elements by what they mean for a text.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript iframe svg template textarea title xmp noembed noframes canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same list.
SIBLINGS = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}, {"thead", "tbody", "tfoot"})
NOT_CONTENT = frozenset("nav footer aside form button select fieldset menu head dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of class and id names in groups; each group is a feature whose weight is learned.
GROUPS = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion",
    "notice": "cookie cookies consent gdpr notice notices alert alerts banner modal popup paywall newsletter subscribe subscription signup disclaimer",
    "menu": "menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar topbar skip tabs",
    "frame": "footer header masthead login search copyright",
    "side": "sidebar sidebars aside widget widgets",
    "related": "related recommended recommendations more trending popular share sharing social follow tags",
    "remark": "comment comments reply replies remark remarks disqus respond",
    "good": "article articlebody content entry maincontent post story text body main",
}
#: Words that add nothing to a name: `ad-box` says no less than `ad`.
FILLER = frozenset("area bar block box container col column inner item outer panel section slot unit wrap wrapper the site page global top bottom left right".split())
REMARKS = frozenset(GROUPS["remark"].split())
REMARK_STARTS = ("comment", "disqus", "reply", "replies", "remark")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_GROUP = {w: k for k, (_, words) in enumerate(GROUPS.items()) for w in words.split()}
_GOOD = list(GROUPS).index("good")

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = re.compile(r"[.!?…。]")


@dataclass
class Element:
    name: str
    parent: Element | None
    hidden: bool = False
    bad: bool = False  # the element itself says: boilerplate
    main: bool = False  # article or main
    names: tuple[float, ...] = ()  # by group: 1 if a class or id is just such a name, 0.5 if a part of it
    holds_main: bool = False


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    length: int = 0
    text: str = ""


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(source)} if source.strip("/ \t\r\n\f") else {}


@lru_cache(10_000)
def _names(value: str) -> tuple[float, ...]:
    """What class and id names say, by group."""
    out = [0.0] * len(GROUPS)
    for name in value.split():
        parts = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w]
        told = [w for w in parts if w not in FILLER]
        for w in told:
            if (k := _GROUP.get(w)) is not None:
                whole = k == _GOOD or all(x in _GROUP for x in told)
                out[k] = max(out[k], 1.0 if whole else 0.5)
    return tuple(out)


def _element(name: str, source: str, parent: Element | None) -> Element:
    e = Element(name, parent)
    a = _attributes(source)
    role = a.get("role", "").lower()
    e.hidden = (parent is not None and parent.hidden) or name == "head" or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
    e.bad = name in NOT_CONTENT or role in BAD_ROLES
    e.main = name in ("article", "main") or role == "main" or a.get("itemprop") == "articleBody"
    if name not in ("html", "body"):
        named = f"{a.get('class', '')} {a.get('id', '')}"
        words = {w for w in _SPLIT.split(_CAMEL.sub(" ", named).lower()) if w}
        # Readers' comments are comments wherever they are, even in articles of their own.
        if words.isdisjoint(("post", "entry")) and (not words.isdisjoint(REMARKS) if e.main else any(n.startswith(REMARK_STARTS) for n in words)):
            e.bad, e.main = True, False
        e.names = _names(named)
    return e


def blocks_of(source: str) -> list[Block]:
    """The page's text blocks in order, with the elements that hold them. Any input gives blocks; what
    isn't closed ends with what holds it, and ends without a beginning are ignored."""
    top = Element("html", None)
    stack, out = [top], []
    block: Block | None = None
    links = at = 0
    size = len(source)

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            block = Block(stack[-1])
            out.append(block)
        block.parts.append(raw)
        if links:
            block.linked += len(raw)

    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        close, name = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            block = None
        if close:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK or name in RAW:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            if not (attributes or "").endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            continue
        if name == "a":
            links += 1
        if name in VOID or name not in BLOCK:
            continue
        if name == "p" or name in BLOCK - {"br", "p"}:  # a block ends an open paragraph
            if stack[-1].name == "p":
                stack.pop()
        for group in SIBLINGS:
            if name in group:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in group:
                        del stack[i:]
                        break
                    if stack[i].name in ("ul", "ol", "dl", "table", "select", "menu", "dir"):
                        break
        e = _element(name, attributes or "", stack[-1])
        if e.main:
            up = e.parent
            while up is not None and not up.holds_main:
                up.holds_main = True
                up = up.parent
        stack.append(e)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        b.length = sum(map(len, b.parts))
    return [b for b in out if b.text and not b.parent.hidden]


#: Names of the features, in order.
FEATURES = ("one", "inside", "outside", "boilerplate elements", "header", *GROUPS, "links", "length", "sentences", "heading", "sign", "few words", "depth", "item")


def features(block: Block, has_main: bool) -> list[float]:
    """A block's features; names of elements that hold the whole article don't count."""
    e, inside, bad, header, heading, item, depth = block.parent, False, 0, False, False, False, 0
    names = [0.0] * len(GROUPS)
    while e is not None:
        heading |= e.name in HEADINGS
        item |= e.name == "li"
        depth += 1
        bad += e.bad
        # A header with the article's own heading belongs to it.
        header |= e.name == "header" and not (heading and _within_main(e))
        inside |= e.main
        if e.names and any(e.names) and not e.main and not (e.holds_main and e.name not in ("section", "ul", "ol")):
            names = [max(x, y) for x, y in zip(names, e.names, strict=True)]
        e = e.parent
    words = block.text.count(" ") + 1
    links = block.linked / max(1, block.length)
    sentences = min(4, len(_ENDS.findall(block.text)))
    return [
        1.0, inside, has_main and not inside, min(2, bad), header, *names, links, min(5.0, math.log(words)), sentences / 2, heading and words > 1,
        block.text[0] in "©®" or block.text[:3] == "(c)", words < 4, min(20, depth) / 10, item,
    ]


def _within_main(e: Element) -> bool:
    up = e.parent
    while up is not None:
        if up.main:
            return True
        up = up.parent
    return False


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (of several, the smallest source side).

    Dinic's algorithm; what a node can pass from source to sink directly goes first.
    """
    n = len(source)
    s, t = n, n + 1
    to, cap, graph = [], [], [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        to.append(b)
        cap.append(there)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, (a, b) in enumerate(zip(source, sink, strict=True)):
        if a > b:
            link(s, i, a - b, 0)
        elif b > a:
            link(i, t, b - a, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for k in graph[x]:
                if cap[k] and level[to[k]] < 0:
                    level[to[k]] = level[x] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                first = next(i for i, k in enumerate(path) if not cap[k])
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while used[x] < len(graph[x]):
                k = graph[x][used[x]]
                if cap[k] and level[to[k]] == level[x] + 1:
                    break
                used[x] += 1
            if used[x] < len(graph[x]):
                path.append(graph[x][used[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                used[x] += 1
            else:
                break


#: Smoothness between blocks in succession, and more if they share their parent element's parent or parent; in
#: hundredths of a logit, like the terminal capacities.
NEXT, SAME_PARENT, SAME_GRANDPARENT = 20, 150, 120
#: Layouts that the classifier is fitted on, and its ridge.
LAYOUTS, RIDGE = 500, 0.1
_MARK = "\u2713"  # begins the content blocks of a generated layout


def training_pages(count: int = LAYOUTS, seed: int = 1) -> list[str]:
    """Generated layouts whose content blocks begin with a mark: with and without articles, with named or nameless
    containers, lists, short paragraphs, menus, notices, adverts (some within the text), related links, comments. Content
    now and then bears names that mostly mark boilerplate."""
    r = random.Random(seed)

    def words(low: int, high: int, stop: bool = True) -> str:
        n = r.randint(low, high)
        out = [r.choice("the a of we it river stone paper light green seven walks under story keeps hand".split()) for _ in range(n)]
        for k in range(r.randint(5, 14), n, r.randint(6, 14)):
            out[k - 1] += r.choice(",.")
        return " ".join(out).capitalize() + (r.choice(".....!?") if stop else "")

    link = lambda text: f'<a href="x">{text}</a>'
    linked = lambda low, high: "".join(f"<li>{link(words(1, 4, False))}</li>" for _ in range(r.randint(low, high)))
    named = lambda kind, k=1.0: f' {r.choice(("class", "class", "id"))}="{_name(r, kind)}"' if r.random() < k else ""

    def nested(text: str) -> str:
        n = r.randint(0, 3)
        return "<div>" * n + text + "</div>" * n

    def content(own: bool) -> str:
        out = [f"<h1>{_MARK}{words(2, 9, False)}</h1>"] if r.random() < 0.8 else []
        if out and own and r.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.randint(2, 9)):
            odd = named(r.choice(("related", "notice", "menu", "side", "frame")), 0.12) if r.random() < 0.5 else ""
            x = r.random()
            if x < 0.48:
                out.append(f"<p{odd}>{_MARK}{words(8, 70)}</p>")
            elif x < 0.57:
                out.append(f"<p{odd}>{_MARK}{words(1, 4, r.random() < 0.6)}</p>")
            elif x < 0.63:
                out.append(f"<h2>{_MARK}{words(1, 6, False)}</h2>")
            elif x < 0.73:
                out.append(f"<ul{odd}>" + "".join(f"<li>{_MARK if r.random() < 0.8 else link(_MARK + words(1, 5, False)) + '</li><li>' + _MARK}{words(2, 16, r.random() < 0.5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.8:
                out.append(f"<p>{_MARK}{words(1, 20, r.random() < 0.5)} {link(words(1, 8, False))} {words(1, 12)}</p>")
            elif x < 0.84:
                out.append(f"<div{odd}><p>{_MARK}{words(5, 40)}</p><p>{_MARK}{words(5, 40)}</p></div>")
            elif x < 0.92:
                out.append(f"<div{named('advert')}>{words(2, 12)}</div>")
            else:
                out.append(r.choice((f"<aside>{words(3, 20)}</aside>", f"<form><label>{words(1, 3, False)}</label><button>{words(1, 2, False)}</button></form>", f"<div{named('related')}><ul>{linked(2, 5)}</ul></div>")))
        return "".join(out)

    def boilerplate() -> str:
        x = r.random()
        if x < 0.25:
            return f"<{(t := r.choice(('nav', 'div', 'div', 'menu')))}{named('menu', 0.7)}><ul>{linked(3, 9)}</ul></{t}>"
        if x < 0.4:
            return f"<div{named('advert', 0.9)}>{words(2, 14)}</div>"
        if x < 0.52:
            return f"<div{named('notice', 0.9)}>{words(4, 30)} {link(words(1, 3, False))}</div>"
        if x < 0.64:
            return f"<{(t := r.choice(('aside', 'div')))}{named('side', 0.8)}><h3>{words(1, 3, False)}</h3><p>{words(3, 25)}</p><ul>{linked(1, 5)}</ul></{t}>"
        if x < 0.76:
            return f"<div{named('related', 0.8)}><h3>{words(1, 3, False)}</h3><ul>{linked(2, 6)}</ul></div>"
        if x < 0.86:
            return "<section{}><h2>{}</h2>{}</section>".format(named("remark"), words(1, 2, False), "".join(f"<{t}{named('remark')}><p>{words(3, 40)}</p></{t}>" for t in [r.choice(("article", "div"))] * r.randint(1, 4)))
        if x < 0.94:
            return f"<form{named('frame', 0.3)}><label>{words(1, 3, False)}</label><input><button>{words(1, 2, False)}</button></form>"
        return f"<p>{link(words(1, 5, False))}</p>"

    pages = []
    for _ in range(count):
        if r.random() < 0.1:  # text and hardly more
            pages.append("".join(f"<p>{_MARK}{words(2, 30)}</p>" for _ in range(r.randint(1, 4))) + (boilerplate() if r.random() < 0.3 else ""))
            continue
        kind = r.choice(("article", "article", "main", "named", "named", "plain", "plain"))
        text = content(kind in ("article", "main"))
        body = {"article": f"<article>{text}</article>", "main": f"<main><div>{text}</div></main>", "named": f"<div{named('good')}>{text}</div>", "plain": f"<div>{text}</div>"}[kind]
        body = nested(body)
        if r.random() < 0.3:
            body = f"<div{named(r.choice(('side', 'good', 'menu')), 0.3)}>{body}{boilerplate()}</div>"
        top = f"<{(t := r.choice(('header', 'div')))}{named('frame', 1.0 if t == 'div' else 0.4)}><h1>{words(1, 4, False)}</h1><p>{words(1, 8, False)}</p></{t}>" if r.random() < 0.6 else ""
        end = f"<{(t := r.choice(('footer', 'div')))}{named('frame', 0.9 if t == 'div' else 0.4)}>{r.choice(('© ', '', 'Copyright '))}{words(2, 20)}</{t}>" if r.random() < 0.8 else ""
        pages.append("<html><body>" + top + "".join(nested(boilerplate()) for _ in range(r.randint(0, 3))) + body + "".join(nested(boilerplate()) for _ in range(r.randint(0, 3))) + end + "</body></html>")
    return pages


def _name(r: random.Random, kind: str) -> str:
    word = r.choice(GROUPS[kind].split())
    filler = sorted(FILLER)
    return r.choice((word, word, f"{r.choice(filler)}-{word}", f"{word}_{r.choice(filler)}"))


def labelled_blocks(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray], list[np.ndarray]]:
    """Blocks, features and labels of generated layouts, by page; the marks are taken off."""
    blocks, rows, labels = [], [], []
    for p in pages:
        found = blocks_of(p)
        labels.append(np.array([b.text.startswith(_MARK) for b in found]))
        for b in found:
            b.text = b.text.removeprefix(_MARK)
        has_main = any(_within_main(b.parent) or b.parent.main for b in found)
        rows.append(np.array([features(b, has_main) for b in found], float).reshape(-1, len(FEATURES)))
        blocks.append(found)
    return blocks, rows, labels


@lru_cache(1)
def fitted() -> tuple[float, ...]:
    """The classifier's weights, by FEATURES; the same wherever they are fitted."""
    _, rows, labels = labelled_blocks(training_pages())
    return tuple(logistic(np.concatenate(rows), np.concatenate(labels).astype(float), RIDGE).round(4).tolist())


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """The smoothness edges (block, block, capacity)."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT))
        for e, c in ((b.parent, SAME_PARENT), (b.parent.parent, SAME_GRANDPARENT)):
            if e is not None and e.name not in ("html", "body"):
                if id(e) in last:
                    edges.append((last[id(e)], i, c))
                last[id(e)] = i
    return edges


def capacities(logit: float) -> tuple[int, int]:
    """The costs of calling a block boilerplate and content, -log of the other label's probability, in hundredths."""
    return round(100 * math.log1p(math.exp(min(30.0, logit)))), round(100 * math.log1p(math.exp(min(30.0, -logit))))


def labels_of(blocks: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """True for content."""
    has_main = any(_within_main(b.parent) or b.parent.main for b in blocks)
    costs = [capacities(sum(w * x for w, x in zip(weights, features(b, has_main), strict=True))) for b in blocks]
    return min_cut([c for c, _ in costs], [b for _, b in costs], edges_of(blocks))


def main_text(source: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The content blocks' texts joined by one space; empty if none."""
    blocks = blocks_of(source or "")
    keep = labels_of(blocks, weights or fitted())
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def page_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded once, white space inside a block becomes one space, content blocks
    are joined by one. Null and empty pages, and pages without content, have the empty text; an empty table gives no
    rows. Rows are independent: null or repeated ids and other columns don't matter.
    """
    weights = fitted()

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py(), weights) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, "page_id long, url string, text string, n_chars long")
