"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree whose nodes are block elements and inline elements
that carry attributes. Boosted trees give every node the probability that it
holds or contains main text, from subtree density, attribute tokens, depth and
sibling statistics. Decoding maximises the joint likelihood under one rule:
nothing below a dropped node is kept.

The trees are fitted on at most ``SAMPLE_PAGES`` pages, labelled by the page
elements whose purpose is certain (articles, navigation, footers, forms, named
asides), and on composed pages whose labels are known by construction.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_slices, spread
from .gbt import BoostedTrees

#: Bound on the pages that the trees are fitted on, and the number of composed pages.
SAMPLE_PAGES, COMPOSED_PAGES = 300, 1200

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SILENT = frozenset("head script style noscript template iframe svg math object select option datalist button textarea title".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "option": ("select",), "p": ("div", "article", "section", "main", "td", "th", "li", "body", "aside", "footer", "header", "nav", "form", "blockquote")}

# Words of class, id and role attributes by what they tell.
TOKENS = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip tabs topbar toolbar".split()),
    "head": frozenset("header masthead branding logo hero".split()),
    "foot": frozenset("footer colophon copyright legal bottom".split()),
    "side": frozenset("sidebar aside widget related recommended trending popular more tags widgets rail".split()),
    "ad": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert popup modal overlay notification paywall warning disclaimer".split()),
    "comment": frozenset("comment comments reply replies disqus respond discussion reader reviews feedback".split()),
    "share": frozenset("share social sharing follow facebook twitter newsletter subscribe signup subscription".split()),
    "form": frozenset("form login search contact register".split()),
    "text": frozenset("article content post entry body main story text prose articlebody blog page".split()),
}
GROUPS = tuple(TOKENS)
TAGS = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "a", "span", "heading", "other")

START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: tuple[int, ...]
    children: list[int] = field(default_factory=list)
    block: bool = True
    place: int = 0  # among the children of the parent


@dataclass
class Page:
    """Nodes in document order, and text runs (node, block number, text)."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def _groups(attributes: str) -> tuple[int, ...]:
    if not attributes:
        return ()
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        words.update(PART.findall(CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()))
    return tuple(k for k, g in enumerate(GROUPS) if words & TOKENS[g])


def parse(markup: str) -> Page:
    """Any text is a page: unclosed, misnested and unknown elements are read as browsers mostly do."""
    page = Page([Node("#page", -1, 0, ())])
    nodes, stack, block, at = page.nodes, [(0, "#page")], 0, 0
    silent = 0
    open_tags: Counter[str] = Counter()
    quoted = True

    def text(raw: str) -> None:
        if open_tags["head"] and raw.strip(" \t\n\r\f"):
            end_head()
        if raw and not silent:
            page.runs.append((top_node(), block, references.unescape(raw) if "&" in raw else raw))

    def top_node() -> int:
        return stack[-1][0]

    def pop_to(depth: int) -> None:
        nonlocal block, silent
        while len(stack) > depth:
            _, name = stack.pop()
            open_tags[name] -= 1
            silent -= name in SILENT
            if name not in INLINE:
                block += 1

    def end_head() -> None:
        """An open head ends where the body begins: at its tag, at any tag or text that a head can't hold."""
        pop_to(next(depth for depth, (_, name) in enumerate(stack) if name == "head"))

    while True:
        start = START.search(markup, at)
        if not start:
            text(markup[at:])
            return page
        text(markup[at : start.start()])
        if start[0][1] in "!?":
            end = "-->" if start[0] == "<!--" else ">"
            close_at = markup.find(end, start.end())
            if close_at < 0:
                return page
            at = close_at + len(end)
            continue
        m = TAG.match(markup, start.start()) if quoted else None
        if not m:  # an unclosed quote: from here on a tag ends at its first bracket
            quoted, m = False, PLAIN_TAG.match(markup, start.start())
        if not m:
            text(markup[start.start() :])
            return page
        at, name = m.end(), m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[name] else ():
                if stack[depth][1] == name:
                    pop_to(depth)
                    break
            continue
        if open_tags["head"]:
            if name == "head":
                continue
            if name not in HEAD:
                end_head()
        if name in VOID:
            if name in ("br", "hr"):
                block += 1
            continue
        ends = ("p",) if name in CLOSES_P else ()
        for closing in (*ends, *CLOSES.get(name, ())):
            for depth in range(len(stack) - 1, 0, -1) if open_tags[closing] else ():
                if stack[depth][1] == closing:
                    pop_to(depth)
                    break
                if stack[depth][1] in SCOPE.get(closing, ("table",)):
                    break
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(markup, at)
            at = close.end() if close else len(markup)
            continue
        if m[3].rstrip().endswith("/") and name not in INLINE | CLOSES_P:
            continue
        inline = name in INLINE
        groups = _groups(m[3])
        if not inline:
            block += 1
        if not inline or groups or name == "a":
            parent = top_node()
            nodes.append(Node(name, parent, len(stack), groups, block=not inline, place=len(nodes[parent].children)))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append((len(nodes) - 1, name))
        else:
            stack.append((top_node(), name))
        open_tags[name] += 1
        silent += name in SILENT


def _tag(name: str) -> int:
    if name in TAGS:
        return TAGS.index(name)
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return TAGS.index("heading")
    return TAGS.index({"ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "pre": "p", "blockquote": "p", "td": "div", "center": "div", "menu": "ul"}.get(name, "other"))


def features(page: Page) -> np.ndarray:
    """One row a node."""
    nodes = page.nodes
    n = len(nodes)
    own, marks, first = [0] * n, [0] * n, [-1] * n
    seen = 0
    for k, _, t in page.runs:
        own[k] += len(t) - t.count(" ") - t.count("\n")
        marks[k] += t.count(".") + t.count(",") + t.count("?") + t.count("!")
        if first[k] < 0:
            first[k] = seen
        seen += len(t)
    size, link, signs, below, paras, start = own[:], [0] * n, marks[:], [1] * n, [0] * n, first[:]
    for k in range(n - 1, 0, -1):
        node, up = nodes[k], nodes[k].parent
        if node.tag == "a":
            link[k] = size[k]
        paras[k] += node.tag == "p"
        size[up] += size[k]
        link[up] += link[k]
        signs[up] += signs[k]
        below[up] += below[k]
        paras[up] += paras[k]
        if start[k] >= 0 and (start[up] < 0 or start[k] < start[up]):
            start[up] = start[k]
    inherited = [0] * n
    kinds: dict[int, Counter[str]] = {}
    rows = []
    log = math.log1p
    for k, node in enumerate(nodes):
        up = nodes[node.parent] if node.parent >= 0 else node
        mask = 0
        for g in node.groups:
            mask |= 1 << g
        above = inherited[node.parent] if node.parent >= 0 else 0
        inherited[k] = above | mask | {"nav": 1, "header": 2, "footer": 4, "aside": 8, "form": 256, "article": 512, "main": 512}.get(node.tag, 0)
        if node.parent >= 0:
            kin = up.children
            j = node.place
            if node.parent not in kinds:
                kinds[node.parent] = Counter(nodes[x].tag for x in kin)
            before = size[kin[j - 1]] if 0 < j < len(kin) else 0
            after = size[kin[j + 1]] if j + 1 < len(kin) else 0
            alike = kinds[node.parent][node.tag] / len(kin)
            share = size[k] / (size[node.parent] or 1)
            count = len(kin)
        else:
            j = before = after = 0
            alike = share = count = 1
        total = size[k]
        tag = [0.0] * len(TAGS)
        tag[_tag(node.tag)] = 1.0
        rows.append([
            log(total), log(own[k]), link[k] / (total or 1), total / below[k], log(below[k]), log(paras[k]), signs[k] / (total or 1),
            node.depth, j, count, alike, share, log(before), log(after), total / (size[0] or 1), max(0, start[k]) / (seen or 1),
            *tag, *((mask >> g) & 1 for g in range(len(GROUPS))), *((above >> g) & 1 for g in range(len(GROUPS))),
        ])
    return np.array(rows, np.float32)


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which nodes are kept: the likeliest choice in which no kept node lies below a dropped one."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    n = len(page.nodes)
    for k in range(n - 1, 0, -1):  # children come after their parent
        up = page.nodes[k].parent
        yes[up] += max(yes[k], no[k])
        no[up] += no[k]
    keep = [False] * n
    for k, node in enumerate(page.nodes):
        keep[k] = node.parent < 0 or (keep[node.parent] and yes[k] >= no[k])
    return keep


def joined(page: Page, keep: list[bool]) -> str:
    """Kept runs; white space inside a block as one space, blocks joined by one space."""
    out, now = [], None
    for k, block, t in page.runs:
        if keep[k]:
            if block != now:
                out.append(" ")
                now = block
            out.append(t)
    return " ".join("".join(out).split())


# Labels.

SURE_DROP = frozenset("nav footer aside form".split())


def teacher(page: Page) -> list[bool]:
    """Labels from elements whose purpose is certain: whether a node holds or contains main text."""
    nodes = page.nodes
    n = len(nodes)
    bad = {GROUPS.index(g) for g in GROUPS if g != "text"}
    cores = [k for k, x in enumerate(nodes) if x.tag in ("article", "main")]
    state = [0] * n  # 1 inside a core, -1 dropped
    for k, x in enumerate(nodes):
        up = state[x.parent] if x.parent >= 0 else 0
        drop = x.tag in SURE_DROP or (set(x.groups) & bad and GROUPS.index("text") not in x.groups) or (x.tag == "header" and up != 1)
        state[k] = -1 if up == -1 or drop else 1 if up == 1 or k in cores or (not cores and x.tag == "p") else 0
    label = [s == 1 for s in state]
    for k in range(n - 1, 0, -1):
        if label[k]:
            label[nodes[k].parent] = True
    return label


#: Parts of a main text beside plain blocks.
PARTS = [
    "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li><li>{}</li></ul>", "<ol><li><p>{}</p></li><li>{}</li></ol>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>",
    "<table><tr><th>{}</th><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>", "<figure><img src='a.png'><figcaption>{}</figcaption></figure>", "<p>{} <a href='#'>{}</a> {}</p>", "<div><p>{}</p><p>{}</p></div>", "<dl><dt>{}</dt><dd>{}</dd></dl>",
]


def meaningless(markup: str, rng: random.Random) -> str:
    """The markup with semantic elements as div, and with classes and ids that tell nothing or are left out."""

    def name(m: re.Match) -> str:
        kind = rng.choice(["", "", "class", "id"])
        return f' {kind}="{"".join(rng.choice("bcdfgjkqvwxz") for _ in range(rng.randint(1, 4)))}{rng.randint(0, 99)}"' if kind else ""

    plain = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside)\b", r"<\1div", markup)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', name, re.sub(r"<div>", '<div class="_">', plain))


def composed(words: list[str], rng: random.Random, plain: bool = False) -> str:
    """A page made from parts; x-keep and x-drop elements mark what is main text.

    A ``plain`` page has no element or name that tells a part's purpose, and
    only such parts beside the main text as its structure tells apart.
    """

    def prose(low: int, high: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))) + rng.choice(".,.?!")

    def links(k: int) -> str:
        return "".join(f'<li><a href="#">{prose(1, 3)}</a></li>' for _ in range(k))

    def noise(kind: str) -> str:
        k = rng.randint(2, 9)
        return {
            "menu": lambda: rng.choice(['<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', '<div class="breadcrumb"><ul>{}</ul></div>']).format(links(k)),
            "head": lambda: rng.choice(['<header><h2>{}</h2></header>', '<div id="header"><p>{}</p></div>', '<div class="masthead">{}</div>']).format(prose(2, 8)),
            "foot": lambda: rng.choice(['<footer>{}</footer>', '<div class="footer"><p>{}</p></div>', '<div id="footer">&copy; {}</div>']).format(prose(4, 25)),
            "side": lambda: rng.choice(['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div class="related"><h3>{}</h3></div>']).format(f"<p>{prose(5, 30)}</p><ul>{links(k)}</ul>"),
            "ad": lambda: rng.choice(['<div class="ad">{}</div>', '<div class="advert banner"><p>{}</p></div>', '<section class="sponsored"><p>{}</p></section>', '<p class="promo">{}</p>']).format(prose(4, 30)),
            "notice": lambda: rng.choice(['<div class="cookie-notice"><p>{}</p></div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div role="alert"><p>{}</p></div>']).format(prose(5, 40)),
            "comment": lambda: rng.choice(['<section class="comments"><h3>{1}</h3>{0}</section>', '<div id="comments">{0}</div>', '<div class="reader-comments"><ol>{0}</ol></div>']).format("".join(rng.choice(['<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>']).format(prose(5, 60)) for _ in range(k)), prose(1, 3)),
            "share": lambda: rng.choice(['<div class="share">{}</div>', '<div class="newsletter signup"><p>{}</p></div>', '<ul class="social">{}</ul>']).format(prose(2, 15)),
            "form": lambda: f'<form action="/s"><label>{prose(1, 4)}</label><input name="q"><p>{prose(2, 12)}</p><button>{prose(1, 2)}</button></form>',
        }[kind]()

    kinds = ["menu", "head", "foot", "side", "ad", "notice", "comment", "share", "form"]
    body, inside = [], rng.random() < 0.4 and not plain
    parts = [f"<h1>{prose(3, 9)}</h1>"] if rng.random() < 0.8 else []
    block = rng.choice(["<p>{}</p>"] * 6 + ["<div>{}</div>", "<p><span>{}</span></p>"])
    for _ in range(rng.choice([1, 2, 3, 5, 9, 15])):
        part = rng.choice([block] * 10 + PARTS)
        while "{}" in part:
            part = part.replace("{}", prose(1, 4) if rng.random() < 0.15 else prose(5, 80), 1)
        parts.append(part)
    if parts and rng.random() < 0.2:
        parts[0] = f"<header>{parts[0]}</header>"
    if rng.random() < 0.2:
        parts = ["<section>", *parts, "</section>"]
    marked = [f'<x-drop>{noise(rng.choice(["ad", "share", "notice", "comment", "side"]))}</x-drop>' for _ in range(rng.randint(1, 2))] if inside else []
    for part in marked:
        parts.insert(rng.randint(0, len(parts)), part)
    core = rng.choice(['<article>{}</article>', '<main>{}</main>', '<article>{}</article>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<section class="entry">{}</section>', '<div class="post-body">{}</div>', '<div>{}</div>', '<main><article>{}</article></main>']).replace("{}", "<x-keep>" + "".join(parts) + "</x-keep>")
    if plain:
        heading = lambda: f"<h3>{prose(1, 3)}</h3>" if rng.random() < 0.5 else ""
        foot = lambda: f'<div><p>&copy; {prose(2, 9)}</p>' + "".join(f'<a href="#">{prose(1, 2)}</a> ' for _ in range(rng.randint(0, 5))) + "</div>"
        listed = lambda: f'<div>{heading()}<ul>{links(rng.randint(2, 9))}</ul></div>'
        row = lambda: "<div>" + rng.choice([" ", " | "]).join(f'<a href="#">{prose(1, 3)}</a>' for _ in range(rng.randint(2, 9))) + "</div>"
        ahead = [rng.choice([listed, row])() for _ in range(rng.randint(0, 2))]
        behind = [rng.choice([listed, row, foot, lambda: noise("form")])() for _ in range(rng.randint(0, 3))]
        body = [*ahead, core, *behind]
    else:
        before = [noise(k) for k in rng.sample(kinds[:6], rng.randint(0, 4))]
        after = [noise(k) for k in rng.sample(kinds, rng.randint(0, 5))]
        body = [*before, core, *after]
    wrap = rng.choice(["{}", "{}", '<div id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>'])
    out = wrap.replace("{}", "".join(body))
    return "<html><head><title>t</title></head><body>" + (meaningless(out, rng) if plain else out) + "</body></html>"


def _composed_rows(words: list[str], rng: random.Random) -> tuple[np.ndarray, list[bool]]:
    """Features and labels of a composed page: the marker elements give the labels and are then unwrapped."""
    marked = composed(words, rng, plain=rng.random() < 0.5)
    tagged, plain = parse(marked), parse(re.sub(r"</?x-(?:keep|drop)>", "", marked))
    labels, state = [], []
    for x in tagged.nodes:
        up = state[x.parent] if x.parent >= 0 else 0
        state.append({"x-keep": 1, "x-drop": -1}.get(x.tag, up))
    holds = [s == 1 for s in state]
    for k in range(len(holds) - 1, 0, -1):
        if holds[k]:
            holds[tagged.nodes[k].parent] = True
    labels = [h for h, x in zip(holds, tagged.nodes) if not x.tag.startswith("x-")]
    return features(plain), labels


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BoostedTrees:
    """Fit the trees on a bounded sample of ``pages`` and on composed pages."""
    own = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    rows = bounded_sample(own, "id", SAMPLE_PAGES).collect()
    xs, ys, words = [], [], []
    for r in rows:
        page = parse(r[1])
        xs.append(features(page))
        ys += teacher(page)
        words += [w for _, _, t in page.runs for w in t.split()]
    rng = random.Random(11)
    words = words or ["lorem", "ipsum", "dolor", "sit", "amet"]
    for _ in range(COMPOSED_PAGES):
        x, y = _composed_rows(words, rng)
        xs.append(x)
        ys += y
    return BoostedTrees().fit(np.concatenate(xs), np.array(ys, float))


def extract(markups: list[str], model: BoostedTrees) -> list[str]:
    pages = [parse(m) for m in markups]
    xs = [features(p) for p in pages]
    p = model.predict(np.concatenate(xs)) if xs else np.zeros(0)
    ends = np.cumsum([len(x) for x in xs])
    return [joined(page, decode(page, p[e - len(page.nodes) : e])) for page, e in zip(pages, ends)]


def main_text(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    Null or empty html, or a page without main text, gives an empty text;
    repeated rows each give a row; an empty table gives none; other columns
    are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def fn(keys, urls, markups):
            found = extract([m or "" for m in markups], own)
            return {"page_id": keys, "url": urls, "text": found, "n_chars": [len(t) for t in found]}

        return fn

    own = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")))
    return map_slices(own, make, "page_id long, url string, text string, n_chars long", rows=256)
