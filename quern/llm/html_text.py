"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a node with a hidden label, content or not.  Unary potentials
weigh what the element shows of itself (tag, words in class and id, share of linked
text, amount of text); edge potentials weigh the labels of parent and child by the
child's kind.  Sum-product messages pass upward and then downward through the tree and
give every node's marginal; text directly in a node with a marginal over one half is
content.  Weights are trained by gradient ascent on the exact likelihood of labelled
pages, whose gradient is the difference of observed and expected feature counts.

No labelled pages come with the corpus, so ``labelled_pages`` lays out pages in several
common designs in which every element's label is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag: quotes bind only after "=", and a quote that is never closed is part of a plain value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: The label that ``labelled_pages`` gives an element.
_LABEL = re.compile(r'(?:^|\s)data-y="([01])"')
_SPACE = re.compile(r"\s+")
#: Elements whose content is no markup; all else is parsed, and left to the model.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark meter nobr object output picture progress q rb rp rt ruby s samp small span strike strong sub sup svg time tt u var"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle semantics annotation".split()
)
_TAGS = {
    **dict.fromkeys(("nav", "menu"), "nav"),
    **dict.fromkeys(("form", "fieldset", "button", "dialog", "legend", "select", "option", "optgroup", "datalist", "template"), "form"),
    **dict.fromkeys(("article", "main"), "main"),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("html", "body"), "root"),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote"),
    **{x: x for x in ("header", "footer", "aside", "section", "div", "p")},
}
#: Words that tell wherever they stand in a name.
_WORDS = {
    "nav": "nav navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "header": "masthead",
    "footer": "footer colophon copyright contentinfo",
    "side": "sidebar aside related recommended recommend widget trending rail complementary",
    "notice": "cookie cookies consent gdpr popup modal overlay newsletter paywall toast",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promoted promotion dfp",
    "comment": "comment comments replies disqus commentlist",
    "form": "login signup searchbox signin",
    "share": "share sharing social byline",
}
#: Words that tell only as the last word of a name that has no word for an article.
_WEAK = {
    "nav": "menu tabs skip",
    "header": "header banner topbar top logo branding",
    "footer": "foot legal bottom",
    "side": "side popular more",
    "notice": "notice alert subscribe warning",
    "comment": "reply discussion respond thread",
    "form": "form search register",
    "share": "follow tags meta author",
}
_MAIN = "article content post entry main story body text prose articlebody"
#: Names with such a word describe a state, or something that is elsewhere or not there.
_STATES = set("no not without with has is js hide show closed open opened fixed sticky collapsed expanded active inactive enabled disabled visible off on".split())
_ASIDE = {"t:nav", "t:header", "t:footer", "t:aside", "t:form"}
_WORD_OF = {w: k for k, ws in _WORDS.items() for w in ws.split()}
_WEAK_OF = {w: k for k, ws in _WEAK.items() for w in ws.split()}
_MAIN_WORDS = set(_MAIN.split())
#: Furniture that is none where it holds most of the page's text, the article included.
_WRAPS = {"t:header", "t:form", "t:nav", "t:aside", *(f"{x}:{k}" for x in "wv" for k in ("nav", "header", "side", "notice", "form", "share")), "v:footer", "v:comment"}
_HIDDEN = re.compile(r"(?:^|[\s\"';])hidden(?=[\s=/]|$)(?!\s*=\s*[\"']?false)|style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


#: What an element closes when it opens, and up to which elements.
_CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)),
}


def _static(tag: str, attrs: str) -> tuple[tuple[str, ...], str]:
    return _cached_static(tag, attrs) if len(attrs) < 500 else _cached_static.__wrapped__(tag, attrs)


def _told(name: str) -> set[str]:
    """What one name (of several, in a class) tells of an element."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
    if _STATES.intersection(words):
        return set()
    found = {"w:" + _WORD_OF[w] for w in words if w in _WORD_OF}
    if _MAIN_WORDS.intersection(words):
        return found or {"w:main"}
    if words and not found and words[-1] in _WEAK_OF:
        found.add("v:" + _WEAK_OF[words[-1]])
    return found


@lru_cache(maxsize=20000)
def _cached_static(tag: str, attrs: str) -> tuple[tuple[str, ...], str]:
    kind = _TAGS.get(tag, "inline" if tag in _INLINE else "other")
    found: set[str] = set()
    if "-" in tag:  # an element of the page's own making
        found |= _told(tag)
    if attrs and kind != "root":
        if _HIDDEN.search(attrs):
            found.add("w:hidden")
        for m in _ATTR.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").split():
                found |= _told(name)
    return ("t:" + kind, *sorted(found)), kind


#: What makes an inline element a node of its own.
_CUT = {"w:hidden", "w:ad", "w:notice", "w:comment", "w:share"}


class Page:
    """Block nodes in page order, parents first, and the text chunks in page order."""

    __slots__ = ("parent", "static", "kind", "chunks", "label")

    def __init__(self, source: str):
        self.parent, self.static, self.kind, self.label = [-1], [("t:root",)], ["root"], [None]
        self.chunks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        # Open elements, where each name stands among them, and where block elements stand.
        stack: list[tuple[str, int]] = [("#", 0)]
        places: dict[str, list[int]] = defaultdict(list)
        blocks = [0]
        text: list[str] = []
        linked, link_depth, at, block = 0, 0, 0, 0

        def flush() -> None:
            nonlocal linked
            while aside:
                resume()
            if text:
                joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                if joined:
                    self.chunks.append((block, joined, linked))
                text.clear()
            linked = 0

        def close_to(k: int) -> None:
            nonlocal block
            while len(stack) > k:
                name, _ = stack.pop()
                places[name].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
            block = stack[-1][1]

        aside: list[tuple[int, list[str], int]] = []  # depth, text around, linked text there

        def resume() -> None:
            """Back to the text around an inline element with a label of its own."""
            nonlocal text, linked, block
            own = block
            block = len(self.parent)
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                self.parent.append(own)
                self.static.append(self_static.pop())
                self.kind.append("inline")
                self.label.append(self_label.pop())
                self.chunks.append((block, joined, linked))
            else:
                self_static.pop(), self_label.pop()
            block = own
            _, text, linked = aside.pop()
            text.append(" ")

        self_static: list[tuple[str, ...]] = []
        self_label: list[int | None] = []
        strict, ends, missing = True, True, set()
        while True:
            to = source.find("<", at)
            piece = source[at : to if to >= 0 else len(source)]
            if piece:
                text.append(piece)
                if link_depth:
                    linked += len(piece.strip())
            if to < 0:
                break
            mark = source[to + 1 : to + 2]
            closing = mark == "/"
            letter = source[to + 2 : to + 3] if closing else mark
            if not (letter.isascii() and letter.isalpha()):
                if closing or mark in ("!", "?"):
                    note = source.startswith("<!--", to)
                    end = source.find("-->" if note else ">", to)
                    at = len(source) if end < 0 else end + (3 if note else 1)
                else:
                    text.append("<")
                    at = to + 1
                continue
            m = _TAG.match(source, to) if strict else None
            if not m:
                # A tag that has no end by the rules, so from here tags end at the next ">".
                strict = False
                ends = ends and source.find(">", to) >= 0
                m = _PLAIN_TAG.match(source, to) if ends else None
            if not m:
                text.append("<")
                at = to + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if closing:
                if tag == "a":
                    link_depth = 0
                if not places[tag]:
                    if tag == "p":
                        flush()
                elif tag not in _INLINE:
                    flush()
                    close_to(places[tag][-1])
                elif places[tag][-1] > blocks[-1]:
                    while aside and places[tag][-1] <= aside[-1][0]:
                        resume()
                    close_to(places[tag][-1])
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in _RAW:
                end = _END[tag].search(source, at) if tag not in missing else None
                if end:
                    to = source.find(">", end.end())
                    at = to + 1 if to >= 0 else len(source)
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(source)
                else:
                    missing.add(tag)
                continue
            if tag == "head":
                continue
            if tag in _INLINE:
                if tag == "a":
                    link_depth = 1
                if m[3]:
                    own = _static(tag, m[3])[0]
                    if any(f in _CUT for f in own):
                        label = _LABEL.search(m[3])
                        self_static.append(own)
                        self_label.append(int(label[1]) if label else None)
                        aside.append((len(stack), text, linked))
                        text, linked = [], 0
                places[tag].append(len(stack))
                stack.append((tag, block))
                continue
            flush()
            link_depth = 0
            if stack[blocks[-1]][0] == "p":
                close_to(blocks[-1])
            if tag in _CLOSES:
                closes, stops = _CLOSES[tag]
                stop = max((places[x][-1] for x in stops if places[x]), default=0)
                lowest = [places[x][i] for x in closes if (i := bisect_right(places[x], stop)) < len(places[x])]
                if lowest:
                    close_to(min(lowest))
            static, kind = _static(tag, m[3])
            self.parent.append(stack[-1][1])
            self.static.append(static)
            self.kind.append(kind)
            label = _LABEL.search(m[3])
            self.label.append(int(label[1]) if label else None)
            block = len(self.parent) - 1
            places[tag].append(len(stack))
            blocks.append(len(stack))
            stack.append((tag, block))
        flush()

    def features(self) -> list[tuple[str, ...]]:
        n = len(self.parent)
        size, links = [0] * n, [0] * n
        for node, text, linked in self.chunks:
            size[node] += len(text)
            links[node] += min(linked, len(text))
        direct = [s - x for s, x in zip(size, links, strict=True)]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            links[self.parent[i]] += links[i]
        mains = [i for i in range(n) if "t:main" in self.static[i] or "w:main" in self.static[i]]
        named = "1" if mains else "0"
        main = max(mains, key=lambda i: (size[i] - links[i], -i), default=-1)
        own, kinds = [set(x) for x in self.static], list(self.kind)
        inside = [False] * n  # the article's own elements
        end = list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            end[self.parent[i]] = max(end[self.parent[i]], end[i])
        plain = size[0] - links[0]
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or "t:main" in self.static[i] or "w:main" in self.static[i]
            if kinds[i] == "header" and inside[i]:  # the head of an article, not of a page
                kinds[i] = "head"
                own[i].discard("t:header")
                own[i].add("t:head")
            wraps = own[i] & _WRAPS
            if wraps and size[i] - links[i] >= max(100, plain // 2) and (main < 0 or i <= main < end[i]):
                own[i] -= wraps
                own[i].add("t:wrap")
                kinds[i] = "wrap" if kinds[i] in ("form", "header", "nav", "aside") else kinds[i]
        self.kind = kinds
        # Whether a node, or one it is in, is named as something other than the article.
        aside = [False] * n
        for i in range(n):
            aside[i] = (i > 0 and aside[self.parent[i]]) or any(f[:2] in ("w:", "v:") and f != "w:main" or f in _ASIDE for f in own[i])
        out = []
        for i in range(n):
            s = size[i]
            share = links[i] / s if s else 0.0
            if kinds[i] == "root":  # text in no element of its own
                own[i].add("r:" + ("0" if not direct[i] else "40" if direct[i] < 40 else "more"))
            out.append((*sorted(own[i]), f"m:{named}:{kinds[i]}", f"x:{named}:{int(aside[i])}:{int(s > 0)}", "s:" + ("0" if not s else "40" if s < 40 else "200" if s < 200 else "more"), "l:" + ("0" if share < 0.1 else "1" if share < 0.5 else "2")))
        return out


def sum_product(parent: list[int], unary: list[tuple[float, float]], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Marginals P(content) of the nodes, and of each node's pair (parent, node).

    ``edge`` holds a node's factors with its parent for the labels 00, 01, 10, 11 (parent
    first).  Parents come before their children, so one pass backward sends all messages
    up and one pass forward sends them down.
    """
    n = len(parent)
    up = [list(u) for u in unary]
    sent = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        e = edge[i]
        m0, m1 = a * e[0] + b * e[1], a * e[2] + b * e[3]
        z = m0 + m1
        m0, m1 = m0 / z, m1 / z
        sent[i] = (m0, m1)
        p = up[parent[i]]
        p[0] *= m0
        p[1] *= m1
        if p[0] + p[1] < 1e-200:
            p[0] *= 1e200
            p[1] *= 1e200
    belief: list[tuple[float, float]] = [(0.0, 0.0)] * n
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    z = up[0][0] + up[0][1]
    belief[0] = (up[0][0] / z, up[0][1] / z)
    for i in range(1, n):
        p, m, e, u = belief[parent[i]], sent[i], edge[i], up[i]
        q0, q1 = p[0] / m[0], p[1] / m[1]
        f00, f01, f10, f11 = q0 * e[0] * u[0], q0 * e[1] * u[1], q1 * e[2] * u[0], q1 * e[3] * u[1]
        z = f00 + f01 + f10 + f11
        pairs[i] = (f00 / z, f01 / z, f10 / z, f11 / z)
        belief[i] = ((f00 + f10) / z, (f01 + f11) / z)
    return [b[1] for b in belief], pairs


class Model:
    def __init__(self) -> None:
        self.unary: dict[str, float] = {}
        self.edge: dict[str, list[float]] = {}

    def factors(self, page: Page) -> tuple[list[tuple[str, ...]], list[tuple[float, float]], list[tuple[float, float, float, float]]]:
        feats = page.features()
        get = self.unary.get
        unary = [(1.0, math.exp(max(-30.0, min(30.0, sum([get(f, 0.0) for f in fs]))))) for fs in feats]
        edge = []
        for kind in page.kind:
            w = self.edge.get(kind) or (0.0, 0.0, 0.0, 0.0)
            edge.append((math.exp(w[0]), math.exp(w[1]), math.exp(w[2]), math.exp(w[3])))
        return feats, unary, edge

    def train(self, pages: list[Page], epochs: int = 25, rate: float = 0.15, decay: float = 1e-3) -> Model:
        for _ in range(epochs):
            for page in pages:
                feats, unary, edge = self.factors(page)
                content, pairs = sum_product(page.parent, unary, edge)
                for i, fs in enumerate(feats):
                    y = page.label[i]
                    if y is None:
                        y = 0
                    step = rate * (y - content[i])
                    for f in fs:
                        self.unary[f] = self.unary.get(f, 0.0) * (1 - decay * rate) + step
                    if i:
                        w = self.edge.setdefault(page.kind[i], [0.0] * 4)
                        seen = 2 * (page.label[page.parent[i]] or 0) + y
                        for k in range(4):
                            w[k] += rate * ((k == seen) - pairs[i][k])
        return self

    def extract(self, source: str) -> str:
        page = Page(source)
        if not page.chunks:
            return ""
        _, unary, edge = self.factors(page)
        content, _ = sum_product(page.parent, unary, edge)
        return "\n\n".join([text for node, text, _ in page.chunks if content[node] > 0.5])


def labelled_pages(count: int = 320, seed: int = 5) -> list[Page]:
    """Laid-out pages; data-y holds each element's label (1 content)."""
    rng = random.Random(seed)

    def say(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def links(n: int, y: int = 0) -> str:
        return f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}"><a href="/x">{say(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def state() -> str:
        """Names that tell nothing: states, and words that are no furniture where they stand."""
        return rng.choice(("has-sidebar", "no-comments", "with-nav", "menu-closed", "js", "row", "wrap", "clearfix", "container", "top-level", "legal-advice", "more-info", "search-results"))

    def named(kind: str, tag: str = "div") -> str:
        words = (_WORDS[kind] + " " + _WEAK.get(kind, "")).split()
        name = rng.choice(words)
        if name in _WORD_OF:
            name = rng.choice((name, name, f"{name}-{rng.choice(('box', 'list', 'content', 'inner', 'item'))}", f"{rng.choice(('site', 'page', 'main', 'left'))}-{name}", f"{name} {rng.choice(('row', 'wrap', 'clearfix'))}"))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}" data-y="0">'

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.08:
            return f'<h2 data-y="1">{say(2, 6)}</h2>'
        if kind < 0.14:
            return '<ul data-y="1">' + "".join(f'<li data-y="1">{say(4, 15)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.18:
            return f'<blockquote data-y="1"><p data-y="1">{say(8, 30)}</p></blockquote>'
        if kind < 0.21:
            return f'<table data-y="1"><tr data-y="1"><td data-y="1">{say(1, 4)}</td><td data-y="1">{say(1, 4)}</td></tr></table>'
        if kind < 0.24:
            return f'<pre data-y="1">{say(3, 20)}</pre>'
        if kind < 0.27:
            cut = rng.choice(('class="ad"', "hidden", 'class="share-count"', 'style="display:none"'))
            return f'<p data-y="1">{say(3, 12)} <span {cut} data-y="0">{say(1, 6)}</span> {say(3, 12)}</p>'
        if kind < 0.33:
            return f'<p data-y="1">{say(3, 12)} <a href="/y">{say(1, 4)}</a> {say(3, 12)}</p>'
        return f'<p data-y="1">{say(1, 60) if kind < 0.5 else say(15, 60)}</p>'

    def furniture(kind: str) -> str:
        tag = rng.random() < 0.5
        if kind == "nav":
            return ('<nav data-y="0">' if tag else named("nav")) + links(rng.randint(2, 9)) + ("</nav>" if tag else "</div>")
        if kind == "header":
            return ('<header data-y="0">' if tag else named("header")) + rng.choice((f'<h2 data-y="0">{say(1, 4)}</h2>', f'<p data-y="0">{say(2, 10)}</p>', say(1, 5))) + ("</header>" if tag else "</div>")
        if kind == "footer":
            return ('<footer data-y="0">' if tag else named("footer")) + rng.choice((say(3, 20), f'<p data-y="0">{say(3, 20)}</p>', links(4))) + ("</footer>" if tag else "</div>")
        if kind == "side":
            inner = rng.choice((links(rng.randint(2, 6)), f'<h3 data-y="0">{say(1, 4)}</h3><p data-y="0">{say(4, 30)}</p>'))
            return ('<aside data-y="0">' if tag else named("side")) + inner + ("</aside>" if tag else "</div>")
        if kind == "form":
            return f'<form data-y="0"><p data-y="0">{say(1, 10)}</p><button data-y="0">{say(1, 2)}</button></form>' if tag else named("form") + f'<form data-y="0">{say(1, 6)}</form></div>'
        if kind == "comment":
            one = lambda: f'<div class="comment" data-y="0"><p data-y="0">{say(3, 40)}</p></div>'
            return named("comment") + rng.choice((f'<h3 data-y="0">{say(1, 3)}</h3>', "")) + "".join(rng.choice((one(), f'<p data-y="0">{say(3, 40)}</p>')) for _ in range(rng.randint(1, 5))) + "</div>"
        return named(kind) + rng.choice((say(2, 30), f'<p data-y="0">{say(2, 30)}</p>')) + "</div>"

    def menu() -> str:
        """Sometimes a cell of links beside the text."""
        return rng.choice(("", f'<td data-y="0">{"<br>".join(f"""<a href="/x">{say(1, 2)}</a>""" for _ in range(rng.randint(2, 6)))}</td>'))

    kinds = ["nav", "header", "side", "notice", "ad", "form", "share"]
    pages = []
    for _ in range(count):  # pages that name nothing: plain blocks, down to one paragraph
        body = "".join(paragraph() for _ in range(rng.choice((1, 1, 2, 3, 6)))) if rng.random() < 0.8 else say(2, 60)
        body = rng.choice((f'<h1 data-y="1">{say(2, 9)}</h1>', "")) + body
        text = rng.choice(('<div data-y="1">{}</div>', "{}", '<div data-y="1"><div data-y="1">{}</div></div>', '<table data-y="1"><tr data-y="1">' + menu() + '<td data-y="1">{}</td></tr></table>')).format(body)
        around = [furniture(k) if rng.random() < 0.35 else "" for k in rng.sample(("nav", "header", "form"), 1) + rng.sample(("footer", "ad", "comment"), 1)]
        top = int(text == body)
        inner = f"{around[0]}{text}{around[1]}"
        shape = rng.random()
        if shape < 0.15:  # text and breaks, in no element but the body, or in none at all
            raw = rng.choice((" ", "<br>", "<br><br>")).join(say(8, 40) for _ in range(rng.randint(1, 4)))
            boxed = rng.random() < 0.4
            if boxed:
                raw = f'<div class="{rng.choice(("post", "text", "entry-content", "box"))}" data-y="1">{raw}</div>'
            raw = f"{around[0]}{raw}{around[1]}"
            pages.append(Page(rng.choice((raw, f'<html data-y="0"><body class="{state()}" data-y="{int(not boxed)}">{raw}</body></html>'))))
            pages[-1].label[0] = int(any(node == 0 for node, _, _ in pages[-1].chunks))
        elif shape < 0.3:  # a piece of a page
            pages.append(Page(inner))
            pages[-1].label[0] = top
        elif shape < 0.45 and text != body:  # a form, or a named box, around the whole page
            box = rng.choice(('form id="form"', "form", 'div class="header"', 'div class="search"', 'div class="content-sidebar-wrap"', 'div class="menu"'))
            text = text.replace("<div", f'<div class="{state()}"', 1)
            pages.append(Page(f'<html data-y="0"><body data-y="0"><{box} data-y="0">{text}<p data-y="1">{say(25, 60)}</p></{box.split()[0]}>{around[1]}</body></html>'))
        else:
            pages.append(Page(f'<html data-y="0"><body class="{state()}" data-y="{top}">{inner}</body></html>'))
    for _ in range(count):
        body = [paragraph() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.15:  # a long run of short blocks
            body += [f'<p data-y="1">{say(1, 3)}</p>' for _ in range(rng.randint(15, 60))]
        for kind in rng.sample(("ad", "side", "share", "notice", "form", "comment", "nav"), rng.randint(0, 2)):
            body.insert(rng.randint(0, len(body)), furniture(kind))
        if rng.random() < 0.8:
            head = f'<h1 data-y="1">{say(2, 9)}</h1>'
            if rng.random() < 0.35:
                head = f'<header data-y="1">{head}{rng.choice(("", f"""<p class="byline" data-y="0">{say(2, 5)}</p>""", f"""<p data-y="1">{say(5, 20)}</p>"""))}</header>'
            body.insert(0, head)
        if rng.random() < 0.1:
            body.append(f'<div style="display:none" data-y="0"><p data-y="0">{say(3, 40)}</p></div>')
        shell = rng.choice(("<article {}>", "<main {}>", '<div class="content" {}>', '<div id="main" {}>', '<div class="post entry" {}>', "<article {}>", "<div {}>", '<section class="story" {}>', '<div class="top-story" {}>', '<div id="main-content" class="no-comments" {}>', '<div class="post" {}>'))
        text = shell.format('data-y="1"') + "".join(body) + f"</{shell[1:].split()[0]}>"
        if rng.random() < 0.25:
            text = f'<main data-y="1">{text}</main>'
        if rng.random() < 0.35:
            text = f'<div class="{state()}" data-y="0">' + text + "</div>"
        before = [furniture(k) for k in rng.sample(kinds, rng.randint(0, 4))]
        after = [furniture(k) for k in rng.sample(("side", "ad", "comment", "form", "footer", "notice", "share"), rng.randint(0, 4))]
        pages.append(Page(f'<html data-y="0"><body data-y="0">{"".join(before)}{text}{"".join(after)}</body></html>'))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model().train(labelled_pages())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, ``text``, ``n_chars``.

    Blocks of content in page order, joined by two newlines; white space inside a block
    is one space and character references are decoded.  Only the contents of script, style,
    title, textarea, iframe, noembed and noframes are left out before the model sees them.  An
    inline element that is hidden, or named as an advert, notice, comment or sharing, is judged by
    itself, and the text around it stays one block.  Broken markup is
    read the way browsers do, in time linear in the page: a quote binds only after "=", a tag
    that never ends by that rule ends at the next ">", and a stray "<" is text.  Null, empty or text-free html
    gives an empty text.  Ids and urls may be null or repeated and are passed on.  Pages
    are independent of each other, so repeated rows get equal results, other columns are
    ignored, and an empty table gives an empty result.  ``n_chars`` counts code points.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [model.extract(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
