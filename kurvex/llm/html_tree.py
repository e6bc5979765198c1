"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element and each run of text is a node with the label content or boilerplate.  Node potentials
come from what the node is (tag, class words, text length, link share, punctuation), edge potentials
from the labels of parent and child; messages go up and down the tree (sum-product) and give every
node's content marginal.  Potentials are relative frequencies of labelled training pages.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import small_batches, tidy

#: A tag with its attributes; a quote only opens a value right after an equals sign.  Nothing is given back, so time is linear.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
#: The same without quotes, for what follows a value that is never closed.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: HTML's void, raw-text and block elements, and what implies the end of an open element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
NEVER = set("script style noscript template iframe noembed noframes title select option datalist button input textarea".split())
#: Elements of drawings and formulas, which a slash may end.
DRAWN = set("svg path g use circle rect line polyline polygon ellipse stop math mspace".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Class and id words that tell boilerplate or content, one feature each.
CUES = {
    "ad": "ad ads advert advertisement advertising banner sponsor sponsored promo promotion",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead topbar logo",
    "foot": "footer copyright legal colophon",
    "side": "sidebar aside widget related recommended trending popular teaser rail",
    "talk": "comment comments reply replies respond disqus discussion",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toolbar",
    "form": "form search login share social sharing buttons",
    "body": "article content post entry story body main text maincontent articlebody",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_TAGS = {t: f"t:{t}" for t in "article main section p h1 h2 h3 h4 h5 h6 blockquote pre figcaption nav aside footer header form ul ol li table td div a span b i em strong code".split()}


#: Share of the weight of features that repeat what others of the same node or its text already tell.
DEPENDENT = 0.4
#: Share of training pages without an element around the article.
BARE = 0.15


class Node:
    __slots__ = ("tag", "parent", "cues", "text", "children", "label")

    def __init__(self, tag: str, parent: int, cues: tuple = (), text: str | None = None, label: int | None = None):
        self.tag, self.parent, self.cues, self.text, self.children, self.label = tag, parent, cues, text, [], label


def tokens(page: str):
    """(kind, value) of the page's texts, start tags and end tags in order, in linear time.

    Kinds: text; open (name, attributes, where the tag ends); close (name).  ``send`` a place to go on from there.
    Comments and declarations are passed over; a tag that never ends takes the rest of the page, as in HTML.
    """
    pos = begin = 0
    last, tag = page.rfind(">"), _TAG
    while True:
        at = page.find("<", pos)
        if at < 0:
            yield "text", page[begin:]
            return
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            yield "text", page[begin:at]
            end = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            pos = begin = end + 1 if end > at else len(page)
        elif mark.isascii() and mark.isalpha() or mark == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha():
            if at > last:
                yield "text", page[begin:at]
                return
            m = tag.match(page, at)
            if m is None:  # a quote that closes behind the last tag: quotes tell nothing from here on
                tag = _PLAIN
                continue
            yield "text", page[begin:at]
            pos = begin = m.end()
            pos = begin = (yield ("close", m[2].lower()) if m[1] else ("open", (m[2].lower(), m[3], pos))) or pos
        else:
            pos = at + 1


def parse(page: str, labelled: bool = False) -> list[Node]:
    """Nodes in page order, node 0 the root; text nodes have the tag ``#``.

    Bad markup never fails: strays are dropped, open elements end with their parent.  Open elements are looked up by
    name, so that the time is linear in the page however deep it is.
    """
    nodes = [Node("html", -1)]
    stack = [0]
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    blocks = [0]

    def add(node: Node) -> int:
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            places[nodes[stack.pop()].tag].pop()
        while blocks[-1] >= k:
            blocks.pop()

    found, goto = tokens(page), None
    while True:
        try:
            kind, value = found.send(goto)
        except StopIteration:
            return nodes
        goto = None
        if kind == "text":
            if value:
                add(Node("#", stack[-1], text=html.unescape(value)))
            continue
        if kind == "close":
            if places.get(value):
                close(places[value][-1])
            continue
        tag, attrs, pos = value
        if tag in ("html", "head", "body"):
            if labelled and tag == "body":
                nodes[0].label = int('data-label="1"' in attrs)
            continue
        if tag in CLOSES:
            if (k := last(CLOSES[tag])) > last(SCOPE[tag]):
                close(k)
        elif tag in BLOCK and nodes[stack[blocks[-1]]].tag == "p":  # a block ends an open paragraph and what is open inside it
            close(blocks[-1])
        cues: tuple = ()
        label = None
        if attrs.strip(" /"):
            words = {_CUE[w] for a in _ATTR.findall(attrs) for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a).lower()) if w in _CUE}
            cues = tuple(sorted(words | ({"hidden"} if _HIDDEN.search(attrs) else set())))
            if labelled and "data-label" in attrs:
                label = int('data-label="1"' in attrs)
        node = add(Node(tag, stack[-1], cues, label=label))
        if tag in RAW or tag == "xmp":
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if tag == "xmp":
                add(Node("#", node, text=page[pos : end.start() if end else len(page)]))
            goto = end.end() if end else len(page)
        elif tag not in VOID and not (tag in DRAWN and attrs.rstrip().endswith("/")):  # HTML ignores the slash of its own elements
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)


def _size(n: int) -> int:
    return min(7, n.bit_length())


def node_features(nodes: list[Node]) -> list[tuple]:
    """What each node shows: tag, class cues, length, share of links, ends of sentences."""
    size, linked, stops = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if x.tag == "#":
            t = x.text
            size[i] = len(t.split())
            stops[i] = t.count(". ") + t.count(".\n") + t.rstrip().endswith((".", "!", "?"))
        if x.tag == "a":
            linked[i] = size[i]
        if x.tag not in NEVER:
            p = x.parent
            size[p] += size[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
    return [
        (None, (), _size(size[i]), min(stops[i], 2)) if x.tag == "#" else (x.tag, x.cues, 4 * linked[i] // size[i] if size[i] else 4)
        for i, x in enumerate(nodes)
    ]


def features_of(shown: tuple) -> list[str]:
    """Feature names of what a node shows."""
    if shown[0] is None:
        return [f"len:{shown[2]}", f"stop:{shown[3]}"]
    tag, cues, share = shown
    return [_TAGS.get(tag, "t:other"), *(f"c:{c}" for c in cues), *([f"links:{share}"] if tag in BLOCK else [])]


class TreeModel:
    """Log potentials: features given label, child label given parent label, root label."""

    def __init__(self, feature: dict[str, np.ndarray], edge: np.ndarray, root: np.ndarray):
        self.feature, self.edge, self.root = feature, edge, root
        self.e = [float(x) for x in np.exp(edge).ravel()]
        self.r = [float(x) for x in np.exp(root)]
        self.known: dict[tuple, float] = {}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Content marginal of every node: messages to the root, then back (children stand after their parents)."""
        n, known = len(nodes), self.known
        e00, e01, e10, e11 = self.e
        own = []  # probability of content, given what stands at or below the node so far
        for shown in node_features(nodes):
            if (p := known.get(shown)) is None:
                if len(known) > 50_000:
                    known.clear()
                p = known[shown] = self._own(features_of(shown))
            own.append(p)
        up = [0.5] * n
        for i in range(n - 1, 0, -1):
            b = own[i]
            m1 = e10 * (1 - b) + e11 * b
            up[i] = m1 = m1 / (m1 + e00 * (1 - b) + e01 * b)
            p = nodes[i].parent
            q = own[p] * m1
            own[p] = q / (q + (1 - own[p]) * (1 - m1))
        r = own[0] * self.r[1]
        out = [r / (r + (1 - own[0]) * self.r[0])] * n
        for i in range(1, n):
            p = out[nodes[i].parent]
            u = up[i]
            a, z = p * (1 - u), (1 - p) * u  # the parent's belief without this child's own message, times u * (1 - u)
            b = own[i]
            b1 = b * (z * e01 + a * e11)
            out[i] = b1 / (b1 + (1 - b) * (z * e00 + a * e10))
        return out

    def _own(self, features: list[str]) -> float:
        d = sum(self.feature.get(f, 0.0) for f in features)
        return float(1 / (1 + np.exp(-min(12.0, max(-12.0, d)))))

    def text(self, page: str) -> str:
        """The blocks with a content marginal of at least one half, white space collapsed, joined by one space."""
        nodes = parse(page)
        m = self.marginals(nodes)
        dead = [False] * len(nodes)
        out: list[str] = []
        for i, x in enumerate(nodes):
            dead[i] = (i > 0 and dead[x.parent]) or x.tag in NEVER
        self._walk(nodes, m, dead, out)
        return _SPACE.sub(" ", "".join(out)).strip()

    @staticmethod
    def _walk(nodes: list[Node], m: list[float], dead: list[bool], out: list[str]) -> None:
        todo = [(0, False)]
        while todo:
            i, done = todo.pop()
            x = nodes[i]
            if done or x.tag in BLOCK or x.tag == "br":
                out.append(" ")
            if done or dead[i]:
                continue
            if x.tag == "#":
                if m[i] >= 0.5:
                    out.append(x.text)
                continue
            if x.tag in BLOCK:
                todo.append((i, True))
            todo += [(c, False) for c in reversed(x.children)]


def fit_tree_model(pages: list[str], smooth: float = 1.0) -> TreeModel:
    """Relative frequencies over labelled pages: elements carry ``data-label`` (1 content, 0 boilerplate), inherited below."""
    feature: dict[str, list[float]] = {}
    edge = np.full((2, 2), smooth)
    root, seen = np.full(2, smooth), np.full((2, 2), smooth)  # seen: by kind (element, text) and label
    for page in pages:
        nodes = parse(page, labelled=True)
        shown = node_features(nodes)
        for i, x in enumerate(nodes):
            x.label = x.label if x.label is not None else nodes[x.parent].label if i else 0
            if i:
                edge[nodes[x.parent].label, x.label] += 1
            else:
                root[x.label] += 1
            seen[int(x.tag == "#"), x.label] += 1
            for f in features_of(shown[i]):
                feature.setdefault(f, [smooth, smooth])[x.label] += 1
    weights = {}
    for f, c in feature.items():
        kind = int(f.startswith(("len", "stop")))
        w = (np.log(c[1] / seen[kind, 1]) - np.log(c[0] / seen[kind, 0])) * (DEPENDENT if f.startswith(("len", "stop", "links")) else 1)
        weights[f] = float(np.clip(w, -5, 5))
    return TreeModel(weights, np.log(edge / edge.sum(1, keepdims=True)), np.log(root / root.sum()))


def training_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Labelled pages of many layouts, made from a seed: menus, headers, notices, adverts, sidebars, forms, comments, articles, footers."""
    r = random.Random(seed)
    syll = "an ber co de el fa ge ha in ja ko la mi no or pa qui re so ta un ve wo xi ya zu".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + r.choice(["." if r.random() < 0.9 else "!", ".", "?"])
    para = lambda: " ".join(sentence() for _ in range(r.randint(1, 7)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def off(tag: str, inner: str, names: str = "") -> str:
        cls = f' class="{r.choice(names.split())}"' if names and r.random() < 0.8 else ""
        return f'<{tag} data-label="0"{cls}>{inner}</{tag.split()[0]}>'

    def junk() -> str:
        return r.choice([
            lambda: off(r.choice(["nav", "div", "ul"]), f"<ul>{links(r.randint(3, 9))}</ul>", "menu navbar navigation breadcrumbs"),
            lambda: off(r.choice(["header", "div"]), f"<a href='/'>{words(1, 3)}</a> {words(0, 4)}", "header masthead topbar"),
            lambda: off(r.choice(["div", "section", "aside"]), sentence() if r.random() < 0.7 else para(), "ad advert banner sponsored promo"),
            lambda: off(r.choice(["aside", "div"]), f"<h3>{words(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul><p>{sentence()}</p>", "sidebar related widget teaser"),
            lambda: off(r.choice(["div", "div hidden", "div style='display:none'"]), f"<p>{sentence()}</p><button>{word()}</button>", "cookie consent notice alert popup newsletter"),
            lambda: off("form", f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>", "search login subscribe"),
            lambda: off(r.choice(["div", "section", "ul", "ol"]), "".join(f"<div class='comment'><b>{word()}</b><p>{para()}</p></div>" for _ in range(r.randint(1, 5))), "comments comment replies discussion"),
            lambda: off("div", "".join(f"<a href='#'>{word()}</a> " for _ in range(4)), "share social"),
        ])()

    def block() -> str:
        inner = para()
        if r.random() < 0.3:
            inner = inner.replace(" ", f" <a href='/{word()}'>{words(1, 2)}</a> ", 1)
        return r.choice([f"<p>{inner}</p>"] * 6 + [f"<p{r.choice([' hidden', ''])}>{inner}</p>"] + [f"<h2>{words(2, 6)}</h2>", f"<blockquote>{inner}</blockquote>", f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>", f"<p><b>{inner}<br>", f"<p>{words(1, 3)}.</p>", f"<pre>{words(3, 20)}</pre>", f"<table><tr><td>{words(1, 3)}</td><td>{sentence()}</td></tr></table>"])

    out = []
    for _ in range(count):
        tag = r.choice(["article"] * 5 + ["main", "div", "section"])
        cls = r.choice(["", ' class="content"', ' class="post entry"', ' id="main"']) if tag in ("article", "main") else r.choice([' class="article-body"', ' class="content"', ' id="main-content"', ""])
        head = f"<h1>{words(2, 10)}</h1>" if r.random() < 0.85 else ""
        inner = head + "".join(block() for _ in range(r.randint(1, 14)))
        if r.random() < 0.3:
            inner += junk()
        before, after = "".join(junk() for _ in range(r.randint(0, 4))), "".join(junk() for _ in range(r.randint(0, 4)))
        foot = off("footer", r.choice([f"© {word()} {words(1, 6)}", f"<p>{sentence()}</p><a href='/'>{word()}</a>", sentence()]), "footer legal copyright") if r.random() < 0.9 else ""
        bare = int(r.random() < BARE)  # no element around the article: its blocks stand in the body
        main = inner if bare else f'<{tag}{cls} data-label="1">{inner}</{tag}>'
        body = f'<body data-label="{bare}">{before}{main}{after}{foot}</body>'
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head>{body}</html>")
    return out


def _extract(model: TreeModel):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                texts = [model.text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return tidy(run)


def extract_main_text(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url and main text of every row (empty if none).

    Null and empty html have an empty text, an empty table gives no rows.  Rows are independent (no shuffle): repeated rows and
    rows without a page_id or url have their results too.  A node whose marginal is exactly one half counts as content.
    Other columns are ignored, whatever their names; a page is read whole, in time linear in its length.
    """
    small_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string")
