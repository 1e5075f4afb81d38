"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of its block elements and their runs of text. Each node has one of three
states: inside the article (C), boilerplate (B), or a container of both (M). A node's features (tag,
words of its class and id, share of link text, length, sentence marks) give it a potential, a parent and
its child a joint one; both are relative counts from labelled pages. Sum-product messages go up and down
the tree once, which gives exact marginals; the runs whose marginal of C is at least one half are the
text, in page order, one block each.

The labelled pages are made by `labelled_pages`: layouts of known structure with invented words, in
which an attribute marks the article and what in it is no part of it.

Nulls: a null or empty page, and one without an article, has an empty text; a null url or page_id is
kept. Repeated rows each get their text. Unclosed comments and raw elements (script, style, title and their like) end with
the page, other unclosed elements with their parent, a head at the first tag that cannot stand in it; a quote
that is never closed is a character like others, and a tag that is never closed ends the page. Parsing takes time in proportion to the
page, whatever its tags. Empty tables give an empty result. Further columns are left aside.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Elements of the HTML standard: those that part blocks, and those whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is raw text, those of the head, and others whose content is no text of the page.
RAW_TAGS = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
DROPPED_TAGS = frozenset("template svg object canvas audio video select button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
TAG_MARK = re.compile(r"[>\"']")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-label\s*=\s*\"(\w+)\"")
PIECE = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|\Z)")

# Words in class and id names, by what they speak for.
GOOD_WORDS = frozenset("article articlebody content contents entry main mainbody post story text body page prose copy".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs byline comment comments consent contact contentinfo complementary cookie cookies disqus footer foot form header "
    "head login masthead menu meta modal nav navbar navigation newsletter notice pager pagination paging popup privacy promo promotion promoted recommended related "
    "replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar top topbar warning widget widgets".split()
)

STATES = ("C", "B", "M")


class Node:
    __slots__ = ("tag", "names", "parent", "text", "links", "chars", "marks", "label", "linked")

    def __init__(self, tag: str, names: str, parent: int, label: str | None):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.text: str | None = None
        self.links = self.chars = self.marks = self.linked = 0


class Scanner:
    """Tags of a page in order. Each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at `at` ends: behind its `>`, which no quotes hold; -1 if it never does."""
        page = self.page
        while m := TAG_MARK.search(page, at):
            at, mark = m.end(), m[0]
            if mark == ">":
                return at
            if mark not in self.unclosed:
                close = page.find(mark, at)
                if close < 0:
                    self.unclosed.add(mark)  # nor is there one behind later quotes
                else:
                    at = close + 1
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, "/" or "", tag in lower case, attributes); the last one has no tag."""
        page, at, begin = self.page, 0, 0
        while m := OPENING.search(page, at):
            if m[2] is None:
                close = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
                yield page[begin : m.start()], "", "", ""
                at = begin = len(page) if close < 0 else close + (3 if m[0] == "<!--" else 1)
                continue
            end = self.tag_end(m.end())
            yield page[begin : m.start()], m[1], m[2].lower() if end >= 0 else "", page[m.end() : end - 1]
            if end < 0:
                return
            at = begin = end
            tag = m[2].lower()
            if not m[1] and tag in RAW_TAGS and page[end - 2] != "/":
                close = RAW_END[tag].search(page, end)
                at = begin = self.tag_end(close.end()) if close else len(page)
                if at < 0:
                    return
        yield page[begin:], "", "", ""


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first; runs of text are nodes with the tag '#' and that of their element."""
    nodes = [Node("html", "", -1, None)]
    stack, run, linked, in_link = [0], [], 0, 0
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
    hidden, depth, head = "", 0, False

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                n = Node("#" + nodes[stack[-1]].tag, "", stack[-1], None)
                n.text, n.chars = text, len(text)
                n.linked = min(linked, len(text))
                n.marks = text.count(". ") + text.count(", ") + text.count("? ") + (text[-1] in ".!?")
                nodes.append(n)
            linked = 0

    def close_to(level: int) -> None:
        while len(stack) > level:
            places[nodes[stack.pop()].tag].pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for piece, slash, tag, attrs in Scanner(page):
        if piece and not hidden and not head:
            piece = unescape(piece) if "&" in piece else piece
            run.append(piece)
            if in_link:
                linked += len(piece)
        if not tag:
            continue
        if head:
            head = tag in HEAD_TAGS and not (slash and tag == "head")
            if head or tag == "head":
                continue
        if hidden:
            if tag == hidden:
                depth += -1 if slash else 0 if attrs.endswith("/") else 1
                if not depth:
                    hidden = ""
                continue
            if not (slash and places.get(tag)):  # the end of what the hidden element is in ends it as well
                continue
            hidden = ""
        if not slash:
            if tag in DROPPED_TAGS:
                if not attrs.endswith("/"):
                    hidden, depth = tag, 1
            elif tag == "head":
                head = True
            elif tag == "a":
                in_link += 1
            elif tag == "br":
                run.append(" ")
            elif tag in BLOCK_TAGS:
                close_run()
                if tag in ("html", "hr"):
                    continue
                if nodes[stack[-1]].tag == "p" or (tag in ("p", "div", "ul", "ol", "section") and any(nodes[i].tag == "p" for i in stack[-2:])):
                    while any(nodes[i].tag == "p" for i in stack[-2:]):
                        close_to(len(stack) - 1)
                if tag in CLOSES:
                    level = last(CLOSES[tag])
                    if level > last(BARRIERS[tag]):
                        if tag == "tr":  # the cell is in a row that ends with it
                            level = min([level, *(places[t][-1] for t in ("tr",) if places.get(t) and places[t][-1] > last(BARRIERS[tag]))])
                        close_to(level)
                in_link = 0
                label = LABEL.search(attrs) if "data-label" in attrs else None
                names = " ".join(x or y or z for x, y, z in NAMES.findall(attrs)) if attrs else ""
                nodes.append(Node(tag, names, stack[-1], label[1] if label else None))
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
        elif tag == "a":
            in_link = max(0, in_link - 1)
        elif tag in BLOCK_TAGS and places.get(tag):
            close_run()
            close_to(places[tag][-1])
            in_link = 0
    close_run()
    for n in reversed(nodes):  # sums over what is below
        if n.text is None:
            n.linked = n.links
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars += n.chars
            up.links += n.linked
            up.marks += n.marks
    return nodes


def speaks(names: str) -> str:
    """What the words of class and id names speak for."""
    if not names:
        return "none"
    words = {w.lower() for w in PIECE.findall(names)}
    bad, good = bool(words & BAD_WORDS), bool(words & GOOD_WORDS)
    return "bad" if bad else "good" if good else "other"


def step(x: float, bounds: tuple) -> int:
    return sum(x >= b for b in bounds)


def features(n: Node) -> tuple:
    """Runs of text speak for themselves; elements only by their share of links, as the rest is said by what is in them."""
    share = step(n.linked / n.chars if n.chars else 0, (0.05, 0.3, 0.7))
    if n.text is None:
        return (("element links", share),)
    return (("links", share), ("chars", step(n.chars, (1, 25, 80, 250, 1000)), step(n.marks / n.chars * 100 if n.chars else 0, (0.2, 0.8))))


def kind(n: Node) -> tuple[str, str]:
    """Joint potentials differ by the child's tag and what its names speak for; runs of text are one kind."""
    return ("#", "") if n.text is not None else (n.tag, speaks(n.names))


class Model:
    """Potentials as smoothed relative counts from labelled pages."""

    def __init__(self, pages: list[str]):
        nodes_of, edges, found = Counter(), Counter(), {s: Counter() for s in STATES}
        kinds: dict[str, set] = {}
        for page in pages:
            nodes = parse(page)
            states = true_states(nodes)
            for n, s in zip(nodes, states, strict=True):
                nodes_of[s] += 1
                if n.parent >= 0:
                    edges[kind(n), states[n.parent], s] += 1
                for f in features(n):
                    found[s][f] += 1
                    kinds.setdefault(f[0], set()).add(f)
        sizes = {k: len(v) + 1 for k, v in kinds.items()}
        self.log: dict[tuple, tuple[float, ...]] = {}
        for k, fs in kinds.items():
            for f in fs:
                self.log[f] = tuple(math.log((found[s][f] + 0.5) / (nodes_of[s] + 0.5 * sizes[k])) for s in STATES)
        # Joint share of a child's kind and state among the children of a parent's state, smoothed toward the product of both.
        total = {a: sum(v for (_, x, _), v in edges.items() if x == a) for a in STATES}
        every = sum(total.values())
        share = [[sum(v for (_, x, y), v in edges.items() if (x, y) == (a, b)) / max(1, total[a]) for b in STATES] for a in STATES]
        self.edge: dict[tuple[str, str], list[list[float]]] = {}
        for k in {x for x, _, _ in edges} | {("", x) for x in ("none", "bad", "good", "other")}:  # "": a tag that no labelled page has
            fits = [x for x in {x for x, _, _ in edges} if x == k or not k[0] and k[1] == x[1]]
            odds = sum(v for (x, _, _), v in edges.items() if x in fits) / every
            self.edge[k] = [[(sum(edges[x, a, b] for x in fits) + 2 * odds * share[i][j]) / (total[a] + 2) / max(odds, 1e-9) for j, b in enumerate(STATES)] for i, a in enumerate(STATES)]
        self.prior = [0.05, 0.15, 0.8]
        self.potentials: dict[tuple, tuple[float, ...]] = {}

    def potential(self, n: Node) -> tuple[float, ...]:
        f = features(n)
        if f not in self.potentials:
            logs = [sum(x) for x in zip(*(self.log.get(x, (0.0, 0.0, 0.0)) for x in f), strict=True)]
            top = max(logs)
            if len(self.potentials) > 50_000:
                self.potentials.clear()
            self.potentials[f] = tuple(max(math.exp(x - top), 1e-9) for x in logs)
        return self.potentials[f]

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Of every node, by messages up to the root and down again."""
        up = [self.potential(n) for n in nodes]
        to_parent: list[tuple] = [()] * len(nodes)
        edges = [self.edge.get(k) or self.edge["", k[1]] for k in map(kind, nodes)]
        for i in range(len(nodes) - 1, 0, -1):
            (ea, eb, ec), (fa, fb, fc), (ga, gb, gc) = edges[i]
            a, b, c = up[i]
            x, y, z = ea * a + eb * b + ec * c, fa * a + fb * b + fc * c, ga * a + gb * b + gc * c
            s = x + y + z
            x, y, z = max(x / s, 1e-12), max(y / s, 1e-12), max(z / s, 1e-12)
            to_parent[i] = (x, y, z)
            p, q, r = up[nodes[i].parent]
            p, q, r = p * x, q * y, r * z
            s = p + q + r
            up[nodes[i].parent] = (max(p / s, 1e-30), max(q / s, 1e-30), max(r / s, 1e-30))
        out: list[tuple] = [()] * len(nodes)
        p, q, r = (u * w for u, w in zip(up[0], self.prior, strict=True))
        s = p + q + r
        out[0] = (p / s, q / s, r / s)
        for i in range(1, len(nodes)):
            (p, q, r), (x, y, z), (a, b, c) = out[nodes[i].parent], to_parent[i], up[i]
            (ea, eb, ec), (fa, fb, fc), (ga, gb, gc) = edges[i]
            p, q, r = p / x, q / y, r / z  # the parent without this child
            a, b, c = a * (p * ea + q * fa + r * ga), b * (p * eb + q * fb + r * gb), c * (p * ec + q * fc + r * gc)
            s = a + b + c
            out[i] = (a / s, b / s, c / s)
        return out

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        found = self.marginals(nodes)
        return "\n\n".join(n.text for n, m in zip(nodes, found, strict=True) if n.text is not None and m[0] >= 0.5)


def true_states(nodes: list[Node]) -> list[str]:
    """States from the labels: C within a labelled article, B elsewhere, M for what holds both."""
    own: list[str] = []
    for n in nodes:
        own.append({"article": "C", "other": "B"}.get(n.label) or (own[n.parent] if n.parent >= 0 else "B"))
    out = list(own)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        if out[i] in "CM" and out[p] == "B":
            out[p] = "M"
    return out


# Syllables of invented words, and class names of the layouts of labelled pages.
SYLLABLES = "ka lo mi ten ra sol ve nu par di os el ti gra mon be cha re lin fo".split()
MAIN_NAMES = ("content", "main-content", "post", "entry-content", "article-body", "story", "page-content", "text", "wrapper", "c1", "")
OTHER_NAMES = {
    "nav": ("menu", "nav", "navbar", "main-navigation", "breadcrumbs", ""),
    "header": ("header", "site-header", "masthead", "top", ""),
    "footer": ("footer", "site-footer", "foot", ""),
    "aside": ("sidebar", "side", "widget", "related-posts", ""),
    "ad": ("ad", "ads", "advert", "banner", "sponsored", "promo"),
    "notice": ("cookie-notice", "notice", "consent", "newsletter-signup", "warning-bar", "popup"),
    "comments": ("comments", "comment-list", "replies", "disqus_thread"),
    "share": ("share", "social", "tags", "meta"),
}


def labelled_pages(count: int = 800, seed: int = 5) -> list[str]:
    """Pages with data-label="article" on the article and data-label="other" on what in it is no part of it."""
    r = random.Random(seed)

    def words(n: int) -> str:
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(len(out)):
            if r.random() < 0.12 or i == len(out) - 1:
                out[i] += r.choice((".", ".", ",")) if i < len(out) - 1 else "."
        return " ".join(out).capitalize()

    def loose(n: int) -> str:
        return words(n) if r.random() < 0.6 else bare(n)

    def bare(n: int) -> str:
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize()

    def attrs(kind: str, named: float = 0.8) -> str:
        name = r.choice(OTHER_NAMES[kind]) if r.random() < named else ""
        return f' {r.choice(("class", "id"))}="{name}"' if name else ""

    def links(n: int, tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/x">{bare(r.randint(1, 4))}</a></li>' for _ in range(n)) + f"</{tag}>"

    def other(kind: str) -> str:
        mark = ' data-label="other"'
        if kind == "nav":
            tag = r.choice(("nav", "nav", "nav", "div"))
            return f"<{tag}{attrs(kind, 0.5 if tag == 'nav' else 1)}{mark}>{links(r.randint(3, 9))}</{tag}>"
        if kind == "header":
            tag = r.choice(("header", "header", "div"))
            top = r.choice((f"<p>{bare(3)}</p>", f"<h1>{bare(2)}</h1>", f"<h2>{bare(3)}</h2>", bare(2)))
            return f"<{tag}{attrs(kind, 1 if tag == 'div' else 0.5)}{mark}>{top}{links(r.randint(0, 4)) if r.random() < 0.5 else ''}<p>{words(r.randint(3, 8))}</p></{tag}>"
        if kind == "footer":
            tag = r.choice(("footer", "footer", "footer", "div"))
            inner = r.choice((f"&copy; {bare(2)} &middot; {words(r.randint(3, 10))}", f"<p>{words(6)}</p>{links(3)}", f"<p>&copy; {bare(3)}</p>"))
            return f"<{tag}{attrs(kind, 1 if tag == 'div' else 0.5)}{mark}>{inner}</{tag}>"
        if kind == "aside":
            tag = r.choice(("aside", "aside", "div", "section"))
            inner = r.choice((f"<h3>{bare(2)}</h3>{links(r.randint(2, 6))}", f"<h3>{bare(2)}</h3><p>{words(r.randint(8, 30))}</p>", f"<p>{words(r.randint(10, 40))}</p>{links(3)}"))
            return f"<{tag}{attrs(kind, 0.4 if tag == 'aside' else 1) or (' class="sidebar"' if tag != 'aside' else '')}{mark}>{inner}</{tag}>"
        if kind in ("ad", "notice", "share"):
            tag = r.choice(("div", "div", "section", "p", "aside"))
            text = words(r.randint(3, 18))
            inner = text if tag == "p" or r.random() < 0.6 else f"<p>{text}</p>"
            return f"<{tag}{attrs(kind, 1)}{mark}>{inner}</{tag}>"
        if kind == "form":
            return f"<form{mark}><p>{bare(3)}</p><label>{bare(2)}</label><input name=q><div>{words(5)}</div></form>"
        tag = r.choice(("section", "div", "ol", "ul"))
        one = "li" if tag in ("ol", "ul") else r.choice(("div", "p"))
        if r.random() < 0.4:
            return f"<{tag}{attrs('comments', 1)}{mark}>" + "".join(f"<{one}>{words(r.randint(3, 30))}</{one}>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        return f"<{tag}{attrs('comments', 1)}{mark}><h3>{bare(2)}</h3>" + "".join(f'<{one} class="comment"><p>{bare(2)}</p><p>{words(r.randint(5, 40))}</p></{one}>' for _ in range(r.randint(1, 5))) + f"</{tag}>"

    def paragraph() -> str:
        x = loose(r.choice((1, 2, 5, 12))) if r.random() < 0.4 else words(r.choice((12, 30, 60, 120)))
        if r.random() < 0.15:
            x = f"<b>{x}<br>"
            return f"<p>{x}"
        if r.random() < 0.2:
            x += f' <a href="/y">{bare(2)}</a> {words(6)}'
        return f"<p>{x}</p>"

    def article() -> str:
        body = []
        title = f"<h1>{bare(r.randint(3, 8))}.</h1>"
        body.append(r.choice((title, title, f"<header>{title}</header>", f"<header>{title}<p>{words(12)}</p></header>", "")))
        for _ in range(r.randint(1, 12)):
            roll = r.random()
            if roll < 0.72:
                body.append(paragraph())
            elif roll < 0.8:
                body.append(f"<h{k}>{bare(r.randint(2, 5))}</h{k}>" if (k := r.randint(2, 4)) else "")
            elif roll < 0.86:
                body.append("<ul>" + "".join(f"<li>{loose(r.randint(1, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif roll < 0.89:
                body.append(f"<blockquote>{r.choice((f"<p>{words(20)}</p>", loose(9)))}</blockquote>")
            elif roll < 0.9:
                body.append(f"<pre>{loose(8)}</pre>")
            elif roll < 0.92:
                body.append(f"<figure><img src=a><figcaption>{words(7)}</figcaption></figure>")
            elif roll < 0.945:
                body.append(f"<table><tr><th>{bare(2)}</th><td>{loose(4)}</td></tr><tr><td>{bare(1)}</td><td>{loose(2)}</td></tr></table>")
            else:
                body.append(other(r.choice(("ad", "ad", "share", "aside", "notice", "form", "nav"))))
        if r.random() < 0.3:
            body.append(other(r.choice(("comments", "share", "footer", "comments"))))
        return "".join(body)

    pages = []
    for i in range(count):
        kind = r.random()
        name = r.choice(MAIN_NAMES)
        mark = f' class="{name}"' if name else ""
        inner = article()
        if kind < 0.5:
            core = f'<article{mark if r.random() < 0.4 else ""} data-label="article">{inner}</article>'
        elif kind < 0.7:
            core = f'<main{mark if r.random() < 0.4 else ""} data-label="article">{inner}</main>'
        elif kind < 0.8:
            core = f'<main><article data-label="article">{inner}</article>{other("comments") if r.random() < 0.5 else ""}</main>'
        else:
            core = f'<div{mark} data-label="article">{inner}</div>'
        before = [other(k) for k in r.sample(("nav", "header", "ad", "notice", "form", "nav"), r.randint(1, 4))]
        after = [other(k) for k in r.sample(("footer", "aside", "comments", "ad", "share", "nav", "footer"), r.randint(1, 4))]
        if r.random() < 0.3:
            core = f'<div{r.choice((" class=wrapper", " id=page", " class=container", ""))}>{core}{other("aside") if r.random() < 0.6 else ""}</div>'
        pages.append("<html><head><title>x</title></head><body>" + "".join(before) + core + "".join(after) + ("</body></html>" if r.random() < 0.9 else ""))
    return pages


_model: list[Model] = []


def trained() -> Model:
    """The model of the labelled pages, made once in a process."""
    if not _model:
        _model.append(Model(labelled_pages()))
    return _model[0]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # some hundred potentials

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main_text = shared.value.main_text
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
