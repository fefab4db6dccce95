"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable (content or not). Its own evidence (element, words in class and id,
length of its text, share of links, sentence marks) gives a potential, and each parent-child edge has a
potential that depends on the child's element. A plain container without text of its own has no evidence: its
edge passes its parent's label on, at any depth. Messages go up from the leaves to the root and down again
(sum-product, exact on a tree), which gives each element's marginal; the text of elements at or over one half
is kept. Potentials are smoothed relative frequencies of labelled pages: a fixed set, built below from page
layouts, of ``TRAINING_PAGES`` pages.

Class names are evidence only where they name a kind of block and nothing else, and blocks of the article bear such
words among others in training, as do furniture blocks without any.

Defined cases: null or empty html has an empty text; broken markup is closed as browsers do for paragraphs,
lists and tables; pages of any size are read whole; equal rows give equal rows; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import by_bytes

#: Labelled pages that the potentials are fitted on.
TRAINING_PAGES = 400
#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe svg math object canvas audio video select textarea button datalist title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = frozenset("div section center span main article figure blockquote ul ol dl table thead tbody tfoot tr".split())
#: An element's start closes an open one of these, up to the element that bounds it.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "thead": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
#: Words in class, id and role, by what they tell; the first kind that is met counts.
HINTS = {
    "comment": "comment comments reply replies discussion respond disqus feedback reader",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "notice": "cookie cookies consent notice notices popup modal newsletter subscribe gdpr alert overlay toast paywall warning",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc skip",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead topbar logo branding",
    "side": "sidebar side aside related widget recommend recommended popular trending share social tags rail",
    "form": "form login signin signup search contact",
    "content": "article content post entry story main body text page",
}
_HINT = {w: kind for kind, words in HINTS.items() for w in words.split()}
#: Words that say where or how a block stands, and not what it holds.
PLACES = frozenset("area bar block bottom box button buttons center col column container count first fixed global group header icon icons inner item items last left link links list main outer page panel posts primary right row secondary section site slot sticky sub title top unit widget wrap wrapper".split())
_KINDS = list(HINTS)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "hint", "parent", "children", "text", "linked", "label", "order")

    def __init__(self, tag: str, hint: str, parent: "Node | None", label: str | None = None):
        self.tag, self.hint, self.parent, self.label = tag, hint, parent, label
        self.children: list[Node] = []
        self.text: list[tuple[int, str]] = []  # (place in the page, words), one entry for each block
        self.linked = 0


def hint_of(attributes: list[tuple[str, str | None]]) -> str:
    """What a name in class, id or role says of a block, if all its words speak of kinds of blocks or of places: "ad-slot-2" is an advert, "search-history" or "tags-explained" may be a topic and says nothing."""
    found = set()
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if all(w in _HINT or w in PLACES or len(w) == 1 for w in words):
                    found |= {_HINT[w] for w in words if w in _HINT}
    return next((k for k in _KINDS if k in found), "none")


class Builder(HTMLParser):
    """Tree of block elements; inline elements only add to the text of their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "none", None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.live = Counter()  # open elements by tag: an end tag without one is passed over at once
        self.hidden: list[str] = []
        self.links = self.place = 0
        self.piece: list[str] = []
        self.nodes = [self.root]

    def flush(self) -> None:
        if self.piece:
            words = _SPACE.sub(" ", "".join(self.piece)).strip()
            self.piece.clear()
            if words:
                self.open[-1][1].text.append((self.place, words))
                self.place += 1

    def close_to(self, at: int) -> None:
        self.flush()
        for tag, _ in self.open[at:]:
            self.live[tag] -= 1
            self.links -= tag == "a" and self.links > 0
        del self.open[at:]

    def implied(self, tag: str) -> None:
        if tag in CLOSES_P:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] == "p":
                    self.close_to(at)
                    break
                if self.open[at][0] not in INLINE:
                    break
        if tag in IMPLIED:
            closes, bounds = (set(x.split()) for x in IMPLIED[tag])
            first = None
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] in bounds:
                    break
                if self.open[at][0] in closes:
                    first = at
            if first is not None:
                self.close_to(first)

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
            if tag != "body":
                return
            self.hidden.clear()  # a head that was never closed
        if tag in ("br", "hr") or tag in VOID:
            if tag == "hr":
                self.implied(tag)
                self.flush()
            elif tag == "br":
                self.piece.append(" ")
            return
        if tag in HIDDEN:
            self.hidden.append(tag)
            return
        if tag in ("html", "body"):
            return
        hint = hint_of(attrs) if attrs else "none"
        if tag in INLINE and (hint in ("none", "content") or tag == "a"):
            self.links += tag == "a"
            self.live[tag] += 1
            self.open.append((tag, self.open[-1][1]))
            return
        self.implied(tag)
        self.flush()
        parent = self.open[-1][1]
        node = Node(tag, hint, parent, dict(attrs).get("data-label"))
        parent.children.append(node)
        self.nodes.append(node)
        self.live[tag] += 1
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if not self.live[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                if tag in INLINE and self.open[at][1] is self.open[at - 1][1]:
                    inner = self.open[at + 1 :]
                    if any(t not in INLINE for t, _ in inner):
                        return
                    self.links -= tag == "a" and self.links > 0
                    self.live[tag] -= 1
                    del self.open[at]
                else:
                    self.close_to(at)
                return
            if tag in INLINE and self.open[at][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.piece.append(data)
            if self.links:
                self.open[-1][1].linked += len(data.strip())


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents before children."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.nodes


def plain_container(node: Node) -> bool:
    return not node.text and node.hint == "none" and node.tag in CONTAINERS


def features(node: Node) -> tuple[str, ...]:
    if plain_container(node):
        return ()
    if not node.text and node.parent is None:
        return ("root",)
    if not node.text:
        return (f"tag {node.tag}", f"hint {node.hint}")
    size = sum(len(t) for _, t in node.text)
    words = " ".join(t for _, t in node.text)
    length = min(6, size.bit_length() // 2)
    density = min(3, 4 * node.linked // size)
    marks = min(2, sum(words.count(c) for c in ".!?,;"))
    return (f"tag {node.tag}", f"hint {node.hint}", f"size {length}", f"links {density}", f"marks {marks}")


def edge_kind(node: Node) -> str:
    """What the potential between a node and its parent depends on: its name's kind, whether it only contains, whether it stands loose in the page."""
    if node.hint not in ("none", "content"):
        return f"hint {node.hint}"
    if plain_container(node):
        return f"plain {node.tag}"
    return f"loose {node.tag}" if node.parent.parent is None else node.tag


class Model:
    """Log potentials: of each feature and of each (parent's label, label) by the child's element."""

    def __init__(self, pages: list[str]):
        seen = {0: Counter(), 1: Counter()}
        edges: dict[str, Counter] = {}
        number = Counter()
        for page in pages:
            labels: dict[int, int] = {}
            for node in parse(page):
                above = labels.get(id(node.parent), int(page.startswith(BARE)))
                y = labels[id(node)] = {"content": 1, "other": 0, None: above}[node.label]
                number[y] += 1
                seen[y].update(features(node))
                if node.parent is not None:
                    for kind in (edge_kind(node), node.tag, "*"):
                        edges.setdefault(kind, Counter())[above, y] += 1
        self.unary = {f: math.log((seen[1][f] + 0.5) / (number[1] + 1)) - math.log((seen[0][f] + 0.5) / (number[0] + 1)) for f in {*seen[0], *seen[1]}}
        self.edge = {kind: [[math.log((c[a, b] + 0.5) / (c[a, 0] + c[a, 1] + 1)) for b in (0, 1)] for a in (0, 1)] for kind, c in edges.items()}

    def pair(self, node: Node) -> list[list[float]]:
        return self.edge.get(edge_kind(node)) or self.edge.get(node.tag) or self.edge["*"]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node: one pass up, one down."""
        at = {id(n): i for i, n in enumerate(nodes)}
        own = [sum(self.unary.get(f, 0.0) for f in features(n)) for n in nodes]  # log odds of the evidence
        up = [[0.0, 0.0] for _ in nodes]  # messages to the parent
        belief = [[0.0, o] for o in own]  # evidence and messages of the children
        for i in range(len(nodes) - 1, 0, -1):
            pair, b = self.pair(nodes[i]), belief[i]
            up[i] = [_sum(pair[a][0] + b[0], pair[a][1] + b[1]) for a in (0, 1)]
            above = belief[at[id(nodes[i].parent)]]
            above[0] += up[i][0]
            above[1] += up[i][1]
        total = [list(b) for b in belief]
        for i in range(1, len(nodes)):
            parent, pair = total[at[id(nodes[i].parent)]], self.pair(nodes[i])
            rest = [parent[a] - up[i][a] for a in (0, 1)]
            for y in (0, 1):
                total[i][y] += _sum(rest[0] + pair[0][y], rest[1] + pair[1][y])
        return [1 / (1 + math.exp(min(700.0, t[0] - t[1]))) for t in total]


def _sum(a: float, b: float) -> float:
    """Log of the sum of exponentials."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


#: Begins a training page whose loose text is its content.
BARE = "<html data-label=content>"


def training_pages(n: int = TRAINING_PAGES) -> list[str]:
    """Labelled pages: random words in common layouts; data-label marks content and other blocks, children inherit."""
    rng = random.Random(11)
    syllables = "an be cor da el fi gan ho in ja ku lo mi na or pa qui ra su ta un ve".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 5, b: int = 25) -> str:
        return words(a, b).capitalize() + rng.choice(".....!?")

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6])))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(k))

    def other() -> str:
        kind = rng.choice(_KINDS[:-1])
        name, tag = rng.choice(HINTS[kind].split()), rng.choice(["div", "div", "section", "aside", "ul" if kind == "nav" else "div"])
        inner = rng.choice([f"<p>{sentence()}</p>", f"<p>{paragraph()}</p>", sentence(3, 12), f"<ul>{links(4)}</ul>", f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>", f"<div><p>{paragraph()}</p></div>", block(), block() + block(), f"<h2>{words(1, 4)}</h2>{block()}{block()}", f"<h2>{words(1, 2)}</h2><div><p>{paragraph()}</p></div>"])
        return f'<{tag} class="{name}" data-label="other">{inner}</{tag}>' if tag != "ul" else f'<ul class="{name}" data-label="other">{links(5)}</ul>'

    def plain(within: bool = False) -> str:
        kinds = [f'<nav data-label="other"><ul>{links(6)}</ul></nav>', f'<aside data-label="other"><h4>{words(1, 3)}</h4><ul>{links(4)}</ul></aside>', f'<aside data-label="other"><p>{paragraph()}</p></aside>', f'<aside data-label="other">{block()}{block()}</aside>', f'<form data-label="other">{block()}</form>', f'<footer data-label="other">{block()}</footer>', f'<header data-label="other">{block()}</header>', f'<form data-label="other"><p>{sentence(2, 8)}</p><input></form>', f'<header data-label="other"><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>', f'<footer data-label="other"><p>&copy; {sentence(3, 10)}</p></footer>', f'<footer data-label="other">&copy; {words(2, 4)} &middot; {sentence(3, 12)}</footer>', f'<div data-label="other"><ul>{links(5)}</ul></div>']
        return rng.choice([k for k in kinds if not (within and k.startswith("<header"))])  # an article's own header is part of it

    def wrapped(text: str) -> str:
        """The text within a few plain containers."""
        for _ in range(rng.choice([0, 0, 0, 0, 1, 2, 4])):
            tag = rng.choice(["div", "div", "div", "section"])
            text = f"<{tag}>{text}</{tag}>"
        return text

    def block() -> str:
        return rng.choices([f"<p>{paragraph()}</p>", f"<p>{words(1, 3)}.</p>", f"<h2>{words(2, 7)}</h2>", f"<ul><li>{sentence()}</li><li>{words(1, 4)}</li><li>{words(1, 4)}</li></ul>", f"<ol><li>{sentence()}</li><li>{words(2, 5)}</li></ol>", f"<blockquote><p>{paragraph()}</p></blockquote>", f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr></table>", f"<pre>{words(3, 20)}</pre>", f"<figure><figcaption>{sentence(3, 8)}</figcaption></figure>", f"<dl><dt>{words(1, 2)}</dt><dd>{sentence()}</dd></dl>", f'<p>{sentence()} <a href="/">{words(1, 3)}</a> {sentence()}</p>', f"<section><h3>{words(2, 5)}</h3><p>{paragraph()}</p></section>", f"<div>{paragraph()}</div>", f'<p><a href="/">{sentence()}</a></p>'], [12, 3, 3, 2, 2, 1, 1, 1, 1, 1, 2, 1, 1, 1])[0]

    def topic(text: str) -> str:
        """A part of an article under a name that holds a word of a kind of blocks among others."""
        name = f"{rng.choice(list(_HINT))}-{words(1, 1)}"
        return rng.choice([f'<section class="{name}">{text}</section>', f'<div class="{name}">{text}</div>', f'<section id="{name}"><h2>{words(1, 4)}</h2>{text}</section>'])

    def loose() -> str:
        """A page without a container: paragraphs alone, or text alone."""
        if rng.random() < 0.3:
            return f"{BARE}{paragraph()}"
        own = re.sub(r"(^|>)<(p|h1|h2)>", r"\1<\2 data-label=content>", "".join(f"<p>{paragraph()}</p>" for _ in range(rng.choice([1, 1, 2, 5]))))
        first = rng.choice(["", f"<h1 data-label=content>{words(2, 9)}</h1>"])
        return f"<html><body>{rng.choice(['', plain()])}{first}{own}{rng.choice(['', plain()])}</body></html>"

    out = []
    for k in range(n):
        if k % 12 == 11:
            out.append(loose())
            continue
        title = f"<h1>{words(2, 9)}{rng.choice(['', '.'])}</h1>"
        title = rng.choice([title, title, title, f"<header>{title}</header>", f"<header>{title}<p>{sentence(2, 8)}</p></header>"])
        body = [title] + [wrapped(block()) if rng.random() < 0.92 else topic(block() + block()) for _ in range(rng.choice([1, 3, 6, 12, 25]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(1, len(body)), rng.choice([other, lambda: plain(True)])())
        opened, closed = rng.choice([("<article data-label=content>", "</article>")] * 3 + [("<main data-label=content>", "</main>"), ('<div class="content" data-label=content>', "</div>"), ('<div class="post" data-label=content>', "</div>"), ('<div id="article-body" data-label=content>', "</div>"), ("<main><article data-label=content>", "</article></main>"), ("<div data-label=content>", "</div>"), (f'<div class="{rng.choice(list(_HINT))}-{words(1, 1)}" data-label=content>', "</div>")])
        before = [wrapped(rng.choice([other, plain])()) for _ in range(rng.randint(0, 3))]
        after = [wrapped(rng.choice([other, plain])()) for _ in range(rng.randint(0, 3))]
        out.append(f"<html><body>{''.join(before)}{opened}{''.join(body)}{closed}{''.join(after)}</body></html>")
    return out


@cache
def trained() -> Model:
    """The model, fitted once in a process."""
    return Model(training_pages())


def main_text(model: Model, html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    kept = [t for n, p in zip(nodes, model.marginals(nodes)) if p >= 0.5 for t in n.text]
    return " ".join(words for _, words in sorted(kept))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and text."""
    model = trained()
    source = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, len(keep)):
            text = pa.array([main_text(model, h) for h in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], text], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, text string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    done = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
