"""Main text of web pages: a tree-structured graphical model over the block elements of a page."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled_pages import labelled_pages
from .quality import logistic

#: Kinds of block elements; elements not named here are inline and belong to the block around them.
KINDS = {
    "p": "p", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "item", "dt": "item", "dd": "item",
    "ul": "list", "ol": "list", "dl": "list", "menu": "list", "div": "div", "section": "div", "center": "div", "details": "div", "summary": "div", "article": "article", "main": "main",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form", "legend": "form", "search": "form",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell",
    "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "address": "footer", "hgroup": "div", "body": "root", "html": "root",
}
_ORDER = sorted(set(KINDS.values()))
#: Kinds that divide a page; a change of label is likelier at them than at what they hold.
_DIVIDE = frozenset(("div", "article", "main", "nav", "header", "footer", "aside", "form", "root"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without readable text.
_MUTE = frozenset("script style noscript template iframe noembed noframes title textarea select button svg math canvas object audio video head option datalist".split())
_RAW = frozenset("script style noscript template iframe noembed noframes title textarea".split())
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_STOPS = frozenset(("table", "ul", "ol", "dl", "td", "th", "body", "html", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form", "blockquote", "figure"))

#: A quote counts only where a value begins and if it has a partner; any other ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?+)?+)*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Name parts of classes, ids and roles.
_AGAINST = re.compile(r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|menubar|header|masthead|banner|footer|foot|sidebar|side|aside|complementary|contentinfo|widget|widgets|ads?|adv|advert|adverts|advertisement|sponsor|sponsored|logo|brand|branding|promo|promotion|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|searchbox|share|sharing|social|related|recommended|breadcrumbs?|crumbs|pagination|pager|tags?|toc|copyright|legal|disclaimer|form|dialog|skip)(?:$|[-_ 0-9])")
_REPLIES = re.compile(r"(?:^|[-_ ])(?:comments?|commentlist|respond|responses?|reply|replies|disqus|discussion|talk|guestbook|feedback|reactions?|reviews?)(?:$|[-_ 0-9])")
_FOR = re.compile(r"(?:^|[-_ ])(?:article|articlebody|content|post|entry|main|story|storybody|text|hentry|body|copy|prose|page)(?:$|[-_ 0-9])")
#: Names that say how a wrapper is laid out, not what it is; those with a side only beside a name of _FOR.
_LAYOUT = re.compile(r"(?<!\S)(?:has|with|without|no|hide|show)[-_]\S+")
_SIDE = re.compile(r"(?<!\S)\S+[-_](?:left|right|none)(?!\S)")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    """A block element. y: its label where the page has labels."""

    kind: str
    parent: int
    names: str = ""
    hidden: bool = False
    chars: int = 0
    linked: int = 0
    own: int = 0
    stops: int = 0
    children: int = 0
    rights: bool = False
    titled: bool = False
    y: int = -1


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) in page order, white space not yet folded
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Block tree and text runs. Unclosed and stray tags are closed or passed over the way browsers do; no input fails."""
    page = Page([Node("root", -1)])
    nodes, runs = page.nodes, page.runs
    open_tags: list[tuple[str, int]] = [("body", 0)]  # name, node
    opened: Counter[str] = Counter(("body",))
    bounds: list[int] = [0]  # places of open paragraphs and of the tags that keep one open
    pieces: list[str] = []
    links = mute = linked = chars = 0
    mute_tag, pos, n = "", 0, len(html)

    def close_run() -> None:
        nonlocal linked, chars
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if chars:
                node = open_tags[-1][1]
                runs.append((node, text))
                nodes[node].own += chars
                nodes[node].linked += linked
            linked = chars = 0

    def pop_to(i: int) -> None:
        nonlocal links
        if any(name in KINDS for name, _ in open_tags[i:]):
            close_run()
        for name, _ in open_tags[i:]:
            opened[name] -= 1
            links -= name == "a"
        while bounds[-1] >= i:
            bounds.pop()
        del open_tags[i:]

    def push(name: str, node: int) -> None:
        if name == "p" or name in _STOPS:
            bounds.append(len(open_tags))
        opened[name] += 1
        open_tags.append((name, node))

    while pos < n:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        tag = m[1]
        if tag is None:
            text = m[0]
            if text[0] == "<":
                if text != "<":
                    continue
                if re.match("[a-zA-Z/]", html[pos : pos + 1]):  # no tag, as in "</3>", or one whose last quote never ends
                    pos = html.find(">", pos) + 1
                    if not pos:
                        break
                    continue
            if not mute:
                if "&" in text:
                    text = entities.unescape(text)
                pieces.append(text)
                size = len(text) - text.count(" ") - text.count("\n")
                chars += size
                if links:
                    linked += size
            continue
        tag = tag.lower()
        if html[m.start() + 1] == "/":
            if mute:
                if tag == mute_tag:
                    mute -= 1
                continue
            if tag == "br":
                pieces.append("\n")
            if opened[tag]:  # a stray end tag costs nothing, any other ends all it passes
                for i in range(len(open_tags) - 1, 0, -1):
                    if open_tags[i][0] == tag:
                        pop_to(i)
                        break
            continue
        if mute:
            mute += tag == mute_tag and tag not in _RAW
            continue
        if tag in _MUTE:
            if tag in _RAW:
                end = re.compile(f"</{tag}[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else n
            elif tag != "head" and not m[2].endswith("/"):
                mute, mute_tag = 1, tag
            continue
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                pieces.append("" if tag == "wbr" else "\n")
            continue
        kind = KINDS.get(tag)
        if kind is None:
            push(tag, open_tags[-1][1])
            links += tag == "a"
            continue
        if kind == "root":
            if "data-label" in m[2]:
                nodes[0].y = int('data-label="1"' in m[2])
            continue
        close_run()
        if open_tags[bounds[-1]][0] == "p":  # a block ends an open paragraph before it
            pop_to(bounds[-1])
        if tag in _ENDS and any(opened[name] for name in _ENDS[tag]):
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] in _ENDS[tag]:
                    pop_to(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif open_tags[i][0] in ("table", "ul", "ol", "dl"):
                    break
        node = Node(kind, open_tags[-1][1])
        if m[2]:
            for a in _ATTRIBUTE.finditer(m[2]):
                name, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                if name in ("class", "id", "role"):
                    node.names += f" {value}"
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    node.hidden = True
            if "data-label" in m[2]:
                node.y = int('data-label="1"' in m[2])
        nodes.append(node)
        push(tag, len(nodes) - 1)
    close_run()
    for node, text in runs:
        nodes[node].rights |= _RIGHTS.match(text) is not None
        nodes[node].stops += text.count(". ") + text.count(", ") + text.count("? ") + text.count("! ") + (text.rstrip()[-1:] in ".!?")
    inside = [False] * len(nodes)  # of an article or the main part
    for i, node in enumerate(nodes):
        node.chars = node.own
        up = nodes[node.parent]
        inside[i] = i > 0 and (inside[node.parent] or up.kind in ("article", "main"))
        if node.kind == "heading" and up.kind == "header" and inside[node.parent]:
            up.titled = True
    for i in range(len(nodes) - 1, 0, -1):
        node, parent = nodes[i], nodes[nodes[i].parent]
        parent.chars += node.chars
        parent.linked += node.linked
        parent.stops += node.stops
        parent.children += 1
    return page


FEATURES = len(_ORDER) + 12


def told(names: str) -> str:
    """Names of an element without those that only say how it is laid out."""
    names = _LAYOUT.sub(" ", names)
    return _SIDE.sub(" ", names) if any(_FOR.fullmatch(name) for name in names.split()) else names


def features(page: Page) -> np.ndarray:
    nodes = page.nodes
    x = np.zeros((len(nodes), FEATURES))
    k = len(_ORDER)
    place = {kind: i for i, kind in enumerate(_ORDER)}
    for i, node in enumerate(nodes):
        row = x[i]
        row[place[node.kind]] = 1
        if node.names:
            names = told(node.names)
            row[k] = _AGAINST.search(names) is not None
            row[k + 1] = _REPLIES.search(names) is not None
            row[k + 2] = _FOR.search(names) is not None and not row[k] and not row[k + 1]
        row[k + 3] = node.hidden
        if node.chars:
            row[k + 4] = 0 if node.stops else node.linked / node.chars
            row[k + 5] = node.stops > 0
            row[k + 6] = min(1.0, node.chars / 200)
            row[k + 7] = min(1.0, node.own / 100)
        else:
            row[k + 8] = 1
        # Linked text without a sentence; a whole paragraph may be a link.
        row[k + 9] = node.linked > 0.5 * node.chars and node.chars > 0 and not node.stops
        row[k + 10] = node.rights and node.own < 100
        row[k + 11] = node.titled
    return x


def _group(node: Node) -> int:
    return int(node.kind not in _DIVIDE)


@dataclass
class Model:
    """Local evidence (log-linear in the features) and potentials of a parent's and a child's labels: one table for
    children that divide a page, one for all others."""

    weights: np.ndarray
    prior: np.ndarray
    pair: np.ndarray
    #: How much the evidence of elements that don't divide the page counts: many of them say the same thing again.
    temper: float = 1.0

    def marginals(self, page: Page) -> np.ndarray:
        """Chance of each node to be content: sum-product over the tree, up to the root and down again. Nodes are
        numbered parents first, so two loops over them are the two passes."""
        x = features(page)
        odds = np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -12, 12)
        odds *= np.where([_group(node) for node in page.nodes], self.temper, 1.0)
        # Evidence of a node for both labels: p(y | x) / p(y).
        no = (1 / (1 + np.exp(odds)) / self.prior[0]).tolist()
        yes = (1 / (1 + np.exp(-odds)) / self.prior[1]).tolist()
        tables = [tuple(t.ravel().tolist()) for t in self.pair]
        parents = [node.parent for node in page.nodes]
        pair = [tables[_group(node)] for node in page.nodes]
        up_no, up_yes = no[:], yes[:]  # evidence of the node and all below it
        sent_no, sent_yes = [1.0] * len(no), [1.0] * len(no)
        for i in range(len(parents) - 1, 0, -1):
            a, b = up_no[i], up_yes[i]
            p00, p01, p10, p11 = pair[i]
            s, t = p00 * a + p01 * b, p10 * a + p11 * b
            total = s + t
            s, t = s / total, t / total
            sent_no[i], sent_yes[i] = s, t
            j = parents[i]
            a, b = up_no[j] * s, up_yes[j] * t
            total = a + b
            up_no[j], up_yes[j] = a / total, b / total
        out = [0.0] * len(parents)
        all_no, all_yes = [0.0] * len(parents), [0.0] * len(parents)
        all_no[0], all_yes[0] = self.prior[0] * up_no[0], self.prior[1] * up_yes[0]
        out[0] = all_yes[0] / (all_no[0] + all_yes[0])
        for i in range(1, len(parents)):
            j = parents[i]
            p00, p01, p10, p11 = pair[i]
            a, b = all_no[j] / sent_no[i], all_yes[j] / sent_yes[i]  # without what the child itself said
            s, t = (a * p00 + b * p10) * up_no[i], (a * p01 + b * p11) * up_yes[i]
            total = s + t
            all_no[i], all_yes[i] = s / total, t / total
            out[i] = all_yes[i]
        return np.array(out)


def train(pages: list[str]) -> Model:
    """Weights and potentials from labelled pages: elements with data-label, and those inside them, have that label;
    all others are no content."""
    xs, ys, parsed = [], [], []
    pairs = np.ones((2, 2, 2))
    for source in pages:
        page = parse(source)
        for i, node in enumerate(page.nodes):
            if node.y < 0:
                node.y = page.nodes[node.parent].y if i else 0
            if i:
                pairs[_group(node), page.nodes[node.parent].y, node.y] += 1
        parsed.append(page)
        xs.append(features(page))
        ys.append(np.array([node.y for node in page.nodes], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    weights = logistic(np.column_stack([x, np.ones(len(x))]), y, penalty=2e-4)
    model, best = Model(weights, np.array([0.5, 0.5]), pairs / pairs.sum(2, keepdims=True)), -1
    for temper in (1.0, 0.7, 0.5, 0.35, 0.2, 0.1):  # the one that gets most text runs of the labelled pages right
        trial, right = Model(model.weights, model.prior, model.pair, temper), 0
        for page in parsed:
            chance = trial.marginals(page)
            right += sum((chance[node] >= 0.5) == (page.nodes[node].y == 1) for node, _ in page.runs)
        if right > best:
            model, best = trial, right
    return model


def main_text(model: Model, html: str) -> str:
    page = parse(html)
    if not page.runs:
        return ""
    chance = model.marginals(page)
    blocks = (_SPACE.sub(" ", text).strip() for node, text in page.runs if chance[node] >= 0.5)
    return "\n\n".join(b for b in blocks if b)


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), labelled: list[str] | None = None) -> DataFrame:
    """One row per page: id, the columns to keep, text.

    Each page is parsed into a tree of block elements. Every element has local
    evidence (its kind, names, links, sentences); potentials between parents and
    children, both learnt from labelled pages, connect it with the tree, and
    message passing up and down gives its chance to be content. The text runs of
    elements with a chance of a half or more are the main text: references
    decoded, white space in a block folded, blocks joined by an empty line.

    Null and empty pages give an empty text. Pages are independent of each
    other: no shuffle, and rows that repeat are extracted each for itself.
    """
    model = spark.sparkContext.broadcast(train(labelled_pages() if labelled is None else labelled))
    names = [id_col, *keep]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(model.value, h.as_py() or "") for h in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found, pa.string())], schema.names)

    return pages.select(*[F.col(c) for c in names], F.col(html_col)).mapInArrow(run, schema)
