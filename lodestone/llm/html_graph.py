"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its runs of text as leaves. Each node has a
hidden label, content or not; a node's features give its own potential, and every edge
between parent and child a potential by the kind of child. Sum-product messages go from the
leaves up and from the root down, which is exact on a tree; a run of text is kept when its
marginal is at least one half. Weights are fitted by maximum likelihood, whose gradient is
the labels minus the marginals of the same passes, on labelled pages: by default pages
written by labelled_pages() from many page layouts, or any that carry data-content marks.

Inside a block, references are decoded and white space, line breaks included, becomes one
space; blocks are joined in page order by two line feeds.

Defined results: a null or empty page, or one without content, has empty text and 0
characters; repeated rows are extracted once each; extra columns are not read; unclosed and
misnested tags are closed where their parent ends, an unclosed comment, script or style takes
the rest of the page and no other element does; math and what object holds are text; pages
are read whole whatever their length.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe title canvas audio video annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript".split())
MATH = frozenset("math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
INLINE = MATH | frozenset("object map a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KINDS = "article main section div p h1 h2 h3 ul ol li dl nav header footer aside form button label select table tr td th blockquote pre figure figcaption details dialog menu body html address".split()
BOILER_WORDS = "nav menu sidebar side footer foot header masthead ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies disqus respond share social related recommended widget breadcrumb breadcrumbs subscribe newsletter signup login search pagination pager copyright legal toolbar skip tags toc".split()
CONTENT_WORDS = "article content post entry story main body text prose page".split()

_WORDS = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")


@dataclass
class Tree:
    """Nodes in page order, parents before children."""

    parent: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)  # element name, "#text" for a run of text
    marks: list[str] = field(default_factory=list)  # class, id and role of an element; text of a run
    linked: list[int] = field(default_factory=list)  # characters of a run that are inside links
    labels: list[int] = field(default_factory=list)  # 1, 0 or -1 where nothing is marked


#: For an opening tag, which open elements end, and which keep those outside them open.
_ALIKE = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}


def parse(page: str) -> Tree:
    """The tree of a page's blocks; scripts, styles and the like have no node.

    As browsers do, a slash at the end of a tag closes only what can't hold anything. Open
    elements are counted by name, so that deep pages take time in proportion to their length.
    """
    tree = Tree()
    stack: list[tuple[str, int]] = []  # open elements; node -1 for inline ones
    blocks: list[int] = []  # nodes of the open elements that have one
    shallow: list[Counter[str]] = []  # for each of these, the inline elements open right in it
    held: Counter[str] = Counter()  # open elements by name
    run: list[str] = []
    state = {"linked": 0}
    uneven: set[str] = set()  # names whose tags don't pair up
    unclosed: set[str] = set()  # names without a further closing tag

    def node(kind: str, marks: str, linked: int = 0, label: int = -1) -> int:
        parent = blocks[-1] if blocks else -1
        tree.parent.append(parent)
        tree.kind.append(kind)
        tree.marks.append(marks)
        tree.linked.append(linked)
        tree.labels.append(label if label >= 0 or parent < 0 else tree.labels[parent])
        return len(tree.kind) - 1

    def push(name: str, at: int) -> None:
        stack.append((name, at))
        held[name] += 1
        if at < 0:
            shallow[-1][name] += 1
        else:
            blocks.append(at)
            shallow.append(Counter())

    def pop(spot: int) -> None:
        while len(stack) > spot:
            name, at = stack.pop()
            held[name] -= 1
            if at < 0:
                shallow[-1][name] -= 1
            else:
                blocks.pop()
                shallow.pop()

    def find(names: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of these names, 0 if there is none or one of `until` comes first."""
        if not any(held[x] for x in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in until:
                return 0
            if stack[i][0] in names:
                return i
        return 0

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(run)).split())
        if text:
            node("#text", text, state["linked"])
        run.clear()
        state["linked"] = 0

    def close(at: int) -> None:
        flush()
        pop(at)

    def past(name: str, at: int) -> int:
        """Where an element without a node ends; without a closing tag only script and style take the rest of the page."""
        first, depth = 0, 1
        for tag in () if name in unclosed else re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            if name in RAW and not tag[1]:
                continue
            first = first or (tag.end() if tag[1] else 0)
            depth += -1 if tag[1] else not tag[0].endswith("/>")
            if not depth:
                return tag.end()
            if first and name in uneven:
                break
        uneven.add(name)
        if first:
            return first
        unclosed.add(name)
        return n if name in ("script", "style") else at

    push("#root", node("html", ""))
    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0 or tag + 1 >= n:
            tag = n
        if tag > at:
            piece = page[at:tag]
            run.append(piece)
            if held["a"]:
                state["linked"] += len(piece)
        if tag == n:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        if page[tag + 1] in "!?":
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        named = _NAME.match(page, tag + 1)
        if named is None:  # a lone less-than sign
            run.append("<")
            at = tag + 1
            continue
        whole = _TAG_REST.match(page, named.end())
        end = whole.end() if whole else page.find(">", named.end()) + 1
        at = end or n
        name = named.group().lower()
        if name[0] == "/":
            name = name[1:]
            if name in INLINE:
                if shallow[-1][name]:  # else it is open around a block, or not at all
                    pop(find((name,)))
            elif spot := find((name,)):
                close(spot)
            continue
        if name == "head":  # its own elements have no node either
            run.append(" ")
            continue
        if name in UNSEEN or name in RAW:
            if name in RAW or page[end - 2 : end] != "/>":
                at = past(name, at)
            run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                run.append(" " if name == "br" else "")
            continue
        if name in INLINE:
            if name not in MATH or page[end - 2 : end] != "/>":
                push(name, -1)
            continue
        flush()
        if name in PARAGRAPH_ENDS and (spot := find(("p",))):
            close(spot)
        alike, until = _ALIKE.get(name, ((), ()))
        if spot := find(alike, until):
            close(spot)
        rest = page[named.end() : end]
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest or "hidden" in rest else {}
        marks = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')} {'hidden' if 'hidden' in found or 'display:none' in found.get('style', '').replace(' ', '') else ''}".lower()
        label = {"1": 1, "0": 0}.get(found.get("data-content", ""), -1)
        push(name, node(name, marks, 0, label))
    flush()
    return tree


# --- features ---------------------------------------------------------------------------

_KIND = {k: i for i, k in enumerate([*KINDS, "#text", "other"])}
_BASE = 2 * len(_KIND)
#: own kind, parent's kind, marks, and figures of a run of text
WIDTH = _BASE + 2 * len(BOILER_WORDS) + 2 * len(CONTENT_WORDS) + 16
_MARK = {w: _BASE + i for i, w in enumerate([*BOILER_WORDS, *CONTENT_WORDS])}
_MARKS = len(_MARK)
_FIGURES = _BASE + 2 * _MARKS


def features(tree: Tree) -> np.ndarray:
    n = len(tree.kind)
    out = np.zeros((n, WIDTH), np.float32)
    inside = [False] * n  # within an article or main element
    for i, kind in enumerate(tree.kind):
        parent = tree.parent[i]
        out[i, _KIND.get(kind, _KIND["other"])] = 1
        if parent >= 0:
            out[i, len(_KIND) + _KIND.get(tree.kind[parent], _KIND["other"])] = 1
        inside[i] = kind in ("article", "main") or parent >= 0 and inside[parent]
        marked = i if kind != "#text" else parent
        if marked >= 0 and (marks := tree.marks[marked]).strip():
            for w in set(_WORDS.findall(marks)):
                if w in _MARK:
                    out[i, _MARK[w] + (_MARKS if kind == "#text" else 0)] = 1
                elif w == "hidden":
                    out[i, _FIGURES] = 1
        out[i, _FIGURES + 1] = inside[i]
        if kind == "#text":
            text = tree.marks[i]
            size, words = len(text), text.count(" ") + 1
            out[i, _FIGURES + 2] = min(1.0, tree.linked[i] / size)
            out[i, _FIGURES + 3] = tree.linked[i] >= 0.9 * size
            out[i, _FIGURES + 4] = min(1.0, np.log1p(words) / 5)
            out[i, _FIGURES + 5] = words >= 10
            out[i, _FIGURES + 6] = words >= 25
            out[i, _FIGURES + 7] = text[-1] in ".!?。\"'"
            out[i, _FIGURES + 8] = "©" in text
            out[i, _FIGURES + 9] = "|" in text
            out[i, _FIGURES + 10] = i / n
            out[i, _FIGURES + 11] = text.count(",") > 1
    return out


# --- the model --------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees one after another, with the edges ordered by depth."""

    parent: np.ndarray
    levels: list[np.ndarray]  # nodes of each depth below the roots
    kind: np.ndarray  # of the edge to the parent: 1 for a run of text, else 0
    x: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    parent, base = [], 0
    for t in trees:
        parent += [p + base if p >= 0 else -1 for p in t.parent]
        base += len(t.parent)
    depth = [0] * len(parent)
    for i, p in enumerate(parent):
        if p >= 0:
            depth[i] = depth[p] + 1
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    cuts = np.searchsorted(deep[order], np.arange(1, (deep.max() if len(deep) else 0) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    kind = np.array([k == "#text" for t in trees for k in t.kind], np.int64)
    return Forest(np.array(parent, np.int64), levels, kind, np.concatenate([features(t) for t in trees]))


@dataclass
class Model:
    weights: np.ndarray  # of the features, towards content
    edges: np.ndarray  # [kind of child, label of parent, label of child]

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds-free marginals: (n, 2) of nodes and (n, 2, 2) of the edge to the parent, by sum-product in logs."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = f.x @ self.weights
        up = own.copy()  # own potential and all messages from below
        sent = np.zeros((n, 2))
        for level in reversed(f.levels):
            sent[level] = np.logaddexp.reduce(self.edges[f.kind[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, f.parent[level], sent[level])
        total = up.copy()
        pairs = np.zeros((n, 2, 2))
        for level in f.levels:
            above = total[f.parent[level]] - sent[level]
            both = above[:, :, None] + self.edges[f.kind[level]]
            total[level] = up[level] + np.logaddexp.reduce(both, axis=1)
            pairs[level] = both + up[level][:, None, :]
        total -= np.logaddexp.reduce(total, axis=1, keepdims=True)
        flat = pairs.reshape(n, 4)
        flat = flat - np.logaddexp.reduce(flat, axis=1, keepdims=True)
        return np.exp(total), np.exp(flat).reshape(n, 2, 2)


def labelled(trees: list[Tree]) -> np.ndarray:
    """A run of text has its mark; an element is content when a run below it is."""
    out: list[np.ndarray] = []
    for t in trees:
        y = np.array([int(k == "#text" and m == 1) for k, m in zip(t.kind, t.labels)])
        for i in range(len(y) - 1, 0, -1):
            if t.parent[i] >= 0:
                y[t.parent[i]] |= y[i]
        out.append(y)
    return np.concatenate(out)


def train(pages: list[str], steps: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam, with a small quadratic penalty."""
    trees = [parse(p) for p in pages]
    f, y = forest(trees), labelled(trees)
    below = np.concatenate([x for x in f.levels]) if f.levels else np.zeros(0, np.int64)
    model = Model(np.zeros(WIDTH), np.zeros((2, 2, 2)))
    truth = np.zeros((2, 2, 2))
    np.add.at(truth, (f.kind[below], y[f.parent[below]], y[below]), 1)
    seen = f.x.T @ y
    flat = np.zeros(WIDTH + 8)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        node, pair = model.beliefs(f)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, f.kind[below], pair[below])
        g = np.concatenate([seen - f.x.T @ node[:, 1], (truth - expected).ravel()]) / len(pages) - penalty * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = Model(flat[:WIDTH], flat[WIDTH:].reshape(2, 2, 2))
    return model


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p or "") for p in pages]
    node, _ = model.beliefs(forest(trees))
    out, at = [], 0
    for t in trees:
        chance = node[at : at + len(t.kind), 1]
        out.append("\n\n".join(t.marks[i] for i, k in enumerate(t.kind) if k == "#text" and chance[i] >= 0.5))
        at += len(t.kind)
    return out


# --- labelled pages ---------------------------------------------------------------------


def labelled_pages(n: int = 320, seed: int = 11) -> list[str]:
    """Pages in many layouts whose elements carry data-content="1" or "0"."""
    rnd = random.Random(seed)
    syllables = "ta ri mo ne sul ker an dio va le pro ben shu ork im".split()

    def words(a: int, b: int) -> str:
        out = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(a, b))]
        out[0] = out[0].capitalize()
        for i in range(3, len(out), rnd.randint(4, 9)):
            out[i] += rnd.choice([",", ",", ".", ";"])
        return " ".join(out)

    def sentence(a: int = 1, b: int = 60) -> str:
        text = words(a, b)
        style = rnd.random()
        if style < 0.06:
            text = " ".join(w + rnd.choice(["***", "###", "%%%", "!!"]) for w in text.split())
        elif style < 0.12:
            text = " | ".join(text.split())
        elif style < 0.16:
            text = text.upper()
        return text + rnd.choice([".", ".", ".", "", "!", "?"])

    def link(text: str) -> str:
        return f'<a href="/{rnd.randint(1, 99)}">{text}</a>'

    def links(k: int) -> str:
        kind = rnd.choice(["ul", "ul", "div", "span"])
        items = [link(words(1, 3)) for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind == "ul" else f"<{kind}>" + rnd.choice([" | ", " ", " · "]).join(items) + f"</{kind}>"

    def boiler() -> str:
        kind = rnd.choice("nav header footer aside ad notice comments form share related crumbs legal popup login tags".split())
        classed = lambda *names: f'class="{rnd.choice(names)}"'
        text = sentence(1, 45)
        if kind == "nav":
            return f'<nav data-content="0">{links(rnd.randint(2, 8))}</nav>' if rnd.random() < 0.6 else f'<div data-content="0" {classed("menu", "nav", "main-menu", "toolbar")}>{links(rnd.randint(2, 8))}</div>'
        if kind == "header":
            return f'<header data-content="0" {classed("site-header", "masthead", "")}><h1>{words(1, 3)}</h1>{links(3)}<p>{text}</p></header>'
        if kind == "footer":
            return f'<footer data-content="0">&copy; {words(1, 3)} &middot; {text}</footer>' if rnd.random() < 0.7 else f'<div data-content="0" {classed("footer", "site-footer", "foot")}><p>{text}</p>{links(3)}</div>'
        if kind == "aside":
            return f'<aside data-content="0"><h3>{words(1, 4)}</h3><p>{text}</p>{links(3)}</aside>' if rnd.random() < 0.6 else f'<div data-content="0" {classed("sidebar", "widget", "side")}><p>{text}</p><p>{sentence(5, 40)}</p></div>'
        if kind == "comments":
            one = lambda: f'<div {classed("comment", "reply", "comment-body")}><p>{sentence(2, 60)}</p></div>'
            return f'<{(t := rnd.choice(["section", "div"]))} data-content="0" {classed("comments", "comment-list", "replies", "respond")}><h2>{words(1, 2)}</h2>{"".join(one() for _ in range(rnd.randint(1, 4)))}</{t}>'
        if kind == "form":
            return f'<form data-content="0"><label>{words(1, 3)}</label><input type="text"><button>{words(1, 2)}</button><p>{text}</p></form>'
        names = {"ad": ("ad", "ads", "advert", "sponsored", "promo", "banner"), "notice": ("notice", "cookie-notice", "cookie", "consent", "alert", "gdpr"), "share": ("share", "social"), "related": ("related", "recommended"), "crumbs": ("breadcrumb", "breadcrumbs"), "legal": ("copyright", "legal"), "popup": ("popup", "modal", "overlay"), "login": ("login", "signup", "subscribe", "newsletter"), "tags": ("tags", "pagination", "toc")}[kind]
        body = rnd.choice([text, f"<p>{text}</p>", f"<p>{text}</p><p>{sentence(3, 50)}</p>", links(3)])
        return f'<{(t := rnd.choice(["div", "div", "section", "p"] if not body.startswith("<") else ["div", "section"]))} data-content="0" {classed(*names)}>{body}</{t}>'

    def block() -> str:
        kind = rnd.choice("p p p p p p p bold h2 list quote pre table bare figure linked".split())
        if kind == "p":
            return f"<p>{sentence()}</p>"
        if kind == "bold":
            return f"<p><b>{sentence(1, 30)}<br>"
        if kind == "h2":
            return f"<h{(k := rnd.choice('23'))}>{words(1, 8)}</h{k}>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{sentence(1, 20)}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>"
        if kind == "figure":
            return f'<figure><img src="x.png"><figcaption>{words(2, 9)}</figcaption></figure>'
        if kind == "linked":
            return f"<p>{words(2, 20)} {link(words(1, 3))} {sentence(2, 20)}</p>"
        if kind == "bare":
            return f"<div>{sentence(3, 50)}</div>"
        return f"<{(t := {'quote': 'blockquote', 'pre': 'pre'}[kind])}>{sentence(3, 30)}</{t}>"

    pages = []
    for _ in range(n):
        blocks = [block() for _ in range(rnd.randint(1, 12))]
        for i in range(len(blocks), 0, -1):
            if rnd.random() < 0.06:
                blocks.insert(i, boiler())
        heading = f"<h1>{words(1, 12)}</h1>"
        heading = rnd.choice([heading, heading, f"<header>{heading}<p>{words(2, 8)}</p></header>", ""])
        inner = heading + "".join(blocks)
        core = rnd.choice(
            [
                f'<article data-content="1">{inner}</article>',
                f'<article data-content="1">{inner}</article>',
                f'<main data-content="1">{inner}</main>',
                f'<main><article data-content="1">{inner}</article>{boiler()}</main>',
                f'<div data-content="1" class="{rnd.choice(["content", "post", "entry-content", "article-body", "story", "main"])}">{inner}</div>',
                f'<div id="wrap"><div data-content="1" id="{rnd.choice(["content", "main", "body"])}">{inner}</div></div>',
                f'<section data-content="1">{inner}</section>',
            ]
        )
        before, after = "".join(boiler() for _ in range(rnd.randint(0, 4))), "".join(boiler() for _ in range(rnd.randint(0, 4)))
        body = before + core + after
        if rnd.random() < 0.3:
            body = f"<div>{body}</div>"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>")
    return pages


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    fitted = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.small_batches(batches, "html"):
            text = extract(some.column("html").to_pylist(), fitted)
            yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return common.map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
