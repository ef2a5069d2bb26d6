"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, whose leaves are blocks of text.
Every node is content or not. A node has a potential of its own (a logistic
model of its tag, its class and id names and, for text, length, links and
punctuation), and every pair of parent and child has one that depends on the
kind of child. Sum-product messages, up from the leaves and down from the root,
give each leaf's marginal; leaves over one half are the main text.

The model is learned from labelled pages: pages written by a generator with a
fixed seed, in many layouts, where it is known which blocks are the article.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, schema_of, texts

#: A tag's attributes up to its end, in one pass: only a quote after an equals sign opens a value. All parts are possessive, so nothing is read twice.
ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[a-z]+")
#: Elements whose text is never shown as page text. Inside RAW ones there are no tags but the end tag; HIDDEN ones nest.
RAW = frozenset("script style noscript iframe title textarea xmp noembed noframes".split())
HIDDEN = frozenset("template object svg canvas audio video select datalist".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a line; all others start a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics annotation".split())
#: Elements that an opening tag of the same list closes, up to the parent named.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
KINDS = {k: kind for kind, names in {"article": "article main", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "para": "p blockquote pre figure figcaption address", "list": "ul ol dl menu", "item": "li dt dd", "table": "table tbody thead tfoot caption", "row": "tr", "cell": "td th", "nav": "nav", "head": "header", "foot": "footer", "side": "aside dialog", "form": "form fieldset button input", "body": "body html"}.items() for k in names.split()}
#: Attributes of elements that aren't shown.
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)(?!\s*=\s*["']?until-found)|\bstyle\s*=\s*(?:"[^"]*\bdisplay\s*:\s*none|'[^']*\bdisplay\s*:\s*none|display:none)""", re.I)
#: Elements that the next block ends if they aren't closed.
OPEN_ENDED = frozenset("p li dt dd tr td th".split())
FAMILIES = {
    "good": "article content post entry story main body text page prose",
    "menu": "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager tabs links",
    "head": "header masthead banner topbar branding logo",
    "foot": "footer copyright legal imprint bottom",
    "side": "sidebar aside widget related recommended trending popular more rail promo",
    "note": "cookie cookies consent notice alert popup modal newsletter subscribe overlay gdpr",
    "ad": "ad ads advert advertisement sponsor sponsored dfp adsense banner",
    "talk": "comment comments reply replies discussion disqus respond response responses thread remark remarks feedback opinions guestbook",
    "share": "share sharing social tags meta byline author",
    "form": "form search login signup",
}
FAMILY = {w: k for k, ws in FAMILIES.items() for w in ws.split()}


class Node:
    __slots__ = ("kind", "names", "parent", "text", "links")

    def __init__(self, kind: str, names: frozenset, parent: int, text: str | None = None, links: int = 0):
        self.kind, self.names, self.parent, self.text, self.links = kind, names, parent, text, links


def families(attributes: str) -> frozenset:
    found = set()
    for m in NAMES.finditer(attributes):
        found |= {FAMILY[w] for w in PIECE.findall((m[1] or m[2] or m[3] or "").lower()) if w in FAMILY}
    return frozenset(found)


def tags(page: str):
    """(text, tag, closing, attributes) in page order: the text before a tag, and the tag in lower case; the last has none.

    Each character is read once: comments, declarations and tags that never
    end are read to the end of the page, and a "<" before anything else is text.
    Text in RAW elements is left out.
    """
    at = begin = 0
    n, held = len(page), []
    while (i := page.find("<", at)) >= 0:
        head = page[i + 1 : i + 2]
        if head in ("!", "?"):
            mark = "-->" if page.startswith("<!--", i) else "]]>" if page.startswith("<![CDATA[", i) else ">"
            held.append(page[begin:i])
            end = page.find(mark, i + 2)
            at = begin = n if end < 0 else end + len(mark)
            continue
        closing = head == "/"
        m = TAG.match(page, i + 1 + closing)
        if m is None:
            at = i + 1
            continue
        held.append(page[begin:i])
        rest = ATTRIBUTES.match(page, m.end())
        tag, end = m[0].lower(), rest.end()
        at = begin = min(n, end + 1)
        if end >= n:
            break
        yield "".join(held), tag, closing, rest[0]
        held = []
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = begin = end.start() if end else n
    held.append(page[begin:])
    yield "".join(held), "", False, ""


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; leaves have a text with character references decoded and white space in one space each."""
    nodes = [Node("body", frozenset(), -1)]
    stack = [("", 0)]
    opened: Counter[str] = Counter()
    held: list[str] = []
    links = in_link = 0
    hidden: list[str] = []
    lower = page.lower()
    left = {tag: lower.count(f"</{tag}") for tag in HIDDEN if f"<{tag}" in lower}
    ends: dict[str, int] = {}  # of elements that an attribute hides: how often their tag is closed in the page
    closed: Counter[str] = Counter()
    in_head = False

    def flush() -> None:
        nonlocal links
        if held:
            if text := " ".join("".join(held).split()):
                nodes.append(Node("text", frozenset((nodes[stack[-1][1]].kind,)), stack[-1][1], text, min(links, len(text))))
            held.clear()
        links = 0

    def pop_to(place: int) -> None:
        flush()
        opened.subtract(t for t, _ in stack[place:])
        del stack[place:]

    for piece, tag, closing, attributes in tags(page):
        if piece and not hidden:
            if in_head and not piece.isspace():
                in_head = False
            if not in_head:
                piece = html.unescape(piece)
                held.append(piece)
                if in_link:
                    links += len(piece.strip())
        if not tag:
            break
        if closing:
            closed[tag] += 1
        if hidden and hidden[-1] not in HIDDEN:
            # inside an element that an attribute hides: up to its end, or if that may be left out the next block
            if tag == hidden[-1]:
                if closing:
                    hidden.pop()
                    continue
                if tag not in OPEN_ENDED:
                    hidden.append(tag)
                    continue
                hidden.pop()
            elif hidden[-1] in OPEN_ENDED and tag not in INLINE and (closing or hidden[-1] == "p"):
                hidden.pop()
            else:
                continue
        if not closing and not hidden and attributes and tag not in HIDDEN and tag not in VOID and tag not in RAW and UNSEEN.search(attributes):
            if tag not in ends:
                ends[tag] = lower.count(f"</{tag}")
            if ends[tag] > closed[tag] and tag not in ("html", "body", "head"):
                if tag not in INLINE:
                    flush()
                hidden.append(tag)
                continue
        if tag in HIDDEN:
            # an element that is never closed hides nothing
            if closing:
                left[tag] = left.get(tag, 0) - 1
                if tag in hidden:
                    while hidden.pop() != tag:
                        pass
            elif not attributes.endswith("/") and left.get(tag, 0) > hidden.count(tag):
                hidden.append(tag)
            continue
        if hidden or tag in RAW or tag in ("option", "optgroup", "html", "meta", "link", "base"):
            continue
        if tag == "head":
            in_head = not closing
            continue
        if tag not in IN_HEAD:
            in_head = False
        if tag == "body":
            continue
        if closing:
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                if opened[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                else:
                    flush()
            continue
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            closes, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in closes:
                    pop_to(i)
                    if tag != "tr":
                        break
        nodes.append(Node(KINDS.get(tag, "box"), families(attributes) if attributes else frozenset(), stack[-1][1]))
        stack.append((tag, len(nodes) - 1))
        opened[tag] += 1
    flush()
    return nodes


def edge(node: Node) -> str:
    """The kind of child that chooses a pair's potential. (The name of a text is the kind of its parent.)"""
    return node.kind if node.kind == "text" else f"{node.kind}.{min(node.names, default='')}"


def own_features(node: Node) -> list[str]:
    if node.kind != "text":
        return [f"k:{node.kind}", *[f"n:{x}" for x in node.names]]
    n = len(node.text)
    ends = node.text[-1] in ".!?…:;\"'”»)"
    return [f"size:{min(6, n.bit_length() // 2)}", f"link:{min(4, 4 * node.links // max(1, n))}", f"end:{ends}", f"stops:{min(3, sum(node.text.count(c) for c in '.,!?'))}", f"mark:{n < 200 and any(c in node.text for c in '©®')}", *[f"in:{x}.{min(4, 4 * node.links // max(1, n))}" for x in node.names]]


def trust(node: Node) -> float:
    """How much a text says for itself: a few words (a cell, a name) say little, and follow what they are in."""
    return min(1.0, 0.3 + len(node.text) / 100)


class TreeModel:
    """Log-odds of nodes by feature, and log-potentials of pairs by kind of child."""

    def __init__(self, weights: dict[str, float], pairs: dict[str, list[float]], root: float, offset: float, prior: float = 0.0):
        self.weights, self.pairs, self.root, self.offset, self.prior = weights, pairs, root, offset, prior
        self.neutral = pairs["text"]

    def pair(self, node: Node) -> list[float]:
        """Potentials of (parent, child): 00, 01, 10, 11."""
        return self.pairs.get(edge(node)) or self.pairs.get(f"{node.kind}.") or self.neutral

    def odds(self, node: Node) -> float:
        if node.kind != "text":  # its kind and first name are in its pair's potential
            x = sum(self.weights.get(f"n:{name}", 0.0) for name in sorted(node.names)[1:])
        else:
            x = trust(node) * (sum(self.weights.get(f, 0.0) for f in own_features(node)) + self.offset) - self.prior
        return math.exp(max(-6.0, min(6.0, x)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node: messages up, then down. Messages are ratios of the two states, so they stay in range."""
        n = len(nodes)
        odds = [self.odds(v) for v in nodes]
        odds[0] *= math.exp(self.root)
        pairs = [self.pair(v) for v in nodes]
        up = [1.0] * n  # from a node to its parent: state 1 over state 0
        below = [0.0] * n  # log of own odds and of all messages from children
        for i in range(n):
            below[i] = math.log(odds[i])
        for i in range(n - 1, 0, -1):
            p00, p01, p10, p11 = pairs[i]
            o = math.exp(max(-300.0, min(300.0, below[i])))
            up[i] = math.log((p10 + p11 * o) / (p00 + p01 * o))
            below[nodes[i].parent] += up[i]
        all_in = below[:]
        for i in range(1, n):
            p = nodes[i].parent
            p00, p01, p10, p11 = pairs[i]
            o = math.exp(max(-300.0, min(300.0, all_in[p] - up[i])))
            all_in[i] = below[i] + math.log((p01 + p11 * o) / (p00 + p10 * o))
        return [1.0 / (1.0 + math.exp(-max(-300.0, min(300.0, x)))) for x in all_in]

    def extract(self, page: str) -> str:
        nodes = parse(page)
        if len(nodes) == 1:
            return ""
        p = self.marginals(nodes)
        return "\n".join(v.text for v, q in zip(nodes, p, strict=True) if v.text is not None and q > 0.5)


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page, and the text of its article's blocks."""
    vowels, rest = "aeiouéüó", "bcdfglmnprstvñ"
    word = lambda: "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randrange(1, 5)))
    few = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))

    def sentence(a: int = 1, b: int = 18) -> str:
        mark = rng.random() < 0.1
        s = [word() + ("," if rng.random() < 0.1 else "") + (rng.choice(("***", "%%%", "###")) if mark else "") for _ in range(rng.randrange(a, b))]
        return (" ".join(s) + ("." if rng.random() < 0.9 else "")).capitalize()

    def para() -> str:
        if rng.random() < 0.06:  # a sign that footers have too
            return f"{sentence(2, 6)} © {few(1, 4)}, {sentence(2, 12)}"
        if rng.random() < 0.1:  # rows of a table or a list of words as text
            return rng.choice((" | ", ", ", " ")).join(word() for _ in range(rng.randrange(2, 60)))
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 1, 2, 3, 6))))

    name = lambda family: rng.choice(FAMILIES[family].split()) + rng.choice(("", "-box", " wide", "_1"))
    tagged = lambda tag, family, inner, chance=0.7: f'<{tag} {rng.choice(("class", "id"))}="{name(family)}">{inner}</{tag}>' if rng.random() < chance else f"<{tag}>{inner}</{tag}>"
    boxed = lambda family, inner: f'<{rng.choice(("div", "section"))} class="{name(family)}">{inner}' + "</div></section>"
    item = lambda: f'<li><a href="/{word()}">{few(1, 4)}</a></li>'
    lists = lambda: f"<ul>{''.join(item() for _ in range(rng.randrange(2, 9)))}</ul>"
    plain = lambda: rng.choice(("{}", "<p>{}</p>", "<p>{}", "<span>{}</span>")).format(sentence())
    chrome = [
        lambda: tagged("nav", "menu", lists()),
        lambda: boxed("menu", lists()),
        lambda: tagged("header", "head", f"<h1>{few(1, 4)}</h1>" + rng.choice((plain(), lists(), ""))),
        lambda: boxed("head", plain()),
        lambda: tagged("aside", "side", rng.choice((lists(), f"<h3>{few(1, 3)}</h3>{plain()}", f"<p>{para()}</p>"))),
        lambda: boxed("side", f"<h2>{few(1, 3)}</h2>" + rng.choice((lists(), f"<p>{para()}</p>"))),
        lambda: boxed("note", rng.choice((plain(), f"<p>{para()}</p><button>{few(1, 3)}</button>"))),
        lambda: boxed("ad", rng.choice((plain(), f"<p>{para()}</p>", f"<a href='#'>{sentence()}</a>"))),
        lambda: f'<{rng.choice(("section", "div"))} class="{name("talk")}"><h3>{few(1, 3)}</h3>' + "".join(rng.choice((f'<div class="comment"><p>{para()}</p></div>', f"<p>{para()}</p>", f"<article><p>{para()}</p></article>")) for _ in range(rng.randrange(1, 6))) + "</section></div>",
        lambda: tagged("form", "form", f"<label>{few(1, 3)}</label><input name='q'><button>{few(1, 2)}</button>{rng.choice(('', plain()))}"),
        lambda: boxed("share", rng.choice((lists(), plain()))),
    ]
    end = [lambda: tagged("footer", "foot", f"&copy; {few(1, 4)} &middot; {sentence()}"), lambda: boxed("foot", rng.choice((plain(), lists(), f"&copy; {few(1, 4)}")))]
    truth: list[str] = []
    out: list[str] = []
    title = sentence(2, 10)
    if rng.random() < 0.9:
        lead = sentence(5, 20) if rng.random() < 0.5 else ""
        out.append(rng.choice((f"<header><h1>{title}</h1>{f'<p>{lead}</p>' if lead else ''}</header>", *[f"<h1>{title}</h1>"] * 5)))
        truth += [title, lead] if lead and out[-1].startswith("<header") else [title]
    for _ in range(rng.randrange(1, 12)):
        kind = rng.random()
        text = para()
        truth.append(text)
        if kind < 0.7:
            out.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p><b>{}<br><p></p>", "<p>{}")).format(text))
        elif kind < 0.74:  # a table of cells, some of them numbers
            truth.pop()
            cell = lambda: rng.choice((few(1, 4), f"{rng.randrange(10_000)}", f"{rng.randrange(100)}.{rng.randrange(10)} %", sentence(2, 9)))
            wide, cells = rng.randrange(2, 6), []
            for r in range(rng.randrange(1, 9)):
                row = [cell() for _ in range(wide)]
                truth += row
                mark = "th" if r == 0 and rng.random() < 0.5 else "td"
                cells.append("<tr>" + "".join(f"<{mark}>{x}</{mark}>" for x in row) + "</tr>")
            caption = few(2, 7) if rng.random() < 0.3 else ""
            truth += [caption] if caption else []
            out.append(f"<table>{f'<caption>{caption}</caption>' if caption else ''}{''.join(cells)}</table>")
        elif kind < 0.77:  # a line that is a link, or begins as one
            before, line = rng.choice(("", few(1, 5).capitalize() + " ")), sentence(2, 7)
            truth[-1] = before + line
            out.append(f"<p>{before}<a href='/{word()}'>{line}</a></p>")
        elif kind < 0.8:
            truth[-1] = head = few(2, 7)
            out.append(f"<h2>{head}</h2>")
        elif kind < 0.9:
            truth.pop()
            rows = [sentence() for _ in range(rng.randrange(1, 5))]
            truth += rows
            out.append(f"<ul>{''.join(f'<li>{r}</li>' for r in rows)}</ul>")
        else:
            out.append(rng.choice(("<blockquote>{}</blockquote>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")).format(text))
        if rng.random() < 0.06:
            out.append(rng.choice(chrome[4:])())
    shape = rng.random()
    if shape < 0.6:
        body = f"<article{rng.choice(('', ' class=post'))}>{''.join(out)}</article>"
    elif shape < 0.75:
        body = f"<main>{''.join(out)}</main>"
    else:
        body = f'<div class="{name("good")}">{"".join(out)}</div>'
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{body}{rng.choice(chrome)() if rng.random() < 0.5 else ""}</div>'
    before = [rng.choice(chrome)() for _ in range(rng.randrange(0, 4))]
    after = [rng.choice(chrome)() for _ in range(rng.randrange(0, 3))] + [rng.choice(end)() for _ in range(rng.randrange(0, 2))]
    return f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", truth


def train(pages: list[tuple[str, list[str]]]) -> TreeModel:
    """Learn from pages and the text of their content blocks, which no other block of the page repeats."""
    rows, ys, scale = [], [], []
    joint: dict[str, list[float]] = {}
    roots = [1.0, 1.0]
    for page, truth in pages:
        nodes = parse(page)
        wanted = set(" ".join(t.split()) for t in truth)
        y = [int(v.text in wanted) if v.text is not None else 0 for v in nodes]
        size, good = [len(v.text) if v.text else 0 for v in nodes], [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].text is not None:
                good[i] = size[i] * y[i]
            else:
                y[i] = int(2 * good[i] > size[i])
            if i:
                size[nodes[i].parent] += size[i]
                good[nodes[i].parent] += good[i]
        roots[y[0]] += 1
        for i in range(1, len(nodes)):
            for k in {edge(nodes[i]), f"{nodes[i].kind}." if nodes[i].kind != "text" else "text"}:
                joint.setdefault(k, [2.0] * 4)[2 * y[nodes[i].parent] + y[i]] += 1
            rows.append((own_features(nodes[i]), nodes[i].kind == "text"))
            scale.append(trust(nodes[i]) if nodes[i].kind == "text" else 1.0)
            ys.append(y[i])
    names = sorted({f for fs, _ in rows for f in fs})
    number = {f: i for i, f in enumerate(names)}
    flat = np.array([number[f] for fs, _ in rows for f in fs])
    row = np.repeat(np.arange(len(rows)), [len(fs) for fs, _ in rows])
    scale = np.array(scale)
    leaf, y = np.array([t for _, t in rows], float) * scale, np.array(ys, float)
    beta, offset = np.zeros(len(names)), 0.0
    speed, speed0 = np.full(len(names), 1e-8), 1e-8
    for _ in range(300):
        z = np.bincount(row, beta[flat], len(rows)) * scale + offset * leaf
        g = (y - 1 / (1 + np.exp(-z))) / len(rows)
        grad = np.bincount(flat, (g * scale)[row], len(names)) - 1e-4 * beta
        grad0 = float((g * leaf).sum())
        speed += grad**2
        speed0 += grad0**2
        beta += 0.5 * grad / np.sqrt(speed)
        offset += 0.5 * grad0 / math.sqrt(speed0)
    # a pair's potential is how likely the child's state is under the parent's, so a kind that was only seen in one of them says nothing of the other;
    # what texts say for themselves is counted over what is usual for texts
    share = {k: [c[2 * a + b] / (c[2 * a] + c[2 * a + 1]) for a in (0, 1) for b in (0, 1)] for k, c in joint.items()}
    said = y[np.array([t for _, t in rows])]
    return TreeModel({f: float(b) for f, b in zip(names, beta, strict=True)}, share, math.log(roots[1] / roots[0]), offset, math.log((said.sum() + 1) / (len(said) - said.sum() + 1)))


def default_model(pages: int = 500, seed: int = 17) -> TreeModel:
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)])


def _extract(model: TreeModel, others: list[str]):
    def run(batches):
        for batch in batches:
            out = [model.extract(t.decode()) for t in texts(batch, "html")]
            yield pa.record_batch([*[batch.column(c) for c in others], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*others, "text", "n_chars"])

    return released(run)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """The columns of pages without html, then text and n_chars.

    A null or empty page, or one without a block that is likelier content than
    not, has an empty text; a long page is read whole, each character once.
    Markup that never ends is read to the end of the page; select, svg and other
    hidden elements that are never closed hide nothing. Columns named text or n_chars are replaced; rows repeat as they are;
    an empty table gives no rows.
    """
    others = [c for c in pages.columns if c.lower() not in {"html", "text", "n_chars"}]
    base = pages.select(*others, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.select(*others).schema.fields)
    return base.mapInArrow(_extract(model or default_model(), others), schema_of(fields + "text string, n_chars long"))
