"""Main-text extraction from HTML with a tree-structured graphical model.

A page is parsed into the tree of its block elements. Every element has a hidden label
(main text or not); single potentials look at its tag, the words of its class, id and role,
its text and links, and pair potentials connect it with its parent. Sum-product messages
run from the leaves to the root and back, and give each element's exact marginal; the text
blocks of elements whose marginal is at least one half are the main text. Weights are
learned by maximum likelihood (the same messages give the gradient) from labelled pages,
which ``labelled_pages`` writes: varied layouts whose elements say what they are.

Inside a block white space, line breaks and inline elements' borders become one space;
blocks are trimmed and joined by one line feed, in page order. Nothing is cut off.

Edge cases: null or empty html gives the empty text; text without any element is main text;
unclosed, stray and wrongly nested tags follow the usual implied ends; an unclosed comment,
script or tag (no ``>`` any more) runs to the end of the page, while an unclosed ``select``,
``video`` or other embedded element hides nothing but itself; pages of any length and depth
take time in proportion to their length; an element whose marginal is exactly one half (a
tie) is main text; repeated rows are extracted each; null ids and urls
stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, slices

RESULT = "page_id long, url string, text string, n_chars long"

# fixed values: HTML's element kinds
#: Elements whose content isn't markup: it ends at the first end tag of their name.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Elements whose content isn't text of the page; they nest, and hide nothing if unclosed.
EMBEDDED = frozenset("template svg math select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end when one of these opens next to them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
HOLDS = frozenset("ul ol menu dl table select article section div body".split())

# no part of these is tried twice at a place, so a page takes time in proportion to its length
_TAG = re.compile(r"""<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>?+)""")
_COMMENT = re.compile(r"<!--(?:-?+>|.*?(?:--!?>|\Z))", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|data-main)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSE = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}

#: Words of class, id and role attributes, by what they speak of.
LEXICON = {
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner dfp adslot adbox".split(),
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip sitemap".split(),
    "remarks": "comment comments commentlist reply replies respond disqus discussion feedback remark reader".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay announcement warning message toast privacy disclaimer".split(),
    "side": "side sidebar rail aside widget widgets related recommended recommendations more popular trending teaser share social sharing follow tags meta byline author".split(),
    "head": "header masthead topbar top logo brand site toolbar hero".split(),
    "foot": "footer foot bottom copyright legal colophon credits".split(),
    "form": "form login signin signup register search subscribe newsletter contact input survey".split(),
    "main": "article content main post entry body story text maincontent page prose".split(),
}
_SPEAKS = {w: k for k, words in LEXICON.items() for w in words}
GROUP = {
    **{t: t for t in "nav header footer aside form article main section div p li body html table pre blockquote figure button".split()},
    **{f"h{i}": "heading" for i in range(1, 7)},
    **{t: "list" for t in "ul ol menu dl dir".split()},
    **{t: "item" for t in "dt dd td th tr tbody thead tfoot caption summary figcaption details legend".split()},
    **{t: "form" for t in "fieldset search".split()},
    **{t: "aside" for t in "dialog".split()},
}
BOUNDARY = frozenset("nav header footer aside form fieldset search button dialog".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote figure figcaption dt dd td th tr tbody table ul ol dl".split())


class Node:
    __slots__ = ("above", "chars", "links", "mark", "tag", "tied", "words")

    def __init__(self, tag: str, above: int, words: tuple[str, ...] = (), mark: str = "") -> None:
        self.tag, self.above, self.words, self.mark = tag, above, words, mark
        self.chars = self.links = 0
        self.tied: tuple[int, ...] = ()


def tokens(page: str) -> list[tuple[str, str | None, bool, str]]:
    """(text, None, ...) and (text before it, tag, whether it ends, attributes), in page order.
    Comments, declarations and raw elements' content are left out."""
    out, at, run, size = [], 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            stop, tag = _COMMENT.match(page, at).end(), None
        elif page.startswith(("<!", "<?"), at) or (page.startswith("</", at) and not page[at + 2 : at + 3].isalpha()):
            stop, tag = page.find(">", at) + 1 or size, None
        elif not (found := _TAG.match(page, at)):
            at += 1  # a plain character
            continue
        else:
            stop, tag = found.end(), found[2].lower()
        out.append((page[run:at], None, False, ""))
        if tag and found[4]:
            closed = found[3].endswith("/")
            if tag in RAW and not found[1]:
                end = None if closed else _CLOSE[tag].search(page, stop)
                stop = end.end() if end else stop if closed else size
                out.append((" ", None, False, ""))
            elif tag in RAW or (tag in EMBEDDED and closed and not found[1]):
                out.append((" ", None, False, ""))
            else:
                out.append(("", tag, bool(found[1]), found[3]))
        at = run = stop
    out.append((page[run:], None, False, ""))
    return out


def _hidden(found: list[tuple[str, str | None, bool, str]]) -> list[tuple[int, int]]:
    """The outermost runs of tokens from an embedded element's tag to its end tag. Unclosed
    ones make no run, nor do stray end tags."""
    open_: dict[str, list[int]] = {}
    runs = []
    for i, (_, tag, ending, _) in enumerate(found):
        if tag in EMBEDDED:
            if not ending:
                open_.setdefault(tag, []).append(i)
            elif open_.get(tag):
                runs.append((open_[tag].pop(), i))
    out, reach = [], -1
    for a, b in sorted(runs):
        if b > reach:
            out.append((max(a, reach + 1), b))
            reach = b
    return out


class _Open:
    """The open elements, and the depths of each kind of tag."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes, self.held, self.depths = nodes, [0], {}

    def push(self, node: int) -> None:
        self.depths.setdefault(self.nodes[node].tag, []).append(len(self.held))
        self.held.append(node)

    def depth(self, tags) -> int:
        """Of the innermost element of these tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close(self, depth: int) -> None:
        """Ends all elements from this depth on."""
        while len(self.held) > depth:
            self.depths[self.nodes[self.held.pop()].tag].pop()


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements (parents before children; 0 is the root) and (element, text) blocks."""
    nodes = [Node("html", -1)]
    open_ = _Open(nodes)
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    linked = choice = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((open_.held[-1], text))
            nodes[open_.held[-1]].chars += len(text)

    found = tokens(page)
    hidden = iter([*_hidden(found), (len(found), len(found))])
    first, last = next(hidden)
    for n, (text, tag, ending, rest) in enumerate(found):
        if n > last:
            first, last = next(hidden)
        if n >= first:
            if n == first:
                run.append(" ")
            continue
        if tag is None:
            if text and not choice:
                run.append(text)
                if linked:
                    nodes[open_.held[-1]].links += len(text.strip())
            continue
        choice = tag in ("option", "optgroup") and not ending  # what an unclosed select offers
        if tag == "a":
            linked = not ending
        elif tag not in BLOCK:
            if tag in VOID or tag in EMBEDDED or choice:
                run.append(" ")
        elif ending:
            if depth := open_.depth((tag,)):
                flush()
                open_.close(depth)
                linked = False
        else:
            flush()
            if tag == "html":
                continue
            if nodes[open_.held[-1]].tag in ("p", *(("h1", "h2", "h3", "h4", "h5", "h6") if tag[0] == "h" and tag[1:].isdigit() else ())):
                open_.close(len(open_.held) - 1)
            if tag in ENDS and (depth := open_.depth(ENDS[tag])) > open_.depth(HOLDS):
                open_.close(depth)
            if tag == "hr":
                continue
            words, mark = [], nodes[open_.held[-1]].mark
            for name, value in _NAMED.findall(rest):
                if name.lower() == "data-main":
                    mark = value.strip("\"'")
                elif name.lower() == "hidden":
                    words.append("hidden")
                else:
                    words += _WORD.findall(value.lower())
            nodes.append(Node(tag, open_.held[-1], tuple(words), mark))
            open_.push(len(nodes) - 1)
            if linked and tag not in ("p", "div"):
                linked = False
    flush()
    return nodes, blocks


# --- the model ----------------------------------------------------------------------


def _features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that hold for each element."""
    n = len(nodes)
    chars, links = [x.chars for x in nodes], [x.links for x in nodes]
    for i in range(n - 1, 0, -1):
        chars[nodes[i].above] += chars[i]
        links[nodes[i].above] += links[i]
    has_main = any(x.tag in ("article", "main") for x in nodes)
    inside, out = [False] * n, []
    for i, x in enumerate(nodes):
        inside[i] = x.tag in ("article", "main") or (i > 0 and inside[x.above])
        kinds = {"hidden" if w == "hidden" else _SPEAKS.get(w) for w in x.words} - {None}
        share = links[i] / chars[i] if chars[i] else 0.0
        f = ["always", f"tag {GROUP.get(x.tag, 'other')}", "text " + ("none" if not x.chars else "short" if x.chars < 30 else "line" if x.chars < 120 else "long")]
        f += [f"speaks {k}" for k in sorted(kinds)]
        f.append("links " + ("none" if not share else "few" if share < 0.4 else "many"))
        f.append("place " + ("inside" if inside[i] else "outside" if has_main else "unknown"))
        if x.tag in BOUNDARY and inside[i]:
            f.append("boundary inside")
        out.append(f)
    return out


def _edge(nodes: list[Node], x: Node) -> int:
    """Which pair potential ties an element to its parent."""
    if x.tag in PLAIN:
        above = nodes[x.above].tag
        return 3 if above in ("article", "main") else 4 if above in ("body", "html") else 0
    return 2 if x.tag in BOUNDARY else 1


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def sum_product(above: list[int], single: list[float], pair: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Marginals of a tree with labels 0 and 1. above: each node's parent (before it; the
    root's is -1). single: score of label 1. pair: scores of (parent, child) labels 00, 01,
    10, 11. Returns P(label 1), and for each node but the root the four pair marginals."""
    n = len(above)
    zero, one = [0.0] * n, list(single)  # messages from the children, with the own score
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        p = pair[i]
        a, b = _log_sum(p[0] + zero[i], p[1] + one[i]), _log_sum(p[2] + zero[i], p[3] + one[i])
        up[i] = (a, b)
        zero[above[i]] += a
        one[above[i]] += b
    marginal, pairs = [0.0] * n, [[0.0] * 4 for _ in range(n)]
    down0, down1 = [0.0] * n, [0.0] * n  # messages from the parent
    for i in range(n):
        if i:
            p, j = pair[i], above[i]
            a, b = down0[j] + zero[j] - up[i][0], down1[j] + one[j] - up[i][1]  # the parent without this child
            down0[i], down1[i] = _log_sum(a + p[0], b + p[2]), _log_sum(a + p[1], b + p[3])
            four = [a + p[0] + zero[i], a + p[1] + one[i], b + p[2] + zero[i], b + p[3] + one[i]]
            high = max(four)
            four = [math.exp(x - high) for x in four]
            pairs[i] = [x / sum(four) for x in four]
        d = down0[i] + zero[i] - down1[i] - one[i]
        marginal[i] = 1 / (1 + math.exp(min(d, 700.0)))
    return marginal, pairs


class TreeModel:
    """Weights of single and pair potentials."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair = [[0.0] * 4 for _ in range(5)]

    def marginals(self, nodes: list[Node], features: list[list[str]] | None = None):
        weight = self.weight
        single = [sum([weight.get(k, 0.0) for k in f]) for f in features or _features(nodes)]
        return sum_product([x.above for x in nodes], single, [self.pair[_edge(nodes, x)] for x in nodes])

    def fit(self, pages: list[str], rounds: int = 60, rate: float = 1.0, penalty: float = 0.001) -> TreeModel:
        """Maximum likelihood on pages whose elements carry ``data-main`` (inherited; 1: main
        text) by AdaGrad on the exact gradient."""
        data = []
        for page in pages:
            nodes, _ = parse(page)
            data.append((nodes, _features(nodes), [int(x.mark == "1") for x in nodes]))
        past: dict = {}
        for _ in range(rounds):
            slope: dict = {}
            for nodes, features, labels in data:
                marginal, pairs = self.marginals(nodes, features)
                for i, x in enumerate(nodes):
                    for k in features[i]:
                        slope[k] = slope.get(k, 0.0) + labels[i] - marginal[i]
                    if i:
                        for k in range(4):
                            key = (_edge(nodes, x), k)
                            slope[key] = slope.get(key, 0.0) + (k == 2 * labels[x.above] + labels[i]) - pairs[i][k]
            for key, g in slope.items():
                now = self.weight.get(key, 0.0) if isinstance(key, str) else self.pair[key[0]][key[1]]
                g = g / len(data) - penalty * now
                past[key] = past.get(key, 0.0) + g * g
                now += rate * g / math.sqrt(past[key] + 1e-9)
                if isinstance(key, str):
                    self.weight[key] = now
                else:
                    self.pair[key[0]][key[1]] = now
        return self

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        if len(nodes) == 1:
            return "\n".join(t for _, t in blocks)
        marginal, _ = self.marginals(nodes)
        return "\n".join(t for i, t in blocks if marginal[i] >= 0.5)


# --- labelled pages -------------------------------------------------------------------


def labelled_pages(count: int = 200, seed: int = 7) -> list[str]:
    """Pages in varied layouts; ``data-main`` tells what is main text (1) and what isn't (0)."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abdeghiklmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def line(low: int = 3, high: int = 60) -> str:
        return words(low, high).capitalize() + "."

    def name(kind: str) -> str:
        return rng.choice(LEXICON[kind]) + rng.choice(["", "-box", "_1", " wrap", "-list"])

    def anchors(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(n))

    def off(tag: str, inner: str, kind: str = "", plain: float = 0.3) -> str:
        named = f' {rng.choice(["class", "id"])}="{name(kind)}"' if kind and rng.random() > plain else ""
        return f'<{tag}{named} data-main="0">{inner}</{tag}>'

    def paragraphs() -> str:
        out = []
        if rng.random() < 0.12:  # many very short ones
            return "".join(f"<p>{line(1, 4)}</p>" for _ in range(rng.randint(5, 40)))
        for _ in range(rng.randint(1, 9)):
            out.append(rng.choices(
                [f"<p>{line()}</p>", f"<p><b>{line(2, 12)}<br><p>{line()}</p>", f"<p>{line()}", f"<h{rng.randint(2, 4)}>{words(1, 6)}</h2>", f"<ul>{''.join(f'<li>{line(2, 15)}</li>' for _ in range(3))}</ul>", f"<blockquote><p>{line()}</p></blockquote>", f"<p>{line()} <a href='/x'>{words(1, 3)}</a> {line(2, 20)}</p>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(3, 20)}</pre>", f"<p>{words(1, 3)}</p>"],
                [9, 2, 2, 2, 1, 1, 2, 0.5, 0.5, 2],
            )[0])
        return "".join(out)

    def extra() -> str:
        return rng.choice([
            lambda: off("div", line(3, 20), "advert", 0.05), lambda: off("aside", f"<h3>{words(1, 3)}</h3><ul>{anchors(3)}</ul>", "side"), lambda: off("div", f"<p>{line(3, 20)}</p>", "notice", 0.05),
            lambda: off("form", f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>", "form"), lambda: off("div", f"<h3>{words(1, 2)}</h3><p>{line(3, 30)}</p><p>{line(3, 20)}</p>", "remarks", 0.02),
            lambda: off("section", f"<ol><li><p>{line(3, 40)}</p></li><li><p>{line(3, 30)}</p></li></ol>", "remarks", 0.02), lambda: off("div", f"<ul>{anchors(4)}</ul>", "menu", 0.05), lambda: off("div", f"<ul>{anchors(3)}</ul>", "side", 0.05),
            lambda: off("aside", f"<p>{line(3, 30)}</p>", "notice", 0.2),
        ])()

    pages = []
    for _ in range(count):
        # a tag that says what it is, or a div whose name does
        tagged = lambda tag, kind, inner, plain: off(tag, inner, kind, plain) if rng.random() < 0.75 else off("div", inner, kind, 0.02)
        top = tagged("nav", "menu", f"<ul>{anchors(rng.randint(2, 8))}</ul>", 0.7) if rng.random() < 0.8 else ""
        if rng.random() < 0.5:
            top = tagged("header", "head", f"<h1>{words(1, 3)}</h1>{top}" if rng.random() < 0.4 else f"<div>{words(1, 3)}</div>{top}", 0.6)
        title = f"<h1>{words(2, 9).capitalize()}</h1>" if rng.random() < 0.9 else ""
        inner = title + paragraphs() + (extra() if rng.random() < 0.5 else "") + (paragraphs() if rng.random() < 0.4 else "")
        tag = rng.choices(["article", "main", "div", "section"], [8, 3, 2, 1])[0]
        named = f' class="{name("main")}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        main = f'<{tag}{named} data-main="1">{inner}</{tag}>'
        if rng.random() < 0.3:
            main = f'<div data-main="1">{main}</div>'
        if rng.random() < 0.15:  # no element around the main text
            main = re.sub(r"<(p|h[1-6]|ul|blockquote|table|pre)>", r'<\1 data-main="1">', title + paragraphs())
        before = "".join(extra() for _ in range(rng.choice([0, 1, 1, 2])))
        after = "".join(extra() for _ in range(rng.choice([0, 0, 1, 2])))
        foot = tagged("footer", "foot", rng.choice([f"&copy; {words(1, 2)} &middot; {line(3, 12)}", f"<p>{line(3, 12)}</p><ul>{anchors(3)}</ul>", f"<p>{line(2, 12)}</p>"]), 0.6) if rng.random() < 0.9 else ""
        pages.append(f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var t="</p>";</script></head><body data-main="0">{top}{before}{main}{after}{foot}' + rng.choice(["</body></html>", ""]))
    return pages


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    """The model of the default labelled pages."""
    return TreeModel().fit(labelled_pages())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trained())  # a weight per feature name

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [model.extract(x) for x in part.column("html").to_pylist()]
                sizes = pa.array(np.array([len(t) for t in texts], np.int64))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RESULT)
