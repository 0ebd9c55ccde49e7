"""Operator 6: main text of web pages from flat text blocks, by a small decision tree.

A page is read once, front to back, into a flat list of blocks: the text between two block-level
tags, with its words, its link density (share of its words inside links), where it stands (in an
article, outside of the page's article, or on a page without one), whether a container around it is
furniture by its element or role, how much of a container's class or id names furniture (the share of the listed words in a
token: all of ``cookie-notice``, a third of ``notice-of-award``), and whether it is a heading or a list item.
A block's features are its own and the words and link density of the blocks before and after it. The
tree (Gini impurity, grown in numpy) is trained on the blocks of a few labelled pages, read by the
same code; it calls a block content or not, and content blocks are joined in page order.

Rows: a null, empty or unfinished page gives what it has, "" if nothing; unclosed scripts, comments
and styles run to the page's end; very long and very deep pages are read in one pass; repeated rows
get the same answer; a column named as the result's, in any case, is replaced, other columns stay; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows, others

#: A comment, a declaration, or a tag with quoted attributes (or, if quotes don't match, up to the next >).
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's elements by what they do here.
UNREAD = frozenset("script style noscript template title textarea select button svg annotation annotation-xml iframe object canvas audio video datalist".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th dialog details figure menu fieldset center blockquote p li dd dt h1 h2 h3 h4 h5 h6 pre address figcaption summary".split())
BLOCKS = CONTAINERS | frozenset("hr caption legend option optgroup frameset".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
#: An opened element of the first kind ends an open one of the second kind.
ENDS = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "comment comments commentlist reply replies respond discussion disqus sidebar rail aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "footer masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription signup login widget popup modal overlay paywall outbrain taboola skip".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies".split())
#: A container with such a share of listed words isn't the page's article.
HALF = 0.5

def _long_and_short() -> tuple[str, ...]:
    """Furniture and article text right after a paragraph of few and of many words, linked and not."""
    pages = []
    for n in (4, 12, 60, 200):
        # furniture of every kind, whatever stands before it
        for furniture in ("<footer>{}</footer>", "<nav>{}</nav>", "<aside class=sidebar>{}</aside>", "<form>{}</form>", "<div class=footer>{}</div>", "<div role=contentinfo>{}</div>"):
            for inner in ("<a>{1}</a> <a>{1}</a>", "<p><a>{2}</a></p><p>{9}</p>", "<p>{70}</p><p><a>{3}</a></p>"):
                pages.append(f"<article><p>{{+{n}}}</p></article>" + furniture.replace("{}", inner))
        for inside in ("<div class=share>{}</div>", "<section class=comments>{}</section>", "<aside>{}</aside>", "<div class=related-posts>{}</div>", "<nav>{}</nav>", "<form>{}</form>", "<footer>{}</footer>"):
            for inner in ("<p><a>{1}</a></p>", "<p><a>{4}</a></p><p>{60}</p>", "<ul><li><a>{3}</a><li>{2}</ul>", "<p><a>{12}</a></p><p><a>{7}</a> {1}</p>"):
                pages.append(f"<article><p>{{+{n}}}</p>" + inside.replace("{}", inner) + "<p>{+9}</p></article>")
        pages.append(f"<article><p>{{+{n}}}</p></article><div><p><a>{{2}}</a></p><p>{{30}}</p></div>")
        # links that are the article's own
        pages.append(f"<article><p><a>{{+6}}</a> {{+2}}</p><p>{{+{n}}}</p><p><a>{{+9}}</a></p><p><a>{{+2}}</a></p><p>{{+5}}</p></article>")
        pages.append(f"<article><p><a>{{+2}}</a></p><p>{{+{n}}}</p><p><a>{{+5}}</a></p><p>{{+20}}</p><p><a>{{+4}}</a></p></article>")
        pages.append(f"<article><h2><a>{{+3}}</a></h2><p>{{+{n}}}</p><p>{{+3}} <a>{{+12}}</a></p></article>")
        # no article: what is linked after a text isn't its
        pages.append(f"<h1>{{+5}}</h1><p>{{+{n + 20}}}</p><p>{{+{n + 30}}}</p><p><a>{{2}}</a> <a>{{2}}</a></p>")
    return tuple(pages)


#: The labelled pages. ``{n}`` stands for n words, ``{+n}`` for n words of main text: what words they are plays no part.
LABELLED_PAGES = (
    # an article between a menu, an advert, a side column and a footer
    "<header><a>{2}</a><p>{6}</p></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div class=ad>{9}</div>"
    "<article><h1>{+8}</h1><p>{+2}</p><p>{+60}</p><p>{+7}</p><p>{+35} <a>{+3}</a> {+20}</p><ul><li>{+6}</li><li>{+11}</li></ul><p>{+90}</p><p>{+1}</p></article>"
    "<aside><h2>{2}</h2><p>{40}</p><p><a>{4}</a></p></aside><footer>{9}</footer>",
    # the same with open elements, and an end that is missing
    "<nav><ul><li><a>{1}</a></li><li><a>{1}</a></li></ul></nav><div class=ad>{14}</div><article><h1>{+5}</h1><p><b>{+12}<br><p>{+70}</p><p>{+3}</p><p>{+150}</p></article><footer>{8}",
    # a journal without an article element
    "<div class=site-header><h1>{3}</h1><p>{7}</p></div><div class=menu><a>{1}</a><a>{1}</a><a>{2}</a></div>"
    "<div id=content><h2>{+6}</h2><p>{+80}<p>{+25}<p>{+8}<p>{+110}<ul><li>{+9}<li>{+12}</ul><p>{+30} <a>{+8}</a></div>"
    "<div class=sidebar><h3>{2}</h3><p>{30}</p><ul><li><a>{4}</a><li><a>{3}</a></ul></div><div class=comments><p>{35}</p><p>{12}</p><p>{90}</p></div>",
    # tables that lay the page out, nothing named
    "<table><tr><td><a>{1}</a><td><a>{2}</a><td>{3}<td><a>{1}</a><tr><td><a>{2}</a><td><p>{4}</p><td><a>{2}</a><tr><td>{8}<td><a>{3}</a>"
    "<tr><td><h2>{+5}</h2><p>{+70}</p><p>{+5}</p><p>{+40}</p><p>{+14}</p><tr><td><a>{2}</a><td><a>{1}</a><td>{9}</table>",
    # talk in short lines, nothing named: short blocks between short ones without links
    "<h1>{+4}</h1><p>{+3}</p><p>{+2}</p><p>{+5}</p><p>{+1}</p><p>{+4}</p><p>{+8}</p><p>{+2}</p>",
    # a page of links and what they lead to: text between links
    "<h1>{3}</h1><div><a>{8}</a></div><div>{14}</div><div><a>{7}</a></div><div>{16}</div><div><a>{9}</a></div><div>{11}</div><div><a>{2}</a></div><div>{5}</div><div><a>{2}</a></div>",
    "<ul><li><a>{1}</a><li><a>{2}</a><li>{2} <a>{3}</a><li><a>{1}</a></ul><p><a>{12}</a> {4}</p><p><a>{6}</a></p><p>{3}</p><p><a>{2}</a></p>",
    # links inside of an article: one between paragraphs belongs to it, a list of them doesn't
    "<article><h1>{+7}</h1><p>{+60}</p><p><a>{+9}</a></p><p>{+50}</p><p>{+10} <a>{+4}</a></p><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{5}</a></li></ul></article>",
    "<article><p>{+80}</p><ul><li>{+4} <a>{+2}</a> {+5}</li><li>{+3} <a>{+3}</a> {+8}</li></ul><p>{+20}</p><p><a>{+4}</a> {+6}</p><p>{+30}</p><ul><li><a>{6}</a></li><li><a>{4}</a></li></ul><p>{+25}</p></article>",
    # furniture inside of an article, and the article's own header
    "<article><header><h1>{+5}</h1><p>{+4}</p></header><div class=notice>{25}</div><p>{+50}</p><div class=advert>{20}</div><p>{+45}</p><div class=share><a>{1}</a> <a>{1}</a></div>"
    "<form><p>{12}</p></form><p>{+15}</p><div class=newsletter><h3>{3}</h3><p>{18}</p></div></article>",
    # readers' comments, some of them articles themselves
    "<article><h1>{+9}</h1><p>{+40}</p><p>{+100}</p></article><section id=comments><h2>{2}</h2><article class=comment><p>{45}</p></article><article class=comment><p>{5}</p></article></section>",
    # text outside of the page's article
    "<div><p>{12}</p><p>{40}</p></div><main><h1>{+3}</h1><p>{+30}</p><p>{+12}</p><p>{+80}</p></main><div><h2>{6}</h2><p>{25}</p><p>{3}</p><p><a>{2}</a></p></div><p>{60}</p>",
    # notices and forms around unnamed text
    "<div class=cookie-notice><p>{30}</p><p><a>{2}</a></p></div><div><p>{+45}</p><p>{+18}</p><h3>{+4}</h3><p>{+65}</p></div><form><p>{10}</p><p>{2}</p></form><div role=contentinfo><p>{22}</p></div>",
    # articles right between links: whatever its neighbours, their unlinked text is main text
    "<nav><a>{1}</a></nav><article><h1>{+6}</h1><p>{+3}</p><p>{+30}</p><p>{+2}</p></article><footer><a>{2}</a></footer>",
    "<nav><ul><li><a>{2}</a></ul></nav><article><p>{+4}</p></article><div><a>{1}</a></div><p>{7}</p>", "<div><a>{1}</a></div><main><p>{+2}</p><p>{+60}</p><p>{+4}</p></main><p><a>{3}</a></p>",
    "<article><h2>{+3}</h2><ul><li><a>{3}</a><li><a>{1}</a></ul><h2>{+2}</h2><p>{+3}</p><ul><li><a>{2}</a><li><a>{4}</a></ul><p>{+9}</p><ul><li><a>{1}</a></ul><p>{+1}</p></article>",
    # the same without an article: a heading and paragraphs after a menu, before a linked line
    "<div class=menu><a>{1}</a></div><h1>{+4}</h1><p>{+50}</p><p>{+12}</p><p>{+28}</p><p><a>{2}</a></p>", "<p><a>{2}</a></p><p>{+33}</p><p>{+70}</p><h2>{+3}</h2><p>{+26}</p><p><a>{4}</a></p><p>{6}</p>",
    # hardly more than the text
    # names that only have a listed word in them
    "<article><h1>{+5}</h1><div class=notice-of-award><p>{+30}</p><p>{+4}</p></div><section id=the-social-contract-today><p>{+60}</p><p><a>{+3}</a> {+2}</p></section></article>",
    "<div id=banner-of-the-north><h1>{+4}</h1><p>{+40}</p><p>{+9}</p></div>",
    *_long_and_short(),
    "<p>{+100}</p>", "<h1>{+6}</h1><p>{+19}</p><p>{+25}</p>", "{+12}", "<article><p>{+1}</p></article>", "<article><h1>{+2}</h1><p>{+4}</p><p>{+3}</p></article>",
)


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    density: float
    place: int
    element: bool
    named: float
    heading: bool
    item: bool


def _names(attributes: str) -> tuple[list[list[str]], str, bool]:
    """The words of each token of class and id, the role, and whether the element is hidden."""
    tokens, role, hidden = [], "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            tokens += [[x.lower() for x in NAME_PART.findall(t)] for t in value.split()]
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return tokens, role, hidden


def _share(tokens: list[list[str]], listed: frozenset[str]) -> float:
    """The largest share of listed words in a token."""
    return max((sum(x in listed for x in t) / len(t) for t in tokens if t), default=0.0)


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    found: list[tuple] = []
    # element; furniture by element or role, and by name, of it or a container; inside an article
    stack: list[tuple[str, bool, float, bool]] = []
    opened: dict[str, int] = {}
    text, linked, in_link, seen_article = [], 0, 0, False

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = html.unescape("".join(text)).split()
            if joined:
                near = [x[0] for x in stack[-2:]]
                _, element, named, inside = stack[-1] if stack else ("", False, 0.0, False)
                found.append((" ".join(joined), len(joined), min(1.0, linked / len(joined)), inside, element, named, any(re.fullmatch("h[1-6]", x) for x in near), "li" in near))
            text, linked = [], 0

    def say(part: str) -> None:
        nonlocal linked
        text.append(part)
        if in_link:
            linked += len(part.split())

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    at = 0
    while m := MARK.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            say(" ")
        elif name == "a":
            in_link = int(not close)
        elif name in UNREAD:
            if not close and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name in BLOCKS:
            flush()
            in_link = 0
            if name not in CONTAINERS:
                continue
            if close:
                while opened.get(name) and leave() != name:
                    pass
                continue
            if name in ENDS and stack and stack[-1][0] in ENDS[name]:
                leave()
            _, element, named, inside = stack[-1] if stack else ("", False, 0.0, False)
            tokens, role, hidden = _names(attributes) if attributes else ([], "", False)
            if name in ("article", "main") or role in ("main", "article"):
                element, named = element or hidden, max(named, _share(tokens, COMMENT_NAMES))
                inside = seen_article = inside or seen_article or not (element or named >= HALF)
            elif name not in ("html", "body"):
                element |= hidden or name in FURNITURE or role in FURNITURE_ROLES or (name == "header" and not inside)
                named = max(named, _share(tokens, FURNITURE_NAMES if inside else FURNITURE_NAMES | {"header"}))
            stack.append((name, element, named, inside))
            opened[name] = opened.get(name, 0) + 1
    say(page[at:])
    flush()
    article = any(inside and not (element or named >= HALF) for _, _, _, inside, element, named, _, _ in found)
    return [Block(b[0], b[1], b[2], (2 if b[3] else 0) if article else 1, *b[4:]) for b in found]


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "element", "named", "heading", "item")


def block_features(found: list[Block]) -> np.ndarray:
    """(blocks, FEATURES); place: 0 outside of the page's article, 1 no article, 2 in it."""
    own = np.array([(b.words, b.density) for b in found], dtype=np.float64).reshape(-1, 2)
    before, after = np.vstack([np.zeros((1, 2)), own[:-1]]), np.vstack([own[1:], np.zeros((1, 2))])
    rest = np.array([(b.place, b.element, b.named, b.heading, b.item) for b in found], dtype=np.float64).reshape(-1, 5)
    return np.hstack([own, before, after, rest])


def labelled_table(pages: tuple[str, ...] = LABELLED_PAGES) -> np.ndarray:
    """Features of the labelled pages' blocks and, last, 1 for main text."""
    word = lambda m: " ".join((["+"] if m[1] else ["w"]) + ["w"] * (int(m[2]) - 1))
    every = [blocks(re.sub(r"\{(\+?)(\d+)\}", word, p)) for p in pages]
    return np.vstack([np.column_stack([block_features(found), ["+" in b.text for b in found]]) for found in every])


@dataclass(frozen=True)
class Node:
    """A leaf has only ``share``, the content share of its training rows."""

    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(table: np.ndarray, depth: int = 7, least: int = 1) -> Node:
    """A decision tree on rows of features and a last column of 0/1; of equal splits the first feature's."""
    x, y = table[:, :-1], table[:, -1]
    share = float(y.mean())
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]) if depth and 0 < share < 1 else ():
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if least <= low.sum() <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                best = min(best, (p * (1 - p) * low.sum() + q * (1 - q) * (~low).sum(), f, float(limit)))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(table[low], depth - 1, least), grow(table[~low], depth - 1, least))


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is content."""
    out, todo = np.zeros(len(x), dtype=bool), [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.low is None:
            out[rows] = node.share >= 0.5
        else:
            low = x[rows, node.feature] <= node.limit
            todo += [(node.low, rows[low]), (node.high, rows[~low])]
    return out


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, block_features(found)), strict=True) if keep)


def extract_text(pages: DataFrame, labelled: tuple[str, ...] = LABELLED_PAGES, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the page itself, with its main ``text``."""
    names = others(pages, html_col, "text")
    tree = grow(labelled_table(labelled))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(p, tree) for (pages,) in arrow_rows(batch, html_col) for p in pages]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in names)
    return pages.select(*names, html_col).mapInArrow(run, f"{schema}text string")
