"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never main text, elements that stand beside it, whole elements that hold raw
# text, elements without content, and elements that break text into blocks: fixed values of HTML.
NEVER = frozenset("""head script style noscript template iframe object svg math canvas audio video
map fieldset button select option textarea input label""".split())
SIDES = frozenset("nav header footer aside form dialog menu search".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track
wbr""".split())
BLOCKS = frozenset("""address article blockquote body caption center dd details dir div dl dt
figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody
td tfoot th thead tr ul""".split()) | NEVER | SIDES
# A start tag ends an open element of these kinds, up to the element that bounds the search.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
        "body": ("head",), "tbody": ("tr", "td", "th", "thead", "tbody"),
        "tfoot": ("tr", "td", "th", "thead", "tbody")}
BOUNDS = frozenset("ul ol dl table select body html article section div".split())
# Words of class and id attributes that name parts beside the article.
BESIDE = frozenset("""ad ads advert adverts advertisement advertising adsense banner promo promotion
sponsor sponsored cookie cookies consent gdpr notice popup modal overlay sidebar aside widget widgets
related recommended recommendations share sharing social newsletter subscribe subscription signup login
menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar footer header masthead comment comments
commentlist disqus respond replies pagination pager skip""".split())
# Words that may follow one of these in a name of such a part, as in share-buttons; any other makes it
# a name of something else, as in related-work or menu-closed.
PARTS = frozenset("""alert area articles bar block body box btn button buttons code col column container
content count feed field form group heading holder icon icons inner inset item items label left link links
list lists logo main media message meta middle mobile module outer panel pane placeholder posts post primary
products region right row secondary section slot stories story text thread title to toggle top bottom topics
unit videos wrap wrapper zone news pages reading tabs desktop sticky fixed""".split())
# Words that make a name one of the layout around such a part, as in has-sidebar.
LAYOUT = frozenset("has have with without no not non hide hides hidden show shows".split())
# What a kind or a name says of a side part counts as a factor of the densities in it, and densities decide.
SIDE_PRIOR = 0.03
PROSE = 100  # characters outside links from which a block is prose rather than a label
# Of the largest sum of densities: a subtree beside that one is text from this share on, and a single block.
PART_SHARE = 0.1
LONE_SHARE = 0.35

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>"
    r"|<[!?][^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_NAMES = re.compile("[a-z]+")
LOOSE = "#text"  # stands for the element that text beside blocks does not have


class Node:
    """A block element: what it holds in order, its counts, and the prior of its kind and names."""

    __slots__ = ("tag", "items", "dropped", "chars", "tags", "link_chars", "link_tags", "density",
                 "holds_article", "named", "prior")

    def __init__(self, tag: str, prior: float = 1.0, named: bool = False) -> None:
        self.tag, self.dropped, self.prior = tag, tag in NEVER, prior
        self.named = named  # a side part for its class or id alone
        self.items: list = []  # nodes, and texts as (text, whether in a link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.holds_article = False


def _prior(tag: str, attributes: str) -> tuple[float, bool]:
    """The factor of an element, and whether its class or id alone makes it a side part."""
    if tag in SIDES:
        return SIDE_PRIOR, False
    beside = _beside(attributes) if attributes and tag not in ("html", "body", "article", "main") else ""
    return (SIDE_PRIOR if beside else 1.0), beside == "name"


def _names_side(token: str) -> bool:
    """Whether one class or id names a part beside the article, rather than a layout or a topic."""
    words = _NAMES.findall(token)
    if LAYOUT & set(words):
        return False
    while words and words[-1] not in BESIDE:
        if words.pop() not in PARTS:
            return False
    return bool(words)


def _beside(attributes: str) -> str:
    """The attribute that names a part beside the article, or nothing: a role rather than a class or id."""
    found = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.lower()
        if name.lower() == "role":
            if {"navigation", "banner", "contentinfo", "complementary", "search",
                    "dialog", "alert"} & set(_NAMES.findall(value)):
                return "role"
        elif not BESIDE.isdisjoint(_NAMES.findall(value)) and any(
                _names_side(token) for token in value.strip("\"'").split()):
            found = "name"
    return found


def parse(page: str) -> Node:
    """Tree of block elements. Inline elements leave their text in the block around them."""
    root = Node("html")
    stack, links, at, cut_off = [root], 0, 0, len(page)
    last = page.rfind("<")
    if last >= 0 and page.find(">", last) < 0 and re.match(r"</?[a-zA-Z]|<!", page[last:last + 3]):
        cut_off = last  # the page ends within a tag

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].items.append((page[at:min(upto, cut_off)], links > 0))

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text(len(page))
            return root
        text(token.start())
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        links = 0
                        break
            continue
        if tag == "a":
            links += 1
            stack[-1].items.append(("", True))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            if tag == "title" and stack[-1].tag == "html":
                continue
            if end is None:
                return root
            closing = page.find(">", at)
            at = closing + 1 if closing >= 0 else len(page)
            continue
        if tag == "br":
            stack[-1].items.append((" ", False))
            continue
        if tag not in BLOCKS:
            continue
        if tag == "hr":
            stack[-1].items.append(Node(tag))
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p":  # any block ends a paragraph
            stack.pop()
            links = 0
        ended = ENDS.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                links = 0
            elif stack[depth].tag in BOUNDS and stack[depth].tag != "body":
                break
        node = Node(tag, *_prior(tag, token[3]))
        stack[-1].items.append(node)
        stack.append(node)


def _walk(root: Node) -> list[tuple[Node, Node | None]]:
    """Nodes with their parents, parents first; without recursion, as pages nest deeply."""
    order, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo.extend((item, node) for item in reversed(node.items) if isinstance(item, Node))
    return order


def _measure(root: Node) -> list[tuple[Node, Node | None]]:
    """Drop what is never text; fill in counts, and densities times the priors on the way down."""
    order = _walk(root)
    for node, parent in reversed(order):
        if node.dropped:
            node.items = []
            continue
        node.holds_article |= node.tag in ("article", "main")
        # An article in a nav or an aside is a teaser.
        if parent is not None and node.holds_article and (node.prior == 1 or _may_wrap(node)):
            parent.holds_article = True
        _wrap_loose(node)
    for node, _ in order:
        # What wraps the article is no side part, whatever its class says.
        if node.holds_article and _may_wrap(node):
            node.prior, node.named = 1.0, False
    if not root.holds_article:
        _trust_wrappers(root, order)
    order = [(n, p) for n, p in _walk(root) if not n.dropped]
    _count(order)
    factor = {}
    for node, parent in order:
        factor[id(node)] = node.prior * (factor[id(parent)] if parent is not None else 1.0)
        node.density = _density(node, root) * factor[id(node)]
    return order


def _may_wrap(node: Node) -> bool:
    """Whether a side part may be a wrapper of the page: by its class or id alone, or as a form."""
    return node.named or node.tag == "form"


def _wrap_loose(node: Node) -> None:
    """Put text beside blocks into blocks of its own, so that it is weighed as they are."""
    if not any(isinstance(i, Node) for i in node.items):
        return
    items: list = []
    for item in node.items:
        if isinstance(item, Node):
            items.append(item)
        elif items and isinstance(items[-1], Node) and items[-1].tag == LOOSE:
            items[-1].items.append(item)
        elif item[0].strip() or item[1]:
            items.append(Node(LOOSE))
            items[-1].items.append(item)
    node.items = items


def _count(order: list[tuple[Node, Node | None]]) -> None:
    """Fill in the counts of nodes, which come after their parents."""
    for node, parent in reversed(order):
        for item in node.items:
            if not isinstance(item, Node):
                n = len(item[0]) if not item[0].isspace() else 0
                node.chars += n
                if item[1]:
                    node.link_chars += n
                    if not item[0]:
                        node.tags += 1
                        node.link_tags += 1
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + (node.tag != LOOSE)
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags


def _free(node: Node) -> int:
    """Characters of a block's own text outside links."""
    return sum(len(i[0].strip()) for i in node.items if not isinstance(i, Node) and not i[1])


def _open(top: Node) -> tuple[bool, bool]:
    """Whether there is a block of prose, and whether there is a first heading, outside side parts."""
    prose = heading = False
    todo = [top]
    while todo:
        node = todo.pop()
        heading |= node.tag == "h1"
        prose |= _free(node) >= PROSE
        todo.extend(i for i in node.items if isinstance(i, Node) and not i.dropped and i.prior == 1)
    return prose, heading


def _trust_wrappers(root: Node, order: list[tuple[Node, Node | None]]) -> None:
    """Give a part that its class, id or kind makes a side part a neutral prior, if it holds the page's text.

    It must hold the densest block, and prose or the first heading. And either there is no prose outside
    the side parts, or the part holds that heading and there is none outside. Side parts inside it go
    by their own names.
    """
    if not any(_may_wrap(node) for node, _ in order):
        return
    live, parent_of = [], {}
    for node, parent in order:
        if not node.dropped and (parent is None or id(parent) in parent_of) and (
                _may_wrap(node) or node.prior == 1):
            parent_of[id(node)] = parent
            live.append((node, parent))
    prose, heading = _open(root)
    if prose and heading:
        return
    _count(live)
    densest = max((n for n, _ in live), key=lambda n: _density(n, root))
    for node, _ in live:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    above, node = [], densest
    while node is not None:
        if node.prior < 1:
            above.append(node)
        node = parent_of[id(node)]
    if above and not any(_open(above[0])):
        return
    for node in reversed(above):
        has_prose, has_heading = _open(node)
        if prose and (heading or not has_heading):
            return
        node.prior, node.named = 1.0, False
        prose, heading = prose or has_prose, heading or has_heading


def _density(node: Node, body: Node) -> float:
    """Composite text density: characters a tag, less where links take their share."""
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(1, node.tags)
    linked, link_tags = max(1, node.link_chars), max(1, node.link_tags)
    free = max(1, chars - node.link_chars)
    base = math.log(chars / free * node.link_chars
                    + body.link_chars / max(1, body.chars) * chars + math.e)
    return chars / tags * math.log(chars / linked * tags / link_tags + 1) / math.log(base + 1)


def _select(order: list[tuple[Node, Node | None]]) -> tuple[list[Node], float, float]:
    """Subtrees with the largest sums of child densities, the threshold of the body path, and its peak.

    The threshold is the smallest density on the way from the densest block to the root. The
    subtree with the largest sum is text, and so are those beside it that reach the threshold
    and a share of that sum; where it lies in an article or main element, that is the text.
    """
    parent_of = {id(n): p for n, p in order}
    densest = max(order, key=lambda x: x[0].density)[0]
    threshold, node = densest.density, densest
    while node is not None:
        threshold = min(threshold, node.density)
        node = parent_of[id(node)]
    total, best = {}, {}
    for node, _ in reversed(order):
        children = [c for c in node.items if isinstance(c, Node) and not c.dropped]
        total[id(node)] = sum(c.density for c in children) if children else node.density
        best[id(node)] = max([total[id(node)], *(best[id(c)] for c in children)])
    largest = best[id(order[0][0])]
    chosen, todo = [], [order[0][0]]
    while todo:
        node = todo.pop()
        children = [c for c in node.items if isinstance(c, Node) and not c.dropped]
        if not children or total[id(node)] >= best[id(node)]:
            chosen.append(node)
            continue
        todo.extend(c for c in reversed(children) if c.chars and c.density >= threshold
                    and best[id(c)] >= largest * (PART_SHARE if any(
                        isinstance(i, Node) for i in c.items) else LONE_SHARE))
    return _widened(chosen, best, largest, parent_of), threshold, densest.density


def _widened(chosen: list[Node], best: dict, largest: float, parent_of: dict) -> list[Node]:
    """The whole article or main element around the subtree with the largest sum, if there is one."""
    node = next((n for n in chosen if best[id(n)] >= largest), None)
    outer = None
    while node is not None:
        if node.tag in ("article", "main"):
            outer = node
            if node.tag == "article":
                break
        node = parent_of[id(node)]
    return chosen if outer is None else [outer]


def _is_side(node: Node, threshold: float, peak: float) -> bool:
    """Inside the text: a side part less dense, by its prior, than the densest block, or a list of links."""
    if node.prior < 1:
        return node.density < peak
    has_blocks = any(isinstance(i, Node) for i in node.items)
    return has_blocks and 2 * node.link_chars > node.chars and node.density < threshold


def _blocks(node: Node, threshold: float, peak: float, out: list[str]) -> None:
    """Texts of blocks in page order."""
    todo: list = [node]
    run: list[str] = []

    def flush() -> None:
        words = html.unescape("".join(run)).split()
        run.clear()
        if words:
            out.append(" ".join(words))

    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, Node):
            flush()
            if not item.dropped and (item is node or not _is_side(item, threshold, peak)):
                todo.append(None)
                todo.extend(reversed(item.items))
        else:
            run.append(item[0])
    flush()


def main_text(page: str | None) -> str:
    """The article of a page as text; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    if not root.chars:
        return ""
    out: list[str] = []
    chosen, threshold, peak = _select(order)
    for node in chosen:
        _blocks(node, threshold, peak, out)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page.

    The page is parsed to its block elements; what is never text (scripts, styles, controls) goes, and text beside
    blocks becomes a block. Every block gets its composite text density: characters a tag, damped by the share
    of links, times a prior: what elements and names call a side part counts little. The subtree with the
    largest sum of child densities is the text, with the rest of the article or main element around
    it, or else with those beside it that reach a share of that sum and the smallest density on the way from the
    densest block to the root. Inside it, side parts go unless, prior and all, they are the densest, and lists
    of links unless they reach that smallest density. Inline elements are no blocks.

    Null or empty pages give empty text; whole pages are read. Rows and other columns
    stay (a column named ``out`` is replaced); repeated rows give repeated texts.
    """

    @F.pandas_udf("string")
    def extracted(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(out, extracted(F.col(html_col)))
