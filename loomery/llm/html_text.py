"""HTML main text by composite text density.

A tree of the page is built; scripts, styles, menus, forms, asides, page headers and footers and hidden elements are cut
by what they are. For every block of the rest the link-adjusted characters per tag are computed::

    density = C / T * ln(C / LC * T / LT + 1) / ln(C / (C - LC) * LC + LCb / Cb * C + e)

where C counts characters, T tags, LC and LT characters and tags in links, and b stands for the body. Inline markup is
text and no tag. The density sum of a block adds the densities of the blocks in it and of its own text. The block of the
largest sum is the core; the smallest density on its path to the body is the threshold. Every block that reaches the
threshold, as all blocks about it do, marks the block of largest sum inside it; the smallest subtree that holds the core
and all marks is the main text, widened to the headings, paragraphs and lists that stand beside it and to the article
that it is in.

Class, id and role only weigh: a name of adverts, notices, comments, sidebars or menus lowers the densities of its block,
so that a lesser text wins against it. A block so named is left out of the main text unless the core is in it, so the
text that density chose is never cut by a name, and neither is a name that only contains such a word (``legal-opinion``).

Defined cases: null or blank html and pages without text give an empty text; a page whose text is all in forms is read
with its forms; unclosed and mis-nested tags are closed as browsers do for p, li, td, tr, option, dt and dd, and a head
without end tag where its first text, the body or an element that is not of a head begins; character references are
decoded once; a character reference that names no character stays as it is; rows are independent, so ties and repeats
change nothing; of blocks with equal sums the first in the page is the core. Work is linear in the page, however deep.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption option select".split()
)
#: Elements that never hold main text.
NEVER = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video map form button input select "
    "textarea label fieldset nav menu aside dialog head title".split()
)
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound head link meta noscript template".split()) | RAW
#: What closes an open element of the same group when it starts.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
#: An implied end does not reach over these.
SCOPE = frozenset("ul ol dl table body html article section div td th".split())
#: Elements that an implied end or its scope can be about.
NEAR = SCOPE | {x for y in CLOSES.values() for x in y} | {"p"}
#: Blocks of running text, as opposed to containers.
TEXTUAL = frozenset("address blockquote center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr li ol p pre table ul".split())
#: Parts of a name that mark a block as something beside the text, wherever they stand in it.
STRONG = re.compile(
    r"(?:^|-)(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|popup|modal|overlay|"
    r"newsletter|subscribe\w*|signup|paywall|comments?|commentlist|disqus|sidebar\w*|widget\w*|related\w*|recommend\w*|trending|"
    r"social\w*|sharing|breadcrumbs?|nav|navbar|navigation|menu\w*|pagination|pager|masthead|footer\w*|topbar|toolbar|login|"
    r"complementary|contentinfo)(?:$|-)"
)
#: Whole names that do so.
WEAK = frozenset(
    "notice notices alert alerts discussion respond responses response replies reply reviews feedback side aside share "
    "legal disclaimer search head header foot skip copyright teaser ".split()
)
STRONG_WEIGHT, WEAK_WEIGHT = 0.02, 0.1
#: Names of content blocks, and marks that only say what stands beside a block.
CONTENT = frozenset("content main article post entry page container wrapper story body text layout".split())
BESIDE = re.compile(r"(?:^|-)(?:has|with|without|no|is|layout)-")
#: Headers that belong to the article itself.
TITLE = re.compile(r"(?:entry|post|article|story|content)-(?:header|head)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Beside the core's own branch of the body, a container needs this share of the core's density sum.
SHARE = 0.1
#: A list of a page without any container that has this share of its characters in links is a menu.
LINKED = 0.8
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|"
    r"""<([a-zA-Z][^\s/><]*)((?:[^<>"']|"[^"]{0,4000}"|'[^']{0,4000}')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*$""",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "kids", "parent", "side", "weight", "near", "c", "t", "lc", "lt", "own", "inner", "dsum", "density")

    def __init__(self, tag: str, parent: Node | None, side: bool = False, weight: float = 1.0):
        self.tag, self.parent, self.side, self.weight = tag, parent, side, weight
        self.near = self if tag in NEAR or parent is None else parent.near
        self.kids: list[Node | str] = []


def name_weight(value: str) -> float:
    """What a class, id or role value makes of its block's density."""
    weight = 1.0
    names = [x for x in TITLE.sub("", value.replace("_", "-")).split() if not BESIDE.search(x)]
    for x in names:
        if STRONG.search(x):
            weight = STRONG_WEIGHT
        elif x in WEAK:
            weight = min(weight, WEAK_WEIGHT)
    return 1.0 if CONTENT.intersection(names) else weight


def _judged(tag: str, attrs: str, in_article: bool, forms: bool) -> tuple[bool, float]:
    """Whether an element is cut for what it is, and the weight of its names."""
    if tag in NEVER and not (forms and tag in ("form", "fieldset")):
        return True, 1.0
    if tag in ("header", "footer") and not (tag == "header" and in_article):
        return True, 1.0
    weight = 1.0
    for name, a, b, c in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True, 1.0
        if name in ("class", "id", "role"):
            weight = min(weight, name_weight(value))
    return False, weight


class _Builder:
    """The tree while it is built: the open node and how many elements of each name are open."""

    def __init__(self):
        self.root = self.node = Node("html", None)
        self.open: Counter[str] = Counter()

    def start(self, tag: str, **judged) -> None:
        child = Node(tag, self.node, **judged)
        self.node.kids.append(child)
        self.open[tag] += 1
        self.node = child

    def end_to(self, node: Node) -> None:
        """Close elements until ``node`` is the open one."""
        while self.node is not node:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def end(self, tag: str) -> None:
        if self.open[tag] > 0:
            x = self.node
            while x.tag != tag:
                x = x.parent
            self.end_to(x.parent)

    def implied(self, tag: str) -> None:
        """The implied end of an open ``tag``, if one is in scope."""
        x = self.node.near if self.open[tag] > 0 else None
        while x is not None:
            if x.tag == tag:
                self.end_to(x.parent)
                return
            x = None if x.tag in SCOPE or x.parent is None else x.parent.near

    def end_head(self) -> None:
        """Content ends an open head; a body that has not begun then begins."""
        while self.open["head"]:
            self.end("head")
        if self.node is self.root:
            self.start("body")


def parse(html: str, forms: bool = False) -> Node:
    """The tree of a page; text inside raw elements is dropped with them. ``forms``: forms are read as blocks."""
    b, at, low = _Builder(), 0, None
    for m in iter(lambda: TOKEN.search(html, at), None):
        if m.start() > at:
            if b.node.tag == "head" and html[at : m.start()].strip():
                b.end_head()
            b.node.kids.append(html[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2] or m[4]
        if tag:
            tag = tag.lower()
            attrs = m[3] or m[5] or ""
            if tag in RAW:
                if not attrs.endswith("/"):
                    low = html.lower() if low is None or len(low) != len(html) else low
                    k = low.find(f"</{tag}", at)
                    k = len(html) if k < 0 else k
                    close = html.find(">", k)
                    at = len(html) if close < 0 else close + 1
                continue
            if tag in ("html", "body"):
                if tag == "body":
                    b.end_head()
                continue
            if b.node.tag == "head" and tag not in HEAD:
                b.end_head()
            if tag in BLOCK:
                b.implied("p")
            for other in CLOSES.get(tag, ()):
                b.implied(other)
            side, weight = _judged(tag, attrs, b.open["article"] + b.open["main"] > 0, forms)
            b.start(tag, side=side, weight=weight)
            if tag in VOID or attrs.endswith("/"):
                b.end_to(b.node.parent)
        elif end:
            end = end.lower()
            if end not in ("html", "body"):
                b.end(end)
    if at < len(html):
        if b.node.tag == "head" and html[at:].strip():
            b.end_head()
        b.node.kids.append(html[at:])
    return b.root


def _nodes(kids: list) -> Iterator[Node]:
    return (k for k in kids if type(k) is not str and not k.side)


def _order(root: Node) -> list[Node]:
    """Nodes that may hold text, in the order of the page, parents before children."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        found.append(n)
        stack.extend(reversed(list(_nodes(n.kids))))
    return found


def density(c: int, t: int, lc: int, lt: int, body_ratio: float) -> float:
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
    return c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1.0) / base


def measure(body: Node) -> list[Node]:
    """The blocks of the body with their densities and density sums; the body comes first."""
    nodes = _order(body)
    for n in reversed(nodes):
        n.c = n.own = n.lc = n.lt = 0
        n.t = int(n.tag in BLOCK or n.tag == "a")
        for k in n.kids:
            if type(k) is str:
                size = sum(map(len, k.split()))
                n.c += size
                n.own += size
            elif not k.side:
                n.c += k.c
                n.t += k.t
                n.lc += k.lc
                n.lt += k.lt
                if k.tag not in BLOCK:
                    n.own += k.own
        if n.tag == "a":
            n.lc, n.lt, n.own = n.c, n.t, 0
    ratio = body.lc / body.c if body.c else 0.0
    for n in nodes:
        if n is not body:
            n.weight *= n.parent.weight
        n.density = n.weight * density(n.c, max(n.t, 1), n.lc, n.lt, ratio)
    for n in reversed(nodes):
        n.inner = 0.0  # densities of the blocks in it
        for k in _nodes(n.kids):
            n.inner += k.density if k.tag in BLOCK else k.inner
        n.dsum = n.inner + n.weight * density(n.own, 1, 0, 0, ratio)
    return [n for n in nodes if n.tag in BLOCK or n is body]


def _path(node: Node, body: Node) -> list[Node]:
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].parent)
    return out


def _marked(body: Node, core: Node, threshold: float) -> Iterator[Node]:
    """The block of largest sum in each block that reaches the threshold, as all blocks about it do."""
    own_branch = {id(x) for x in _path(core, body)}
    best: dict[int, Node] = {}
    for n in reversed(_order(body)):
        top = n if n.tag in BLOCK or n is body else None
        for k in _nodes(n.kids):
            t = best.get(id(k))
            if t is not None and (top is None or t.dsum > top.dsum):
                top = t
        if top is not None:
            best[id(n)] = top
    stack = [body]
    while stack:
        n = stack.pop()
        for k in _nodes(n.kids):
            if k.tag not in BLOCK:
                stack.append(k)
            elif k.density >= threshold:
                beside = n is body and id(k) not in own_branch and k.tag not in TEXTUAL
                if k.c and not (beside and k.dsum < SHARE * core.dsum):
                    stack.append(k)
                    yield best[id(k)]


def _common(nodes: list[Node], body: Node) -> Node:
    """The smallest subtree that holds all of ``nodes``."""
    wanted = {id(n) for n in nodes}
    holds: dict[int, int] = {}
    for n in reversed(_order(body)):
        holds[id(n)] = (id(n) in wanted) + sum(holds[id(k)] for k in _nodes(n.kids))
    whole = body
    while id(whole) not in wanted:
        below = [k for k in _nodes(whole.kids) if holds[id(k)] == len(wanted)]
        if not below:
            break
        whole = below[0]
    return whole


def _widened(main: Node, body: Node, core: Node) -> Node:
    """``main`` with the headings, paragraphs and lists beside it, and all of the article that it is in."""
    while main is not body:
        up = main.parent
        rest = [k for k in _nodes(up.kids) if k is not main and k.c and k.weight >= up.weight]
        if up.tag in BLOCK and any(k.tag in BLOCK and k.tag not in TEXTUAL for k in rest) or up is body and not rest:
            break
        main = up
    for x in _path(main, body):
        if x.tag in ("article", "main"):
            main = x
    return main


def main_node(root: Node) -> tuple[Node, Node] | None:
    """(main subtree, core) of a page."""
    body = next((k for k in root.kids if type(k) is not str and k.tag == "body"), root)
    blocks = measure(body)
    if not body.c:
        return None
    core = max(blocks, key=lambda n: n.dsum)
    threshold = min(x.density for x in _path(core, body) if x.tag in BLOCK or x is body)
    main = _common([core, *_marked(body, core, threshold)], body)
    return _widened(main, body, core), core


def _leave_out(main: Node, core: Node) -> None:
    """Cut from the main subtree what its names mark as something else, unless the core is in it, and menus of the body."""
    about = {id(x) for x in _path(core, main)}
    stack = [main]
    while stack:
        n = stack.pop()
        for k in _nodes(n.kids):
            if id(k) not in about:
                menu = n.tag in ("body", "html") and k.tag in BLOCK and k.tag not in ("p", "pre") and k.lt > 2 and k.lc >= LINKED * k.c
                k.side = k.weight < n.weight or menu
            if not k.side:
                stack.append(k)


def text_of(node: Node) -> str:
    """The text of a node: blocks in order, white space as one space."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if type(n) is str:
            out.append(n)
        elif n.side:
            out.append(" ") if n.tag in BLOCK else None
        elif n.tag == "br":
            out.append("\n")
        else:
            block = n.tag in BLOCK
            if block:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(n.kids))
    return " ".join(unescape("".join(out)).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    for forms in (False, True):
        found = main_node(parse(html, forms))
        if found is not None:
            _leave_out(*found)
            return text_of(found[0])
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
