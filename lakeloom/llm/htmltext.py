"""Main text of web pages by composite text density.

Every element gets a link-adjusted density: its characters for each tag below it, times a logarithm that falls as
its links grow; tags that only mark phrases (bold, line breaks) aren't counted, as they don't thin a text. A node's
density sum is that of its child blocks, and of the text that stands in it directly. The block of the largest sum is
the core; the lowest density on the way from it up to below the body is the threshold. On that way up, what stands
beside it is content too where it reaches the threshold in paragraphs, or is a heading before it that it lacks, or,
below the body, a paragraph, list or table; and what is between such parts. Blocks of mostly links aren't.

Names are hints only. An element whose tag, role or whole class says menu, sidebar, advert, comment and so on counts
as if its text were links, a quarter of its density sum, and is left out beside or inside the core, but never with the
core in it: an article stays whatever it is called. A hinted block of little text is no core. Only elements that
hold no text for readers (scripts, styles, controls, embedded media) are removed by kind.

A null, empty or unparsable page has the empty text, and so has one with no text but hinted scraps. Lengths are not
limited; pages of equal html give equal text, of equal sums the first block counts; any other column of the input
stays as it is, and one named `main_text` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of HTML: elements without content, elements of raw text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p ul ol dl table blockquote pre figure".split())
# Elements that hold no text for readers, and hints of boilerplate by element, ARIA role, and class or id.
NEVER = frozenset("head title script style noscript template button select option datalist textarea input iframe object embed applet svg canvas audio video map dialog xmp noembed noframes".split())
HINTED = frozenset("nav header footer aside form menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads adv adbox advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies share sharing social related recommended widget widgets newsletter subscribe subscription signup login toolbar pagination pager skip".split()
)
#: What may stand beside such a word in one class without changing what it says.
NEUTRAL = frozenset("site page main top bottom left right box block list bar area wrap wrapper container inner outer slot unit section post posts item links link row col column content form global primary secondary mobile desktop js the".split())
HINT_WEIGHT, HINTED_CORE = 0.25, 500
CLOSES = {  # an opening tag of the key's kind ends these open elements
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "own", "own_links", "density", "total", "never", "hint", "in_hint", "in_link")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = self.own_links = 0
        self.density = self.total = 0.0
        hidden, self.hint = _marks(tag, attributes, parent)
        self.never = hidden or bool(parent and parent.never)
        self.in_hint = self.hint or bool(parent and parent.in_hint)
        self.in_link = tag == "a" or bool(parent and parent.in_link)
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


def _says_boilerplate(name: str) -> bool:
    """Whether all parts of a class or id are hints, or neutral beside one."""
    parts = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in WORDS for w in parts) and all(w in WORDS or w in NEUTRAL for w in parts)


def _marks(tag: str, attributes: str, parent: Node | None) -> tuple[bool, bool]:
    """(never read, hinted) by an element's tag and attributes."""
    never, hint = tag in NEVER, tag in HINTED
    if tag in ("html", "body", "#root"):
        return False, False
    if tag == "header":  # of a page; an article's own holds its title
        up = parent
        while up is not None and up.tag not in ("article", "main", "section"):
            up = up.parent
        hint = up is None
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                hint = hint or any(map(_says_boilerplate, value.split()))
            elif name == "role":
                hint = hint or value.strip() in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                never = True
    return never, hint


def parse(html: str) -> Node:
    """The page as a tree; unclosed and misnested elements are closed as browsers do for the common cases."""
    root = node = Node("#root", None)
    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            node.parts.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag ends the nearest open element of its name, but not across a block for an inline name
            up = node
            while up.parent and up.tag != tag and not (tag in INLINE and up.tag in BLOCK):
                up = up.parent
            if up.parent and up.tag == tag:
                node = up.parent
            continue
        if tag in BLOCK:
            up = node
            while up.parent and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            up = node
            while up.parent and up.tag not in stops:
                if up.tag in ends:
                    node = up.parent
                up = up.parent
        new = Node(tag, node, m[3])
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            stop = end.start() if end else len(html)
            new.parts.append(html[at:stop])
            at = html.find(">", stop) + 1 if end and ">" in html[stop:] else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            node = new
    node.parts.append(html[at:])
    return root


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if not c.never]
    return out


def _is_block(n: Node) -> bool:
    return n.tag not in INLINE and n.tag not in VOID


def score(root: Node) -> tuple[list[Node], Node]:
    """Set every read node's counts, density and density sum; the nodes from the root down, and the body."""
    nodes = _order(root)
    for n in reversed(nodes):
        text = sum(len(" ".join(unescape(x).split())) for x in n.parts if type(x) is str)
        n.own += text
        n.chars += text
        if n.in_link:
            n.own_links += text
        n.link_chars = n.chars if n.hint or n.tag == "a" else n.link_chars + (text if n.in_link else 0)
        if p := n.parent:
            p.chars, p.link_chars = p.chars + n.chars, p.link_chars + n.link_chars
            p.tags, p.link_tags = p.tags + n.tags + (_is_block(n) or n.tag == "a"), p.link_tags + n.link_tags + (n.tag == "a")
            if not _is_block(n):  # a phrase's text stands in the block around it
                p.own, p.own_links = p.own + n.own, p.own_links + n.own_links
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)

    def density(c: int, t: int, lc: int, lt: int) -> float:
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(base), 0.1)

    for n in nodes:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags) if n.chars else 0.0
    for n in nodes:
        direct = density(n.own, 1, n.own_links, n.own_links > 0) if n.own else 0.0
        n.total = (direct + sum(c.density for c in n.children if not c.never and _is_block(c))) * (HINT_WEIGHT if n.in_hint else 1)
    return nodes, body


def _core(body: Node) -> Node | None:
    """The first block of the largest density sum; a hinted one must hold some text besides links."""
    best = None
    for n in _order(body):
        if _is_block(n) and n.total > (best.total if best else 0) and not (n.in_hint and n.chars - n.own_links < HINTED_CORE):
            best = n
    return best


def _beside(part: Node | str, threshold: float, below_body: bool, ranks: set[str], before: bool) -> bool:
    """Whether a part beside the way up is content by itself."""
    if type(part) is str:
        return len(" ".join(unescape(part).split())) >= max(threshold, 1)
    if part.never or part.hint or not part.chars or part.link_chars * 2 > part.chars:
        return False
    if part.tag in HEADINGS:
        return before and not any(r <= part.tag for r in ranks)
    if part.tag in PARAGRAPHS and below_body:
        return True
    return part.density >= threshold and (part.tag in PARAGRAPHS or any(_is_block(c) for c in part.children))


def main_parts(root: Node) -> list[Node | str]:
    """The parts of the main text, in page order."""
    _, body = score(root)
    core = _core(body)
    if core is None:  # too short for any density: what is no link
        return [body] if body.chars > body.link_chars else []
    parts: list[Node | str] = [core]
    threshold, up = core.density, core.parent if core is not body else None
    while up is not None and up is not body and up.parent is not None:
        threshold, up = min(threshold, up.density), up.parent
    ranks, at = {n.tag for n in _order(core) if n.tag in HEADINGS}, core
    while at is not body and at.parent is not None:
        up, low = at.parent, at.parent is not body and at.parent.parent is not None
        here = next(i for i, x in enumerate(up.parts) if x is at)
        good = [i for i, x in enumerate(up.parts) if i != here and _beside(x, threshold, low, ranks, i < here)]
        first, last = min([here, *good]), max([here, *good])
        kept = lambda x: type(x) is str or not (x.never or x.hint or _is_block(x) and x.chars and x.link_chars * 2 > x.chars)
        parts = [*filter(kept, up.parts[first:here]), *parts, *filter(kept, up.parts[here + 1 : last + 1])]
        ranks |= {up.parts[i].tag for i in good if type(up.parts[i]) is not str} & HEADINGS
        at = up
    return parts


def text_of(parts: list[Node | str]) -> str:
    """Blocks in page order, one space between them; white space inside a block becomes one space. Hinted blocks inside are left out."""
    out: list[str] = []
    stack: list = [x for p in reversed(parts) for x in ((p,), " ")]
    while stack:
        x = stack.pop()
        if type(x) is tuple:  # a part itself, hinted or not
            x = x[0]
            if type(x) is str:
                out.append(unescape(x))
                continue
        elif type(x) is str:
            out.append(x)
            continue
        elif x.never or x.hint:
            continue
        edge = " " if x.tag in BLOCK or x.tag == "br" else ""
        stack.append(edge)
        stack += [(unescape(p) if type(p) is str else p) for p in reversed(x.parts)]
        out.append(edge)
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    return text_of(main_parts(parse(html))) if html else ""


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Append the main text of each page; one pass, no shuffle."""
    kept = [c for c in pages.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x) for x in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), text], [*kept, out])

    return pages.mapInArrow(run, pages.select(*kept).withColumn(out, F.lit("")).schema)
