"""Main-text extraction from HTML by tree scoring.

A page is read into a tree of elements and text blocks. Every paragraph-like
block earns points for its length and its commas and passes them to its
ancestors (all to the parent, half to the grandparent, a third of that and so
on further up); a container's sum is discounted by its link density. The best
container is kept, with those of its siblings that score close to it or read
like prose. Elements that are never content by their tag or role (menus, page
headers and footers, forms, scripts) and boxes of links are left out, but for
lists under a heading of sources. Names (classes and ids) count word by word:
an element that is named after page furniture (adverts, notices, comments by
readers and so on) and nothing else stays only if it holds FURNITURE_SHARE of all
points of the page, or if it is so named by an id, as generators make them of
headings, and reads like a section of the article. Vaguer names cost
UNLIKELY_POINTS, which tells against a container or sibling but takes nothing
out of the article. A page is read and scored in time linear in its length,
however deep its elements are nested.

Defined results: null or empty html gives an empty text; a page without any
container that scores gives the blocks of its body; broken markup (open tags,
pages cut in the middle of a tag or a reference) is read as far as it goes; no
length is capped; rows are independent, so repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_slices, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "template", "noscript", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = RAW | {"head", "nav", "aside", "footer", "form", "button", "select", "option", "menu", "dialog", "object", "audio", "video", "canvas", "label", "input", "fieldset"}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What an opening tag closes, within the given scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words that name page furniture, and words that stand beside them in such names. A name is one of furniture if its
#: words are all of these kinds, one of the first at least: `ads-top`, `reader-comments`, but not `related-work`.
FURNITURE = frozenset("ad ads adbox advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer footnav gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pagination popup promo promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription topbar".split())
BESIDE = frozenset("area article articles bar block body bottom box button buttons col container count desktop feed fixed follow form global icons inner item items js left line link links list main media mobile module more outer page panel policy post posts primary reader readers right row secondary section settings site slot sm sticky stories stream strip text thread title top unit us user view widget with wrap wrapper your zone facebook friends google inline large leaderboard native rectangle small skyscraper this twitter".split())
#: Of the first, those that headings are made of, too: by such an id alone a section that reads like one of the article stays.
TOPICS = frozenset("banner consent cookies header menu navigation notice overlay promotion share sharing social subscription".split())
#: Furniture by form rather than by content: beside a name of content, as in `content-header`, they tell nothing.
FORMS = frozenset("banner header masthead modal notice notification overlay popup".split())
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CONTROLS = {"button", "form", "select", "label", "fieldset", "option", "dialog", "menu"}
#: Headings of lists of links that belong to an article.
SOURCES = re.compile(r"\W*(?:sources?|references|bibliography|further reading|literature|quellen|literatur|sources et références|références|bibliographie|fuentes|referencias|bibliografía)\W*$", re.I)
#: Names that content seldom has.
UNLIKELY = re.compile(r"(?:^|[-_\s])(?:alert|combx|community|disclaimer|discussion|extra|foot|legends|login|pager|remark|reply|rss|shoutbox|skip|tags|toolbar|tools|widget)(?:$|[-_\s\d])", re.I)
FURNITURE_SHARE, UNLIKELY_POINTS = 0.9, 25.0
MAYBE = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text)(?:$|[-_\s])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog", "alertdialog", "toolbar", "form"}
TAG_POINTS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "form": -3.0, "address": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
COMMAS = re.compile(r"[,،、，﹐]")


class Node:
    __slots__ = ("tag", "parent", "never", "points", "below", "chars", "linked", "blocks", "hint", "furniture", "topic", "unlikely", "controls", "state")

    def __init__(self, tag, parent, never=False, hint=0.0, furniture=False, topic=False, unlikely=False):
        self.tag, self.parent, self.never, self.hint, self.furniture, self.topic, self.unlikely = tag, parent, never, hint, furniture, topic, unlikely
        self.points, self.below, self.chars, self.linked, self.blocks = 0.0, 0.0, 0, 0, 0
        self.controls = tag in CONTROLS
        self.state = None


class Block:
    __slots__ = ("node", "text", "linked", "points")

    def __init__(self, node, text, linked):
        self.node, self.text, self.linked = node, text, linked
        n = len(text)
        self.points = 1.0 + len(COMMAS.findall(text)) + min(n / 100.0, 3.0) if n >= 25 and node.tag not in HEADINGS else 0.2
        self.points *= 1.0 - linked / n


def _furniture_words(name: str) -> set[str]:
    """The words of a class or id that name furniture; none if another word stands beside them."""
    plain = re.sub(r"[^a-z]", "", name.lower())
    if plain in FURNITURE:
        return {plain}
    words = {w.lower() for w in WORDS.findall(name)}
    return words & FURNITURE if words <= FURNITURE | BESIDE else set()


def _kind(tag: str, attrs: str, inside_content: bool) -> tuple[bool, float, bool, bool, bool]:
    """Whether an element is never content, the points its names give it, and whether they are of furniture, of
    furniture by an id that may be a heading's, or unlikely."""
    if tag in NEVER or tag == "header" and not inside_content:
        return True, 0.0, False, False, False
    if not attrs or attrs.isspace():  # no names to be read
        return False, 0.0, False, False, False
    classes, ident, hidden, role = [], "", False, ""
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), html_lib.unescape(a or b or c)
        if key == "class":
            classes += value.split()
        elif key == "id":
            ident = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key == "role":
            role = value.lower()
        elif key == "aria-modal" and value == "true":
            hidden = True
    if tag in ("html", "body"):
        return False, 0.0, False, False, False
    if hidden or role in ROLES:
        return True, 0.0, False, False, False
    names = " ".join([*classes, ident])
    maybe = bool(MAYBE.search(names))
    if tag in ("article", "main"):
        # an article among readers' comments is one of them; other names on it tell nothing
        return False, 25.0 * maybe, bool(re.search(r"(?:^|[-_\s])comment", names, re.I)), False, False
    by_class = set().union(*map(_furniture_words, classes)) if classes else set()
    by_id = _furniture_words(ident)
    if maybe and by_class | by_id <= FORMS:
        by_class = by_id = set()
    furniture = bool(by_class or by_id)
    unlikely = bool(UNLIKELY.search(names)) and not maybe
    return False, 25.0 * maybe - UNLIKELY_POINTS * unlikely, furniture, furniture and not by_class and by_id <= TOPICS, unlikely


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements, parents first, and text blocks in page order, each at its nearest block-level element."""
    root = Node("html", None)
    nodes, stack, blocks, run = [root], [root], [], []
    run_linked = 0
    where: dict[str, list[int]] = {"html": [0]}  # places in the stack by tag
    blocky = [0]  # places of block-level elements in the stack

    def flush():
        nonlocal run, run_linked
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run = []
            node = stack[blocky[-1]]
            if text and not node.never:
                blocks.append(Block(node, text, min(run_linked, len(text))))
        run_linked = 0

    def close(k: int):
        for node in reversed(stack[k:]):
            where[node.tag].pop()
        del stack[k:]
        while blocky[-1] >= k:
            blocky.pop()

    def last(tags) -> int:
        found = 0
        for t in tags:
            if (places := where.get(t)) and places[-1] > found:
                found = places[-1]
        return found

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not stack[-1].never:
            run.append(piece)
            if where.get("a"):
                run_linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        closing, name, attrs = m.groups()
        if not name:
            if m[0].startswith("<![CDATA["):
                run.append(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if closing:
            if tag == "br":
                run.append(" ")
                continue
            k = last((tag,))
            if tag not in BLOCK and blocky[-1] > k:
                continue  # an inline end tag doesn't reach through blocks
            if tag in BLOCK or k and stack[k].never:
                flush()
            if k:
                close(k)
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in ("br", "hr"):
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            stack[-1].controls = stack[-1].controls or tag == "input"
            continue
        if tag in BLOCK:
            if run:
                flush()
            if tag in ENDS_P and (k := last(("p",))):
                close(k)
        if tag in CLOSES:
            what, scope = CLOSES[tag]
            if (k := last(what)) > last(scope):
                flush()
                close(k)
        if tag in ("html", "body") and where.get(tag):
            continue
        parent = stack[-1]
        if tag == "body":
            parent = root
            flush()
            close(1)
        never, hint, furniture, topic, unlikely = _kind(tag, attrs, tag != "header" or bool(where.get("article") or where.get("main")))
        if never and not parent.never:
            flush()
        if tag not in BLOCK and attrs.rstrip().endswith("/"):
            continue
        node = Node(tag, parent, never or parent.never, hint, furniture, topic, unlikely)
        nodes.append(node)
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocky.append(len(stack))
        stack.append(node)
    flush()
    return nodes, blocks


def _without_furniture(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks outside of elements that are named as furniture and neither hold nearly all the page's points nor,
    named so by an id that may be a heading's, read like a section: a heading first, then two paragraphs or more, few
    links, nothing to press or fill in."""
    if not any(node.furniture for node in nodes):
        return blocks
    total = sum(block.points for block in blocks)
    for block in blocks:
        node = block.node
        node.below += block.points
        node.chars += len(block.text)
        node.linked += block.linked
        node.blocks += block.points >= 1.0
    for node in reversed(nodes):
        if parent := node.parent:
            parent.below += node.below
            parent.chars += node.chars
            parent.linked += node.linked
            parent.blocks += node.blocks
            parent.controls = parent.controls or node.controls
    starts: dict[int, Block] = {}  # of each element, its first block in page order
    if any(node.topic for node in nodes):
        for block in blocks:
            node = block.node
            while node and id(node) not in starts:
                starts[id(node)] = block
                node = node.parent
    for node in nodes:
        first = starts.get(id(node))
        section = node.topic and first and first.node.tag in HEADINGS and node.blocks >= 2 and not node.controls and node.linked < 0.3 * node.chars
        node.state = bool(node.parent and node.parent.state) or node.furniture and not section and node.below <= FURNITURE_SHARE * total
    kept = [block for block in blocks if not block.node.state]
    for node in nodes:
        node.below, node.chars, node.linked, node.blocks, node.state = 0.0, 0, 0, 0, None
    return kept


def extract(page: str | None) -> str:
    """The main text of one page: blocks joined by two line ends."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    blocks = _without_furniture(nodes, blocks)
    if not blocks:
        return ""
    for block in blocks:
        node = block.node
        container = node if node.tag in ("div", "article", "main", "section", "body", "td", "html") else node.parent
        container.points += block.points
        container.state = True  # has points of its own or below
        node.chars += len(block.text)
        node.linked += block.linked
        node.blocks += 1
    # all points to the container, half to its parent, a third of that and so on further up
    for node in reversed(nodes):
        if parent := node.parent:
            parent.below += 0.5 * node.points + node.below / 3
            parent.chars += node.chars
            parent.linked += node.linked
            parent.blocks += node.blocks
            parent.state = parent.state or node.state
        node.points += node.below

    def score(node: Node) -> float:
        return (node.points + (TAG_POINTS.get(node.tag, 0.0) + node.hint if node.points else 0.0)) * (1.0 - node.linked / max(1, node.chars))

    best = max((node for node in nodes if node.state), key=score)  # of equals the first
    # a container whose parent holds hardly more than it is one part of the whole: climb to what gathers the parts
    top = best
    while top.parent and top.parent.tag not in ("body", "html") and score(top.parent) >= 0.75 * score(best):
        top = top.parent
    kept = {id(top)}
    if top.tag not in ("body", "html"):
        floor = max(10.0, 0.2 * score(best))
        for node in nodes:
            if node.parent is not top.parent or node is top or not node.blocks:
                continue
            density = node.linked / max(1, node.chars)
            if score(node) >= floor and density < 0.5 or node.tag == "p" and (node.chars > 80 and density < 0.25 or 0 < node.chars <= 80 and density == 0 and top.tag not in ("article", "main")) or node.tag in HEADINGS and density == 0:
                kept.add(id(node))
    # lists that follow a heading of sources are part of the article
    cited, climbed = set(), set()
    for before, block in zip(blocks, blocks[1:], strict=False):
        if before.node.tag in HEADINGS and SOURCES.match(before.text):
            box = block.node
            while box.parent and box.tag not in ("ul", "ol", "dl") and id(box) not in climbed:
                climbed.add(id(box))  # what is above has been seen to once
                box = box.parent
            if box.tag in ("ul", "ol", "dl"):
                cited.add(id(box))
    # by element: whether it is inside what is kept, in a box of links there, in a header there, in a heading there
    for node in nodes:
        inside, links, header, heading = node.parent.state if node.parent else (False, False, False, False)
        if id(node) in kept:
            node.state = (True, False, False, False)
            continue
        # lists, tables and boxes of links inside the article are menus
        box = node.tag in ("ul", "ol", "dl", "table", "div", "section") and id(node) not in cited and (node.blocks >= 2 and node.linked > 0.8 * node.chars or node.unlikely and node.linked > 0.5 * node.chars)
        node.state = (inside, links or box, header or node.tag == "header", heading or node.tag in HEADINGS)
    out = []
    for block in blocks:
        inside, links, header, heading = block.node.state
        if inside and not links and not (header and not heading):
            out.append(block.text)
    return "\n\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_slices(batches, "html"):
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    own = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return own.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
