"""HTML extraction by tree scoring.

Method. A tolerant scanner builds the tree of containers and their text blocks. Each paragraph-like block gives points
for its length and commas to its ancestors, halving with the distance; a container's sum is discounted by the share of
its text that stands in links. The best container is kept, with siblings whose text stands in links for less than three
tenths. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments never enter the tree.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import slices, texts_of

#: Quotes part values from markup only where they open a value; elsewhere, and where they aren't closed, they are characters.
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+{_VALUE}?+)*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))")
_HIDDEN_ATTR = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml canvas xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose content is never part of the article.
DROP = frozenset("nav header footer aside form button select dialog head menu search fieldset".split())
#: What a new element of this name closes, up to the nearest element of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words of class, id or role that mark what stands beside an article.
UNLIKELY = frozenset(
    "ad ads advert advertisement adverts advertising adsense adslot adbox adunit banner breadcrumb breadcrumbs comment comments commentlist commentary consent contentinfo cookie cookies copyright disqus "
    "footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendation recommendations recommended related replies "
    "reply respond rss search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags taboola toc toolbar tooltip widget widgets complementary alert gdpr login".split()
)
#: Words that say nothing about what stands in an element: with these alone beside it, a word of UNLIKELY marks an element.
NEUTRAL = frozenset(
    "area areas article articles bar bars block blocks body bottom box boxes btn btns button buttons card cards col column container content count elem element feed foot form group head heading holder icon icons inline inner item items label left "
    "lg link links list lists main md menu middle module outer page panel pane popover post posts primary reader readers region right row secondary section segment side site slot small sm stories story text title top unit user users visitor wide wrap wrapper".split()
)
LIKELY = frozenset("article body content entry main post story text prose".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """A container: its blocks of text and its child containers, in page order."""

    __slots__ = ("tag", "parent", "children", "score", "link", "size", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.children: list[Node | Block] = []
        self.score = 0.0
        self.link = self.size = 0


class Block:
    __slots__ = ("text", "link", "tag")

    def __init__(self, text: str, link: int, tag: str):
        self.text, self.link, self.tag = text, link, tag


def _names(attrs: str) -> tuple[list[set[str]], dict[str, str]]:
    """The words of each single class, id and role, and all attributes."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return [{w.lower() for w in _WORDS.findall(x)} for k in ("class", "id", "role") for x in found.get(k, "").split()], found


def _unlikely(words: set[str]) -> bool:
    """True for 'cookie-notice' and 'related-posts', not for 'notice-period', 'has-sidebar' or 'article-main-text'."""
    marks = words & UNLIKELY
    return bool(marks) and all(w in NEUTRAL or w.isdigit() for w in words - marks) and not (words & {"article", "main"} and not words & {"related", "comments", "comment"})


def _beside(tag: str, attrs: str, by_class: bool) -> bool:
    """True if an element stands beside the article by its name or its attributes."""
    if tag in DROP:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN_ATTR.search(attrs) and "hidden" in _ATTR.sub(" ", attrs).lower().split():
        return True
    names, found = _names(attrs)
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE) or found.get("aria-hidden") == "true":
        return True
    return by_class and any(map(_unlikely, names))


def _weight(attrs: str) -> float:
    return 25.0 if attrs and any(words & LIKELY for words in _names(attrs)[0]) else 0.0


def parse(page: str, by_class: bool = True) -> Node:
    """The tree of containers of a page. Unclosed, misnested and cut-off markup is taken as browsers take it, roughly.

    Elements are looked up by name through their places on the stack, so that time is linear however deep they nest.
    Without ``by_class``, classes, ids and roles mark nothing.
    """
    root = Node("root", None)
    #: Element ("" when closed before those inside it), container that holds its content, and whether it is beside (1).
    stack: list[tuple[str, Node, int]] = []
    places: dict[str, list[int]] = {}  # of open elements, by name
    blocks: list[int] = []  # of open elements of BLOCK
    open_ended: set[str] = set()  # elements of RAW without an end tag from here on
    node, beside, link = root, 0, 0
    text: list[str] = []
    in_link = 0

    def flush() -> None:
        nonlocal in_link
        if text:
            s = " ".join("".join(text).split())
            text.clear()
            if s:
                node.children.append(Block(s, min(in_link, len(s)), stack[-1][0] if stack else ""))
        in_link = 0

    def pop_to(k: int) -> None:
        """Close the elements from place k of the stack on."""
        nonlocal node, beside, link
        while len(stack) > k:
            tag, at, out = stack.pop()
            if not tag:
                continue
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                flush_if_open()
                node = at
            beside -= out
            link -= tag == "a"

    def last(names) -> int:
        """The place of the innermost open element of one of the names, or -1."""
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    def no_block_after(k: int) -> bool:
        return not blocks or blocks[-1] <= k

    def flush_if_open() -> None:
        if text:
            flush()

    def put(raw: str) -> None:
        nonlocal in_link
        if raw and not beside:
            s = html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if link:
                in_link += len(s.strip())

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            put(page[pos:])
            break
        put(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                put(page[m.start() + 9 : pos].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            k = last((tag,))
            if tag == "br" or tag == "p" and k < 0:
                text.append(" ") if not beside else None
                continue
            if k < 0:
                continue
            if tag not in BLOCK and not no_block_after(k):
                _, at, out = stack[k]  # </b> over a block boundary ends the inline element alone
                beside -= out
                link -= tag == "a"
                stack[k] = ("", at, 0)
                places[tag].pop()
                continue
            pop_to(k)
            continue
        attrs = m[3] or ""
        if tag in RAW:
            end = None
            if tag not in open_ended:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, pos)
                if end is None:  # nor has any later one
                    open_ended.add(tag)
            if tag in ("script", "style", "title", "textarea"):
                pos = end.end() if end else n
            elif end and not attrs.rstrip().endswith("/"):
                pos = end.end()
            continue
        if tag in VOID:
            if tag == "hr":
                flush_if_open()
            elif not beside:
                text.append(" ") if tag == "br" else None
            continue
        if tag in BLOCK:
            k = last(("p",))
            if k >= 0 and no_block_after(k):
                pop_to(k)
            if tag in CLOSES:
                shut, stop = CLOSES[tag]
                k = last(shut)
                if k > last(stop):
                    pop_to(k)
        elif tag == "a":  # links don't nest
            k = last(("a",))
            if k >= 0 and no_block_after(k):
                pop_to(k)
        out = int(_beside(tag, attrs, by_class))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
            flush_if_open()
            stack.append((tag, node, out))
            if not beside and not out:
                child = Node(tag, node, _weight(attrs))
                node.children.append(child)
                node = child
        else:
            stack.append((tag, node, out))
        beside += out
        link += tag == "a"
    pop_to(0)
    flush_if_open()
    return root


def _blocks(node: Node):
    stack: list[Node | Block] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Block):
            yield x
        else:
            stack.extend(reversed(x.children))


def _score(root: Node) -> list[Node]:
    """Pass the points of blocks up to their ancestors; returns the containers in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):  # children before parents
        for c in node.children:
            node.size += len(c.text) if isinstance(c, Block) else c.size
            node.link += c.link
    for node in order:
        for c in node.children:
            if isinstance(c, Block) and not re.fullmatch("h[1-6]", c.tag) and len(c.text) >= 2:
                points = 1 + c.text.count(",") + len(c.text) / 100
                points *= 1 - c.link / max(1, len(c.text))
                # a paragraph's points go to the container that holds it, then fade upwards
                up = node.parent if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") and node.parent else node
                share = 1.0
                while up is not None and share > 0.01:
                    up.score += points * share
                    share *= 0.5
                    up = up.parent
    for node in order:
        node.score = (node.score + (node.weight if node.score else 0)) * (1 - node.link / max(1, node.size))
    return order


def main_text(page: str) -> str:
    """The article's text: blocks in page order, joined by one newline; the empty text if there is none.

    Where classes, ids and roles would leave no text at all, they mark nothing.
    """
    if not page:
        return ""
    return _main_text(parse(page)) or _main_text(parse(page, by_class=False))


def _main_text(root: Node) -> str:
    order = _score(root)
    named = [x for x in order if x.tag in ("article", "main") and x.size]
    inside = [x for x in order if x.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and x.score > 0]
    if not inside:
        return "\n".join(b.text for b in _blocks(root) if b.link < len(b.text))
    best = max(inside, key=lambda x: x.score)
    # a named article that holds most of the best container's text is the article as a whole
    above: set[int] = set()
    up: Node | None = best
    while up is not None:
        above.add(id(up))
        up = up.parent
    best = next((x for x in sorted(named, key=lambda x: x.tag != "article") if id(x) in above), best)
    # a wrapper around the best container alone stands for it
    while best.tag not in ("article", "main", "body") and best.parent is not None and best.parent.parent is not None and best.parent.tag not in ("body", "html") and best.parent.size == best.size:
        best = best.parent
    keep = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        keep = []
        for c in best.parent.children:
            if c is best:
                keep.append(c)
            elif isinstance(c, Block):
                if c.link < 0.3 * len(c.text):
                    keep.append(c)
            elif c.size and c.link < 0.3 * c.size:
                keep.append(c)
    return "\n".join(b.text for x in keep for b in ([x] if isinstance(x, Block) else _blocks(x)))


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) of every page, from its whole html.

    Null or empty html gives the empty text; nulls in other columns stay; repeated rows give repeated rows; columns
    outside ``keep`` are not read. One row in, one row out, without a shuffle.
    """
    cols = [df[id_col].alias("_id"), *(df[c].alias(f"_k{i}") for i, c in enumerate(keep)), df[html_col].alias("html")]
    rows = df.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", text string"

    def run(batches):
        for b in slices(batches, "html"):
            text = pa.array(list(map(main_text, texts_of(b, "html"))), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "text")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("bigint"))
