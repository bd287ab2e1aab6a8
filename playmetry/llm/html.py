"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One piece of markup: a comment, a declaration, or a tag.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
#: Elements whose content is no markup, and what ends each.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in ("script", "style", "noscript", "textarea", "title")}
#: An end of the tag by '/>', as far as the slash is no part of a value.
CLOSED = re.compile(r"(?:\A|[\s\"'])/\Z")
#: Elements that '/>' closes, as it does all inside the first two.
FOREIGN = frozenset(["svg", "math"])
INNER = FOREIGN | {"select"}
CLOSABLE = FOREIGN | {"iframe", "template", "object", "canvas", "select"}
#: Elements of foreign content that may hold other elements.
HOLDERS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Elements that end foreign content and lists of options left open.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 article section main div ul ol dl table blockquote pre form nav header footer aside figure body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not begin a new block.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img
    object canvas svg iframe template select math semantics mrow mfrac msqrt mroot mstyle merror mpadded mphantom mi mn mo ms mtext mspace
    msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction""".split()
)
#: Elements that a new element of the first kind closes, as far as one of the second kind.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements inside which a new block closes an open paragraph no further.
SCOPE = frozenset("body div article section main td th li blockquote figure aside nav header footer form object template svg math foreignobject".split())
#: Elements that are never part of the article.
OUTSIDE = frozenset("head nav footer aside button select input menu dialog svg template iframe annotation annotation-xml".split())
#: Elements that may wrap a whole page as well as a few controls.
FORMS = frozenset(["form", "fieldset"])
#: Words in id, class or role that name a side part: parts of readers and links to other pages,
ASIDE_READERS = frozenset("comment comments disqus replies reply respond related".split())
#: parts that are no article text wherever they stand,
ASIDE_ALWAYS = frozenset("ad ads advert advertisement adverts consent cookie cookies modal paywall popup promoted sidebar sponsor sponsored".split())
#: and parts that a section of an article may be named like.
ASIDE_MAYBE = frozenset(
    """banner breadcrumb breadcrumbs complementary contentinfo footer masthead menu nav navbar navigation newsletter notice notices
    privacy promo search share sharing signup social subscribe toolbar widget""".split()
)
#: Words that turn a name into a setting of what it is given to: no-sidebar, has-ads, comments-open.
SETTINGS = frozenset("no not non without with has have hide show open closed enabled disabled status free".split())
#: What follows `related` where it means other pages.
RELATED = frozenset("related article articles block box container content entries items links list more news pages post posts products reading section stories topics videos widget wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
#: A part with fewer plain characters than this for each of its controls is a control itself.
CONTROL_CHARS = 100


class Node:
    __slots__ = ("tag", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "outside", "parent", "controls", "voids", "plain", "linked", "held")

    def __init__(self, tag: str, parent: Node | None, outside: int):
        self.tag, self.parent, self.outside = tag, parent, outside
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.controls = self.voids = 0  # inputs and all void elements right in this node
        self.plain = self.linked = self.held = 0  # characters out of and in links, and controls, of the subtree


#: How an element was told to be outside: by its tag for certain; the others until `judge` has
#: seen how much text it holds.
BY_TAG, BY_FORM, BY_NAME, BY_SURE_NAME, BY_READERS = 1, 2, 3, 4, 5
#: Links beside the text that `main_text` found to be less dense than its threshold.
BY_DENSITY = 6
SURE = (BY_TAG, BY_SURE_NAME, BY_READERS, BY_DENSITY)


def named_outside(tag: str, kind: str, value: str) -> int:
    """What a class, id or role says about a part."""
    found = 0
    for name in value.split():
        words = WORDS.findall(name)
        if not SETTINGS.isdisjoint(words):
            continue
        kinds = set(words)
        anchor = tag == "section" and kind == "id"  # an id that a table of contents points to
        if kinds & (ASIDE_READERS - {"related"}) or "related" in kinds and not anchor and kinds <= RELATED:
            return BY_READERS
        if kinds & ASIDE_ALWAYS and not anchor or kind == "role" and kinds & ASIDE_MAYBE:
            found = BY_SURE_NAME
        elif not found and kinds & (ASIDE_MAYBE | ASIDE_ALWAYS | ASIDE_READERS):
            found = BY_NAME
    return found


def marked_outside(tag: str, attributes: str) -> int:
    """Is this element a menu, header, footer, sidebar, notice, advert, form or comment part?"""
    if tag in OUTSIDE:
        return BY_TAG
    found = BY_FORM if tag in FORMS else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "".join(values).lower() == "true":
            return BY_TAG
        if name in ("class", "id", "role") and tag not in HEADINGS:
            names = "".join(values).lower()
            if tag == "article":  # a comment may be one; other names are of its subject
                names = " ".join(n for n in names.split() if not ASIDE_READERS.isdisjoint(WORDS.findall(n)[:1]) and named_outside(tag, name, n) == BY_READERS)
            found = max(found, named_outside(tag, name, names))
    return found


def parse(page: str) -> Node:
    """A tree of the page, forgiving about tags that are never closed or never opened."""
    root = node = Node("html", None, 0)
    at, inner = 0, None  # inner: the last svg, math or select element that is open
    while m := MARKUP.search(page, at):
        if m.start() > at:
            node.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW and (inner is None or inner.tag == "select"):
            at = RAW[tag].search(page, at).end()
            node.controls += tag == "textarea"
            continue
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
                inner = inner and inner_part(node)
            elif tag == "p":
                node.parts.append("\n")
            continue
        if inner and tag in BLOCKS and not (inner.tag == "select" and tag == "div"):
            up = node
            while up is not inner and up.tag not in HOLDERS:
                up = up.parent
            if up is inner:
                node = inner.parent
                inner = inner_part(node)
        if tag in ("html", "body"):
            while tag == "body" and node.tag == "head":
                node = node.parent
            if tag == "html":
                continue
        if tag in VOID:
            node.voids += tag != "wbr"
            node.controls += tag == "input"
            if tag in ("br", "hr"):
                node.parts.append("\n")
            continue
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            up = node
            while up is not root and up.tag not in closed and up.tag not in stop:
                up = up.parent
            if up.tag in closed:
                node = up.parent
        elif tag not in INLINE:
            up = node
            while up is not root and up.tag != "p" and up.tag not in SCOPE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        inner = inner and inner_part(node)
        child = Node(tag, node, marked_outside(tag, m[3]) or int(tag == "header" and not within_article(node)))
        node.parts.append(child)
        if not (m[3].endswith("/") and tag in INLINE - CLOSABLE or (tag in CLOSABLE or inner and inner.tag in FOREIGN) and CLOSED.search(m[3])):
            node = child
            inner = child if tag in INNER else inner
    if at < len(page):
        node.parts.append(html.unescape(page[at:]))
    return root


def inner_part(node: Node | None) -> Node | None:
    """The svg, math or select element that holds this node."""
    while node is not None and node.tag not in INNER:
        node = node.parent
    return node


def within_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def measure(root: Node, aside: tuple[int, ...]) -> list[Node]:
    """Plain and linked characters and controls of every subtree, without parts of these marks; parents before children."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(p for p in node.parts if not isinstance(p, str) and p.outside not in aside)
    for node in reversed(nodes):
        node.plain, node.linked, node.held = 0, 0, node.controls
        for p in node.parts:
            if isinstance(p, str):
                node.plain += len(p) - sum(map(p.count, " \t\n\r"))
            elif p.outside not in aside:
                node.plain, node.linked, node.held = node.plain + p.plain, node.linked + p.linked, node.held + p.held
            else:
                node.held += p.tag in ("button", "select")
        if node.tag == "a":
            node.plain, node.linked = 0, node.plain + node.linked
    return nodes


def links_or_control(node: Node) -> bool:
    """Is this mostly links, or a few words around controls?"""
    return node.plain <= node.linked or node.plain < CONTROL_CHARS * node.held


def judge(root: Node) -> None:
    """Clear the marks of parts that hold too much of the page's plain text to stand aside.

    A named part or a form stands aside while it holds the minor share, and where the only
    article stands beside it. What readers wrote may well be longer than the article, so
    such a part has to hold nine tenths, or the page's title, to be taken for a wrapper.
    Where names that a section may have mark most of the page, only parts of links and
    controls stand aside.
    """
    nodes = measure(root, (BY_TAG,))
    for node in nodes:
        if node.outside >= BY_SURE_NAME and wraps(node, root):
            node.outside = 0
    nodes = measure(root, SURE)
    for node in nodes:
        if node.outside and wraps(node, root):
            node.outside = 0
    left = [n for n in nodes if n.outside]
    tops, below = [], set()
    for node in nodes:  # parents come first
        if node.parent in below or node.outside:
            below.add(node)
            if node.parent not in below:
                tops.append(node)
    if 2 * sum(n.plain for n in tops) > root.plain:
        for node in left:
            if not links_or_control(node):
                node.outside = 0


def wraps(node: Node, root: Node) -> bool:
    """Does this marked part hold the article, rather than stand beside it?"""
    if 2 * node.plain <= root.plain:
        return False
    nearly_all = 10 * node.plain >= 9 * root.plain
    if nearly_all and node.outside < BY_SURE_NAME:
        return True
    if not holds(node, ("article", "main")) and holds(root, ("article", "main"), node):
        return False
    return nearly_all or node.outside != BY_READERS or holds(node, ("h1", "article", "main")) and not holds(root, ("h1", "article", "main"), node)


def holds(root: Node, tags: tuple[str, ...], but: Node | None = None) -> bool:
    """Is one of these elements below `root`, neither in `but` nor in a side part?"""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in tags and node is not root:
            return True
        stack.extend(p for p in node.parts if not isinstance(p, str) and p is not but and p.outside not in SURE)
    return False


def densest(root: Node) -> Node:
    """The node with the largest sum of densities, or the only article or main element that it holds.

    If the longest article or main element is in a marked part, it is tried without the
    marks around it; these go if it holds the densest text then. What readers wrote and
    links to related pages are no such articles.
    """
    def pick() -> Node:
        best = max(weigh(root), key=lambda n: n.total)
        if within_article(best):
            return best
        held = [n for n in inside(best) if n.tag in ("article", "main") and n.total and not within_article(n.parent)]
        return held[0] if len(held) == 1 else best

    found, marked, around = None, {}, []
    for node in measure(root, (BY_TAG, BY_READERS)):
        marked[node] = marked.get(node.parent, [])
        if node.outside:
            marked[node] = [*marked[node], node]
        if marked[node] and node.tag in ("article", "main") and (found is None or node.plain > found.plain):
            found, around = node, marked[node]
    if found is None:
        return pick()
    marks = [n.outside for n in around]
    for n in around:
        n.outside = 0
    best = up = pick()
    while up is not None and up is not found:
        up = up.parent
    if up is found:
        return best
    for n, mark in zip(around, marks):
        n.outside = mark
    return pick()


def only_links(node: Node, threshold: float) -> bool:
    """Is this a block of links below the threshold, and no title?"""
    sparse = node.density < threshold and node.link_tags > 1 and 2 * node.link_chars >= node.chars
    return sparse and node.tag not in HEADINGS and node.tag not in ("header", "hgroup") and not holds(node, ("h1",))


def readmit(node: Node) -> None:
    """Inside the article, a name or a form alone sets nothing aside: only links and controls stay out."""
    for part in measure(node, SURE):
        if part.outside and not links_or_control(part):
            part.outside = 0


def inside(root: Node) -> list[Node]:
    """Nodes that may hold article text, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in node.parts if not isinstance(p, str) and not p.outside)
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, adjusted by links: chars / tags times the logarithm of
    (chars / link_chars) * (tags / link_tags) to the base
    ln(chars / plain_chars * link_chars + body_ratio * chars + e).

    `body_ratio` is the share of link characters in the whole body. Counts of zero are taken
    as 1, for every node alike, so a single short link leaves a density nearly as it was. A
    node whose text lies in links as densely as its tags do has density 0.
    """
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    tags, link_chars, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / plain * link_chars + body_ratio * chars + math.e)
    return chars / tags * max(math.log(chars / link_chars * tags / link_tags), 0.0) / math.log(base)


def weigh(root: Node) -> list[Node]:
    """Composite density of every node, and the sum over its children; a block that holds no
    other block counts as one child."""
    nodes = inside(root)
    for node in nodes:
        node.chars = node.link_chars = node.link_tags = 0
        node.tags, node.total = node.voids, 0.0
    for node in reversed(nodes):
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(p) - sum(map(p.count, " \t\n\r"))
            elif not p.outside:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body_ratio = max(root.link_chars, 1) / max(root.chars, 1)
    for node in nodes:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, body_ratio)
    for node in nodes:
        children = [p for p in node.parts if not isinstance(p, str) and not p.outside]
        # Formatting inside a block is no part of its own: such a block counts as one.
        if all(p.tag in INLINE for p in children):
            node.total = 0.0 if node.tag in INLINE else node.density
        else:
            node.total = sum(p.density for p in children)
    return nodes


def blocks_of(node: Node) -> list[str]:
    """Blocks of a subtree in page order, white space in each as one space."""
    out, now, stack = [], [], [node]

    def close() -> None:
        words = "".join(now).split()
        if words:
            out.append(" ".join(words))
        now.clear()

    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            now.append(part)
        elif not part.outside:
            if part.tag in INLINE:
                stack.extend(reversed(part.parts))
            else:
                stack.append(None)
                stack.extend(reversed(part.parts))
                stack.append(None)
    close()
    return out


def main_text(page: str | None) -> str:
    """Text of the densest part of a page.

    Parts that their element or name marks as no article are set aside first, named ones and
    forms only while they hold the minor share of the plain text (`judge`) and, inside the
    article, only where they are links or controls or surely no text of it. Of the rest,
    the subtree whose children have the largest sum of densities is the article. The least
    density on its path up to the body is the threshold: a parent that is as dense as that,
    and whose other children all are, only wraps the article and takes its place. An article
    or main element around the text takes its place whatever its density; blocks of links
    below the threshold that it holds beside the text are left out.
    """
    if not page:
        return ""
    root = parse(page)
    judge(root)
    best = densest(root)
    if not best.total and root.chars > root.link_chars:
        best = root  # too short for any density
    elif not best.total:
        return ""
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    chosen = best
    for k, parent in enumerate(path[1:], 1):
        if parent.tag in ("html", "body") and chosen.tag in ("article", "main"):
            break
        others = [p for p in parent.parts if not isinstance(p, str) and not p.outside and p is not path[k - 1] and p.chars]
        loose = any(isinstance(p, str) and p.strip() for p in parent.parts)
        if parent.tag in ("article", "main") or chosen.tag not in ("article", "main") and (others or loose) and all(p.density >= threshold for p in others):
            for child, above in zip(path[path.index(chosen) : k], path[path.index(chosen) + 1 : k + 1]):
                for p in above.parts:
                    if not isinstance(p, str) and p is not child and not p.outside and only_links(p, threshold):
                        p.outside = BY_DENSITY
            chosen = parent
    readmit(best if chosen.tag in ("html", "body") else chosen)
    return " ".join(blocks_of(chosen))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text (empty if there is none), n_chars (its code points).

    Null and empty pages give an empty text. Every page is judged by itself, as a whole, so
    repeated rows get equal results; nothing is cut from long pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long")
