"""Main text of web pages by tree scoring.

A page is read into a tree. Parts that are never article text go first. Each paragraph then gives
points for its length and its commas to the elements around it, in full to its parent, by half to the
next and by less further up; an element keeps them in the measure that its text is not links. The best
container is taken together with those of its siblings that read like part of the same article.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from wattloom.llm.common import per_batch

#: HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot dd dt li html body summary figcaption".split())
#: An opening tag ends open elements of these names, up to one of the named bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that hold no article text.
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video form button input select textarea label fieldset "
    "nav header footer aside menu dialog noframes noembed title xmp".split()
)
#: Words of a class, id or role that mark furniture, and those that mark an article whatever else is said.
UNLIKELY = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup "
    "modal overlay newsletter subscribe subscription signup sidebar sidebars rail widget widgets comment comments respond disqus discussion replies menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations footer header masthead "
    "search login toolbar complementary contentinfo skip hidden".split()
)
LIKELY = frozenset("article content main post entry story body text".split())
#: Words that make a class tell of a state, as in `has-sidebar` or `comments-open`, not of what the element is.
STATES = frozenset("has with no without is open opened closed enabled disabled on off allowed supports".split())
#: Elements that an opening tag looks for among the open ones, see ``IMPLIED``.
MARKS = frozenset(n for ends, bounds in IMPLIED.values() for n in (*ends, *bounds))
#: Elements that bound the search for an open paragraph, the paragraph included.
P_BOUNDS = frozenset("p td th div article section table li body".split())
PARAGRAPHS = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption".split())
CONTAINERS = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[a-zA-Z]+")


class Node:
    """An element: its children are elements and raw strings, in order."""

    __slots__ = ("name", "children", "parent", "furniture", "doubtful", "holds", "likely", "chars", "commas", "linked", "points", "bound", "mark", "block")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.children = name, parent, []
        self.furniture, self.doubtful, self.holds, self.likely = name in DROPPED, False, False, False
        self.chars = self.commas = self.linked = 0
        self.points = 0.0
        #: This element or the nearest around it that is of ``P_BOUNDS`` or of ``MARKS``.
        self.bound = self if parent is None or name in P_BOUNDS else parent.bound
        self.mark = self if parent is None or name in MARKS else parent.mark
        #: The nearest block around it.
        self.block = parent if parent is None or parent.name in BLOCKS else parent.block
        if attributes and not attributes.isspace():
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id", "role"):
                    tokens = [WORD.findall(t) for t in value.split()]
                    self.likely |= any(len(t) == 1 and t[0] in LIKELY for t in tokens)
                    self.doubtful |= any(STATES.isdisjoint(t) and not UNLIKELY.isdisjoint(t) for t in tokens)
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.furniture = True
            self.doubtful &= not self.likely and name not in ("article", "main", "body", "html")


def parse(html: str) -> Node:
    """The page's tree; unclosed and crossed tags are mended as browsers do in the common cases."""
    root = at = Node("#root", None)
    place, size = 0, len(html)
    open_names: dict[str, int] = {}

    def leave(node: Node) -> Node:
        """Closes what is open within ``node``, and ``node``; gives its parent."""
        here, parent = at, node.parent
        while here is not parent:
            open_names[here.name] -= 1
            here = here.parent
        return parent

    while place < size:
        m = TAG.search(html, place)
        if m is None:
            at.children.append(html[place:])
            break
        if m.start() > place:
            at.children.append(html[place : m.start()])
        place = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if open_names.get(name):
                open_ = at
                while open_.name != name:
                    open_ = open_.parent
                at = leave(open_)
            continue
        if name in CLOSES_P and at.bound.name == "p":
            at = leave(at.bound)
        if name in IMPLIED:
            ends, bounds = IMPLIED[name]
            if any(open_names.get(e) for e in ends):
                p, last = at.mark, None
                while p is not root and p.name not in bounds:
                    if p.name in ends:
                        last = p
                    p = p.parent.mark
                if last is not None:
                    at = leave(last)
        node = Node(name, at, m[3] or m[6] or "")
        at.children.append(node)
        if name in ("article", "main"):
            # what holds the article is no furniture, whatever its class says
            up = at
            while not up.holds:
                up.holds, up = True, up.parent or up
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(html, place)
            place = end.end() if end else size
        elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            at = node
            open_names[name] = open_names.get(name, 0) + 1
    stack = [root]
    while stack:
        node = stack.pop()
        node.furniture |= node.doubtful and not node.holds
        stack.extend(c for c in node.children if isinstance(c, Node))
    return root


def _walk(root: Node):
    """Elements in page order, furniture left out with all it holds."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _measure(nodes: list[Node]) -> None:
    """Characters, commas and linked characters of each element, its kept descendants included."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                node.chars += len(text)
                node.commas += text.count(",") + text.count("、") + text.count("，")
            elif not c.furniture:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.linked
        if node.name == "a":
            node.linked = node.chars


def link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _is_paragraph(node: Node) -> bool:
    """A paragraph element, or a block that holds text of its own."""
    if node.name in PARAGRAPHS:
        return not any(isinstance(c, Node) and c.name in BLOCKS and c.name != "p" and not c.furniture and c.chars for c in node.children)
    return node.name in BLOCKS and any(isinstance(c, str) and not c.isspace() for c in node.children)


def best_container(nodes: list[Node]) -> Node | None:
    """The element whose paragraphs earned most after the discount for links; the outermost of equals is not preferred."""
    scored: dict[int, Node] = {}
    for node in nodes:
        if not node.chars or not _is_paragraph(node):
            continue
        points = min(1.0, node.chars / 25) + node.commas + min(node.chars / 100, 3.0)
        # a block with text of its own is a container as well as a paragraph
        up = node if node.name not in PARAGRAPHS else node.block
        level = 0
        while up is not None and up.name != "html" and level < 5:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points = CONTAINERS.get(up.name, 0.0) + 25.0 * up.likely
            up.points += points / (1, 2, 6, 9, 12)[level]
            level += 1
            up = up.block
    best = None
    for node in scored.values():
        node.points *= 1 - link_density(node)
        if best is None or node.points > best.points:
            best = node
    return best


def blocks_of(node: Node, out: list[str]) -> None:
    """Texts of the blocks below ``node`` in page order, white space folded."""
    parts: list[str] = []

    def close():
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    stack: list = [node]
    while stack:
        at = stack.pop()
        if at is None:
            close()
        elif isinstance(at, str):
            parts.append(at)
        elif not at.furniture:
            if at.name == "br":
                parts.append(" ")
            if at.name in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(at.children))
    close()


def main_text(html: str | None) -> str:
    """The article's blocks joined by an empty line; an empty text where a page has none."""
    if not html:
        return ""
    root = parse(html)
    nodes = list(_walk(root))
    _measure(nodes)
    best = best_container(nodes)
    out: list[str] = []
    if best is None:
        blocks_of(root, out)
        return "\n\n".join(out)
    for sibling in best.parent.children if best.parent is not None else [best]:
        if isinstance(sibling, str):
            if best.name not in ("article", "main", "body") and not sibling.isspace():
                blocks = Node("p", None)
                blocks.children.append(sibling)
                blocks_of(blocks, out)
        elif sibling is best or not sibling.furniture and sibling.chars and (sibling.points >= max(10.0, 0.2 * best.points) or sibling.name in PARAGRAPHS and link_density(sibling) < 0.25 and best.name not in ("article", "main")):
            blocks_of(sibling, out)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row; null html gives an empty text."""
    return per_batch(
        pages.select("page_id", "url", "html"),
        "page_id long, url string, text string",
        lambda b: {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())},
    )
