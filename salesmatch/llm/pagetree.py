"""A light tree of a web page: which text stands in which container."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Possessive: a tag whose quotes do not close is given up at once and ends at its first ">".
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select head".split())
#: Of these, the ones whose content runs to the page's end if no end tag follows; the others then end at once.
_TO_THE_END = frozenset("script style textarea title".split())
#: Elements that are never part of the article.
AWAY = frozenset("nav header footer aside form menu button dialog fieldset label legend".split())
#: Elements that hold other blocks, and those that end where a block begins.
HOLD = frozenset("html body main article section div table tbody thead tfoot tr td th ul ol dl blockquote center "
                 "details figure".split()) | AWAY
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address summary figcaption caption hr br option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words of class, id or role names that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations comment comments "
    "commentlist disqus reply replies respond pagination pager form contentinfo complementary".split())
_NOT = frozenset("has with no without".split())
#: Words that may stand beside a mark in a name ("ad-box", "post-comments"). Any other word ("social-history") makes
#: the name one of the page's subject, which is no mark.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons center col column container content entry first group head heading icon icons id "
    "inner inline item items js l last layout left link links list main mobile module outer page pane panel part post posts r region "
    "right row section site slot small stories story tag text thread title tools top unit user view wrap wrapper articles article".split())


class Node:
    __slots__ = ("parent", "tag", "label", "away", "size", "kids", "place")

    def __init__(self, parent, tag, label, away):
        self.parent, self.tag, self.label, self.away, self.size, self.kids = parent, tag, label, away, 0, []
        #: Hash of the path from the body, grown from the parent's.
        self.place = 0
        if parent is not None:
            parent.kids.append(self)
            self.place = parent.place if tag in ("html", "body") else hash((parent.place, label))


def _describe(tag: str, attrs: str) -> tuple[str, bool]:
    """Generalised label (tag and class names, digits as #) and whether the element is marked as no article."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, False
    label, away = tag, False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _WORD.findall(token)]
                if any(p in MARKS for p in parts) and parts[0] not in _NOT and all(
                        p in MARKS or p in _PLAIN or p.isdigit() for p in parts):
                    away = True
            if name == "class":
                names = sorted({re.sub(r"\d+", "#", t.lower()).replace(">", "") for t in value.split()})
                label = ".".join([tag, *names])
        elif name == "style":
            away |= "display:none" in value.replace(" ", "").lower()
        else:
            away |= value.lower() in ("true", "") if name == "aria-hidden" else True
    return label, away and tag not in ("html", "body", "main", "article")


_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(r"</head\s*+>|<body[\s>]" if tag == "head" else f"</{re.escape(tag)}\\s*+>", re.I)


def parse(html: str) -> tuple[Node, list]:
    """The root and, in page order, (node, text, in a link) of each text, with None between blocks."""
    root = Node(None, "root", "root", False)
    stack, items, at, link = [root], [], 0, False
    n, last = len(html), html.rfind(">")  # nothing is a tag after the last ">", but an open comment
    opened: dict[str, int] = {}  # how many elements of a tag are open
    unclosed: set[str] = set()  # tags whose end tag does not follow any more

    def pop(to: int) -> None:
        for node in stack[to:]:
            opened[node.tag] -= 1
        del stack[to:]

    while at < n:
        m = _TAG.search(html, at) if at <= last else _OPEN_COMMENT.search(html, at)
        end = m.start() if m else n
        if end > at:
            items.append((stack[-1], html[at:end], link))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is _TAG else ""
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes its element, if it is open
            if tag == "a":
                link = False
            if tag in HOLD or tag in LEAF:
                items.append(None)
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop(i)
                        break
                    if stack[i].tag in HOLD and tag not in HOLD:
                        break
            continue
        if tag in RAW:
            if (m[3] if m[2] else m[6]).rstrip().endswith("/") and tag not in _TO_THE_END:
                continue
            # The head is not raw: it ends at its end tag or where the body begins.
            close = None if tag in unclosed else _end_of(tag).search(html, at)
            if close is None:
                unclosed.add(tag)
                at = n if tag in _TO_THE_END else at
            else:
                at = close.start() if close[0][:2] != "</" else close.end()
            continue
        attrs = m[3] if m[2] else m[6]
        label, away = _describe(tag, attrs)
        if tag == "a":
            link = True
        block = tag in HOLD or tag in LEAF
        if block:
            items.append(None)
            while stack[-1].tag in LEAF:
                pop(len(stack) - 1)
            if tag in HOLD:
                link = False
        away |= tag in AWAY
        if tag not in _VOID and not attrs.endswith("/") and (block or away):
            stack.append(Node(stack[-1], tag, label, away or stack[-1].away))
            opened[tag] = opened.get(tag, 0) + 1
    return root, items


def unmarked(items: list) -> list[tuple[Node, str, bool]]:
    """Node and text of every block outside marked elements, and whether most of the text is links."""
    out, part = [], []
    for item in [*items, None]:
        if item is None:
            if part:
                text = " ".join(unescape("".join(t for _, t, _ in part)).split())
                if text:
                    size = [(len(t.strip()), link) for _, t, link in part]
                    out.append((part[0][0], text, 2 * sum(n for n, link in size if link) > sum(n for n, _ in size)))
                part = []
        elif not item[0].away:
            part.append(item)
    return out


def around(root: Node, core: set, found: list, repeated) -> list[str]:
    """Texts of ``core`` and of the blocks around it that are not page furniture, in page order.

    A container beside the core goes if more than half of its text is links or
    ``repeated`` blocks; of the others, and of single blocks, only what is repeated
    goes, and single blocks of links that are no headings.
    """
    spine = set()
    for node in core:
        while node is not None and node not in spine:
            spine.add(node)
            node = node.parent
    inside = under(root, core)
    top: dict[Node, Node] = {}  # of a node off the spine, its highest ancestor off the spine
    for node in all_nodes(root):
        if node not in spine:
            top[node] = top.get(node.parent, node)
    judged, weight = [], {}
    for node, text, link in found:
        if node in inside:
            judged.append((text, True, None))
            continue
        beside = top.get(node)
        again = repeated(text)
        if beside is not None and beside.tag in HOLD:
            sums = weight.setdefault(beside, [0, 0])
            sums[again or link] += len(text)
            judged.append((text, not again, sums))
        else:
            judged.append((text, not again and not (link and node.tag not in HEADINGS), None))
    return [text for text, kept, sums in judged if kept and (sums is None or sums[1] <= sums[0])]


def path(node: Node) -> str:
    """Generalised path of labels from the body down."""
    labels = []
    while node.parent is not None:
        if node.tag not in ("html", "body"):
            labels.append(node.label)
        node = node.parent
    return ">".join(reversed(labels))


def place_of(name: str) -> int:
    """``Node.place`` of nodes whose ``path`` is ``name``; hashes hold within one process."""
    place = 0
    for label in name.split(">") if name else ():
        place = hash((place, label))
    return place


def under(root: Node, nodes: set) -> set:
    """All nodes that are or lie in one of ``nodes``."""
    out = set()
    for node in all_nodes(root):
        if node in nodes or node.parent in out:
            out.add(node)
    return out


def measure(root: Node, items: list) -> None:
    """Text outside links and marked elements, counted for every node with its descendants."""
    for item in items:
        if item is not None and not item[2] and not item[0].away:
            item[0].size += len(item[1].strip())
    for node in reversed(list(all_nodes(root))):
        if node.parent is not None:
            node.parent.size += node.size


def main_container(root: Node, share: float) -> Node:
    """The deepest container that still holds ``share`` of the page's own text."""
    node = root
    while True:
        best = max((k for k in node.kids if k.tag in HOLD and not k.away), key=lambda k: k.size, default=None)
        if best is None or best.size < share * max(1, root.size):
            return node
        node = best


def all_nodes(root: Node):
    """Every node after its parent."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(node.kids)
