"""The leaf blocks of an HTML page: runs of text between block boundaries, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

#: Fixed values of HTML: elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
HIDDEN = frozenset("head noscript template iframe svg math select datalist button object canvas audio video map".split())
#: An opening tag closes these open elements first, up to the nearest of the containers named.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_P = BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}

INLINE = frozenset("a b i em strong span".split())

TOKEN = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++)|(<)"""
)
NAMED = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Element:
    """An open element: its tag, its class, id and role as one string, the element around it, and its nearest tag that is not inline."""

    __slots__ = ("tag", "names", "parent", "depth", "block")

    def __init__(self, tag: str, names: str, parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = tag if tag not in INLINE else parent.block if parent else ""

    def path(self) -> list[Element]:
        """From the outermost element to this one."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out[::-1]


class Leaf(NamedTuple):
    inside: Element | None
    text: str
    linked: int  # code points inside links


class _Stack:
    """The open elements, and where the open elements of each tag stand, so that no end tag has to look through them all."""

    def __init__(self):
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.hidden = self.links = 0

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at[tag] else -1

    def push(self, tag: str, names: str) -> None:
        self.at[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"
        self.open.append(Element(tag, names, self.open[-1] if self.open else None))

    def pop(self, to: int) -> None:
        while len(self.open) > to:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def leaves(page: str) -> list[Leaf]:
    """The page's blocks of visible text in order: character references decoded, white space turned into one space. Time is
    linear in the page, however deep its elements are."""
    found: list[Leaf] = []
    stack, parts = _Stack(), []
    linked, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Leaf(stack.open[-1] if stack.open else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if m.lastindex in (7, 8):
            if not stack.hidden:
                text = html.unescape(m.group())
                parts.append(text)
                linked += len(text) if stack.links else 0
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            where = stack.last(tag)
            if tag in BLOCKS:
                flush()
            if where >= 0 and (tag in BLOCKS or stack.last_block() <= where):
                stack.pop(where)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if tag in BLOCKS:
            flush()
        if tag in CLOSES:
            shut, within = (max(map(stack.last, tags)) for tags in CLOSES[tag])
            if shut > within:
                stack.pop(shut)
        elif tag in IN_P and stack.last("p") >= 0 and stack.last("p") == stack.last_block():
            stack.pop(stack.last("p"))
        if tag == "br":
            parts.append(" ")
        if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag not in BLOCKS:
            continue
        if tag in HIDDEN and tag != "head" and not stack.hidden:
            parts.append(" ")
        if tag == "body" and stack.at["head"]:
            stack.pop(stack.at["head"][0])
        stack.push(tag, " ".join(x for n in NAMED.findall(m[3] or m[6] or "") for x in n if x).lower())
    flush()
    return found
