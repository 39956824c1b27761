"""HTML pages as trees of elements and texts, in flat lists with parents before children."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: A comment, a tag (closing mark, name, attributes), or a declaration. Quotes hold attribute values only after an equals sign.
MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)

#: Elements of HTML by what a parser does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
SILENT = RAW | frozenset("svg math select button datalist object audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul legend option".split()
)
#: Elements of a head; any other ends it.
HEAD = frozenset("head html base link meta noscript script style template title".split())
#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: A paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option"}
P_WITHIN = {"button", "object", "table", "td", "th", "caption", "li", "body"}

RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
TEXT = "#text"
#: Attributes that a tree keeps.
KEPT = ("class", "id", "role", "hidden", "style", "aria-hidden", "data-label")


@dataclass
class Tree:
    """Elements and texts of a page in page order; node 0 is the page itself.

    block: for a text, the number of its block, which the start and end of
    every block element raise.
    """

    names: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    texts: list[str] = field(default_factory=lambda: [""])
    blocks: list[int] = field(default_factory=lambda: [0])

    def add(self, name: str, parent: int, attributes: dict[str, str], text: str, block: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.attributes.append(attributes)
        self.texts.append(text)
        self.blocks.append(block)
        return len(self.names) - 1


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if "=" not in raw and "hidden" not in raw.lower():
        return out
    for name, *values in ATTRIBUTE.findall(raw):
        if (name := name.lower()) in KEPT and name not in out:
            out[name] = unescape(next((v for v in values if v), ""))
    return out


class _Open:
    """The elements that are open, outermost first."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = [(0, "#page")]
        self.count: Counter = Counter()
        self.silent = 0

    def push(self, node: int, name: str) -> None:
        self.stack.append((node, name))
        self.count[name] += 1
        self.silent += name in SILENT

    def cut(self, place: int) -> None:
        for _, name in self.stack[place:]:
            self.count[name] -= 1
            self.silent -= name in SILENT
        del self.stack[place:]

    def end(self, name: str) -> bool:
        """Closes the innermost element of this name; an inline one only inside its block."""
        if not self.count[name]:
            return False
        for place in range(len(self.stack) - 1, 0, -1):
            own = self.stack[place][1]
            if own == name:
                self.cut(place)
                return True
            if name not in BLOCKS and own in BLOCKS:
                return False
        return False

    def imply(self, closing: set[str], within: set[str]) -> bool:
        """Closes the outermost of these elements that is open below the nearest of ``within``."""
        if not any(self.count[name] for name in closing):
            return False
        cut = 0
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place][1] in closing:
                cut = place
            elif self.stack[place][1] in within:
                break
        if cut:
            self.cut(cut)
        return cut > 0


def parse(html: str | None) -> Tree:
    """The tree of a page.

    End tags that may be left out are supplied, those without a start tag are
    passed over; an end tag of an inline element does not close a block.
    Scripts, styles and other elements without text of the page stay as
    elements, their content is dropped, as are comments.
    """
    tree, open_ = Tree(), _Open()
    html = html or ""
    block = at = 0

    def text(piece: str) -> None:
        # a blank between inline texts parts their words
        if piece and not open_.silent:
            tree.add(TEXT, open_.stack[-1][0], {}, unescape(piece) if not piece.isspace() else " ", block)

    while at < len(html):
        found = MARKUP.search(html, at)
        if not found:
            break
        text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            block += open_.end(name) and name in BLOCKS
            continue
        if name == "br":
            text(" ")
            continue
        closed = open_.imply(*CLOSES[name]) if name in CLOSES else False
        if name in ENDS_P:
            closed |= open_.imply({"p"}, P_WITHIN)
        if name not in HEAD:
            closed |= open_.imply({"head"}, set())
        block += closed or name in BLOCKS
        node = tree.add(name, open_.stack[-1][0], _attributes(found[3]), "", block)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = end.start() if end else len(html)
        if name not in VOID and not (found[3].endswith("/") and name in SILENT - RAW):
            open_.push(node, name)
    text(html[at:])
    return tree
