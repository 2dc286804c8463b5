"""A forgiving reader of HTML: elements, their text and the breaks between blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Elements whose content is no markup, void elements, and blocks.
_RAW = frozenset("script style template svg iframe noscript textarea select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul br".split()
)
_STOP = re.compile("""[>"']""")
_NAME_END = re.compile(r"[\s/>]|\Z")
_LETTER = re.compile("[a-zA-Z]")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ENDS_P = BLOCKS - {"br", "body", "html", "head"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table div section article main body html nav aside footer header form".split())


@dataclass
class Page:
    """Elements in page order; ``pieces`` holds ``(element, text)`` and ``None`` for a break."""

    tags: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str] | None] = field(default_factory=list)


def tokens(source: str) -> Iterator[tuple[str | None, bool, str]]:
    """``(tag, closes, attributes)`` of each tag, ``(None, False, text)`` of what stands between.

    One scan forward: nothing is looked at again and again, however broken the markup is.  A tag that
    never ends is text; comments and raw elements that never end take the rest; their content is one space.
    """
    last, pos, name_end = source.rfind(">"), 0, 0
    dead: set[int] = set()  # places of > and quotes from which no tag ends
    while pos < len(source):
        start = source.find("<", pos)
        if start < 0:
            yield None, False, source[pos:]
            return
        if start > last:  # no tag ends any more, only a comment or a declaration can begin
            rest = min((i for i in (source.find("<!", start), source.find("<?", start)) if i >= 0), default=len(source))
            yield None, False, source[pos:rest]
            return
        if start > pos:
            yield None, False, source[pos:start]
        if source[start + 1 : start + 2] in ("!", "?"):
            mark, skip = ("-->", 4) if source.startswith("<!--", start) else (">", 2)
            end = source.find(mark, start + skip)
            pos = end + len(mark) if end >= 0 else len(source)
            continue
        closes = source.startswith("/", start + 1)
        begin = start + 1 + closes
        end = -1
        if _LETTER.match(source, begin):
            if name_end < begin:
                name_end = _NAME_END.search(source, begin).start()
            name = source[begin:name_end] if name_end - begin < 32 else ""
            raw = name.lower() if not closes and name.lower() in _RAW else None
            end = source.find(">", name_end) if raw else _tag_end(source, name_end, dead)
        if end < 0:
            yield None, False, "<"
            pos = start + 1
        elif raw:
            close = _RAW_ENDS[raw].search(source, end + 1)
            pos = close.end() if close else len(source)
            yield None, False, " "
        else:
            yield source[begin:name_end].lower(), closes, source[name_end:end]
            pos = end + 1


def _tag_end(source: str, pos: int, dead: set[int]) -> int:
    """The first ``>`` outside of quotes, or -1; ``dead`` remembers places that lead to none."""
    passed = []
    while (stop := _STOP.search(source, pos)) and stop.start() not in dead:
        at = stop.start()
        if source[at] == ">":
            return at
        passed.append(at)
        pos = source.find(source[at], at + 1) + 1
        if not pos:
            break
    dead.update(passed)
    return -1


class _Open:
    """The open elements; finding the innermost of a name takes no walk through the others."""

    def __init__(self) -> None:
        self.stack = [0]
        self._names: list[str] = ["#page"]
        self._depths: dict[str, list[int]] = {}
        self._walls: list[int] = [0]

    def push(self, element: int, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append(element)
        self._names.append(tag)
        self._depths.setdefault(tag, []).append(depth)
        if tag in _WALLS:
            self._walls.append(depth)

    def close(self, tags: tuple[str, ...], walled: bool) -> None:
        """Close the innermost of ``tags`` with all in it, unless it lies beyond a wall."""
        depth = max((d[-1] for t in tags if (d := self._depths.get(t))), default=0)
        if not depth or (walled and self._walls[-1] > depth):
            return
        while len(self.stack) > depth:
            self.stack.pop()
            tag = self._names.pop()
            self._depths[tag].pop()
            if tag in _WALLS:
                self._walls.pop()


def read(source: str | None) -> Page:
    page = Page(["#page"], [""], [-1])
    opened = _Open()
    for tag, closes, text in tokens(source or ""):
        if tag is None:
            page.pieces.append((opened.stack[-1], html.unescape(text)))
            continue
        if tag in BLOCKS:
            page.pieces.append(None)
        if closes:
            opened.close((tag,), False)
            continue
        if tag in _ENDS_P:
            opened.close(("p",), True)
        if tag in _SAME:
            opened.close(_SAME[tag], True)
        page.tags.append(tag)
        page.attrs.append(text)
        page.parents.append(opened.stack[-1])
        if tag not in _VOID and not text.rstrip().endswith("/"):
            opened.push(len(page.tags) - 1, tag)
    return page


def text_of(page: Page, kept: list[bool]) -> str:
    """The text of kept elements: one line per block, white space inside a block as one space."""
    blocks: list[str] = []
    block: list[str] = []
    for piece in [*page.pieces, None]:
        if piece is None:
            if line := " ".join("".join(block).split()):
                blocks.append(line)
            block = []
        elif kept[piece[0]]:
            block.append(piece[1])
    return "\n".join(blocks)
