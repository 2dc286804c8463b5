"""Terminal display width, justification and wrapping as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour codes to strip, and the code point ranges two cells wide, in the
# order in which they apply (combining marks rank between the two groups).
ANSI_CODES = r"\x1b\[[0-9;]*m"
WIDE_FIRST = ((0x4E00, 0x9FFF), (0xAC00, 0xD7AF))
WIDE_LAST = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF01, 0xFF60), (0x3000, 0x303E))
NEGATIVE = (0x0008, 0x007F)
ZERO = (0x0000, 0x001F)

# Below U+0300 there are neither marks nor wide characters, only controls to leave out.
ONE_CELL = r"\x20-\x7e\x80-\x{2ff}"


@lru_cache(maxsize=1)
def _combining_class() -> str:
    """Regex ranges of all combining marks, from the Unicode tables of this interpreter."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(code)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return _ranges(ranges)


def _ranges(ranges) -> str:
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges)


def _count(col: Column, char_class: str) -> Column:
    return F.char_length(col) - F.char_length(F.regexp_replace(col, char_class, ""))


def line_width(col: Column) -> Column:
    """Cells one line takes: marks none, East Asian characters two, backspace minus one."""
    text = F.regexp_replace(col, ANSI_CODES, "")
    # Only these few characters are looked up in the long list of marks.
    special = F.regexp_replace(text, f"[{ONE_CELL}]+", "")
    marks = _combining_class()
    wide = f"[{_ranges(WIDE_FIRST)}[{_ranges(WIDE_LAST)}&&[^{marks}]]]"
    none = f"[{marks}{_ranges((c, c) for c in ZERO)}]"
    back = f"[{_ranges((c, c) for c in NEGATIVE)}]"
    general = (
        F.char_length(text) + _count(special, wide) - _count(special, none) - 2 * _count(special, back)
    )
    # Printable text in Latin letters, the common case, is done after one look.
    return F.when(col.rlike(f"^[{ONE_CELL}]*\\z"), F.char_length(col)).otherwise(general)


def display_width(col: Column) -> Column:
    """Width of the widest line of a text."""
    return F.when(~F.contains(col, F.lit("\n")), line_width(col)).otherwise(
        F.array_max(F.transform(F.split(col, "\n"), line_width))
    )


def justify(col: Column, width: Column, align: str) -> Column:
    """Pad a line to ``width`` cells: ``l`` left, ``r`` right, ``c`` centred.

    An odd number of spaces around a centred text puts the extra one to the right of a
    text of odd width and to the left of one of even width.
    """
    own = line_width(col)
    spare = F.greatest(width - own, F.lit(0))
    if align == "l":
        before = F.lit(0)
    elif align == "r":
        before = spare
    elif align == "c":
        before = F.floor((spare + F.when(own % 2 == 0, 1).otherwise(0)) / 2).cast("int")
    else:
        raise ValueError(f"alignment must be l, c or r, not {align!r}")
    return F.concat(F.repeat(F.lit(" "), before), col, F.repeat(F.lit(" "), spare - before))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def wrap(col: Column, width: Column) -> Column:
    """Greedy wrap of one line into an array of lines of at most ``width`` characters.

    White space inside a line stays, at the cut it goes.  A word longer than a line fills
    the rest of the current line (and leaves a full one as it is) and goes on in the next.
    One pattern match per line does it, so long texts take linear time.
    """
    w = F.greatest(width, F.lit(1)).cast("string")
    before = (F.greatest(width, F.lit(1)) - 1).cast("string")
    over = (F.greatest(width, F.lit(1)) + 1).cast("string")
    # At the start or at a word: a full line if a longer word begins in it, otherwise as
    # many whole words as fit.  Texts without longer words take the plain second form.
    at = F.lit(r"(?s)(?:^|(?=\S))")
    whole_words = F.concat(F.lit(".{1,"), w, F.lit(r"}(?<=\S)(?=\s|\z)"))
    long_word = F.concat(
        F.lit(r"(?=(?:.{0,"), before, F.lit(r"}\s)?\S{"), over, F.lit(r"}).{"), w, F.lit("}")
    )
    either = F.concat(at, F.lit("(?:"), long_word, F.lit("|"), whole_words, F.lit(")"))

    def cut(spaced: Column) -> Column:
        return F.when(
            F.regexp_like(spaced, F.concat(F.lit(r"(?<!\S)\S{"), over, F.lit("}"))),
            F.regexp_extract_all(spaced, either, F.lit(0)),
        ).otherwise(F.regexp_extract_all(spaced, F.concat(at, whole_words), F.lit(0)))

    def lines(line: Column) -> Column:
        spaced = F.regexp_replace(line, r"[\t\n\x0b\f\r]", " ")
        found = _bound(spaced, cut)
        some = _bound(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(f))
        return F.when(line_width(line) <= width, F.array(line)).otherwise(some)

    # Each value is computed once, however often a step names it.
    return _bound(col, lines)
