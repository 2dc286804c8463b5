"""Leaves of JSON texts in one pass over their tokens, with a stack instead of recursion.

The pass costs what the text is long, however deep it nests, and keeps each leaf's text as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+")|([{}\[\],:])'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]+)?+(?:[eE][+-]?[0-9]+)?+|true|false|null))"
)
_REST = re.compile(r"[ \t\r\n]*\Z")

# What may come next.
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _COMMA_OR_END, _DONE = range(7)
_CLOSES = {"}": "{", "]": "["}


class Leaf(NamedTuple):
    item: tuple[int, ...]
    """Positions in the lists that no object surrounds, if these are opened."""
    path: tuple[str, ...]
    text: str
    """The JSON text of the value."""


def string_value(text: str) -> str:
    return text[1:-1] if "\\" not in text else json.loads(text)


def leaves(text: str, into_lists: bool = False, top_lists: bool = False) -> Iterator[Leaf]:
    """Values that are not opened: plain ones, empty containers, and lists unless asked otherwise.

    ``into_lists`` opens all lists and puts positions into the path; ``top_lists`` opens those that no
    object surrounds and puts positions into ``item``.  Raises ``ValueError`` where the text is no JSON.
    """
    path: list[str] = []
    item: list[int] = []
    stack: list[tuple[str, list | None, int]] = []  # bracket, where its steps go (None: not opened), its place
    closed = 0  # brackets on the stack that are not opened
    want, pos, empty = _VALUE, 0, False

    def leaf(start: int, end: int) -> Leaf:
        return Leaf(tuple(item), tuple(path), text[start:end])

    while want != _DONE:
        token = _TOKEN.match(text, pos)
        if not token:
            raise ValueError(f"no JSON at character {pos}")
        string, mark, scalar = token.groups()
        start, pos = token.start(token.lastindex), token.end()
        if want in (_VALUE, _VALUE_OR_END) and not (mark and mark not in "{["):
            if mark:
                opened = not closed and (mark == "{" or into_lists or (top_lists and not path))
                steps = None
                if opened:
                    steps = item if mark == "[" and top_lists and not path and not into_lists else path
                    steps.append("" if steps is path else 0)
                    if mark == "[" and steps is path:
                        path[-1] = "0"
                else:
                    closed += 1
                stack.append((mark, steps, start))
                want, empty = (_KEY_OR_END if mark == "{" else _VALUE_OR_END), True
                continue
            if not closed:
                yield leaf(start, pos)
        elif want in (_KEY, _KEY_OR_END) and string:
            if not closed:
                path[-1] = string_value(string)
            want, empty = _COLON, False
            continue
        elif want == _COLON and mark == ":":
            want = _VALUE
            continue
        elif want == _COMMA_OR_END and mark == ",":
            bracket, steps, _ = stack[-1]
            if bracket == "[" and steps is not None:
                steps[-1] = str(int(steps[-1]) + 1) if steps is path else steps[-1] + 1
            want = _KEY if bracket == "{" else _VALUE
            continue
        elif want in (_COMMA_OR_END, _VALUE_OR_END, _KEY_OR_END) and stack and _CLOSES.get(mark) == stack[-1][0]:
            _, steps, begin = stack.pop()
            if steps is None:
                closed -= 1
                if not closed:
                    yield leaf(begin, pos)
            else:
                steps.pop()
                if empty and want != _COMMA_OR_END:
                    yield leaf(begin, pos)
        else:
            raise ValueError(f"no JSON at character {start}")
        want, empty = (_COMMA_OR_END if stack else _DONE), False
    if not _REST.match(text, pos):
        raise ValueError(f"no JSON at character {pos}")



def indented(text: str, indent: int = 2, sort_keys: bool = True) -> str:
    """The JSON text with a line for each member, by default in order of the keys' code points.

    A first pass finds the members of all containers, a second one writes them in order from a stack,
    so documents may nest to any depth.  Strings and numbers stay as they are written; of equal keys the last counts.
    """
    list(leaves(text))  # is it JSON?
    tree: list = []  # containers: [bracket, members]; a member is (key, plain text or number of a container)
    open_: list[int] = []
    key, pos, root = None, 0, None
    while token := _TOKEN.match(text, pos):
        string, mark, scalar = token.groups()
        pos = token.end()
        if mark in ("}", "]"):
            open_.pop()
            continue
        if mark in (",", ":"):
            continue
        if string and open_ and tree[open_[-1]][0] == "{" and key is None:
            key = string
            continue
        member = string or scalar or len(tree)
        if mark:
            tree.append([mark, []])
        if open_:
            tree[open_[-1]][1].append((key, member))
        else:
            root = member
        key = None
        if mark:
            open_.append(member)
    out: list[str] = []
    todo: list = [("", root, "", 0)]  # what stands before a value, the value, what follows it, its depth
    while todo:
        before, value, after, depth = todo.pop()
        line = " " * (indent * depth) + before
        if isinstance(value, str):
            out.append(line + value + after)
            continue
        bracket, members = tree[value]
        end = {"{": "}", "[": "]"}[bracket]
        if bracket == "{":
            members = list({string_value(k): (k, v) for k, v in members}.items())
            members = [m for _, m in (sorted(members, key=lambda m: m[0]) if sort_keys else members)]
        if not members:
            out.append(line + bracket + end + after)
            continue
        out.append(line + bracket)
        todo.append(("", end, after, depth))
        for n in range(len(members) - 1, -1, -1):
            k, v = members[n]
            todo.append((f"{k}:" if k is not None else "", v, "," if n < len(members) - 1 else "", depth + 1))
    return "\n".join(out)
