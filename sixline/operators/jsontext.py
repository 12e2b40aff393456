"""JSON texts of any depth.

The standard decoder is fast but recursive: texts nested deeper than its stack are read by a loop
with a stack of its own instead, to the same result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def refuse(word: str):
    """NaN and Infinity are no JSON."""
    raise ValueError(word)


class Reader:
    """Decodes with given functions for whole and other numbers; ``read`` gives (parsed, value)."""

    def __init__(self, whole: Callable[[str], object] = int, other: Callable[[str], object] = float) -> None:
        self.whole, self.other = whole, other
        self.decoder = json.JSONDecoder(parse_int=whole, parse_float=other, parse_constant=refuse)

    def read(self, text: str | None) -> tuple[bool, object]:
        """Whether a text is one JSON value from end to end, and that value."""
        if text is None:
            return False, None
        try:
            return True, self.decoder.decode(text)
        except RecursionError:
            pass
        except ValueError:
            return False, None
        try:
            return True, self._looped(text)
        except (ValueError, IndexError):
            return False, None

    def _scalar(self, s: str, i: int):
        c = s[i]
        if c == '"':
            return scanstring(s, i + 1, True)
        if c in _WORDS:
            word, value = _WORDS[c]
            if not s.startswith(word, i):
                raise ValueError(i)
            return value, i + len(word)
        m = _NUMBER.match(s, i)
        if not m:
            raise ValueError(i)
        return (self.other if m[1] or m[2] else self.whole)(m[0]), m.end()

    def _looped(self, s: str):
        skip = lambda i: _SPACE.match(s, i).end()
        stack: list[tuple[object, str | None]] = []  # a container, and the name under which its value is to come
        i, value = skip(0), None
        while True:
            # A value begins at i.
            if s[i] in "{[":
                made, close = ({}, "}") if s[i] == "{" else ([], "]")
                i = skip(i + 1)
                if s[i] == close:
                    value, i = made, i + 1
                else:
                    name = None
                    if close == "}":
                        name, i = self._name(s, i, skip)
                    stack.append((made, name))
                    continue
            else:
                value, i = self._scalar(s, i)
            # It ends; so may what holds it.
            while True:
                i = skip(i)
                if not stack:
                    if i != len(s):
                        raise ValueError(i)
                    return value
                holder, name = stack[-1]
                if name is None:
                    holder.append(value)
                else:
                    holder[name] = value
                if s[i] == ",":
                    i = skip(i + 1)
                    if name is not None:
                        name, i = self._name(s, i, skip)
                        stack[-1] = (holder, name)
                    break
                if s[i] != ("]" if name is None else "}"):
                    raise ValueError(i)
                i += 1
                value = stack.pop()[0]

    def _name(self, s: str, i: int, skip) -> tuple[str, int]:
        if s[i] != '"':
            raise ValueError(i)
        name, i = scanstring(s, i + 1, True)
        i = skip(i)
        if s[i] != ":":
            raise ValueError(i)
        return name, skip(i + 1)


def plain(text: str) -> str:
    """A text without halves of surrogate pairs, which JSON can write but UTF-8 can't."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
