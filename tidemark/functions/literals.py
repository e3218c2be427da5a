"""Texts that hold a literal: JSON, or a Python dict or list as it was printed. Read character by character, never evaluated."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "\\": "\\", "'": "'", '"': '"', "/": "/", "\n": ""}
_HEX = {"x": 2, "u": 4, "U": 8}
_NAMES = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_CLOSING = {"[": "]", "(": ")", "{": "}"}
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def _quoted(text: str, i: int) -> tuple[str, int]:
    """The string whose quote is at i, and the place behind it."""
    quote, out, i = text[i], [], i + 1
    while i < len(text):
        c = text[i]
        if c == quote:
            joined = "".join(out)
            return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= x <= "\udfff" for x in joined) else joined, i + 1
        if c == "\n":
            break
        if c != "\\":
            out.append(c)
            i += 1
            continue
        c = text[i + 1 : i + 2]
        if c in _HEX:
            digits = text[i + 2 : i + 2 + _HEX[c]]
            if len(digits) < _HEX[c] or not all(d in "0123456789abcdefABCDEF" for d in digits) or int(digits, 16) > 0x10FFFF:
                break
            out.append(chr(int(digits, 16)))
            i += 2 + len(digits)
        elif c and c in "01234567":
            n = 1
            while n < 3 and text[i + 1 + n : i + 2 + n] in tuple("01234567"):
                n += 1
            out.append(chr(int(text[i + 1 : i + 1 + n], 8)))
            i += 1 + n
        elif c:
            out.append(_ESCAPES.get(c, "\\" + c))  # an unknown escape is text
            i += 2
        else:
            break
    raise ValueError("a string without an end")


def parse(text: str):
    """The value of a literal: strings, numbers, true, false and null in either spelling, lists, tuples and dicts, nested at will.

    Anything else raises ValueError.
    """
    stack: list[list] = []  # open containers: bracket, items or pairs, the key that waits for its value
    state, i, n, result = "value", 0, len(text), None

    while True:
        while i < n and text[i] in " \t\r\n":
            i += 1
        c = text[i] if i < n else ""
        if state == "done":
            if c:
                raise ValueError("text behind the literal")
            return result
        if state in ("comma", "colon"):
            if state == "colon":
                if c != ":":
                    raise ValueError("a key without a value")
                state, i = "value", i + 1
                continue
            if c == ",":
                stack[-1][3] = True
                state, i = "item", i + 1
                continue
            if c != _CLOSING[stack[-1][0]] or not c:
                raise ValueError("a container without an end")
        if state in ("item", "comma") and c and c == _CLOSING[stack[-1][0]]:
            bracket, items, key, comma = stack.pop()
            if key:
                raise ValueError("a key without a value")
            value = dict(items) if bracket == "{" else tuple(items) if bracket == "(" and (comma or not items) else items[0] if bracket == "(" else items
            i += 1
        elif c in ("[", "(", "{") and c:
            if stack and stack[-1][0] == "{" and not stack[-1][2]:
                raise ValueError("a key that is no plain value")
            stack.append([c, [], [], False])
            state, i = "item", i + 1
            continue
        elif c in ("'", '"') and c:
            value, i = _quoted(text, i)
            while True:  # strings side by side are one
                j = i
                while j < n and text[j] in " \t\r\n":
                    j += 1
                if j >= n or text[j] not in "'\"":
                    break
                more, i = _quoted(text, j)
                value += more
        elif number := _NUMBER.match(text, i):
            value = number.group()
            value = float(value) if any(x in value for x in ".eE") else int(value) if len(value) < 4000 else float(value)
            i = number.end()
        else:
            j = i
            while j < n and (text[j].isalnum() or text[j] == "_"):
                j += 1
            if text[i:j] not in _NAMES:
                raise ValueError("no literal")
            value, i = _NAMES[text[i:j]], j
        if not stack:
            result, state = value, "done"
        elif stack[-1][0] == "{" and not stack[-1][2]:
            if isinstance(value, (list, dict)):
                raise ValueError("a key that is no plain value")
            stack[-1][2].append(value)
            state = "colon"
        else:
            top = stack[-1]
            if top[0] == "{":
                top[1].append((top[2].pop(), value))
            else:
                top[1].append(value)
            state = "comma"


def name_in(text: str, broken: int) -> str:
    """The name that a dict holds, else the text's beginning; no name is empty text."""
    try:
        found = parse(text)
        if not isinstance(found, dict):
            return text[:broken]
        name = found.get("name", "")
        return "" if name is None else str(name)
    except ValueError:
        return text[:broken]


def joined(text: str, most: int) -> str:
    """The items of a list by spaces, else the text; cut to a length."""
    try:
        found = parse(text)
        return (" ".join(map(str, found)) if isinstance(found, (list, tuple)) else text)[:most]
    except ValueError:
        return text[:most]


def per_text(function, *parameters):
    """function(text, *parameters) as a function of a column; nulls stay null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t, *parameters))

    return run
