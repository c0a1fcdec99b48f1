"""JSON of any depth.

The standard decoder and encoder recurse, and give up on values nested some thousand levels deep.  ``parse`` and
``canonical_text`` fall back to loops with a stack of their own, so that depth never decides what a record means.
"""

from __future__ import annotations

import json
import re
from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, Context, Decimal, Inexact
from json.decoder import scanstring

_EXACT = Context(prec=MAX_PREC, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[Inexact])  # nothing is rounded
_DIGITS = 4_000  # numbers with more digits are kept as texts, as the interpreter limits integer texts
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.A)
_WORDS = {"null": None, "true": True, "false": False}


def _nested(text: str, number):
    """What ``json.loads`` gives, by a loop; ``number`` reads a number's text."""
    stack: list[tuple] = []  # (container, key that waits for its value)
    at, done, value = 0, False, None

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"no key at {i}")
        key, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return key, i + 1

    while True:
        at = skip(at)
        sign = text[at : at + 1]
        if not done:
            if sign in ("{", "["):
                inner, at = ({}, "}") if sign == "{" else ([], "]"), skip(at + 1)
                if text[at : at + 1] == inner[1]:
                    value, done, at = inner[0], True, at + 1
                elif sign == "{":
                    key, at = member(at)
                    stack.append((inner[0], key))
                else:
                    stack.append((inner[0], None))
            elif sign == '"':
                value, at = scanstring(text, at + 1, True)
                done = True
            elif match := _NUMBER.match(text, at):
                value, at, done = number(match[0]), match.end(), True
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError(f"no value at {at}")
                value, at, done = _WORDS[word], at + len(word), True
            continue
        if not stack:
            if at != len(text):
                raise ValueError(f"text behind the value at {at}")
            return value
        holder, key = stack.pop()
        if key is None:
            holder.append(value)
        else:
            holder[key] = value
        if sign == ",":
            key, at = (None, at + 1) if key is None else member(skip(at + 1))
            stack.append((holder, key))
            done = False
        elif sign == ("]" if key is None else "}"):
            value, at = holder, at + 1
        else:
            raise ValueError(f"no end of a container at {at}")


def _plain_number(text: str):
    match = _NUMBER.fullmatch(text)
    return float(text) if match[1] or match[2] else int(text)


def parse(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _nested(text, _plain_number)


class _Number(str):
    """The text of a number that is no whole one; it begins with a sign of its own."""


def _exact_number(text: str) -> int | _Number:
    """One object for each number."""
    value = Decimal(text)
    if not value.is_finite():
        raise ValueError(text)
    value = value.normalize(_EXACT)
    _, digits, exponent = value.as_tuple()
    if exponent >= 0 and len(digits) + exponent <= _DIGITS:
        return int(value)
    return _Number("\x00" + str(value))


def _no_constant(name: str):
    raise ValueError(name)


_READER = json.JSONDecoder(parse_int=_exact_number, parse_float=_exact_number, parse_constant=_no_constant)
_SHORT_READER = json.JSONDecoder(parse_float=_exact_number, parse_constant=_no_constant)  # whole numbers of at most _DIGITS digits need no call
_WRITER = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


def _written(value) -> str:
    """What ``_WRITER`` writes, by a loop; a string that begins like a number's text is told from it."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if type(x) is bytes:
            out.append(x.decode())
        elif isinstance(x, (dict, list)):
            sides = (b"{", b"}") if isinstance(x, dict) else (b"[", b"]")
            parts: list = [sides[0]]
            for n, item in enumerate(sorted(x)) if isinstance(x, dict) else enumerate(x):
                if n:
                    parts.append(b",")
                parts += [_WRITER.encode(item).encode() + b":", x[item]] if isinstance(x, dict) else [item]
            todo += reversed([*parts, sides[1]])
        elif type(x) is str and x.startswith("\x00"):
            out.append(_WRITER.encode("\x00\x00" + x))
        else:
            out.append(_WRITER.encode(x))
    return "".join(out)


def canonical_text(text: str) -> str:
    """One text for each JSON value: key order, white space, escapes and the spelling of numbers do not count.

    Of repeated keys the last counts.  ValueError if the text is no JSON.  Numbers are compared exactly.
    """
    if "\\u0000" not in text:
        try:
            return _WRITER.encode((_SHORT_READER if len(text) <= _DIGITS else _READER).decode(text))
        except RecursionError:
            pass
    return _written(_nested(text, _exact_number))


def text_of(value) -> str:
    """JSON of a value of any depth."""
    try:
        return json.dumps(value)
    except RecursionError:
        return _written(value)
