"""Channel patterns: '*', '?', '[abc]', '[a-z]' in either order, '[^x]' or '[!x]', and '\\' as escape."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, for Java and Python, that matches what the pattern matches."""
    out, at, n = [], 0, len(pattern)
    while at < n:
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and at < n:
            out.append(re.escape(pattern[at]))
            at += 1
        elif c == "[":
            group, end = _group(pattern, at)
            out.append(r"\[" if end < 0 else group)
            at = at if end < 0 else end
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + r")(?!(?s:.))"


def _group(pattern: str, at: int) -> tuple[str, int]:
    """The regular expression of a bracket that opens before ``at``, and where it ends; -1 if it never closes."""
    negative = pattern[at : at + 1] in ("^", "!")
    at += negative
    parts = []
    while at < len(pattern) and pattern[at] != "]":
        if pattern[at] == "\\" and at + 1 < len(pattern):
            parts.append(_in_group(pattern[at + 1]))
            at += 2
        elif pattern[at + 1 : at + 2] == "-" and pattern[at + 2 : at + 3] not in ("", "]"):
            low, high = sorted((pattern[at], pattern[at + 2]))
            parts.append(f"{_in_group(low)}-{_in_group(high)}")
            at += 3
        else:
            parts.append(_in_group(pattern[at]))
            at += 1
    if at >= len(pattern):
        return "", -1
    if not parts:  # an empty bracket matches nothing, its negation anything
        return "(?s:.)" if negative else "(?!)", at + 1
    return f"[{'^' if negative else ''}{''.join(parts)}]", at + 1


def _in_group(c: str) -> str:
    return "\\" + c if c in r"\]^-[&~" else c
