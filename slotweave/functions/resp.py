"""The wire texts of results: simple strings, integers, errors, bulk strings, arrays and integer arrays."""

from __future__ import annotations

END = "\r\n"


def encode(value) -> str:
    """A value as wire text; None is the nil reply, an exception an error, a tuple an array of integers."""
    if value is None:
        return f"$-1{END}"
    if isinstance(value, Exception):
        return f"-{value}{END}"
    if isinstance(value, bool):
        return f":{int(value)}{END}"
    if isinstance(value, int):
        return f":{value}{END}"
    if isinstance(value, float):
        return encode(f"{value:f}")
    if isinstance(value, str):
        return f"${len(value.encode())}{END}{value}{END}"
    if isinstance(value, tuple):
        return f"@{len(value)}|" + "".join(f"{x}|" for x in value) + END
    if isinstance(value, list):
        return f"*{len(value)}{END}" + "".join(map(encode, value))
    raise TypeError(f"no wire text for {type(value).__name__}")


def decode(text: str):
    """The value of a wire text; an error text is returned as a ValueError, nil as the empty string."""
    value, rest = _decode(text.encode())
    if rest:
        raise ValueError("text after the value")
    return value


def _decode(data: bytes):
    if not data:
        raise ValueError("no data")
    line, _, rest = data[1:].partition(END.encode())
    kind, head = data[:1], line.decode()
    if kind == b"+":
        return head, rest
    if kind == b"-":
        return ValueError(head), rest
    if kind == b":":
        return int(head), rest
    if kind == b"$":
        n = int(head)
        if n < 0:
            return "", rest
        return rest[:n].decode(), rest[n + 2 :]
    if kind == b"@":
        n, *parts = head.split("|")
        return [int(x) for x in parts[: int(n)]], rest
    if kind == b"*":
        out = []
        for _ in range(int(head)):
            value, rest = _decode(rest)
            out.append(value)
        return out, rest
    raise ValueError(f"unknown prefix {kind!r}")


def shortest_float(value: float) -> str:
    """A float in its shortest form; an exponent is used below 1e-4 and from 1e21 on for plain scores."""
    return repr(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
