"""Score bounds such as '5', '(5', '-inf' and '+inf', and rank bounds that may count from the end."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bound(text: str) -> tuple[float, bool]:
    """(value, exclusive); an infinite bound is the largest finite score.  Anything that is no number is an error."""
    exclusive = text.startswith("(")
    body = text[exclusive:]
    if body.lower() in ("inf", "+inf", "-inf"):
        return (-1 if body.startswith("-") else 1) * sys.float_info.max, exclusive
    if body != body.strip() or not body:
        raise ValueError(f"min or max is not a float: {text!r}")
    value = float(body)
    if math.isnan(value):
        raise ValueError(f"min or max is not a float: {text!r}")
    return value, exclusive


def within(score: Column, low: str, high: str) -> Column:
    """Whether a score lies between two bounds."""
    (least, open_low), (most, open_high) = parse_bound(low), parse_bound(high)
    above = score > F.lit(least) if open_low else score >= F.lit(least)
    return above & (score < F.lit(most) if open_high else score <= F.lit(most))


def rank_between(rank: Column, size: Column, start: int, stop: int) -> Column:
    """Whether a 0-based rank lies in the inclusive slice start..stop; negative numbers count from the end."""
    first = F.lit(start) if start >= 0 else F.greatest(size + F.lit(start), F.lit(0))
    last = F.lit(stop) if stop >= 0 else size + F.lit(stop)
    return (rank >= first) & (rank <= last)
