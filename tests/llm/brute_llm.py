"""Plain Python versions of the text problems, over whole small tables."""

from __future__ import annotations

import json
import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\W_]+")


def seen(text):
    if text.startswith("{"):
        try:
            book = json.loads(text)
        except ValueError:
            return text
        if isinstance(book, dict) and "cells" in book:
            part = lambda x: x if isinstance(x, str) else "".join(x or [])
            return "\n".join(part(c.get("source")) + "\n" + "\n".join(part(o.get("text")) for o in c.get("outputs") or []) for c in book["cells"])
    return text


def p7(folder):
    items = {}
    for r in pq.read_table(f"{folder}/eval_items.parquet").to_pylist():
        own = WORD.findall((r["text"] or "").lower())
        n = min(13, len(own))
        items[r["item_id"]] = {f" {' '.join(own[i : i + n])} " for i in range(len(own) - n + 1)} if own else set()
    out = set()
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        text = f" {' '.join(WORD.findall(seen(r['text'] or '').lower()))} "
        out |= {(r["doc_id"], item) for item, passages in items.items() if any(p in text for p in passages)}
    return out
