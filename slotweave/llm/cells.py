"""Reading a notebook's text back into its cells, and into the words its reader sees.

A notebook is written out as raw JSON ('ipynb'), or as plain text with one of four kinds of cell marks
('script', 'percent', 'fence', 'plain').  The stored layout may be missing or wrong, so it is told from the
text alone.  Everything here works on whole texts, on the Python side of an Arrow batch.
"""

from __future__ import annotations

import json
import re

MARKDOWN, CODE, OUTPUT = "markdown", "code", "output"

_PERCENT = re.compile(r"^# %%(?: \[(\w+)\])?[ \t]*$", re.M)
_SCRIPT = re.compile(r"^# (?:In|Out) ?\[[ \d]*\]:[ \t]*$", re.M)
_PLAIN = re.compile(r"^(?:In|Out) ?\[[ \d]*\]: ?", re.M)
_FENCE = re.compile(r"^```(\w*)[ \t]*$", re.M)


def joined(source) -> str:
    """The text of a JSON 'source' or 'text' field, which may be a string, a list of pieces or absent."""
    if isinstance(source, str):
        return source
    if isinstance(source, list):
        return "".join(piece for piece in source if isinstance(piece, str))
    return ""


def raw_notebook(text: str):
    """The decoded notebook if the text is raw notebook JSON, else None."""
    if text.lstrip()[:1] != "{":
        return None
    try:
        book = json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return None
    return book if isinstance(book, dict) and isinstance(book.get("cells"), list) else None


def _output_text(output) -> str:
    if not isinstance(output, dict):
        return ""
    parts = [joined(output.get("text"))]
    if isinstance(data := output.get("data"), dict):
        parts += [joined(data[kind]) for kind in data if kind.startswith("text/")]
    if isinstance(output.get("traceback"), list):
        parts += [line for line in output["traceback"] if isinstance(line, str)]
    elif output.get("output_type") == "error":
        parts.append(f"{output.get('ename', '')}: {output.get('evalue', '')}")
    return "\n".join(part for part in parts if part)


def _json_cells(book: dict) -> list[tuple[str, str]]:
    cells = []
    for cell in book["cells"]:
        if not isinstance(cell, dict):
            continue
        kind = cell.get("cell_type")
        cells.append((CODE if kind == "code" else MARKDOWN, joined(cell.get("source"))))
        outputs = cell.get("outputs")
        cells += [(OUTPUT, _output_text(output)) for output in (outputs if isinstance(outputs, list) else [])]
    return cells


def _uncommented(text: str) -> str:
    return "\n".join(line[2:] if line.startswith("# ") else line[1:] if line.startswith("#") else line for line in text.split("\n"))


def _percent_cells(text: str) -> list[tuple[str, str]]:
    cells, kind, at = [], None, 0
    for mark in [*_PERCENT.finditer(text), None]:
        body = text[at : mark.start() if mark else len(text)].strip("\n")
        if kind or body:
            cells.append((kind or MARKDOWN, body if kind == CODE else _uncommented(body)))
        if mark:
            kind, at = {"markdown": MARKDOWN, "output": OUTPUT}.get(mark[1], CODE), mark.end()
    return cells


def _script_cells(text: str) -> list[tuple[str, str]]:
    """Cells stand apart by blank lines; a block of comments that follows code or output is markdown.

    A mark and its code are a blank line apart, so an empty block behind a mark (three blank lines) is an empty code cell.
    With two blank lines the code itself begins with one, or is written as nbconvert does.
    """
    cells, kind = [], MARKDOWN
    for block in re.split(r"\n[ \t]*\n", text):
        block = block.strip("\n")
        if not block.strip():
            if kind == CODE:
                cells.append((CODE, ""))
                kind = MARKDOWN
            continue
        first, _, rest = block.partition("\n")
        if _SCRIPT.match(first):
            kind = OUTPUT if first.startswith("# Out") else CODE
            if kind == OUTPUT:
                cells.append((OUTPUT, "\n".join(line[1:] if line.startswith(" ") else line for line in _uncommented(rest).split("\n"))))
                kind = MARKDOWN
            elif rest:
                cells.append((CODE, rest))
            continue
        lines = block.split("\n")
        comment = all(line.startswith("#") for line in lines)
        if kind == CODE:
            cells.append((CODE, block))
            kind = MARKDOWN
        else:
            cells.append((MARKDOWN, _uncommented(block)) if comment else (CODE, block))
    return cells


def _fence_cells(text: str) -> list[tuple[str, str]]:
    cells, kind, at = [], MARKDOWN, 0
    for mark in _FENCE.finditer(text):
        inside = kind != MARKDOWN
        if inside == bool(mark[1]):  # an opening mark within a fence, or a bare mark outside: text
            continue
        body = text[at : mark.start()].strip("\n")
        if inside or body:
            cells.append((kind, body))
        kind, at = (MARKDOWN if inside else OUTPUT if mark[1] in ("text", "output", "html") else CODE), mark.end()
    if body := text[at:].strip("\n"):
        cells.append((kind, body))
    return cells


def _marked_layout(text: str) -> str:
    if "# %%" in text and _PERCENT.search(text):
        return "percent"
    if ("# In" in text or "# Out" in text) and _SCRIPT.search(text):
        return "script"
    if "```" in text and _FENCE.search(text):
        return "fence"
    return "plain"


def layout_of(text: str) -> str:
    """'ipynb', 'percent', 'script', 'fence' or 'plain', told from the marks in the text."""
    return "ipynb" if raw_notebook(text) is not None else _marked_layout(text)


def read_cells(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(layout, [(kind, text), ...]) of a notebook.

    In the 'plain' layout only the start of code and output is marked, so a part that starts with such a mark
    also holds the markdown that follows it; its kind is that of the mark.
    """
    if (book := raw_notebook(text)) is not None:
        return "ipynb", _json_cells(book)
    layout = _marked_layout(text)
    if layout != "plain":
        return layout, {"percent": _percent_cells, "script": _script_cells, "fence": _fence_cells}[layout](text)
    cells, kind, at = [], MARKDOWN, 0
    for mark in [*_PLAIN.finditer(text), None]:
        body = text[at : mark.start() if mark else len(text)].strip("\n")
        if body:
            cells.append((kind, body))
        if mark:
            kind, at = OUTPUT if mark[0].startswith("Out") else CODE, mark.end()
    return "plain", cells


def reader_text(text: str) -> str:
    """The text as a reader sees it: raw notebook JSON decoded, everything else as it is."""
    book = raw_notebook(text)
    return text if book is None else "\n".join(body for _, body in _json_cells(book))
