"""Evaluation passages that stand in a corpus.

MinHash containment search, partitioned by size: every evaluation item becomes passages of ``SPAN`` words (a shorter
item is one passage), and passages are grouped by their number of words.  A document is compared with a group
through all its windows of that size, so that passage and window have sets of equal size and containment can't be
lost in a long document: a window that holds all shingles of a passage has the passage's MinHash values, and a
sliding minimum over the shingle hashes gives those of all windows of a document at once.  Windows whose values are
those of a passage are candidates, which must contain all shingles of the passage and then its very words.

Few passages are an index in every task.  More than that stay in Spark: windows that pass a bitmap of their MinHash
values, whose size is fixed, are joined with the passages by size and MinHash.  Either way the texts are read once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.cells import reader_text
from slotweave.workspace import materialize

SPAN = 13  # consecutive words that count as a leak
SHINGLE = 5
INDEX_PASSAGES, INDEX_BYTES = 200_000, 32 << 20  # of passages in a task's memory; beyond either they are joined
_FILTER_BITS = 27  # of the bitmap that windows must pass before they are shuffled: 16 MB
_SALTS = 16  # of a passage in that join, as one passage may stand in a large part of the corpus
_CHUNK = 1 << 20  # characters that are hashed together
_WORD = re.compile(r"[^\W_]+")
_BASE, _MIX, _SECOND = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_BITS = 22


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64."""

    n = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, _CHUNK + 65_536)
            cls.up, cls.down = _powers(_BASE, cls.n), _powers(pow(_BASE, -1, 1 << 64), cls.n)
        return cls.up[:n], cls.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(_MIX)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a text in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _letters()[points]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _Powers.upto(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return _mixed(out)


def window_minhashes(hashes: np.ndarray, sizes: list[int]):
    """(size, first MinHash, second MinHash) of every window of each size, in words."""
    shingles = _shingles(hashes, SHINGLE)
    first, second, upto = shingles, _mixed(shingles * np.uint64(_SECOND)), SHINGLE
    others = second
    for size in sizes:
        if size < SHINGLE:
            own = _shingles(hashes, size)
            yield size, own, _mixed(own * np.uint64(_SECOND))
            continue
        while upto < size and len(first) > 1:  # one more word: one more shingle in each window
            upto += 1
            first = np.minimum(first[:-1], shingles[upto - SHINGLE :])
            second = np.minimum(second[:-1], others[upto - SHINGLE :])
        if upto == size:
            yield size, first, second


def shingle_containment(passage: tuple[str, ...], window: tuple[str, ...]) -> float:
    """The share of the passage's shingles that the window holds; a passage shorter than a shingle is one."""
    k = min(SHINGLE, len(passage))
    runs = lambda own: {own[i : i + k] for i in range(len(own) - k + 1)}
    wanted = runs(passage)
    return len(wanted & runs(window)) / len(wanted)


def minhashes(passage: tuple[str, ...]) -> tuple[int, int]:
    """The two MinHash values of a passage."""
    hashes, _, _ = word_hashes(" ".join(passage))
    _, first, second = next(window_minhashes(hashes, [len(passage)]))
    return int(first[0]), int(second[0])


class Chunk:
    """Some texts in lower case, hashed together: [(id, text)]."""

    def __init__(self, documents: list[tuple[int, str]]):
        self.documents, self.text = documents, "\n".join(t for _, t in documents)
        ends_at = np.cumsum([len(t) + 1 for _, t in documents])
        self.hashes, self.starts, self.ends = word_hashes(self.text)
        self.owner = np.searchsorted(ends_at, self.starts, side="right")

    def windows(self, sizes: list[int], passes):
        """(size, position, document, first, second) of the windows within one document whose MinHash ``passes``."""
        for size, first, second in window_minhashes(self.hashes, sizes):
            hits = np.flatnonzero(passes(size, first))
            hits = hits[self.owner[hits] == self.owner[hits + size - 1]]
            yield from ((size, at, self.documents[self.owner[at]][0], int(first[at]), int(second[at])) for at in hits.tolist())

    def words(self, size: int, at: int) -> tuple[str, ...]:
        return tuple(_WORD.findall(self.text[self.starts[at] : self.ends[at + size - 1]]))


class PassageIndex:
    """Passages (item, number, words) by size and MinHash."""

    def __init__(self, passages: list[tuple[int, int, tuple[str, ...]]]):
        by_size = defaultdict(lambda: defaultdict(list))
        for item, number, passage in passages:
            by_size[len(passage)][minhashes(passage)].append((item, number, passage))
        self.sizes = sorted(by_size)
        self.found = {size: dict(group) for size, group in by_size.items()}
        self.seen, self.values = {}, {}
        for size, group in by_size.items():
            self.values[size] = np.array(sorted({first for first, _ in group}), np.uint64)
            self.seen[size] = np.zeros(1 << _BITS, bool)
            self.seen[size][self.values[size] >> np.uint64(64 - _BITS)] = True

    def _passes(self, size: int, first: np.ndarray) -> np.ndarray:
        may = self.seen[size][first >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(may)
        may[at] = np.isin(first[at], self.values[size])
        return may

    def search(self, documents: list[tuple[int, str]], every: bool = False):
        """(document, item, number) of passages that stand in ``documents``; one for each pair, or with ``every`` all."""
        chunk = Chunk(documents)
        pairs, triples = set(), set()
        for size, at, document, first, second in chunk.windows(self.sizes, self._passes):
            window = None
            for item, number, passage in self.found[size].get((first, second), ()):
                if (document, item, number) in triples or not every and (document, item) in pairs:
                    continue
                window = window or chunk.words(size, at)
                if shingle_containment(passage, window) == 1 and window == passage:
                    pairs.add((document, item))
                    triples.add((document, item, number))
        return triples


def passages_of(item_id: int, text: str, span: int = SPAN) -> list[tuple[int, int, tuple[str, ...]]]:
    """(item, number, words) of an item's different passages: its runs of ``span`` words, or all its words if they are fewer."""
    own = words(text)
    runs = [tuple(own[i : i + span]) for i in range(max(1, len(own) - span + 1))] if own else []
    return [(item_id, number, passage) for number, passage in enumerate(dict.fromkeys(runs))]


def _pieces(text: str, size: int = 4 * _CHUNK, overlap: int = SPAN) -> Iterator[str]:
    """A very long text in pieces that share ``overlap`` words, so that every passage lies whole in one of them."""
    start, end = 0, size
    while end < len(text):
        while end < len(text) and text[end - 1].isalnum():  # never within a word
            end += 1
        reach, last = 1024, []
        while len(last) <= overlap and reach < 4 * (end - start):
            last = [m.start() for m in _WORD.finditer(text, max(start, end - reach), end)]
            reach *= 4
        if len(last) <= overlap:  # hardly any words: a larger piece
            end += size
            continue
        yield text[start:end]
        start = last[-overlap]
        end = max(start, end) + size
    yield text[start:]


def _chunks(batches, span: int) -> Iterator[list[tuple[int, str]]]:
    for batch in batches:
        chunk, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc_id is None or not text:
                continue
            for piece in _pieces(reader_text(text).lower(), overlap=span):
                chunk.append((doc_id, piece))
                size += len(piece)
                if size >= _CHUNK:
                    yield chunk
                    chunk, size = [], 0
        if chunk:
            yield chunk


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("number", pa.int32())])
_PASSAGES = pa.schema([("item_id", pa.int64()), ("number", pa.int32()), ("size", pa.int32()), ("first", pa.int64()), ("second", pa.int64()), ("passage", pa.string())])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("first", pa.int64()), ("second", pa.int64()), ("passage", pa.string())])


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def item_passages(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, number, size, first, second, passage: the passages of the items, their MinHash values and words."""

    def run(batches):
        for batch in batches:
            own = [p for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in passages_of(i, t, span)]
            yield _batch([(i, n, len(p), *map(_signed, minhashes(p)), " ".join(p)) for i, n, p in own], _PASSAGES)

    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "item_id BIGINT, number INT, size INT, first BIGINT, second BIGINT, passage STRING")
    return materialize(rows, "passages")


def _by_index(documents: DataFrame, passages: DataFrame, span: int, every: bool) -> DataFrame:
    rows = [(r["item_id"], r["number"], tuple(r["passage"].split(" "))) for r in passages.select("item_id", "number", "passage").collect()]  # at most INDEX_PASSAGES
    index = documents.sparkSession.sparkContext.broadcast(PassageIndex(rows))

    def run(batches):
        for chunk in _chunks(batches, span):
            yield _batch(sorted(index.value.search(chunk, every)), _FOUND)

    return documents.mapInArrow(run, "doc_id BIGINT, item_id BIGINT, number INT")


def _by_join(documents: DataFrame, passages: DataFrame, span: int) -> DataFrame:
    """Windows that pass a bitmap of the passages' MinHash values, joined with the passages by size and MinHash."""
    cells = passages.select(F.shiftrightunsigned("first", 64 - _FILTER_BITS).alias("cell")).selectExpr("cell >> 6 AS word", "shiftleft(1L, CAST(cell & 63 AS INT)) AS bit")
    bits = cells.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words_ = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for r in bits.toLocalIterator():  # at most 2^21 rows
        words_[r["word"]] = r["bits"]
    sizes = sorted(r["size"] for r in passages.select("size").distinct().collect())  # at most ``span``
    shared = documents.sparkSession.sparkContext.broadcast(words_)

    def run(batches):
        own = shared.value.view(np.uint64)

        def passes(_, first):
            at = first >> np.uint64(64 - _FILTER_BITS)
            return (own[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        for documents_ in _chunks(batches, span):
            chunk = Chunk(documents_)
            rows = {(doc, size, _signed(first), _signed(second), " ".join(chunk.words(size, at))) for size, at, doc, first, second in chunk.windows(sizes, passes)}
            yield _batch(sorted(rows), _WINDOWS)

    windows = documents.mapInArrow(run, "doc_id BIGINT, size INT, first BIGINT, second BIGINT, passage STRING")
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    salted = passages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return windows.join(salted, ["size", "first", "second", "passage", "salt"]).select("doc_id", "item_id", "number")


def _found(documents: DataFrame, passages: DataFrame, span: int, every: bool) -> DataFrame:
    documents = documents.select("doc_id", "text")
    count, size = passages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    if count <= INDEX_PASSAGES and size <= INDEX_BYTES:
        return _by_index(documents, passages, span, every)
    return _by_join(documents, passages, span)


def leaked_items(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, item_id of every document that holds ``span`` consecutive words of an item, or all of a shorter item.

    Words are runs of letters and digits in lower case; raw notebook JSON is decoded first.  Null and empty texts
    and null ids give no row, nor do items without a word.  Each pair comes once, however often it occurs, also if
    ids repeat.  Whole texts are searched, once, whatever the number of items.
    """
    return _found(documents, item_passages(items, span), span, every=False).select("doc_id", "item_id").distinct()


def leaked_shares(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, item_id, found, passages: how many of an item's different passages stand in a document that leaks it.

    ``found`` equal to ``passages`` means that the whole item stands in the document.  Null cases as in ``leaked_items``.
    """
    passages = item_passages(items, span)
    totals = passages.groupBy("item_id").agg(F.count_distinct("passage").alias("passages"))
    found = _found(documents, passages, span, every=True).distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("found"))
    return found.join(totals, "item_id").select("doc_id", "item_id", "found", "passages")
