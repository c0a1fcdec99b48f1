"""Log files as a Spark data source: ``spark.dataSource.register(WalSource)``, then format('wal') reads and writes.

A file holds frames: four bytes with the length, most significant first, and a JSON object with cmd, term, index and
data in base64.  A frame that the file's end cuts off is left out, as a crash may have torn it; a length above 64 MiB
means a corrupt file and is an error.  Options: path, a file or a folder on a file system that all executors share.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "idx BIGINT, term BIGINT, cmd STRING, data BINARY, file STRING"
LARGEST = 64 << 20
PART = 64 << 20  # bytes of a file that one task reads
_MARK = b'{"cmd":'


def frame(idx: int, term: int, cmd: str | None, data: bytes | None) -> bytes:
    body = json.dumps({"cmd": cmd or "", "term": term, "index": idx, "data": base64.b64encode(data or b"").decode()}, separators=(",", ":")).encode()
    return len(body).to_bytes(4, "big") + body


def read_frames(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str, bytes, int]]:
    """(idx, term, cmd, data, offset behind the frame) of the whole frames from a frame's offset on."""
    end = os.path.getsize(path) if end is None else end
    with open(path, "rb") as file:
        file.seek(start)
        at = start
        while at + 4 <= end:
            size = int.from_bytes(file.read(4), "big")
            if size > LARGEST:
                raise ValueError(f"{path}: frame of {size} bytes at {at}; the file is corrupt")
            if at + 4 + size > end:
                return
            entry = json.loads(file.read(size))
            at += 4 + size
            yield entry["index"], entry["term"], entry["cmd"], base64.b64decode(entry.get("data") or ""), at


def whole_length(path: str, start: int = 0) -> int:
    """The offset behind the last whole frame; bodies are skipped."""
    end, at = os.path.getsize(path), start
    with open(path, "rb") as file:
        while at + 4 <= end:
            file.seek(at)
            size = int.from_bytes(file.read(4), "big")
            if size > LARGEST:
                raise ValueError(f"{path}: frame of {size} bytes at {at}; the file is corrupt")
            if at + 4 + size > end:
                break
            at += 4 + size
    return at


def truncate(path: str, keep: int) -> None:
    """Cut a file down to its first ``keep`` entries."""
    at = 0
    for n, (*_, end) in enumerate(read_frames(path), 1):
        if n <= keep:
            at = end
    with open(path, "r+b") as file:
        file.truncate(at)
        file.flush()
        os.fsync(file.fileno())


def _current(path: str) -> str:
    """The name of the folder's current generation; '' until it has been overwritten once."""
    try:
        with open(os.path.join(path, "CURRENT")) as file:
            return file.read()
    except FileNotFoundError:
        return ""


def _files(path: str, generation: str | None = None) -> list[str]:
    """A file itself, or the files of a folder's current generation; names begin with that of their generation."""
    if os.path.isfile(path):
        return [path]
    generation = _current(path) if generation is None else generation
    own = lambda name: name.partition("-")[0] == generation if generation else "-" not in name
    return sorted(os.path.join(path, name) for name in os.listdir(path) if name.endswith(".wal") and own(name))


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int | None  # of the part; None for the whole file
    exact: bool = True  # the start is that of a frame


def frame_from(path: str, start: int) -> int:
    """The offset of the first frame that begins at ``start`` or behind it; the file's size if there is none.

    A body begins with the key of the command, and that text can't stand within a body, where quotes are escaped.
    """
    size, at = os.path.getsize(path), start
    with open(path, "rb") as file:
        while at < size:
            file.seek(at)
            found = file.read((1 << 20) + len(_MARK) + 3).find(_MARK, 4)
            if found >= 0:
                return at + found - 4
            at += 1 << 20
    return size


def _rows(part: _Range) -> Iterator[tuple]:
    if part.exact:
        for idx, term, cmd, data, _ in read_frames(part.path, part.start, part.end):
            yield idx, term, cmd, data, part.path
        return
    at = frame_from(part.path, part.start) if part.start else 0
    for idx, term, cmd, data, behind in read_frames(part.path, at) if at < part.end else ():
        yield idx, term, cmd, data, part.path
        if behind >= part.end:
            return


def _parts(path: str) -> list[_Range]:
    """A large file in parts that begin at frames, found by each task for itself; a small one whole."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        marked = file.read(4 + len(_MARK))[4:] == _MARK
    if size <= PART or not marked:
        return [_Range(path, 0, None)]
    return [_Range(path, start, min(start + PART, size), exact=False) for start in range(0, size, PART)]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [part for file in _files(self.path) for part in _parts(file)]

    def read(self, partition):
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset has the whole length of each file."""

    def __init__(self, path: str):
        self.path, self.seen = path, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        self.seen = {file: whole_length(file, self.seen.get(file, 0)) for file in _files(self.path)}
        return dict(self.seen)

    def partitions(self, start, end):
        return [_Range(file, start.get(file, 0), to) for file, to in end.items() if to > start.get(file, 0)]

    def read(self, partition):
        return _rows(partition)

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    staged: str


class _Writer(DataSourceWriter):
    """Each task writes a file of its own and syncs it; files get their final names only when all are complete."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        staged = os.path.join(self.path, f".{uuid.uuid4().hex}.staged")
        with open(staged, "wb") as file:
            for row in iterator:
                file.write(frame(row["idx"], row["term"], row["cmd"], bytes(row["data"]) if row["data"] is not None else None))
            file.flush()
            os.fsync(file.fileno())
        return _Written(staged)

    def commit(self, messages):
        """New files of the current generation; an overwrite makes the next one, current by one rename, and then drops the old."""
        generation, old = _current(self.path), []
        if self.overwrite:
            old = _files(self.path)
            generation = f"{int(generation or 0) + 1:08d}"
        prefix = f"{generation}-" if generation else ""
        numbers = [os.path.basename(f).removeprefix(prefix)[:8] for f in _files(self.path, generation)]
        first = 1 + max((int(n) for n in numbers if n.isdigit()), default=-1)
        for n, message in enumerate(filter(None, messages)):
            if os.path.getsize(message.staged):
                os.replace(message.staged, os.path.join(self.path, f"{prefix}{first + n:08d}.wal"))
            else:
                os.remove(message.staged)
        if self.overwrite:
            staged = os.path.join(self.path, f".{uuid.uuid4().hex}.staged")
            with open(staged, "w") as file:
                file.write(generation)
                file.flush()
                os.fsync(file.fileno())
            os.replace(staged, os.path.join(self.path, "CURRENT"))
        for file in old:
            os.remove(file)

    def abort(self, messages):
        for message in filter(None, messages):
            if os.path.exists(message.staged):
                os.remove(message.staged)


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema):
        return _Reader(self._path())

    def streamReader(self, schema):
        return _StreamReader(self._path())

    def writer(self, schema, overwrite):
        return _Writer(self._path(), overwrite)
