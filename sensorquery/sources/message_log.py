"""Message logs as a stream: files of JSON lines {"topic": ..., "payload": ...} that grow while they are read.

Spark's file streams read a file once; a log that is appended to needs a position in it. The offset of
this source is the number of bytes of each file up to its last complete line, so a line is read when it
is whole, once, and a restart goes on from the checkpoint to the byte. Ranges are cut into partitions of
PART_BYTES, each of which reads the lines that begin in it.

``format("message_log")`` takes a folder (local, or any store that pyarrow opens) and a ``suffix``
(``.log``). Rows are (topic, payload, file, position). A line that is no JSON object, or has no text as
topic, comes with a null topic and the whole line as payload, so the ingest rejects it with a reason.
A payload that is not text is passed as JSON. The offset has one number per file: rotate logs into
folders of their own rather than keep very many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sensorquery.session import ship_functions

NAME = "message_log"
LAYOUT = "topic string, payload string, file string, position long"
PART_BYTES = 8 << 20
_CHUNK = 1 << 16


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def complete_bytes(handle, start: int, size: int) -> int:
    """The end of the last complete line between ``start`` and ``size``, read backwards in small pieces."""
    end = size
    while end > start:
        begin = max(start, end - _CHUNK)
        handle.seek(begin)
        cut = handle.read(end - begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        end = begin
    return start


def lines_from(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in [start, end); a line that begins before is skipped."""
    at = start
    if start:
        handle.seek(start - 1)
        at = start - 1 + len(_line(handle, start - 1)[0])
    while at < end:
        line, _ = _line(handle, at)
        if not line:
            return
        yield at, line
        at += len(line)


def _line(handle, at: int) -> tuple[bytes, int]:
    handle.seek(at)
    pieces = []
    while True:
        piece = handle.read(_CHUNK)
        cut = piece.find(b"\n")
        if cut >= 0 or not piece:
            pieces.append(piece[:cut + 1] if cut >= 0 else piece)
            return b"".join(pieces), at
        pieces.append(piece)


def message(line: bytes) -> tuple[str | None, str]:
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    try:
        found = json.loads(text)
        topic, payload = found["topic"], found.get("payload")
    except (ValueError, TypeError, KeyError, RecursionError):
        return None, text
    if not isinstance(topic, str):
        return None, text
    return topic, payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _store(self.path)
        out = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                name, before = info.path[len(root):].lstrip("/"), self.known.get(info.path, 0)
                if info.size > before:
                    with store.open_input_file(info.path) as handle:
                        before = complete_bytes(handle, before, info.size)
                self.known[info.path] = before
                if before:
                    out[name] = before
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found: list[InputPartition] = []
        for name, stop in sorted(end.items()):
            for at in range(start.get(name, 0), stop, PART_BYTES):
                found.append(_Range(name, at, min(at + PART_BYTES, stop)))
        return found

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, root = _store(self.path)
        with store.open_input_file(f"{root.rstrip('/')}/{partition.file}") as handle:
            for at, line in lines_from(handle, partition.start, partition.end):
                yield (*message(line), partition.file, at)

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LAYOUT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".log"))


def read_log(spark: SparkSession, path: str, suffix: str = ".log"):
    """The messages of a log folder as a stream."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(NAME).option("suffix", suffix).option("path", path).load()


ship_functions(__name__)
