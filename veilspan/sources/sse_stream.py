"""Event streams as a streaming source: folders of byte files that grow.

A file is a stream.  An offset holds how far each file has been read, in bytes.  A
batch reads from the last block end before its own bytes, so a block, a character
or a line end that lies across two batches comes out once, whole, with the batch
that ends it.  Reading depends on the offsets alone: a batch that runs again after
a failure, or from a checkpoint, gives the same rows.

Next to a file `name`, an empty file `name.eof` says that it is complete: what
follows the last block end is then an event too, and a row with the fault `eof` is
the last one; `name.failed` does the same with `transport`.  Bytes that are no
UTF-8 give the fault `bytes`, and nothing more of that stream.

The offset names every file of the folder, so move finished streams away in time;
files are read where the tasks run, from any store that Arrow can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .payloads import sse_event

SCHEMA = "stream_id string, seq long, data string, event string, id string, retry string, comments array<string>, fault string"
ENDS = {".eof": "eof", ".failed": "transport"}
_BLOCK_END = re.compile(rb"\r\n\r\n|\n\n")
#: Bytes read at a time when the last block end is looked for.
STEP = 1 << 16


@dataclass
class Piece(InputPartition):
    """Bytes [start, end) of a file; `fault` says how its stream ended, if it did with these."""

    path: str
    start: int
    end: int
    fault: str | None


def block_start(file, at: int) -> int:
    """Where the block begins that byte `at` belongs to: after the last block end that is not after `at`."""
    low, tail = at, b""
    while low:
        step = min(STEP, low)
        low -= step
        file.seek(low)
        tail = file.read(step) + tail[:3]
        found = None
        for found in _BLOCK_END.finditer(tail):
            pass
        if found is not None:
            return low + found.end()
    return 0


def piece_events(file, start: int, end: int, fault: str | None) -> Iterator[tuple[int, dict | None, str | None]]:
    """(number, event, fault): events of blocks that end in bytes (start, end]; the number of an event is the place of its end."""
    at = block_start(file, start)
    file.seek(at)
    data = file.read(end - at)
    ends = [m.span() for m in _BLOCK_END.finditer(data)]
    if fault is not None and (not ends or ends[-1][1] < len(data)):
        ends.append((len(data), len(data)))
    first = 0
    for text_end, block_end in ends:
        block, first = data[first:text_end], block_end
        try:
            event = sse_event(block.decode("utf-8"))
        except UnicodeDecodeError:
            yield 2 * (at + block_end), None, "bytes"
            return
        if event is not None:
            yield 2 * (at + block_end), event, None
    if fault is not None:
        yield 2 * end + 1, None, fault  # after an event that ends in the same place


class SseReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: [bytes, fault]}."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))}
        mark = lambda name: next((fault for end, fault in ENDS.items() if name + end in found), None)
        return {name: [size, mark(name)] for name, size in sorted(found.items()) if not name.endswith(tuple(ENDS))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before = lambda name: start.get(name, [0, None])
        return [Piece(name, before(name)[0], size, fault) for name, (size, fault) in end.items() if [size, fault] != before(name) and before(name)[1] is None]

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with system.open_input_file(f"{root}/{piece.path}") as file:
            for number, event, fault in piece_events(file, piece.start, piece.end, piece.fault):
                e = event or {"data": None, "event": None, "id": None, "retry": None, "comments": []}
                yield piece.path, number, e["data"], e["event"], e["id"], e["retry"], e["comments"], fault

    def commit(self, end: dict) -> None:
        pass


class SseSource(DataSource):
    """`spark.readStream.format("veilspan_sse").load(folder)` after `register(spark)`."""

    @classmethod
    def name(cls) -> str:
        return "veilspan_sse"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SseReader:
        return SseReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SseSource)
