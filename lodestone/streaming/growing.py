"""A streaming source that follows text files while they grow: offsets are byte positions at line ends.

``spark.dataSource.register(GrowingLines)``, then ``spark.readStream.format("growing_lines").load(folder)``. A file is
read on from where the last batch ended, up to its last complete line; a line that is still being written waits. New files
join, and a stream that starts again from its checkpoint goes on behind the last line it has committed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Bytes of one input partition, and of one read.
PIECE = 32 << 20
READ = 1 << 20
SCHEMA = "file string, position bigint, line string"


@dataclass
class Piece(InputPartition):
    """The lines of ``file`` that begin in [start, end); both lie at line ends, or ``start`` within a line of the piece before."""

    file: str
    start: int
    end: int
    first: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class GrowingLines(DataSource):
    """Options: ``path``, a folder in any store that pyarrow reads; ``suffix`` of the files' names."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options.get("suffix", ""))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The position behind the last line end of each file that has one."""
        store, folder = _store(self.path)
        found = {}
        for info in store.get_file_info(fs.FileSelector(folder)):
            name = info.base_name
            if info.type == fs.FileType.File and name.endswith(self.suffix) and name[0] not in "._":
                end = self._last_end(store, info.path, info.size)
                if end:
                    found[info.path] = end
        return found

    @staticmethod
    def _last_end(store: fs.FileSystem, path: str, size: int) -> int:
        with store.open_input_file(path) as file:
            high = size
            while high > 0:
                low = max(0, high - READ)
                at = file.read_at(high - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            pieces += [Piece(file, low, min(low + PIECE, stop), first) for low in range(first, stop, PIECE)]
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the piece, each with its position; the last one may end behind the piece."""
        store, _ = _store(self.path)
        with store.open_input_file(piece.file) as file:
            at, rest = piece.start, b""
            if piece.start > piece.first:
                # The line that is open where the piece begins belongs to the piece before.
                at -= 1
                while True:
                    block = file.read_at(READ, at)
                    cut = block.find(b"\n")
                    if cut >= 0:
                        at += cut + 1
                        break
                    at += len(block)
            position = at
            while position < piece.end:
                block = file.read_at(READ, at)
                if not block:
                    return
                at += len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                held: list[tuple[int, bytes]] = []
                for line in lines:
                    if position >= piece.end:
                        break
                    held.append((position, line))
                    position += len(line) + 1
                if held:
                    yield pa.RecordBatch.from_pydict({
                        "file": pa.array([piece.file] * len(held)), "position": pa.array([p for p, _ in held], pa.int64()),
                        "line": pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for _, x in held])})

    def commit(self, end: dict) -> None:
        pass
