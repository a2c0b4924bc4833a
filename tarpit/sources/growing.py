"""Logs that grow: a streaming data source that resumes inside a file.

Spark's file stream reads a file once, so lines appended later are lost. Here the offset
of the stream holds, for each file of a folder, who it is and how many bytes are read:

* A file is named by its first line (``HEAD_BYTES`` of it at most), so a rotated log that
  is renamed goes on where it was, and a new file under the old path starts at its
  beginning. Files with the same first line are told apart by the order of their paths.
* Only whole lines are read: the offset ends after the last line feed, and a line
  that is still being written arrives with a later batch.
* A file that became shorter than what was read has been replaced and is read anew.

What is new is cut into byte ranges, one Spark partition each; a range that starts inside
a line leaves it to the range before. The checkpoint has the offsets, so a batch that is
retried reads the same bytes. Files are reached through ``pyarrow.fs``: a local or mounted
path, or a URI of a store that it knows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .events import parse_event_lines

HEAD_BYTES = 4096
BLOCK_BYTES = 64 << 20
#: Bytes fetched at once, and lines handed on at once.
READ_BYTES = 1 << 20
BATCH_LINES = 4096

SCHEMA = "value string, split struct<rank:string,file:string,block:long>"
_SPLIT = pa.struct([("rank", pa.string()), ("file", pa.string()), ("block", pa.int64())])
_ARROW = pa.schema([("value", pa.string()), ("split", _SPLIT)])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(store: fs.FileSystem, path: str) -> str | None:
    """Digest of a file's first line; None while that isn't whole."""
    with store.open_input_file(path) as f:
        first, feed, _ = f.read(HEAD_BYTES).partition(b"\n")
    return hashlib.md5(first).hexdigest() if feed or len(first) == HEAD_BYTES else None


def _whole_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line feed."""
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - READ_BYTES)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def list_logs(folder: str) -> dict[str, dict]:
    """The files of a folder by name of their first line: path, time of change, bytes of
    whole lines. Hidden files (first character "." or "_") are left out."""
    store, base = _open(folder)
    found: dict[str, dict] = {}
    infos = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    for info in sorted(infos, key=lambda i: i.path):
        if info.type != fs.FileType.File or info.base_name[0] in "._":
            continue
        try:
            head = _head(store, info.path)
            if head is None:
                continue
            name, k = head, 0
            while name in found:
                k += 1
                name = f"{head}-{k}"
            found[name] = {"path": info.path, "time": info.mtime_ns or 0, "bytes": _whole_lines(store, info.path, info.size)}
        except FileNotFoundError:  # renamed since it was listed; the next look finds it
            continue
    return found


class LogRange(InputPartition):
    """Bytes of a file: the lines that start from ``start`` on and before ``stop``."""

    def __init__(self, name: str, path: str, start: int, stop: int, end: int, rank: str):
        self.name, self.path, self.start, self.stop, self.end, self.rank = name, path, start, stop, end, rank


def lines_of(store: fs.FileSystem, part: LogRange) -> Iterator[bytes]:
    """The lines that start in a range. ``end`` is where the file's whole lines end."""
    at = part.start
    with store.open_input_file(part.path) as f:
        rest = b""
        inside = at > 0 and f.read_at(1, at - 1) != b"\n"  # of the range before
        while at < part.end:
            data = f.read_at(min(READ_BYTES, part.end - at), at)
            if not data:
                raise OSError(f"{part.path} is shorter than {part.end} bytes")
            first = at - len(rest)  # place of the first line in ``rest + data``
            *lines, rest = (rest + data).split(b"\n")
            at += len(data)
            for line in lines:
                if first >= part.stop:
                    return
                if not inside:
                    yield line
                inside = False
                first += len(line) + 1
            if first >= part.stop:
                return


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.by_path = options.get("order", "time") == "path"

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(list_logs(self.folder), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for name, log in now.items():
            rank = log["path"] if self.by_path else f"{log['time']:020d}"
            at = before.get(name, {}).get("bytes", 0)
            at = 0 if at > log["bytes"] else at
            for k in range(at, log["bytes"], self.block):
                out.append(LogRange(name, log["path"], k, min(k + self.block, log["bytes"]), log["bytes"], rank))
        return sorted(out, key=lambda p: (p.rank, p.name, p.start))

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.folder)
        try:
            moved = _head(store, partition.path) != partition.name.split("-")[0]
        except FileNotFoundError:
            moved = True
        if moved:  # renamed between the offset and now
            now = list_logs(self.folder).get(partition.name)
            if now is None:
                raise FileNotFoundError(f"the log that was {partition.path} is gone")
            partition = LogRange(partition.name, now["path"], partition.start, partition.stop, partition.end, partition.rank)
        split = {"rank": partition.rank, "file": partition.name, "block": partition.start}

        def batch(lines: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([split] * len(lines), _SPLIT)], schema=_ARROW)

        held: list[str] = []
        for line in lines_of(store, partition):
            held.append(line.decode("utf-8", "replace"))
            if len(held) == BATCH_LINES:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log").load(folder)``; options ``blockBytes``, ``order``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader({k.lower(): v for k, v in self.options.items()})


def stream_growing_events(spark: SparkSession, folder: str, order: str = "time", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The logs of a folder as a stream of raw events with ``split``, appended lines
    and rotated files included. In a micro-batch files come in the ``order`` of their time
    of change, then name; "path" takes the order of their paths, for logs named by date."""
    if order not in ("time", "path"):
        raise ValueError("order is time or path")
    spark.dataSource.register(GrowingLog)
    lines = spark.readStream.format("growing_log").option("order", order).option("blockBytes", block_bytes).load(folder)
    return parse_event_lines(lines)
