"""A tree of source files as a Spark data source, for batches and for streams.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").load("s3://bucket/checkouts")
    spark.readStream.format("source_tree").option("settle", 5).load("hdfs://host/checkouts")

Rows: file_path (relative to the root), source, version (time of the last change, in microseconds). The driver lists the root alone; each of its folders is a partition that lists and reads
its own part of the tree, and so are the files that lie in the root itself. Option `prefix` chooses folders before anything is listed; with option `pushdown` and the setting
spark.sql.python.filterPushdown.enabled so do conditions on file_path (equal, in, starts with). Undecodable bytes become U+FFFD, a file that goes while it is read is skipped.

A stream has the time of the last change as its offset and takes, per micro-batch, the files changed after the last one. Files that changed less than `settle` seconds ago
wait for the next, so that none with the same time is missed. What is deleted is not seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..operators.extract import supported_extensions
from .project import SKIPPED

SCHEMA = "file_path string, source string, version long"
#: Rows of a batch that a task hands over, and bytes of their texts.
ROWS, BYTES = 256, 4 << 20


def prefix(folder: str, after: int = -1, upto: int = 1 << 62) -> InputPartition:
    """A folder below the root, or (folder "") the files of the root itself; only files changed after one time, up to another."""
    return InputPartition((folder, after, upto))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    found, inside = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return found, inside.rstrip("/")


def _wanted(info: pafs.FileInfo, root: str) -> bool:
    parts = info.path[len(root) :].strip("/").split("/")
    return info.is_file and info.path.endswith(tuple(supported_extensions())) and not set(parts) & set(SKIPPED)


def _micros(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


class _Tree:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.only: list[str] | None = [options["prefix"]] if options.get("prefix") else None  # paths, or beginnings of paths, one of which a file must have
        self.exact = False

    def prefixes(self) -> list[str]:
        files, root = _open(self.root)
        top = files.get_file_info(pafs.FileSelector(root, recursive=False))
        folders = sorted(x.base_name for x in top if x.type == pafs.FileType.Directory and x.base_name not in SKIPPED)
        keep = lambda folder: self.only is None or any(p.startswith(f"{folder}/") or not self.exact and f"{folder}/".startswith(p) for p in self.only)
        own = [""] if any(x.is_file for x in top) and (self.only is None or not self.exact or any("/" not in p for p in self.only)) else []
        return own + [x for x in folders if keep(x)]

    def infos(self, part: InputPartition) -> Iterator[pafs.FileInfo]:
        files, root = _open(self.root)
        folder, after, upto = part.value
        place = f"{root}/{folder}" if folder else root
        for info in sorted(files.get_file_info(pafs.FileSelector(place, recursive=bool(folder), allow_not_found=True)), key=lambda x: x.path):
            if _wanted(info, root) and after < _micros(info) <= upto:
                name = info.path[len(root) + 1 :]
                if self.only is None or any(name == p if self.exact else name.startswith(p) for p in self.only):
                    yield info

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.root)
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["file_path", "source", "version"])

        for info in self.infos(part):
            try:
                with files.open_input_stream(info.path) as stream:
                    text = stream.read().decode("utf-8", "replace")
            except FileNotFoundError:
                continue
            rows.append((info.path[len(root) + 1 :], text, _micros(info)))
            size += len(text)
            if len(rows) >= ROWS or size >= BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()


class _Reader(_Tree, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [prefix(x) for x in self.prefixes()] or [prefix("")]


class _Pushed(_Reader):
    """A reader that conditions are handed to: Spark allows such a one only if its setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.only is None and getattr(f, "attribute", None) == ("file_path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.only = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else [x for x in f.value if x is not None]
                self.exact = not isinstance(f, StringStartsWith)
            else:
                yield f


class _StreamReader(_Tree, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", 1))

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": int((time.time() - self.settle) * 1_000_000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [prefix(x, start["changed"], end["changed"]) for x in self.prefixes()] or [prefix("", start["changed"], end["changed"])]

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """format("source_tree"); options path, prefix, pushdown, for streams settle."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return (_Pushed if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)
