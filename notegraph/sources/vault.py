"""A folder of notes as a Spark data source: all files, dot-folders too, with exact nanosecond times.

Options: ``root``, ``ignore`` (JSON list of globs), ``content`` (``false`` for stats only), ``chunk`` (files, or at most so
many folders, per partition), ``folders`` (from how many open folders on the walk goes on in tasks, an eighth as many at least).
A folder is skipped as a whole if a pattern ignores all of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import path_matches
from ..manifest import Manifest
from ..schemas import FILES
from ..session import parts_of

#: About as much of contents is read before it's passed on.
BATCH_BYTES = 32_000_000


def walk(root: str, ignore: list[str], folders: list[str], most: int | None = None) -> tuple[list[str], list[str]]:
    """Vault-relative paths of everything named ``*.md`` under ``folders`` that no pattern ignores, and the folders still to be
    walked: none, or as soon as there are ``most`` of them those."""
    whole = {g[:-3] for g in ignore if g.endswith("/**") and not set("*?") & set(g[:-3])}
    found: list[str] = []
    open_folders = list(folders)
    while open_folders and (most is None or len(open_folders) < most):
        folder = open_folders.pop(0)
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False) and path not in whole:
                open_folders.append(path)
            if e.name.endswith(".md") and not any(path_matches(path, g) for g in ignore):
                found.append(path)
    return found, open_folders


def list_notes(root: str, ignore: list[str]) -> list[str]:
    """All notes of a collection, in order."""
    return sorted(walk(root, ignore, [""])[0])


class _Chunk(InputPartition):
    def __init__(self, paths: list[str], folders: list[str]):
        self.paths, self.folders = paths, folders


class _Reader(DataSourceReader):
    """The driver walks the upper folders only; those below are walked by the tasks that read them."""

    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"])
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.content = options.get("content", "true") != "false"
        self.chunk = int(options.get("chunk", "500"))
        self.folders = int(options.get("folders", "256"))

    def partitions(self) -> list[InputPartition]:
        paths, below = walk(self.root, self.ignore, [""], self.folders)
        paths.sort()
        # not a partition a folder: a collection may have a folder for each note
        n = min(len(below), max(self.folders // 8, -(-len(below) // self.chunk)))
        return [_Chunk(paths[i : i + self.chunk], []) for i in range(0, len(paths), self.chunk)] + [_Chunk([], below[i::n]) for i in range(n)] or [_Chunk([], [])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        folder, base = None, ""
        for path in sorted([*partition.paths, *(walk(self.root, self.ignore, partition.folders)[0] if partition.folders else [])]):
            full = os.path.join(self.root, path)
            head, name = os.path.split(path)
            if head != folder:  # one look at the links on the way for all files of a folder
                folder, base = head, os.path.realpath(os.path.join(self.root, head))
            real = os.path.realpath(full) if os.path.islink(full) else os.path.join(base, name)
            escaped = real != self.root and not real.startswith(self.root.rstrip("/") + "/")
            try:
                stat = os.stat(full)
                mtime, size = stat.st_mtime_ns, stat.st_size
            except OSError:
                mtime = size = None
            data = None
            if self.content and not escaped:
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    pass
            yield (path, mtime, size, escaped, data)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """``FILES`` rows of a listing with their contents, read where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, size, begun = [], 0, 0
            for i, (path, escaped) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                content = None
                if not escaped:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read()
                    except OSError:
                        pass
                data.append(content)
                size += len(content or b"")
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(begun, len(data))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])
                    data, size, begun = [], 0, i + 1

    return listed.select("path", "mtime_ns", "size", "escaped").mapInArrow(run, FILES)


def read_files(spark: SparkSession, manifest: Manifest, content: bool = True) -> DataFrame:
    """The files, with their contents unless ``content`` is false. Contents are read by tasks of equal numbers of files, however
    these are spread over folders: paths are shuffled, contents aren't."""
    spark.dataSource.register(VaultSource)
    listed = spark.read.format("notes").option("root", str(manifest.root)).option("ignore", json.dumps(manifest.ignores)).option("content", "false").load()
    return read_contents(listed.repartition(parts_of(spark), "path"), str(manifest.root)) if content else listed
