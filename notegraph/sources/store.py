"""The materialised index: Parquet tables in versioned folders, and a pointer that is replaced at once.

Nodes, the issues of single files and postings are cut into buckets by a hash of the path, each a folder of the version that
wrote it last. A refresh rewrites only the buckets of files that changed; the pointer says where each bucket lies.
Files, edges and issues of the whole are written anew, as one change may turn any of them.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import time
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..errors import IndexStoreError, NotegraphError
from ..manifest import Manifest
from ..operators import index, search
from ..scan import ScanResult, assemble, nodes_of, scan
from ..schemas import FILES
from .vault import read_contents, read_files

SCHEMA_VERSION = "2"
BUCKETED, WHOLE = ("nodes", "file_issues", "postings"), ("files", "edges", "issues")
LOCK_WAIT_S = 5.0
FILES_PER_BUCKET = 20_000
#: What a damaged index, or one that can't be read or locked, raises.
CACHE_ERRORS = (OSError, NotegraphError, PySparkException, Py4JError)


def index_folder(manifest: Manifest, spark: SparkSession | None = None) -> Path:
    """Never inside the collection: the state folder of the user, by a hash of the root.

    On a cluster it has to be a folder that all machines have mounted, which only ``NOTEGRAPH_STATE_DIR`` can name.
    """
    named = os.environ.get("NOTEGRAPH_STATE_DIR")
    if not named and spark is not None and not spark.sparkContext.master.startswith("local"):
        raise IndexStoreError("set NOTEGRAPH_STATE_DIR to a folder that all machines share")
    base = named or os.path.join(os.environ.get("XDG_STATE_HOME") or os.path.expanduser("~/.local/state"), "notegraph")
    at = Path(base).resolve() / hashlib.sha256(str(manifest.root).encode()).hexdigest()[:16]
    if manifest.root in at.parents:
        raise IndexStoreError("the index must not lie inside the collection")
    return at


def meta_of(manifest: Manifest) -> dict[str, str]:
    return {"schema": SCHEMA_VERSION, "engine": __version__, "manifest": manifest.digest, "vaultId": manifest.vault_id}


@dataclass
class Index:
    manifest: Manifest
    folder: Path
    pointer: dict
    spark: SparkSession
    parsed: int = 0  # files that the last refresh parsed

    @property
    def version(self) -> int:
        return self.pointer["version"]

    def table(self, name: str) -> DataFrame:
        schema = T.StructType.fromJson(self.pointer["schemas"][name])
        at = [str(self.folder / p) for p in _places(self.pointer, name)]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def scan_result(self) -> ScanResult:
        return ScanResult(self.manifest, self.table("nodes"), self.table("edges"), self.table("issues"), self.table("files"))

    def search(self, query: str, limit: int = 20, as_of=None) -> DataFrame:
        nodes = self.table("nodes").join(self.table("files").select("path", "mtime_ns"), "path", "left")
        return search.search_indexed(nodes, self.table("postings"), query, limit, as_of, self.table("nodes").count(), self.manifest)

    def counts(self) -> DataFrame:
        return index.counts(self.table("nodes"), self.table("edges"), self.table("files"), self.table("postings"))

    def pending(self) -> dict[str, int]:
        listed = read_files(self.spark, self.manifest, content=False)
        rows = index.stat_diff(self.table("files"), listed).groupBy("change").count().collect()
        return {"changed": 0, "removed": 0} | {r["change"]: r["count"] for r in rows}


def _places(pointer: dict, name: str) -> list[str]:
    """The folders, relative to the index, that hold a table."""
    where = pointer["at"][name]
    return [f"v{v}/{name}/bucket={b}" for b, v in sorted(where.items())] if name in BUCKETED else [f"v{where}/{name}"]


def _damaged(folder: Path, pointer: dict) -> bool:
    """Whether a file of the index is missing, cut off, or no Parquet file any more."""
    try:
        for name, size in pointer["sizes"].items():
            with open(folder / name, "rb") as f:
                if f.seek(0, os.SEEK_END) != size or size < 12:
                    return True
                f.seek(-4, os.SEEK_END)
                if f.read() != b"PAR1":
                    return True
    except OSError:
        return True
    return False


def _pointer(folder: Path) -> dict | None:
    """The pointer, or null if it or what it points at isn't whole."""
    try:
        got = json.loads((folder / "current.json").read_text("utf-8"))
        if got["schema"] != SCHEMA_VERSION:
            return got  # another layout, which isn't looked into
        return None if set(got["at"]) != {*BUCKETED, *WHOLE} or not isinstance(got["version"], int) or _damaged(folder, got) else got
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None


@contextmanager
def _locked(folder: Path, wait: float = LOCK_WAIT_S):
    """One refresh at a time; the lock goes with the process that holds it."""
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "lock", "a") as f:
        end = time.monotonic() + wait
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() >= end:
                    raise IndexStoreError(f"another process has held the index for {wait:g} s") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def _publish(folder: Path, pointer: dict, before: dict | None) -> None:
    """The pointer in place, synced with its folder; what neither it nor the one before points at goes."""
    places = [p for t in (*BUCKETED, *WHOLE) for p in _places(pointer, t)]
    pointer["sizes"] = {str(f.relative_to(folder)): f.stat().st_size for p in places for f in (folder / p).glob("*.parquet")}
    beside = folder / "current.json.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(pointer, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, folder / "current.json")
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)
    used = {*places, *(p for t in (*BUCKETED, *WHOLE) for p in (_places(before, t) if before else []))}
    for old in folder.glob("v*"):
        tables = [f"{old.name}/{t.name}" for t in old.iterdir() if t.is_dir()]
        parts = [f"{t}/{b.name}" for t in tables if t.split("/")[1] in BUCKETED for b in (folder / t).glob("bucket=*")]
        gone = [t for t in tables if t not in used and not any(u.startswith(f"{t}/") for u in used)] + [p for p in parts if p not in used]
        for x in gone:
            shutil.rmtree(folder / x, ignore_errors=True)
        if len(gone) and not any((old / t.split("/")[1]).exists() for t in tables):
            shutil.rmtree(old, ignore_errors=True)


def _bucket(n: int):
    return F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")


def open_index(spark: SparkSession, manifest: Manifest, rebuild: bool = False, wait: float = LOCK_WAIT_S) -> Index:
    """The index brought up to date: only changed files are parsed, only their buckets rewritten; edges and issues are those
    of the whole.

    A missing, damaged or outdated index (schema, engine, manifest or vault id) is built anew.
    """
    folder = index_folder(manifest, spark)
    with _locked(folder, wait):
        now = _pointer(folder)
        version = max((int(p.name[1:]) for p in folder.glob("v*") if p.name[1:].isdigit()), default=0) + 1
        listed = read_files(spark, manifest, content=False).select("path", "mtime_ns", "size", "escaped")
        if rebuild or now is None or any(now.get(k) != v for k, v in meta_of(manifest).items()):
            return _build(spark, manifest, folder, version, listed, None)
        old = Index(manifest, folder, now, spark)
        touched = index.stat_diff(old.table("files"), listed).withColumn("bucket", _bucket(now["buckets"])).cache()
        try:
            buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # as many as there are buckets at most
            return _build(spark, manifest, folder, version, listed, (old, touched, buckets)) if buckets else old
        finally:
            touched.unpersist()


def _build(spark: SparkSession, manifest: Manifest, folder: Path, version: int, stats: DataFrame, before: tuple[Index, DataFrame, list[int]] | None) -> Index:
    fresh = stats if before is None else stats.join(before[1].where("change = 'changed'").select("path"), "path", "left_semi")
    nodes, file_issues = nodes_of(read_contents(fresh, str(manifest.root)), manifest)
    tables = {"nodes": nodes, "file_issues": file_issues, "postings": search.build_postings(nodes, manifest.zones, search.stop_words(manifest.search))}
    parsed = nodes.count()
    at: dict = {name: {} for name in BUCKETED} | {name: version for name in WHOLE}
    if before is None:
        n, touched_buckets = max(1, -(-stats.count() // FILES_PER_BUCKET)), None
    else:
        old, touched, touched_buckets = before
        n = old.pointer["buckets"]
        for name in BUCKETED:
            at[name] = {b: v for b, v in old.pointer["at"][name].items() if int(b) not in touched_buckets}
            known = [str(old.folder / p) for p in _places(old.pointer, name) if int(p.rpartition("=")[2]) in touched_buckets]
            if known:
                rows = spark.read.schema(T.StructType.fromJson(old.pointer["schemas"][name])).parquet(*known)
                tables[name] = index.upsert(rows, tables[name], touched)
    pointer = meta_of(manifest) | {"version": version, "buckets": n, "at": at, "schemas": {k: json.loads(df.schema.json()) for k, df in (tables | {"files": stats}).items()}}
    shutil.rmtree(folder / f"v{version}", ignore_errors=True)
    for name, df in tables.items():
        # postings are sorted by term, so that a prefix reads few row groups of a bucket
        rows = df.withColumn("bucket", _bucket(n)).repartition(n if touched_buckets is None else len(touched_buckets), "bucket")
        rows.sortWithinPartitions("bucket", *(("term", "path", "zone") if name == "postings" else ("path",))).write.partitionBy("bucket").parquet(str(folder / f"v{version}" / name))
        at[name] |= {p.name.rpartition("=")[2]: version for p in (folder / f"v{version}" / name).glob("bucket=*")}
    stats.write.parquet(str(folder / f"v{version}" / "files"))
    new = Index(manifest, folder, pointer, spark, parsed)
    whole = assemble(manifest, new.table("nodes"), new.table("file_issues"))
    for name in ("edges", "issues"):
        df = getattr(whole, name)
        pointer["schemas"][name] = json.loads(df.schema.json())
        df.write.parquet(str(folder / f"v{version}" / name))
    _publish(folder, pointer, before[0].pointer if before else None)
    return new


def open_or_scan(spark: SparkSession, manifest: Manifest, use_index: bool = True) -> tuple[Index | None, ScanResult]:
    """The index, or a full scan if it can't be used; the caller sees which by the first value."""
    if use_index:
        try:
            got = open_index(spark, manifest)
            return got, got.scan_result()
        except CACHE_ERRORS:
            pass
    return None, scan(spark, manifest)


def index_status(spark: SparkSession, manifest: Manifest) -> dict:
    folder = index_folder(manifest, spark)
    now = _pointer(folder)
    if now is None or now["schema"] != SCHEMA_VERSION:
        return {"exists": False, "path": str(folder)}
    at = Index(manifest, folder, now, spark)
    current = all(now.get(k) == v for k, v in meta_of(manifest).items())
    return {"exists": True, "path": str(folder), "current": current, "meta": {k: now[k] for k in (*meta_of(manifest), "version")}, "counts": at.counts().first().asDict(), "pending": at.pending()}
