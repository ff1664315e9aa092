"""Scanning a collection into nodes, edges and issues, with prospective contents laid over it."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MutationError
from .functions.canonical import digest
from .functions.globs import path_matches
from .manifest import Manifest, load_manifest
from .operators import validate
from .operators.parse import parse_files
from .schemas import FILES
from .session import stored
from .sources.vault import read_files

NODE_COLUMNS = ["id", "path", "kind", "title", "stem", "properties_json", "properties_text", "tags", "headings", "source_hash", "body", "props", "wikilinks", "markdown_links"]


class ScanResult:
    """Lazy tables of one scan. ``nodes`` has the columns of ``NODE_COLUMNS``. ``edges`` and ``issues`` are given as tables or as
    functions, which make them when they're first asked for; ``note_issues`` are those that a note has by itself."""

    def __init__(self, manifest: Manifest, nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame], issues: DataFrame | Callable[[], DataFrame], files: DataFrame | None = None, note_issues: DataFrame | None = None):
        self.manifest, self.nodes, self.files, self.note_issues = manifest, nodes, files, note_issues
        self._edges, self._issues = edges, issues

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges() if callable(self._edges) else self._edges

    @cached_property
    def issues(self) -> DataFrame:
        return self._issues() if callable(self._issues) else self._issues

    def summary(self) -> DataFrame:
        return validate.summary(self.nodes, self.edges, self.issues)

    def ordered_issues(self) -> DataFrame:
        return validate.ordered_issues(self.issues)


def overlay(files: DataFrame, updates: dict[str, bytes], creates: dict[str, bytes]) -> DataFrame:
    """``files`` with some contents replaced and some paths added."""
    rows = [(p, None, len(b), False, bytearray(b)) for p, b in {**updates, **creates}.items()]
    if not rows:
        return files
    new = files.sparkSession.createDataFrame(rows, FILES)
    return files.join(F.broadcast(new.select("path")), "path", "left_anti").unionByName(new)


def check_overlays(manifest: Manifest, updates: dict[str, bytes], creates: dict[str, bytes]) -> None:
    both = set(updates) & set(creates)
    if both:
        raise MutationError(f"{min(both)} is both created and updated")
    for path in creates:
        check_note_path(manifest, path)
        at = manifest.root / path
        if at.exists() or at.is_symlink():
            raise MutationError(f"{path} exists already")
    for path in updates:
        check_note_path(manifest, path)
        if not (manifest.root / path).is_file():
            raise MutationError(f"{path} isn't a note of the collection")


def check_note_path(manifest: Manifest, path: str) -> None:
    """Relative, normalised, a note that isn't ignored, and no symbolic link on the way."""
    if not path.endswith(".md") or path.startswith("/") or "\\" in path or os.path.normpath(path) != path or path.startswith(".."):
        raise MutationError(f"{path!r} must be a normalised relative path of a note")
    if any(path_matches(path, g) for g in manifest.ignores):
        raise MutationError(f"{path} is ignored")
    at = manifest.root
    for part in Path(path).parts:
        at = at / part
        if at.is_symlink():
            raise MutationError(f"{path} leads through a symbolic link")


def nodes_of(files: DataFrame, manifest: Manifest) -> tuple[DataFrame, DataFrame]:
    """Classified nodes (stored, as parsing is Python work) and the issues of single files; ``files`` is read once, and not later on."""
    parsed = stored(parse_files(files, manifest.legacy_colons), "parsed")
    classified = validate.classify(parsed.where("error is null and not escaped"), manifest)
    escaped = parsed.where("escaped").select(validate.issue("error", "path.escape", "file lies outside of the collection").alias("i"))
    broken = parsed.where("error is not null").select(validate.issue("error", "markdown.parse", F.col("error")).alias("i"))
    kinds = classified.select(F.explode("found_issues").alias("i"))
    return classified.select(*NODE_COLUMNS), escaped.unionByName(broken).unionByName(kinds).select("i.*")


def assemble(manifest: Manifest, nodes: DataFrame, issues: DataFrame, files: DataFrame | None = None) -> ScanResult:
    own = issues.unionByName(validate.note_issues(nodes, manifest))
    # links are checked on the stored edges, not on the joins that found them
    result = ScanResult(manifest, nodes, lambda: stored(validate.edges_of(nodes, manifest), "edges"), lambda: own.unionByName(validate.edge_issues(nodes, result.edges, manifest)), files, own)
    return result


def scan(spark: SparkSession, root: str | Path | Manifest, updates: dict[str, bytes] | None = None, creates: dict[str, bytes] | None = None) -> ScanResult:
    manifest = root if isinstance(root, Manifest) else load_manifest(root)
    updates, creates = updates or {}, creates or {}
    check_overlays(manifest, updates, creates)
    files = overlay(read_files(spark, manifest), updates, creates)
    nodes, issues = nodes_of(files, manifest)
    return assemble(manifest, nodes, issues, files)


def vault_digest(result: ScanResult) -> str:
    """A digest of the nodes' hashes, the edges and the issues, whatever order they were found in.

    Rows are hashed where they are; per table only sums over their hashes and the count reach the driver.
    """

    def of(df: DataFrame, *columns: str) -> list:
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(5)]
        return list(df.agg(F.count(F.lit(1)).alias("n"), *parts).first())

    return digest([result.manifest.vault_id, result.manifest.digest, of(result.nodes, "path", "source_hash"), of(result.edges, "source", "relation", "target", "provenance", "source_location", "resolved"), of(result.issues, "level", "code", "message", "path")])
