"""Exact filter queries over nodes."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.canonical import loose
from ..functions.globs import matches_any
from . import graph
from .parse import prop


def unique(values: list[str] | tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(values))


def check_glob(glob: str) -> str:
    parts = glob.split("/")
    if not glob or glob.startswith("/") or "\\" in glob or any(p in ("", ".", "..") for p in parts):
        raise QueryError(f"path pattern {glob!r} must be relative and normalised")
    return glob


def _has(name: str) -> Column:
    return F.exists("props", lambda p: p["name"] == name)


def query_nodes(
    nodes: DataFrame,
    edges: DataFrame | None = None,
    *,
    paths: list[str] = (),
    kinds: list[str] = (),
    tags: list[str] = (),
    has_fields: list[str] = (),
    properties: list[tuple[str, Any]] = (),
    without_incoming: bool = False,
    limit: int | None = None,
    declared_kinds: list[str] | None = None,
) -> DataFrame:
    """Nodes by id that match any path, any kind, all tags, all fields and all properties.

    Values compare as in Python: true, 1 and 1.0 are equal, lists by order; a missing property isn't null.
    """
    if limit is not None and limit <= 0:
        raise QueryError("limit must be positive")
    names = [k for k, _ in properties]
    if len(set(names)) < len(names):
        raise QueryError("a property may be filtered once")
    unknown = [k for k in kinds if declared_kinds is not None and k not in declared_kinds]
    if unknown:
        raise QueryError(f"unknown kind {unknown[0]!r}")
    wanted_tags = unique([t.strip().lstrip("#") for t in tags])
    if "" in wanted_tags or "" in [f.strip() for f in has_fields]:
        raise QueryError("empty tags and fields can't be filtered")
    tests = []
    if kinds:
        tests.append(F.col("kind").isin(unique(kinds)))
    if paths:
        tests.append(matches_any(F.col("path"), [check_glob(p) for p in unique(paths)]))
    if wanted_tags:
        tests.append(F.size(F.array_except(F.lit(wanted_tags), "tags")) == 0)
    tests += [_has(f) for f in unique(has_fields)]
    tests += [F.coalesce(prop(k, "value_loose") == loose(v), F.lit(False)) for k, v in properties]
    rows = nodes.where(reduce(lambda a, b: a & b, tests)) if tests else nodes
    if without_incoming:
        rows = graph.without_incoming(rows, edges)
    rows = rows.orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def read_node(nodes: DataFrame, target: str) -> DataFrame:
    """The node of an id or path; an unknown one is an error."""
    row = nodes.where(F.col("id") == target.strip().removesuffix(".md"))
    if not row.take(1):
        raise QueryError(f"no note {target!r}")
    return row
