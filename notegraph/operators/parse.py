"""From file contents to nodes: frontmatter in Python, all else as JVM expressions."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from ..errors import ParseError
from ..functions import text as X
from ..functions import yaml12
from ..functions.canonical import canonical, json_type, loose, text_hash
from ..functions.targets import clean_target, relative_target
from ..schemas import LINKS, PROP

_PARSED = f"path string, source_hash string, body string, properties_json string, properties_text string, fm_tags array<string>, props array<struct<{PROP.replace(' string', ':string')}>>, error string, escaped boolean"


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """The frontmatter between a first line ``---`` and the next ``---`` or ``...``, and the body after it."""
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].strip() != "---":
        return None, text
    for i, line in enumerate(lines[1:], 1):
        if line.strip() in ("---", "..."):
            return "".join(lines[1:i]), "".join(lines[i + 1 :])
    raise ParseError("frontmatter is not closed")


def parse_bytes(data: bytes, legacy_colons: bool = False) -> tuple[dict[str, Any], str]:
    """Properties and body of a note."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseError(f"not UTF-8: {e.reason} at byte {e.start}") from None
    head, body = split_frontmatter(text)
    if head is None:
        return {}, body
    try:
        return yaml12.load_mapping(head), body
    except ParseError:
        if not legacy_colons:
            raise
        return yaml12.load_mapping(yaml12.quote_colons(head)), body


def plain_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def props_of(properties: dict[str, Any]) -> list[dict[str, str]]:
    return [{"name": k, "json_type": json_type(v), "value_json": canonical(v), "value_loose": loose(v), "value_text": plain_text(v)} for k, v in sorted(properties.items())]


def _tags(properties: dict[str, Any]) -> list[str]:
    value = properties.get("tags")
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def parse_files(files: DataFrame, legacy_colons: bool = False) -> DataFrame:
    """One row per file: the columns of a node but for its kind, props, link texts, the error if it can't be parsed, and whether
    it lies outside (``escaped``, if ``files`` tells), when it isn't parsed. Contents are read once: the hash is taken where they're parsed."""

    schema = to_arrow_schema(DataType.fromDDL(_PARSED))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data, escaped in zip(*(b.column(i).to_pylist() for i in range(3))):
                if escaped:
                    rows.append((path, *[None] * 7, True))
                    continue
                source_hash = None if data is None else text_hash(data)
                try:
                    if data is None:
                        raise ParseError("file can't be read")
                    properties, body = parse_bytes(data, legacy_colons)
                    rows.append((path, source_hash, body, canonical(properties), json.dumps(properties, ensure_ascii=False), _tags(properties), props_of(properties), None, False))
                except ParseError as e:
                    rows.append((path, source_hash, None, None, None, None, None, str(e), False))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    outside = "escaped" if "escaped" in files.columns else F.lit(False)
    return _shaped(files.select("path", "content", outside).mapInArrow(parse, _PARSED))


def _shaped(parsed: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md\z", "")
    rows = parsed.withColumn("id", F.regexp_replace("path", r"\.md\z", "")).withColumn("stem", stem).withColumn("mask", X.masked(F.col("body")))
    return rows.select(
        "id", "path", X.title(F.col("body"), F.col("stem")).alias("title"), "stem", "properties_json", "properties_text", X.all_tags(F.col("fm_tags"), F.col("mask")).alias("tags"), X.headings(F.col("body")).alias("headings"), "source_hash", "body", "props",
        X.wikilinks(F.col("mask")).alias("wikilinks"), X.markdown_links(F.col("mask")).alias("markdown_links"), "error", "escaped",
    )


def with_props(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the array ``props`` made of ``properties_json``; null or broken JSON gives no properties."""
    columns = nodes.columns

    @F.pandas_udf(f"array<struct<{PROP.replace(' string', ':string')}>>")
    def expand(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> list[dict[str, str]]:
            try:
                got = json.loads(v) if v else {}
            except ValueError:
                got = {}
            return props_of(got) if isinstance(got, dict) else []

        return values.map(one)

    return nodes.select(*columns, expand("properties_json").alias("props"))


def prop(name: str, part: str = "value_json") -> Column:
    """A part of the property ``name``, null if the node lacks it."""
    return F.get(F.filter("props", lambda p: p["name"] == name), F.lit(0))[part]


def clean_links(raw: DataFrame) -> DataFrame:
    """``LINKS`` of rows (id, pos, raw, syntax) whose target lies within the collection."""

    schema = to_arrow_schema(DataType.fromDDL(LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, pos, text, syntax in zip(*(c.to_pylist() for c in b.columns)):
                got = clean_target(text, syntax)
                if got is None:
                    continue
                relative = relative_target(id_, got[0])
                if got[1] == "markdown" and relative is None:
                    continue
                rows.append((id_, pos, text, got[1], posixpath.normpath(got[0]), relative, got[2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return raw.select("id", "pos", "raw", "syntax").mapInArrow(run, LINKS)


def body_links(parsed: DataFrame) -> DataFrame:
    """id, pos, raw, syntax of the links in bodies: all wikilinks first, then all Markdown links."""
    wiki = F.transform("wikilinks", lambda x: F.struct(x.alias("raw"), F.lit("wikilink").alias("syntax")))
    markdown = F.transform("markdown_links", lambda x: F.struct(x.alias("raw"), F.lit("markdown").alias("syntax")))
    return parsed.select("id", F.posexplode(F.concat(wiki, markdown)).alias("pos", "l")).select("id", "pos", "l.raw", "l.syntax")
