"""Queries over collections of note files, made of the given tables, and the SQL that checks them.

Each query writes its notes as files into the shared folder (tasks write them, none passes through the driver) and then
uses the engine as a caller does: load the manifest, list, parse, classify, resolve, validate, index, write.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import text_hash
from ..manifest import Manifest, load_manifest
from ..operators import graph, merge, mutate, search
from ..operators.current import latest
from ..scan import ScanResult, scan
from ..session import Stored, parts_of, read_table, shared_dir, shuffles_dropped
from ..sources import store
from ..sources.vault import read_files

T = read_table
RELATIONS = {
    "parent": {"field": "parent", "cardinality": "0..1", "targetKinds": ["document", "task", "meeting", "decision", "glossary"], "acyclic": True},
    "children": {"field": "children", "cardinality": "0..*", "targetKinds": ["document", "task", "meeting", "decision", "glossary"]},
    "related": {"field": "related", "cardinality": "0..*", "targetKinds": ["document", "task"]},
    "depends_on": {"field": "depends_on", "cardinality": "0..*", "targetKinds": ["document", "task", "meeting", "decision", "glossary"], "acyclic": True},
    "supersedes": {"field": "supersedes", "cardinality": "0..1", "targetKinds": ["decision", "document"], "acyclic": True},
    "ranked": {"field": "priority", "cardinality": "0..1", "targetKinds": ["task"]},
}
KINDS = {
    "task": {"selectors": [{"hasField": "priority"}], "fields": {"owner": {"type": "string", "required": True}, "priority": {"type": "number"}}},
    "decision": {"selectors": [{"path": "notes/archive/**"}]},
    "meeting": {"selectors": [{"type": "meeting"}, {"path": "notes/meetings/*.md"}]},
}
BODY_ZONE = [{"source": "body", "weight": 1, "phraseWeight": 8, "countCap": 6}]


def write_vault(spark: SparkSession, notes: DataFrame, manifest: dict) -> Manifest:
    """``notes`` (path, content) as files of a new collection in the shared folder, which must be a mounted one."""
    root = Path(shared_dir(spark).removeprefix("file://")) / f"vault-{uuid.uuid4().hex}" / "notes-root"
    (root / ".notegraph").mkdir(parents=True)
    full = {"$schema": "local", "apiVersion": "notegraph/v1", "vaultId": "given-tables", "defaultKind": "document", "nodeKinds": {"document": {"selectors": [{"type": "document"}]}}} | manifest
    (root / ".notegraph" / "manifest.json").write_text(json.dumps(full))
    at = str(root)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                folder = os.path.dirname(os.path.join(at, path))
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                beside = os.path.join(at, f"{path}.{uuid.uuid4().hex}.tmp")
                with open(beside, "wb") as out:
                    out.write(bytes(content))
                os.replace(beside, os.path.join(at, path))
            yield pd.DataFrame({"n": [len(f)]})

    with shuffles_dropped(spark):
        notes.select("path", "content").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return load_manifest(root)


# -- notes made of nodes and edges ---------------------------------------------------------------


def node_notes(s: SparkSession, d: str, body: bool) -> DataFrame:
    """path, content of each current node: its properties as frontmatter, and its own body or, instead, its edges.

    Edges of the frontmatter stand in the property of their relation, as wikilink, Markdown link or plain id, whatever
    their provenance says; other edges stand in the body.
    """
    shown = ("id", "properties_json", "body") if body else ("id", "properties_json")
    nodes = latest(T(s, d, "nodes"), "path", "indexed_at", "source_hash", *shown).where("id is not null")
    e = T(s, d, "edges").where("src is not null and dst is not null").select("src", "dst", "field", "provenance").distinct()
    how = F.element_at(F.split("provenance", ":"), -1)
    written = F.when(how == "wikilink", F.concat(F.lit("[["), F.col("dst"), F.lit("|seen from here]]"))).when(how == "markdown", F.concat(F.lit("[a note]("), F.col("dst"), F.lit(".md#top)"))).otherwise(F.col("dst"))
    lists = e.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.when(F.col("provenance").startswith("frontmatter"), F.col("field")), F.lit("")).alias("field"), written.alias("text")))).alias("links"))
    if body:
        rows = nodes.withColumn("links", F.lit(None).cast("array<struct<field:string,text:string>>"))
    else:
        rows = nodes.join(lists, nodes["id"] == lists["src"], "left").withColumn("body", F.lit(None).cast("string")).repartition(parts_of(s), "path")

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for given, own, links in zip(f["properties_json"], f["body"], f["links"]):
                properties = json.loads(given) if given else {}
                text = (own or "") if body else ""
                for x in links if links is not None else ():
                    if x["field"]:
                        properties.setdefault(x["field"], []).append(x["text"])
                    else:
                        text += f"- {x['text']}\n"
                for name, spec in RELATIONS.items() if not body else ():
                    value = properties.get(spec["field"])
                    if spec["cardinality"] == "0..1" and isinstance(value, list) and len(value) == 1:
                        properties[spec["field"]] = value[0]
                out.append(mutate.render(None, properties, text))
            yield pd.DataFrame({"path": f["path"], "content": pd.Series(out, dtype=object)})

    return rows.select("path", "properties_json", "body", "links").mapInPandas(render, "path string, content binary")


def scanned(s: SparkSession, manifest: Manifest) -> ScanResult:
    """A scan of a collection that was made for it alone: the scan keeps what it read, so the files go."""
    result = scan(s, manifest)
    shutil.rmtree(manifest.root.parent)
    return result


def node_scan(s: SparkSession, d: str) -> ScanResult:
    return scanned(s, write_vault(s, node_notes(s, d, True), {"nodeKinds": KINDS | {"document": {"selectors": [{"tag": "no such tag"}]}}}))


def edge_scan(s: SparkSession, d: str) -> ScanResult:
    kinds = {"task": {"selectors": [{"path": "tickets/**"}]}, "decision": {"selectors": [{"path": "notes/archive/**"}]}, "meeting": {"selectors": [{"path": "notes/meetings/*.md"}]}, "glossary": {"selectors": [{"path": "notes/reference/**"}]}, "document": {"selectors": [{"tag": "no such tag"}]}}
    return scanned(s, write_vault(s, node_notes(s, d, False), {"nodeKinds": kinds, "relations": RELATIONS}))


def scan_nodes(s: SparkSession, d: str) -> DataFrame:
    n = node_scan(s, d).nodes
    return n.select("id", "path", "kind", "title", "stem", F.array_join("headings", "|").alias("headings"), F.array_join("tags", "|").alias("tags"), "properties_json", F.sha2("body", 256).alias("body_hash"))


def scan_field_issues(s: SparkSession, d: str) -> DataFrame:
    return node_scan(s, d).note_issues.where("code like 'field.%' or code like 'node.%'").select("level", "code", "path")


def scan_edges(s: SparkSession, d: str) -> DataFrame:
    return edge_scan(s, d).edges.where("relation <> 'ranked'").select("source", "relation", "target", "provenance", "source_location", "resolved")


def scan_positions(s: SparkSession, d: str) -> DataFrame:
    e = edge_scan(s, d).edges
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.sort_array(F.collect_list(F.struct("position", "relation")))[0]["relation"].alias("first_relation"))


def scan_issues(s: SparkSession, d: str) -> DataFrame:
    return edge_scan(s, d).issues.where("code <> 'relation.cycle'").select("level", "code", "message", "path")


def scan_cycles(s: SparkSession, d: str) -> DataFrame:
    return edge_scan(s, d).issues.where("code = 'relation.cycle'").select(F.regexp_extract("message", "'([^']*)'", 1).alias("relation"), "path")


def scan_summary(s: SparkSession, d: str) -> DataFrame:
    return edge_scan(s, d).summary().select("nodes", "edges", "warnings", "valid")


def incoming_edges(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "edges").where("src is not null and dst is not null").select(F.col("src").alias("source"), F.coalesce("field", F.lit("link")).alias("relation"), F.col("dst").alias("target"), "provenance").distinct()
    return graph.incoming(e)


# -- notes made of documents ---------------------------------------------------------------------

BROKEN = "---\nopen: [1\n"
IGNORED = ["documents/meetings/**", "documents/*/1000*.md"]


def document_notes(s: SparkSession, d: str) -> DataFrame:
    """path, content of each document, as it stands; a document without a language label begins with broken frontmatter."""
    t = T(s, d, "documents").where("text is not null")
    path = F.concat(F.lit("documents/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.select(path.alias("path"), F.encode(F.concat(F.when(F.col("lang").isNull(), F.lit(BROKEN)).otherwise(F.lit("")), F.col("text")), "utf-8").alias("content"))


def document_vault(s: SparkSession, d: str, **more) -> Manifest:
    return write_vault(s, document_notes(s, d), {"ignore": IGNORED, "search": {"zones": BODY_ZONE}} | more)


def _escaping(manifest: Manifest) -> None:
    """A note that is a link to a file outside, a link to one inside, a folder named like a note, and one in a dot-folder."""
    outside = manifest.root.parent / "outside.md"
    outside.write_text("outside")
    (manifest.root / "escaped.md").symlink_to(outside)
    (manifest.root / "folder.md").mkdir()
    (manifest.root / ".hidden").mkdir()
    (manifest.root / ".hidden" / "dot.md").write_text("# Dot\n")
    (manifest.root / "inside.md").symlink_to(manifest.root / ".hidden" / "dot.md")


def vault_listing(s: SparkSession, d: str) -> DataFrame:
    manifest = document_vault(s, d)
    _escaping(manifest)
    listed = read_files(s, manifest, content=False)
    return listed.select("path", F.when(F.col("path") != "folder.md", F.when(~F.col("escaped"), F.col("size"))).alias("size"), "escaped")


def vault_hashes(s: SparkSession, d: str) -> DataFrame:
    manifest = document_vault(s, d)
    _escaping(manifest)
    return scan(s, manifest).nodes.select("id", "source_hash")


def vault_file_issues(s: SparkSession, d: str) -> DataFrame:
    manifest = document_vault(s, d)
    _escaping(manifest)
    got = scan(s, manifest)
    order = F.row_number().over(Window.orderBy(F.coalesce("path", F.lit("")), "level", "code", "message"))
    return got.issues.where("code in ('path.escape', 'markdown.parse')").select("path", "level", "code", order.cast("int").alias("place"))


def _first_paths(s: SparkSession, d: str, n: int) -> list[str]:
    """The ``n`` smallest paths of notes without frontmatter."""
    rows = document_notes(s, d).where(~F.col("content").cast("string").startswith("---")).where("path not like 'documents/meetings/%' and path not like 'documents/%/1000%'")
    return [r.path for r in rows.select("path").orderBy("path").limit(n).collect()]


def _indexed(s: SparkSession, d: str, use: Callable[[Manifest, list[str]], DataFrame]) -> DataFrame:
    """Runs ``use`` with an index folder beside the notes."""
    manifest = document_vault(s, d)
    before = os.environ.get("NOTEGRAPH_STATE_DIR")
    os.environ["NOTEGRAPH_STATE_DIR"] = str(manifest.root.parent / "state")
    try:
        return use(manifest, _first_paths(s, d, 3))
    finally:
        os.environ.pop("NOTEGRAPH_STATE_DIR") if before is None else os.environ.update(NOTEGRAPH_STATE_DIR=before)


def _edited(s: SparkSession, manifest: Manifest, paths: list[str]) -> store.Index:
    """An index, then one note changed, one removed and one new, and the index brought up to date."""
    store.open_index(s, manifest)
    (manifest.root / paths[0]).write_text("# Changed\n\nedited words stand here\n")
    (manifest.root / paths[1]).unlink()
    (manifest.root / "fresh.md").write_text("# Fresh\n\nnew words stand here\n")
    return store.open_index(s, manifest)


def index_nodes(s: SparkSession, d: str) -> DataFrame:
    def use(manifest: Manifest, paths: list[str]) -> DataFrame:
        got = _edited(s, manifest, paths)
        return Stored(got.table("nodes").select("id", "title", "source_hash", F.lit(got.parsed).cast("bigint").alias("parsed")), "shown").df

    return _indexed(s, d, use)


def index_postings(s: SparkSession, d: str) -> DataFrame:
    def use(manifest: Manifest, paths: list[str]) -> DataFrame:
        got = _edited(s, manifest, paths)
        return Stored(got.table("postings").where(~F.col("term").startswith(search.STEM_PREFIX)).select("term", "path", "zone", "count"), "shown").df

    return _indexed(s, d, use)


def index_state_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts and pending changes of an index that lags behind by one edit."""

    def use(manifest: Manifest, paths: list[str]) -> DataFrame:
        store.open_index(s, manifest)
        (manifest.root / paths[0]).write_text("# Changed\n\nedited words stand here\n")
        got = store.index_status(s, manifest)
        return s.createDataFrame([(got["exists"], got["current"], got["counts"]["files"], got["counts"]["nodes"], got["pending"]["changed"], got["pending"]["removed"])], "present boolean, current boolean, files bigint, nodes bigint, changed bigint, removed bigint")

    return _indexed(s, d, use)


def index_recovery(s: SparkSession, d: str) -> DataFrame:
    """What is read after the index was damaged in three ways: its nodes, its pointer, its edges while it can't be rebuilt."""

    def use(manifest: Manifest, paths: list[str]) -> DataFrame:
        first = store.open_index(s, manifest)
        shown = []

        def seen(how: str) -> None:
            found, result = store.open_or_scan(s, manifest)
            shown.append(Stored(result.nodes.select("id", "source_hash", F.lit(how).alias("damage"), F.lit(found is not None).alias("indexed")), "shown").df)

        for part in (first.folder / f"v{first.version}" / "nodes").glob("bucket=*/*.parquet"):
            part.write_bytes(b"damaged")
        for crc in (first.folder / f"v{first.version}" / "nodes").glob("bucket=*/.*.crc"):
            crc.unlink()
        seen("table")
        (first.folder / "current.json").write_text("{")
        seen("pointer")
        shutil.rmtree(first.folder)
        first.folder.write_text("a file where the folder should be")
        seen("folder")
        return shown[0].unionByName(shown[1]).unionByName(shown[2])

    return _indexed(s, d, use)


def node_mutations(s: SparkSession, d: str) -> DataFrame:
    """A note updated and one created by plan and apply; then what the plans, receipts and files say."""
    manifest = document_vault(s, d, capabilities=["node-mutation-apply"], ignore=[*IGNORED, "documents/tickets/**"])
    path = next(p for p in _first_paths(s, d, 1000) if not p.startswith("documents/tickets/"))
    before = text_hash((manifest.root / path).read_bytes())
    requests = [
        {"schemaVersion": mutate.REQUEST_SCHEMA, "operation": "update", "path": path, "kind": "document", "expectedSourceHash": before, "changes": {"setProperties": {"status": "done", "n": 3}, "body": "# New\n"}},
        {"schemaVersion": mutate.REQUEST_SCHEMA, "operation": "create", "path": "documents/made.md", "kind": "task", "document": {"properties": {}, "body": "made"}},
    ]
    rows = []
    for r in requests:
        plan = mutate.plan_node_mutation(s, manifest, r)
        # broken notes make the collection invalid, so the plan is; the write is then refused
        try:
            state = mutate.apply_node_mutation_plan(s, manifest, plan)["state"]
        except mutate.MutationError as e:
            state = str(e)
        codes = sorted(i["code"] for i in plan["issues"] if i.get("path") == r["path"])
        rows.append((r["path"], plan["candidate"]["content"], plan["candidate"]["sourceHash"], plan["precondition"].get("sourceHash"), plan["summary"]["nodes"], plan["valid"], ",".join(codes), state, plan["diff"].count("\n+") - 1))
    return s.createDataFrame(rows, "path string, content string, source_hash string, before string, nodes bigint, valid boolean, issues string, state string, added int")


def applied_mutation(s: SparkSession, d: str) -> DataFrame:
    """An update applied to a valid collection, the notes without broken frontmatter: hashes of all notes afterwards, with the receipt's state."""
    notes = document_notes(s, d).where(~F.col("content").cast("string").startswith(BROKEN))
    manifest = write_vault(s, notes, {"ignore": IGNORED, "capabilities": ["node-mutation-apply"]})
    path = _first_paths(s, d, 1)[0]
    request = {"schemaVersion": mutate.REQUEST_SCHEMA, "operation": "update", "path": path, "kind": "document", "expectedSourceHash": text_hash((manifest.root / path).read_bytes()), "changes": {"body": "applied"}}
    receipt = mutate.apply_node_mutation_plan(s, manifest, mutate.plan_node_mutation(s, manifest, request))
    got = scan(s, manifest).nodes
    return Stored(got.select("id", "source_hash", F.when(F.col("path") == receipt["path"], receipt["state"]).alias("state")), "shown").df


def merged_note(s: SparkSession, d: str) -> DataFrame:
    """A merge planned, validated and applied to a note: hashes of all notes afterwards, with the receipt's state."""
    notes = document_notes(s, d).where(~F.col("content").cast("string").startswith(BROKEN))
    manifest = write_vault(s, notes, {"ignore": IGNORED, "capabilities": ["semantic-merge-apply"], "merge": {"fields": {"tags": {"strategy": "set"}}}})
    path = _first_paths(s, d, 1)[0]
    at = manifest.root / path
    sides = {"base": b"---\ntags: [a, b]\nx: 1\n---\nbody", "ours": b"---\ntags: [a, b, c]\nx: 1\n---\nbody", "theirs": b"---\ntags: [b, d]\nx: 2\n---\nnew body"}
    at.write_bytes(sides["ours"])
    plan = merge.plan_merge(s, manifest, path, sides, {k: c * 40 for k, c in zip(merge.SIDES, "abc")})
    receipt = mutate.apply_merge_plan(s, manifest, plan)
    got = scan(s, manifest).nodes
    return Stored(got.select("id", "source_hash", F.when(F.col("path") == receipt["path"], F.concat_ws(" ", F.lit(plan["state"]), F.lit(receipt["state"]))).alias("state"), F.when(F.col("path") == receipt["path"], F.col("properties_json")).alias("properties")), "shown").df


def queries() -> dict:
    return {
        "scan_nodes": scan_nodes, "scan_field_issues": scan_field_issues, "scan_edges": scan_edges, "scan_positions": scan_positions, "scan_issues": scan_issues, "scan_cycles": scan_cycles, "scan_summary": scan_summary, "incoming_edges": incoming_edges,
        "vault_listing": vault_listing, "vault_hashes": vault_hashes, "vault_file_issues": vault_file_issues, "index_nodes": index_nodes, "index_postings": index_postings, "index_state_counts": index_state_counts, "index_recovery": index_recovery,
        "node_mutations": node_mutations, "applied_mutation": applied_mutation, "merged_note": merged_note,
    }


# -- SQL -----------------------------------------------------------------------------------------

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, source_hash DESC) AS rn FROM nodes) WHERE rn = 1 AND path IS NOT NULL AND id IS NOT NULL)"
_BLANK = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}]"
_MASKED = "regexp_replace(regexp_replace(regexp_replace(b, '(?ms)^ {0,3}(?:```|~~~).*?^ {0,3}(?:```|~~~)[ \\t]*$', '', 'g'), '`+[^`\\n]*`+', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TYPE = "json_type(properties_json, '$.priority')"
# an edge as it was written into a note, and where it leads
_WRITTEN = f"""{_CURRENT}, w AS (SELECT src, dst, CASE WHEN starts_with(provenance, 'frontmatter') THEN field ELSE 'link' END AS relation, string_split(provenance, ':')[-1] AS how FROM (SELECT DISTINCT src, dst, field, provenance FROM edges WHERE src IN (SELECT id FROM cur) AND dst IS NOT NULL)),
ids AS (SELECT id FROM cur), names AS (SELECT string_split(id, '/')[-1] AS name, min(id) AS target FROM ids GROUP BY 1 HAVING count(*) = 1),
counted AS (SELECT *, count(*) OVER (PARTITION BY src, relation) AS n FROM w),
live AS (SELECT * FROM counted WHERE NOT (relation IN ('parent', 'supersedes') AND n > 1)),
near AS (SELECT *, CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') || '/' || dst ELSE dst END AS nearby, string_split(dst, '/')[-1] AS name FROM live),
e AS (SELECT near.src AS source, relation, coalesce(CASE WHEN dst IN (SELECT id FROM ids) THEN dst WHEN nearby IN (SELECT id FROM ids) THEN nearby END, names.target, dst) AS target,
    CASE WHEN relation = 'link' THEN how ELSE 'frontmatter:' || relation || ':' || how END AS provenance, CASE WHEN relation <> 'link' THEN 'frontmatter.' || relation END AS source_location,
    dst IN (SELECT id FROM ids) OR nearby IN (SELECT id FROM ids) OR names.target IS NOT NULL AS resolved FROM near LEFT JOIN names USING (name)),
p AS (SELECT id, path, {_TYPE} AS kind_of, json_extract_string(properties_json, '$.priority') AS value FROM cur),
ranked AS (SELECT p.id AS source, 'ranked' AS relation, coalesce(names.target, value) AS target, names.target IS NOT NULL AS resolved FROM p LEFT JOIN names ON names.name = value WHERE kind_of = 'VARCHAR'),
kinds AS (SELECT id, path, CASE WHEN starts_with(path, 'tickets/') THEN 'task' WHEN starts_with(path, 'notes/archive/') THEN 'decision' WHEN regexp_full_match(path, 'notes/meetings/[^/]*\\.md') THEN 'meeting' WHEN starts_with(path, 'notes/reference/') THEN 'glossary' ELSE 'document' END AS kind FROM cur)"""
_ISSUES = """unresolved AS (SELECT CASE WHEN relation = 'link' THEN 'warning' ELSE 'error' END AS level, CASE WHEN relation = 'link' THEN 'link.unresolved' ELSE 'relation.unresolved' END AS code,
    CASE WHEN relation = 'link' THEN 'link target ''' || target || ''' doesn''t exist' ELSE 'relation ''' || relation || ''' has no target ''' || target || '''' END AS message, path
    FROM (SELECT source, relation, target, resolved FROM e UNION ALL SELECT * FROM ranked) x JOIN kinds ON kinds.id = source WHERE NOT resolved),
wrong AS (SELECT 'error' AS level, 'relation.target-kind' AS code, 'relation ''' || relation || ''' doesn''t allow kind ''' || t.kind || '''' AS message, f.path FROM (SELECT source, relation, target, resolved FROM e UNION ALL SELECT * FROM ranked) x
    JOIN kinds f ON f.id = source JOIN kinds t ON t.id = target
    WHERE resolved AND (relation = 'related' AND t.kind NOT IN ('document', 'task') OR relation = 'supersedes' AND t.kind NOT IN ('decision', 'document') OR relation = 'ranked' AND t.kind <> 'task')),
shape AS (SELECT DISTINCT 'error' AS level, 'relation.cardinality' AS code, 'relation ''' || relation || ''' expects one value in ''' || relation || '''' AS message, path FROM counted JOIN kinds ON kinds.id = src WHERE relation IN ('parent', 'supersedes') AND n > 1
    UNION ALL SELECT 'error', 'relation.target-type', 'relation ''ranked'' has a target that isn''t a string', path FROM p WHERE kind_of <> 'VARCHAR'),
issues AS (SELECT * FROM unresolved UNION ALL SELECT * FROM wrong UNION ALL SELECT * FROM shape)"""
_FILES = """docs AS (SELECT doc_id, text, lang, coalesce(source, 'none') AS source, 'documents/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path, CASE WHEN lang IS NULL THEN '---' || chr(10) || 'open: [1' || chr(10) ELSE '' END || text AS content FROM documents WHERE text IS NOT NULL),
kept AS (SELECT * FROM docs WHERE source <> 'meetings' AND NOT regexp_full_match(path, 'documents/[^/]*/1000[^/]*\\.md')),
notes AS (SELECT *, regexp_replace(path, '\\.md$', '') AS id, sha256(content) AS source_hash, regexp_replace(text, '(?s)\\A---\\n.*?\\n---[ \\t]*(?:\\n|\\z)', '') AS body FROM kept WHERE lang IS NOT NULL),
plain AS (SELECT * FROM notes WHERE NOT starts_with(text, '---')), firsts AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM plain)"""
_TITLE = "coalesce(nullif(trim(regexp_extract(body, '(?m)^#[ \\t]+(.+?)[ \\t\\r]*$', 1)), ''), string_split(id, '/')[-1])"
_CHANGED, _FRESH = "'# Changed' || chr(10) || chr(10) || 'edited words stand here' || chr(10)", "'# Fresh' || chr(10) || chr(10) || 'new words stand here' || chr(10)"
_EDITED = f"""{_FILES}, edited AS (SELECT path, id, {_TITLE} AS title, body AS text, source_hash FROM notes WHERE path NOT IN (SELECT path FROM firsts WHERE k <= 2)
    UNION ALL SELECT path, regexp_replace(path, '\\.md$', ''), 'Changed', {_CHANGED}, sha256({_CHANGED}) FROM firsts WHERE k = 1 UNION ALL SELECT 'fresh.md', 'fresh', 'Fresh', {_FRESH}, sha256({_FRESH}))"""


def oracle_sql() -> dict[str, str]:
    from ..functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    seen = [f"json_type(properties_json, '$.{n}')" for n in ("owner", "priority")]
    return {
        "scan_nodes": f"""WITH {_CURRENT}, x AS (SELECT *, coalesce(body, '') AS b FROM cur), m AS (SELECT *, {_MASKED} AS masked,
                list_filter([CASE WHEN starts_with(path, 'notes/archive/') THEN 'decision' END, CASE WHEN regexp_full_match(path, 'notes/meetings/[^/]*\\.md') THEN 'meeting' END, CASE WHEN {_TYPE} IS NOT NULL THEN 'task' END], lambda k: k IS NOT NULL) AS ks FROM x)
            SELECT id, path, CASE WHEN len(ks) = 0 THEN 'document' WHEN len(ks) = 1 THEN ks[1] ELSE '__invalid__' END AS kind, coalesce(nullif(trim(regexp_extract(b, '(?m)^#[ \\t]+(.+?)[ \\t\\r]*$', 1)), ''), stem) AS title, stem,
                array_to_string(list_transform(regexp_extract_all(b, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t\\r]*$', 1), lambda h: trim(h)), '|') AS headings,
                coalesce((SELECT string_agg(t, '|' ORDER BY k) FROM (SELECT t, min(k) AS k FROM (SELECT unnest(regexp_extract_all(masked, '(?:^|[^\\p{{L}}\\p{{N}}_])#([A-Za-z0-9_/-]+)', 1)) AS t, generate_subscripts(regexp_extract_all(masked, '(?:^|[^\\p{{L}}\\p{{N}}_])#([A-Za-z0-9_/-]+)', 1), 1) AS k) GROUP BY t)), '') AS tags,
                properties_json, sha256(b) AS body_hash FROM m""",
        "scan_field_issues": f"""WITH {_CURRENT}, m AS (SELECT path, {seen[0]} AS o, {seen[1]} AS p, list_filter([CASE WHEN starts_with(path, 'notes/archive/') THEN 'decision' END, CASE WHEN regexp_full_match(path, 'notes/meetings/[^/]*\\.md') THEN 'meeting' END, CASE WHEN {_TYPE} IS NOT NULL THEN 'task' END], lambda k: k IS NOT NULL) AS ks FROM cur)
            SELECT 'error' AS level, 'node.ambiguous-kind' AS code, path FROM m WHERE len(ks) > 1
            UNION ALL SELECT 'error', 'field.required', path FROM m WHERE ks = ['task'] AND o IS NULL UNION ALL SELECT 'error', 'field.type', path FROM m WHERE ks = ['task'] AND o <> 'VARCHAR'
            UNION ALL SELECT 'error', 'field.type', path FROM m WHERE ks = ['task'] AND p NOT IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE')""",
        "scan_edges": f"WITH {_WRITTEN} SELECT source, relation, target, provenance, source_location, resolved FROM e",
        "scan_positions": f"WITH {_WRITTEN}, a AS (SELECT source, relation FROM e UNION ALL SELECT source, relation FROM ranked) SELECT source, count(*) AS n, CAST(0 AS INTEGER) AS first, CAST(count(*) - 1 AS INTEGER) AS last, min(relation) AS first_relation FROM a GROUP BY source",
        "scan_issues": f"WITH {_WRITTEN}, {_ISSUES} SELECT level, code, message, path FROM issues",
        "scan_cycles": f"""WITH RECURSIVE {_WRITTEN}, l AS (SELECT DISTINCT relation, source, target FROM e WHERE resolved AND relation IN ('parent', 'depends_on', 'supersedes')),
            reach AS (SELECT relation, source, target FROM l UNION SELECT r.relation, r.source, l.target FROM reach r JOIN l ON l.relation = r.relation AND l.source = r.target),
            loops AS (SELECT relation, source AS id FROM reach WHERE source = target)
            SELECT relation, min(id) || '.md' AS path FROM (SELECT relation, id FROM loops UNION SELECT r.relation, r.source FROM reach r JOIN loops ON loops.relation = r.relation AND loops.id = r.target) GROUP BY relation""",
        "scan_summary": f"WITH {_WRITTEN}, {_ISSUES} SELECT (SELECT count(*) FROM cur) AS nodes, (SELECT count(*) FROM e) + (SELECT count(*) FROM ranked) AS edges, (SELECT count(*) FROM issues WHERE level = 'warning') AS warnings, (SELECT count(*) FROM issues WHERE level = 'error') = 0 AS valid",
        "incoming_edges": "SELECT DISTINCT dst AS id, src AS source, coalesce(field, 'link') AS relation, provenance FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL",
        "vault_listing": f"WITH {_FILES} SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS size, false AS escaped FROM kept UNION ALL VALUES ('escaped.md', CAST(NULL AS BIGINT), true), ('folder.md', NULL, false), ('.hidden/dot.md', 6, false), ('inside.md', 6, false)",
        "vault_hashes": f"WITH {_FILES} SELECT id, source_hash FROM notes UNION ALL SELECT x, sha256('# Dot' || chr(10)) FROM (VALUES ('.hidden/dot'), ('inside')) v(x)",
        "vault_file_issues": f"""WITH {_FILES}, i AS (SELECT path, 'error' AS level, 'markdown.parse' AS code FROM kept WHERE lang IS NULL UNION ALL VALUES ('escaped.md', 'error', 'path.escape'), ('folder.md', 'error', 'markdown.parse'))
            SELECT *, CAST(row_number() OVER (ORDER BY path, level, code) AS INTEGER) AS place FROM i""",
        "index_nodes": f"WITH {_EDITED} SELECT id, title, source_hash, CAST(2 AS BIGINT) AS parsed FROM edited",
        "index_postings": f"""WITH {_EDITED}, words AS (SELECT path, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM edited)
            SELECT term, path, CAST(0 AS INTEGER) AS zone, CAST(count(*) AS INTEGER) AS count FROM words WHERE length(term) > 1 AND term NOT IN ({stop}) GROUP BY term, path""",
        "index_state_counts": f"WITH {_FILES} SELECT true AS present, true AS current, (SELECT count(*) FROM kept) AS files, (SELECT count(*) FROM notes) AS nodes, CAST(1 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS removed",
        "index_recovery": f"WITH {_FILES} SELECT id, source_hash, damage, indexed FROM notes, (VALUES ('table', true), ('pointer', true), ('folder', false)) v(damage, indexed)",
        "node_mutations": f"""WITH {_FILES}, n AS (SELECT count(*) AS n FROM notes WHERE source <> 'tickets'), u AS (SELECT path, source_hash AS before, 'status: done' || chr(10) || 'n: 3' AS head FROM plain WHERE source <> 'tickets' ORDER BY path LIMIT 1),
            r AS (SELECT path, '---' || chr(10) || head || chr(10) || '---' || chr(10) || '# New' || chr(10) AS content, before, n AS nodes, '' AS issues, CAST(5 AS INTEGER) AS added FROM u, n
                UNION ALL SELECT 'documents/made.md', 'made', NULL, n + 1, 'node.kind-mismatch', 1 FROM n)
            SELECT path, content, sha256(content) AS source_hash, before, nodes, false AS valid, issues, 'the plan isn''t valid' AS state, added FROM r""",
        "applied_mutation": f"WITH {_FILES} SELECT id, CASE WHEN k = 1 THEN sha256('applied') ELSE source_hash END AS source_hash, CASE WHEN k = 1 THEN 'applied' END AS state FROM notes LEFT JOIN firsts USING (path)",
        "merged_note": f"""WITH {_FILES} SELECT id, CASE WHEN k = 1 THEN sha256('---' || chr(10) || 'tags: [b, c, d]' || chr(10) || 'x: 2' || chr(10) || '---' || chr(10) || 'new body') ELSE source_hash END AS source_hash, CASE WHEN k = 1 THEN 'clean applied' END AS state,
            CASE WHEN k = 1 THEN '{{"tags":["b","c","d"],"x":2}}' END AS properties FROM notes LEFT JOIN firsts USING (path)""",
    }
