"""Queries of single steps of the engine over the given tables, and the SQL that checks them: stems, link targets,
frontmatter, merges of bodies, manifests, and what the command line reports."""

from __future__ import annotations

import contextlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..manifest import check_manifest
from ..operators import context, merge, search
from ..operators.parse import clean_links, parse_files, with_props
from ..session import Stored, read_table
from . import reference, vaults

T = read_table
ZONES = [{"source": "stem", "weight": 12, "phraseWeight": 20}, {"source": "firstHeading", "weight": 9}, {"source": "path", "weight": 8}, {"source": "tags", "weight": 7}, {"source": "properties", "weight": 4}, {"source": "headings", "weight": 4, "countCap": 3}, {"source": "body", "weight": 1, "phraseWeight": 8, "countCap": 6}]
# how the target of an edge may be written: syntax, text before and after it
FORMS = [("wikilink", "", "|an alias"), ("wikilink", "note: ", ""), ("wikilink", "", ".pdf"), ("markdown", "/", ".md"), ("markdown", "<", ".md>"), ("markdown", "", ".md?q=1#top \"a title\""), ("markdown", "https://example.invalid/", ""), ("markdown", "../", ".md"), ("frontmatter", "", ""), ("frontmatter", "[[", "]]"), ("frontmatter", "[x](", ".md)")]
MANIFESTS = {
    "good": {}, "no vault id": {"vaultId": None}, "short vault id": {"vaultId": "ab"}, "unknown key": {"extra": 1}, "no kinds": {"nodeKinds": {}}, "unknown default kind": {"defaultKind": "other"}, "bad weight": {"search": {"zones": [{"source": "body", "weight": 1001}]}},
    "bad source": {"search": {"zones": [{"source": "tail", "weight": 1}]}}, "boost without target": {"search": {"boosts": [{"weight": 1}]}}, "relation to unknown kind": {"relations": {"r": {"field": "f", "cardinality": "0..*", "targetKinds": ["other"]}}}, "bad cardinality": {"relations": {"r": {"field": "f", "cardinality": "1", "targetKinds": ["document"]}}},
    "bad strategy": {"merge": {"fields": {"f": {"strategy": "both"}}}}, "few characters": {"context": {"maxCharacters": 255}}, "repeated capability": {"capabilities": ["a", "a"]}, "good relation": {"relations": {"r": {"field": "f", "cardinality": "0..*", "targetKinds": ["document"], "acyclic": True}}},
}


def candidates_stems(s: SparkSession, d: str) -> DataFrame:
    got = search.candidates(reference.given_postings(s, d), T(s, d, "files").select("path").distinct().count(), ["notes", "planning"])
    return got.select("path", F.round("candidate_score", 6).alias("candidate_score"))


def search_indexed(s: SparkSession, d: str) -> DataFrame:
    nodes = reference.documents_as_nodes(s, d)
    postings = Stored(search.build_postings(nodes, reference.DOC_ZONES), "postings").df
    got = search.search_indexed(nodes, postings, "planning checks", 20, reference.AS_OF, zones=reference.DOC_ZONES)
    return got.select("path", F.round("score", 6).alias("score"), F.array_join("matched_zones", ",").alias("zones"))


def search_vault_zones(s: SparkSession, d: str) -> DataFrame:
    nodes = with_props(reference.current_nodes(s, d, "source_hash", "id", "kind", "title", "stem", "tags", "headings", "properties_json", "body"))
    return reference.shown(search.score(nodes, "release plan", ZONES))


def clean_targets(s: SparkSession, d: str) -> DataFrame:
    """Each edge's target written in every form, cleaned: what leads out of the collection isn't there."""
    e = T(s, d, "edges").where("src is not null and dst is not null").select("src", "dst").distinct()
    forms = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(x).alias("syntax"), F.concat(F.lit(a), F.col("dst"), F.lit(b)).alias("raw")) for i, (x, a, b) in enumerate(FORMS)))
    return clean_links(e.select(F.col("src").alias("id"), F.explode(forms).alias("f")).select("id", "f.*")).distinct()


def merge_bodies(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("t"))
    text = {"base": F.col("p"), "ours": F.when(F.col("t") == "F", F.concat("p", F.lit(" ours"))).otherwise(F.col("p")), "theirs": F.when(F.col("p") == "1-URGENT", F.lit("theirs")).when(F.col("p") == "5-LOW", F.concat("p", F.lit(" ours"))).otherwise(F.col("p"))}
    sides = [o.select("path", F.lit("\0body").alias("field"), F.concat(F.lit('"'), text[x], F.lit('"')).alias("value_json")) for x in merge.SIDES]
    return merge.merge_fields(*sides, {}).select("path", "strategy", "resolution", "candidate_present", "candidate_json", "conflict")


def freshness_keys(s: SparkSession, d: str) -> DataFrame:
    return reference.nodes_with_props(s, d).select("id", context.freshness_key({}).alias("fresh"))


def frontmatter_forms(s: SparkSession, d: str) -> DataFrame:
    """Documents behind a frontmatter in which a colon stands unquoted, closed by dots; read strictly and in the lenient way."""
    docs = T(s, d, "documents").where("text is not null and source is not null")
    head = F.concat(F.lit("---\nsummary: "), F.col("source"), F.lit(": "), F.col("doc_id").cast("string"), F.lit("\nn: 1.0\non: [yes, null]\n...\n"))
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("bigint").alias("mtime_ns"), F.lit(None).cast("bigint").alias("size"), F.lit(False).alias("escaped"), F.encode(F.concat(head, "text"), "utf-8").alias("content"))
    shown = lambda df, how: df.select("id", F.lit(how).alias("reading"), "properties_json", F.sha2("body", 256).alias("body"), F.col("error").isNotNull().alias("failed"))
    return shown(parse_files(files, True), "lenient").unionByName(shown(parse_files(files), "strict"))


def manifest_checks(s: SparkSession, d: str) -> DataFrame:
    """Which manifests are accepted. They are no table, so this is the only query without one."""
    good = {"$schema": "local", "apiVersion": "notegraph/v1", "vaultId": "test-vault", "nodeKinds": {"document": {"selectors": [{"path": "**"}]}}}
    rows = []
    for name, change in MANIFESTS.items():
        raw = {k: v for k, v in (good | change).items() if v is not None}
        rows.append((name, not check_manifest(raw)))
    return s.createDataFrame(rows, "manifest string, accepted boolean")


def cli_reports(s: SparkSession, d: str) -> DataFrame:
    """What the commands print about the documents as notes, and the codes they end with."""
    manifest = vaults.document_vault(s, d)
    rows: list[tuple[str, int, str, str]] = []

    def run(*args: str) -> tuple[int, dict]:
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            code = cli.main(["--vault", str(manifest.root), "--no-cache", *args], s)
        text = out.getvalue() or err.getvalue()
        return code, json.loads(text) if text.startswith("{") else {"text": text}

    code, got = run("search", "merge plan", "--limit", "15")
    rows += [("search", code, h["path"], str(h["score"])) for h in got["hits"]]
    code, got = run("query", "--kind", "document", "--limit", "10")
    rows += [("query", code, n["id"], n["kind"]) for n in got["nodes"]]
    code, got = run("validate")
    rows += [("validate", code, k, str(v).lower()) for k, v in got["summary"].items() if k in ("nodes", "errors", "valid")]
    path = vaults._first_paths(s, d, 1)[0]
    code, got = run("read", path)
    rows.append(("read", code, path, got["node"]["body"]))
    code, got = run("read", "no/such/note")
    rows.append(("read", code, "no/such/note", got["schemaVersion"]))
    code, got = run("search", "merge", "--limit", "100000")
    rows.append(("search", code, "limit", got["schemaVersion"]))
    return s.createDataFrame(rows, "command string, code int, item string, value string")


def queries() -> dict:
    return {
        "stem_match": lambda s, d: search.stem_counts(reference.given_postings(s, d), ["checking", "planned", "notes"]),
        "candidates_stems": candidates_stems, "search_indexed": search_indexed, "search_vault_zones": search_vault_zones, "clean_targets": clean_targets, "merge_bodies": merge_bodies, "freshness_keys": freshness_keys, "frontmatter_forms": frontmatter_forms, "manifest_checks": manifest_checks, "cli_reports": cli_reports,
    }


# -- SQL -----------------------------------------------------------------------------------------


def _zones_sql() -> str:
    texts = {
        "stem": "coalesce(stem, '')", "firstHeading": "CASE WHEN len(headings) > 0 THEN headings[1] ELSE replace(replace(stem, '-', ' '), '_', ' ') END", "path": "path", "tags": "coalesce(array_to_string(tags, ' '), '')",
        "properties": "array_to_string(list_transform(list_sort(json_keys(properties_json)), lambda k: k || ' ' || coalesce(json_extract_string(properties_json, '$.' || k), '')), ' ')", "headings": "coalesce(array_to_string(headings, ' '), '')", "body": "coalesce(body, '')",
    }
    columns = ", ".join(f"lower({texts[z['source']]}) AS z{i}" for i, z in enumerate(ZONES))
    parts = []
    for i, z in enumerate(ZONES):
        sum_ = " + ".join(reference._times(f"z{i}", t, z.get("countCap", 1)) for t in ("release", "plan"))
        phrase = f" + CASE WHEN contains(z{i}, 'release plan') THEN {z['phraseWeight']} ELSE 0 END" if z.get("phraseWeight") else ""
        parts.append(f"{z['weight']} * ({sum_}){phrase} AS s{i}")
    total = " + ".join(f"s{i}" for i in range(len(ZONES)))
    names = ", ".join(f"CASE WHEN s{i} > 0 THEN '{z['source']}' END" for i, z in enumerate(ZONES))
    return f"WITH {reference._CURRENT}, x AS (SELECT path, {columns} FROM cur), y AS (SELECT path, {', '.join(parts)} FROM x) SELECT path, CAST({total} AS DOUBLE) AS score, concat_ws(',', {names}) AS zones FROM y WHERE {total} > 0"


def _indexed_sql() -> str:
    # the words of the documents whose stem is that of a token, apart from the stem itself
    stop = ", ".join(f"'{w}'" for w in reference.X.STOP_WORDS)
    forms = {"plan": ("planning", "plans", "planned"), "check": ("checks", "checking", "checked")}
    stems = " UNION ALL ".join(f"SELECT path, zone, 's:{k}', sum(count) FROM words WHERE term IN ({', '.join(repr(f) for f in v)}) GROUP BY path, zone" for k, v in forms.items())
    score = []
    for zone, text, cap, weight, phrase in (("0", "b", 6, 1, 8), ("1", "z", 1, 8, 15)):
        parts = []
        for token, stem in (("planning", "plan"), ("checks", "check")):
            exact = reference._times(text, token, cap)
            parts.append(f"CASE WHEN {exact} > 0 THEN {exact} * {weight} ELSE least(coalesce((SELECT sum(count) FROM posted p WHERE p.path = c.path AND zone = {zone} AND term IN ('{stem}', 's:{stem}')), 0), {cap}) * CAST({weight} * 0.8 AS DOUBLE) END")
        score.append(" + ".join(parts) + f" + CASE WHEN contains({text}, 'planning checks') THEN {phrase} ELSE 0 END AS s{zone}")
    return f"""WITH {reference._DOCS}, raw AS (SELECT path, 0 AS zone, unnest(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}]+')) AS term FROM docs UNION ALL SELECT path, 1, unnest(regexp_extract_all(z, '[\\p{{L}}\\p{{N}}]+')) FROM docs),
        words AS (SELECT path, zone, term, count(*) AS count FROM raw WHERE length(term) > 1 AND term NOT IN ({stop}) GROUP BY path, zone, term), posted AS (SELECT path, zone, term, count FROM words UNION ALL {stems}),
        hit AS (SELECT *, CASE WHEN starts_with(term, 'planning') OR starts_with(term, 'checks') THEN 1.0::DOUBLE WHEN term IN ('plan', 's:plan', 'check', 's:check') THEN 0.8::DOUBLE ELSE 0 END AS factor FROM posted), used AS (SELECT * FROM hit WHERE factor > 0),
        df AS (SELECT term, count(DISTINCT path) AS df FROM used GROUP BY term), n AS (SELECT count(*) AS n FROM docs),
        c AS (SELECT path, sum([1, 8][zone + 1] * least(count, [6, 1][zone + 1]) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * factor) AS v FROM used JOIN df USING (term), n GROUP BY path ORDER BY round(v, 9) DESC, path LIMIT 200),
        s AS (SELECT c.path, {', '.join(score)} FROM c JOIN docs USING (path))
        SELECT path, round((s0 + s1) * (1 + 0.15::DOUBLE), 6) AS score, concat_ws(',', CASE WHEN s0 <> 0 THEN 'body' END, CASE WHEN s1 <> 0 THEN 'property:source' END) AS zones FROM s WHERE s0 + s1 <> 0 ORDER BY s0 + s1 DESC, path LIMIT 20"""


def _targets_sql() -> str:
    kept = {0: ("wikilink", False), 2: ("wikilink", True), 4: ("markdown", False), 5: ("markdown", False), 7: ("markdown", False), 8: ("frontmatter", False), 9: ("wikilink", False), 10: ("markdown", False)}
    parts = []
    for pos, (syntax, foreign) in kept.items():
        _, a, b = FORMS[pos]
        raw = f"'{a}' || dst || '{b}'"
        target = "dst || '.pdf'" if foreign else "'../' || dst" if pos == 7 else "dst"
        # the folder of the source, or the one above it
        base = "regexp_replace(src, '/?[^/]*$', '')"
        near = f"regexp_replace({base}, '/?[^/]*$', '')" if pos == 7 else base
        own = "dst || '.pdf'" if foreign else "dst"
        relative = f"CASE WHEN {near} = '' THEN {own} ELSE {near} || '/' || {own} END"
        parts.append(f"SELECT src AS id, CAST({pos} AS INTEGER) AS pos, {raw} AS raw, '{syntax}' AS syntax, {target} AS clean_target, {relative} AS relative_target, {str(foreign).lower()} AS \"foreign\" FROM e" + (" WHERE contains(src, '/')" if pos == 7 else ""))
    return "WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) " + " UNION ".join(parts)


def oracle_sql() -> dict[str, str]:
    cur, given = reference._CURRENT, reference._GIVEN
    dated = lambda f: f"CASE WHEN json_type(properties_json, '$.{f}') = 'VARCHAR' AND (regexp_full_match(json_extract_string(properties_json, '$.{f}'), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(json_extract_string(properties_json, '$.{f}') AS DATE) IS NOT NULL OR regexp_full_match(json_extract_string(properties_json, '$.{f}'), '\\d{{8}}') AND try_strptime(json_extract_string(properties_json, '$.{f}'), '%Y%m%d') IS NOT NULL) THEN json_extract_string(properties_json, '$.{f}') END"
    accepted = ", ".join(f"('{k}', {str(k.startswith('good')).lower()})" for k in MANIFESTS)
    note = "least((length(b) - length(replace(b, '{t}', ''))) // {n}, 6)"
    score = f"{note.format(t='merge', n=5)} + {note.format(t='plan', n=4)} + CASE WHEN contains(b, 'merge plan') THEN 8 ELSE 0 END"
    return {
        "stem_match": f"WITH {given} SELECT path, zone, regexp_replace(term, '^s:', '') AS stem, CAST(sum(count) AS INTEGER) AS count FROM given WHERE regexp_replace(term, '^s:', '') IN ('check', 'plan', 'note') GROUP BY 1, 2, 3",
        "candidates_stems": f"""WITH {given}, hit AS (SELECT *, CASE WHEN starts_with(term, 'notes') THEN 1.0::DOUBLE WHEN term IN ('note', 's:note') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN starts_with(term, 'planning') THEN 1.0::DOUBLE WHEN term IN ('plan', 's:plan') THEN 0.8::DOUBLE ELSE 0 END AS factor FROM given WHERE zone < 7),
            used AS (SELECT * FROM hit WHERE factor > 0), df AS (SELECT term, count(DISTINCT path) AS df FROM used GROUP BY term), n AS (SELECT count(DISTINCT path) AS n FROM files),
            s AS (SELECT path, sum([12, 9, 8, 7, 4, 4, 1][zone + 1] * least(count, [1, 1, 1, 1, 1, 1, 6][zone + 1]) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * factor) AS v FROM used JOIN df USING (term), n GROUP BY path)
            SELECT path, round(v, 6) AS candidate_score FROM s ORDER BY round(v, 9) DESC, path LIMIT 200""",
        "body_tags_links": f"WITH x AS (SELECT doc_id, text AS b FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, {vaults._MASKED} AS t FROM x) SELECT doc_id, CAST(len(regexp_extract_all(t, '!?\\[\\[([^\\]]+)\\]\\]')) AS INTEGER) AS wikilinks, CAST(len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])#([A-Za-z0-9_/-]+)')) AS INTEGER) AS tags FROM m",
        "search_indexed": _indexed_sql(),
        "search_vault_zones": _zones_sql(),
        "clean_targets": _targets_sql(),
        "merge_bodies": """WITH o AS (SELECT 'orders/' || o_orderkey || '.md' AS path, o_orderpriority AS b, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' ours' ELSE o_orderpriority END AS o, CASE o_orderpriority WHEN '1-URGENT' THEN 'theirs' WHEN '5-LOW' THEN o_orderpriority || ' ours' ELSE o_orderpriority END AS t FROM orders),
            r AS (SELECT *, CASE WHEN o = t THEN CASE WHEN o = b THEN 'unchanged' ELSE 'same-change' END WHEN o = b THEN 'theirs' WHEN t = b THEN 'ours' END AS resolution FROM o)
            SELECT path, 'manual' AS strategy, resolution, resolution IS NOT NULL AS candidate_present, CASE WHEN resolution IS NOT NULL THEN '"' || CASE WHEN resolution = 'theirs' THEN t ELSE o END || '"' END AS candidate_json, CASE WHEN resolution IS NULL THEN 'body.concurrent-change' END AS conflict FROM r""",
        "freshness_keys": f"WITH {cur} SELECT id, coalesce({dated('updated')}, {dated('created')}, '') AS fresh FROM cur",
        "frontmatter_forms": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, '{"n":1.0,"on":["yes",null],"summary":"' || source || ': ' || doc_id || '"}' AS p FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
            SELECT id, 'lenient' AS reading, p AS properties_json, sha256(text) AS body, false AS failed FROM d UNION ALL SELECT id, 'strict', NULL, NULL, true FROM d""",
        "manifest_checks": f"SELECT * FROM (VALUES {accepted}) v(manifest, accepted)",
        "cli_reports": f"""WITH {vaults._FILES}, b AS (SELECT path, id, body, lower(body) AS b FROM notes), s AS (SELECT path, {score} AS v FROM b), top AS (SELECT * FROM s WHERE v <> 0 ORDER BY v DESC, path LIMIT 15), ten AS (SELECT id FROM notes ORDER BY id LIMIT 10)
            SELECT 'search' AS command, CAST(0 AS INTEGER) AS code, path AS item, CAST(v AS VARCHAR) AS value FROM top UNION ALL SELECT 'query', 0, id, 'document' FROM ten
            UNION ALL SELECT 'validate', 1, 'nodes', CAST(count(*) AS VARCHAR) FROM notes UNION ALL SELECT 'validate', 1, 'errors', CAST(count(*) AS VARCHAR) FROM kept WHERE lang IS NULL UNION ALL SELECT 'validate', 1, 'valid', 'false'
            UNION ALL SELECT 'read', 0, path, body FROM notes JOIN firsts USING (path) WHERE k = 1 UNION ALL SELECT 'read', 2, 'no/such/note', 'notegraph.error/v1' UNION ALL SELECT 'search', 2, 'limit', 'notegraph.error/v1'""",
    }
