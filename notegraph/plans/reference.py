"""Queries of the engine's operators over the given tables, and the SQL that checks each of them.

The vault tables are used as they are; ``documents`` and the star schema are adapted to nodes and edges. All run
over whole tables. Limits stand only where a ranking or a page of results is the feature.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.globs import matches
from ..manifest import Manifest
from ..operators import context, filters, graph, index, merge, search, validate
from ..operators.current import latest
from ..operators.parse import clean_links, with_props
from ..scan import overlay
from ..session import Stored, read_table

T = read_table
DOC_ZONES = [{"source": "body", "weight": 1, "phraseWeight": 8, "countCap": 6}, {"source": "property", "field": "source", "weight": 8, "phraseWeight": 15, "countCap": 1}]
AS_OF = datetime.date(1999, 1, 1)
FIELDS = {
    "document": {"status": {"type": "string", "required": True, "enum": ["open", "done", "draft", "active"]}, "priority": {"type": "integer"}},
    "task": {"status": {"type": "string", "required": True}, "priority": {"type": "number", "required": True}, "owner": {"type": "string", "required": True}},
    "meeting": {"updated": {"type": "string", "required": True}},
    "decision": {"owner": {"type": "string", "required": True}},
    "glossary": {"tags": {"type": "list"}},
}
POLICY = Manifest(None, {"vaultId": "given-tables", "nodeKinds": {k: {"selectors": [{"path": "**"}], "fields": f} for k, f in FIELDS.items()}})
SELECTORS = Manifest(None, {"vaultId": "given-tables", "nodeKinds": {"ticket": {"selectors": [{"path": "tickets/**"}]}, "daily": {"selectors": [{"path": "notes/daily/*.md"}]}, "urgent": {"selectors": [{"hasField": "priority"}]}, "inbox": {"selectors": [{"tag": "inbox"}]}}})
MERGE = {"fields": {"status": {"strategy": "scalar"}, "labels": {"strategy": "set"}}, "defaultFieldStrategy": "manual"}


def documents_as_nodes(s: SparkSession, d: str) -> DataFrame:
    """A document as a node: kind is its language label, source a property."""
    docs = T(s, d, "documents")
    key = F.col("doc_id").cast("string")
    source = F.struct(F.lit("source").alias("name"), F.lit("string").alias("json_type"), F.to_json(F.struct("source")).alias("value_json"), F.to_json(F.struct("source")).alias("value_loose"), F.col("source").alias("value_text"))
    at = F.concat(F.lit("documents/"), F.coalesce("source", F.lit("none")), F.lit("/"), key)
    return docs.select("doc_id", at.alias("id"), F.concat(at, F.lit(".md")).alias("path"), F.coalesce("lang", F.lit("none")).alias("kind"), X.title(F.coalesce("text", F.lit("")), key).alias("title"), key.alias("stem"), F.coalesce("text", F.lit("")).alias("body"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("headings"), F.when(F.col("source").isNotNull(), F.array(source)).otherwise(F.array().cast("array<struct<name:string,json_type:string,value_json:string,value_loose:string,value_text:string>>")).alias("props"), F.col("created_at"))


def current_nodes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current row of each path. Columns come with the key, so unread ones aren't scanned."""
    return latest(T(s, d, "nodes"), "path", "indexed_at", *columns)


def nodes_with_props(s: SparkSession, d: str) -> DataFrame:
    return with_props(current_nodes(s, d, "source_hash", "id", "kind", "title", "stem", "tags", "properties_json"))


def vault_edges(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "edges")
    return e.select(F.col("src").alias("source"), F.coalesce("field", F.lit("link")).alias("relation"), F.col("dst").alias("target"), "provenance", "source_location", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def star_nodes(s: SparkSession, d: str) -> DataFrame:
    def of(table: str, key: str, name: str) -> DataFrame:
        at = F.concat(F.lit(f"{table}/"), F.col(key).cast("string"))
        return T(s, d, table).select(at.alias("id"), F.concat(at, F.lit(".md")).alias("path"), F.lit(table).alias("kind"), F.col(name).cast("string").alias("title"))

    return of("region", "r_regionkey", "r_name").unionByName(of("nation", "n_nationkey", "n_name")).unionByName(of("supplier", "s_suppkey", "s_name")).unionByName(of("customer", "c_custkey", "c_name"))


def star_edges(s: SparkSession, d: str) -> DataFrame:
    def of(table: str, key: str, to: str, ref: str) -> DataFrame:
        return T(s, d, table).select(F.concat(F.lit(f"{table}/"), F.col(key).cast("string")).alias("source"), F.lit(to).alias("relation"), F.concat(F.lit(f"{to}/"), F.col(ref).cast("string")).alias("target"), F.lit(True).alias("resolved"))

    return of("nation", "n_nationkey", "region", "n_regionkey").unionByName(of("supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(of("customer", "c_custkey", "nation", "c_nationkey"))


def neighbors(s: SparkSession, d: str, target: str, depth: int, direction: str) -> DataFrame:
    got = graph.neighbors(star_nodes(s, d), star_edges(s, d), target, depth, direction, limit=50)
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["field"], e["direction"])), ",")
    return got.select("id", "kind", F.col("distance").cast("int").alias("distance"), edges.alias("edges"), "truncated")


def doc_hits(s: SparkSession, d: str, query: str, boosts: list[dict] = (), zones: list[dict] = DOC_ZONES) -> DataFrame:
    return search.score(documents_as_nodes(s, d), query, zones, boosts)


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("path", "score", F.array_join("matched_zones", ",").alias("zones"))


def doc_postings(s: SparkSession, d: str) -> DataFrame:
    return search.build_postings(documents_as_nodes(s, d), DOC_ZONES[:1]).where(~F.col("term").startswith(search.STEM_PREFIX))


def given_postings(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "postings").where("term is not null and count > 0 and file is not null").groupBy("term", "file", "zone", "count").agg(F.lit(1).alias("one"))
    return p.groupBy("term", "file", "zone").agg(F.sum("count").cast("int").alias("count")).select("term", F.col("file").cast("string").alias("path"), "zone", "count")


def df_idf(s: SparkSession, d: str) -> DataFrame:
    p = doc_postings(s, d)
    n = T(s, d, "documents").count()
    df = p.groupBy("term").agg(F.countDistinct("path").alias("df"))
    return df.select("term", "df", F.round(search.idf(n, F.col("df")), 6).alias("idf"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    got = search.candidates(given_postings(s, d), T(s, d, "files").select("path").distinct().count(), ["note", "plan"], stemming=False)
    return got.select("path", F.round("candidate_score", 6).alias("candidate_score"))


def freshness_rank(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    score = search.freshness(F.col("o_totalprice"), day, none, F.lit(None).cast("long"), AS_OF, half_life=365.0)
    return o.select("o_orderkey", score.alias("score")).orderBy(F.col("score").desc(), "o_orderkey").limit(100).select("o_orderkey", F.round("score", 4).alias("score"))


def context_groups(s: SparkSession, d: str) -> DataFrame:
    rows = context.grouped(doc_hits(s, d, "merge plan"), {"fields": ["source"], "keyCase": "upper", "notesPerGroup": 3}, limit=8)
    return rows.select("key", F.col("group_rank").cast("int"), F.col("place").cast("int"), "path", "score", "group_score", "count", "representative", "top_match")


def context_budget(s: SparkSession, d: str) -> DataFrame:
    rows = context.context(doc_hits(s, d, "merge plan"), ["merge", "plan"], {"maxCharacters": 3000, "snippetLines": 2, "snippetCharacters": 120}, limit=20)
    return rows.select(F.col("rank").cast("int"), "path", F.array_join("snippets", "\n").alias("snippets"), F.col("cost").cast("int"), F.col("used").cast("bigint"))


def validate_fields(s: SparkSession, d: str) -> DataFrame:
    return validate.field_issues(nodes_with_props(s, d), POLICY).select("level", "code", "path")


def validate_unresolved(s: SparkSession, d: str) -> DataFrame:
    e = vault_edges(s, d)
    rows = e.where(~F.col("resolved")).groupBy("source", "relation", "target").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("relation") == "link", "warning").otherwise("error")
    return rows.select(level.alias("level"), F.when(F.col("relation") == "link", "link.unresolved").otherwise("relation.unresolved").alias("code"), "source", "relation", "target", "n")


def validate_target_kind(s: SparkSession, d: str) -> DataFrame:
    kinds = current_nodes(s, d, "source_hash", "id", "kind").select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    e = vault_edges(s, d).where(F.col("resolved") & F.col("relation").isin("depends_on", "supersedes")).distinct()
    return e.join(kinds, "target").where(~F.col("target_kind").isin("task", "decision")).select("source", "relation", "target", "target_kind", "provenance")


def validate_summary(s: SparkSession, d: str) -> DataFrame:
    issues = validate_unresolved(s, d).select("level").unionByName(validate_fields(s, d).select("level"))
    return validate.summary(current_nodes(s, d, "source_hash"), vault_edges(s, d), issues)


def classify_kind(s: SparkSession, d: str) -> DataFrame:
    rows = validate.classify(nodes_with_props(s, d).drop("kind"), SELECTORS)
    return rows.select("id", "kind", F.array_join(F.transform("found_issues", lambda i: i["code"]), ",").alias("codes"))


def cycle_residual(s: SparkSession, d: str) -> DataFrame:
    e = vault_edges(s, d).where(F.col("resolved") & F.col("relation").isin("depends_on", "supersedes", "parent"))
    return graph.cycles(e)


def resolve_links(s: SparkSession, d: str) -> DataFrame:
    """The raw targets of edges, resolved again against the nodes by id, folder and name."""
    raw = T(s, d, "edges").where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    links = clean_links(raw.select(F.col("src").alias("id"), "pos", F.element_at(F.split("dst", "/"), -1).alias("raw"), F.lit("frontmatter").alias("syntax")))
    got = graph.resolve(links, current_nodes(s, d, "source_hash", "id").select("id"))
    return got.select("id", "raw", "target", "resolved").distinct()


def merge_inputs(s: SparkSession, d: str) -> list[DataFrame]:
    """Three versions of the orders' fields: each side changes, drops or adds some of them by rules of its own."""
    o = T(s, d, "orders").withColumn("path", F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")))
    k = F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    status = {
        "base": quoted(F.col("o_orderstatus")),
        "ours": F.when(k % 5 == 0, F.lit('"X"')).otherwise(quoted(F.col("o_orderstatus"))),
        "theirs": F.when(k % 7 == 0, F.lit('"Y"')).when(k % 3 == 0, quoted(F.col("o_orderstatus"))).when(k % 5 == 0, F.lit('"X"')).otherwise(quoted(F.col("o_orderstatus"))),
    }
    labels = {
        "base": F.lit('["a","b"]'),
        "ours": F.when(k % 4 == 0, F.lit('["b","c","b"]')).otherwise(F.lit('["a","b"]')),
        "theirs": F.when(k % 6 == 0, F.lit('["a","b","d"]')).when(k % 11 == 0, F.lit('"a"')).otherwise(F.lit('["a","b"]')),
    }

    def side(name: str) -> DataFrame:
        f = o.select("path", F.explode(F.array(F.struct(F.lit("status").alias("field"), status[name].alias("value_json")), F.struct(F.lit("labels").alias("field"), labels[name].alias("value_json")))).alias("x"), k.alias("k")).select("path", "k", "x.*")
        gone = {"base": F.lit(False), "ours": (F.col("k") % 13 == 0), "theirs": (F.col("k") % 17 == 0)}[name]
        return f.where(~((F.col("field") == "status") & gone)).select("path", "field", "value_json")

    return [side(x) for x in merge.SIDES]


def merged(s: SparkSession, d: str) -> DataFrame:
    return merge.merge_fields(*merge_inputs(s, d), MERGE)


def index_diff(s: SparkSession, d: str) -> DataFrame:
    """Between the first and the last listing of each path."""
    f = T(s, d, "files").where("path is not null")
    first = f.groupBy("path").agg(F.min(F.struct("listed_at", "mtime_ns", "size", "is_escaped")).alias("x")).select("path", "x.mtime_ns", "x.size", F.col("x.is_escaped").alias("escaped"))
    last = latest(f, "path", "listed_at", "mtime_ns", "size", "is_escaped").withColumnRenamed("is_escaped", "escaped")
    known = latest(T(s, d, "index_state"), "path", "run_id", "mtime_ns", "size").withColumn("escaped", F.lit(False))
    return index.stat_diff(first, last).withColumn("between", F.lit("listings")).unionByName(index.stat_diff(known, last).withColumn("between", F.lit("state and listing")))


def overlay_scan(s: SparkSession, d: str) -> DataFrame:
    docs = T(s, d, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.lit(None).cast("bigint").alias("mtime_ns"), F.lit(None).cast("bigint").alias("size"), F.lit(False).alias("escaped"), F.encode("text", "utf-8").alias("content"))
    got = overlay(docs, {"documents/100004": b"replaced"}, {"documents/new": b"created"})
    return got.select("path", F.sha2("content", 256).alias("source_hash"))


def queries() -> dict:
    return {
        "search_exact_topk": lambda s, d: shown(search.ranked(doc_hits(s, d, "merge plan", [{"kind": "en", "weight": 3}]), 20)),
        "search_phrase": lambda s, d: shown(doc_hits(s, d, "the merge plan")),
        "search_boosts": lambda s, d: shown(search.ranked(doc_hits(s, d, "search page", [{"path": "documents/meetings/*", "weight": 5}, {"kind": "de", "weight": 2}]), 50)),
        "search_stopwords": lambda s, d: shown(doc_hits(s, d, "the of and в на glossary")),
        "postings_build": lambda s, d: doc_postings(s, d),
        "postings_df_idf": df_idf,
        "candidates_top200": candidates,
        "prefix_match": lambda s, d: given_postings(s, d).where(F.col("term").startswith("no") & ~F.col("term").startswith(search.STEM_PREFIX)).groupBy("term").agg(F.countDistinct("path").alias("files"), F.sum("count").alias("total")),
        "freshness_rank": freshness_rank,
        "snippets_first_lines": lambda s, d: documents_as_nodes(s, d).select("doc_id", F.array_join(context.snippets(["glossary"], 2, 80, False), "\n").alias("snippets")),
        "context_group_topn": context_groups,
        "context_budget": context_budget,
        "ticket_key": lambda s, d: current_nodes(s, d, "source_hash").select("path", context.ticket(F.col("path")).alias("ticket")),
        "query_kind_where": lambda s, d: filters.query_nodes(nodes_with_props(s, d), kinds=["task", "document"], properties=[("status", "open"), ("priority", 2)]).select("id", "kind"),
        "query_tags_superset": lambda s, d: filters.query_nodes(nodes_with_props(s, d), tags=["inbox", "#roadmap"]).select("id"),
        "query_has_field": lambda s, d: filters.query_nodes(nodes_with_props(s, d), has_fields=["owner", "lang"]).select("id"),
        "query_path_glob": lambda s, d: filters.query_nodes(nodes_with_props(s, d), paths=["notes/*/run*.md", "tickets/**"]).select("id"),
        "query_limit": lambda s, d: filters.query_nodes(nodes_with_props(s, d), kinds=["meeting"], limit=25).select("id"),
        "path_glob_tail": lambda s, d: current_nodes(s, d, "source_hash").where(matches(F.col("path"), "daily/r*", tail=True)).select("path"),
        "graph_edges_all": lambda s, d: graph.positioned(vault_edges(s, d).distinct()).select("source", "relation", "target", "provenance", "position"),
        "graph_incoming": lambda s, d: graph.incoming_counts(vault_edges(s, d)),
        "graph_orphans": lambda s, d: graph.without_incoming(current_nodes(s, d, "source_hash", "id").select("id", "path"), vault_edges(s, d)).select("id"),
        "neighbors_d1_both": lambda s, d: neighbors(s, d, "region/1", 1, "both"),
        "neighbors_d2_out": lambda s, d: neighbors(s, d, "customer/7", 2, "out"),
        "neighbors_d3_in": lambda s, d: neighbors(s, d, "region/2.md", 3, "in"),
        "resolve_links": resolve_links,
        "cycle_residual": cycle_residual,
        "validate_fields": validate_fields,
        "validate_unresolved": validate_unresolved,
        "validate_target_kind": validate_target_kind,
        "validate_summary": validate_summary,
        "classify_kind": classify_kind,
        "headings_of_bodies": lambda s, d: current_nodes(s, d, "source_hash", "id", "stem", "body").where("body is not null").select("id", F.array_join(X.headings(F.col("body")), "|").alias("headings"), X.title(F.col("body"), F.col("stem")).alias("title")),
        "mask_code": lambda s, d: T(s, d, "documents").where("text is not null").select("doc_id", F.sha2(X.masked(F.col("text")), 256).alias("masked")),
        "body_tags_links": lambda s, d: T(s, d, "documents").where("text is not null").select("doc_id", F.size(X.wikilinks(X.masked(F.col("text")))).alias("wikilinks"), F.size(X.body_tags(X.masked(F.col("text")))).alias("tags")),
        "source_hash_dups": lambda s, d: T(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("source_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"),
        "index_diff": index_diff,
        "index_status_counts": lambda s, d: index.counts(current_nodes(s, d, "source_hash"), T(s, d, "edges"), T(s, d, "files"), T(s, d, "postings")),
        "merge_fields": lambda s, d: merged(s, d).select("path", "field", "strategy", "resolution", "candidate_present", "candidate_json", "conflict"),
        "merge_summary": lambda s, d: merge.merge_states(merged(s, d)),
        "overlay_scan": overlay_scan,
    }


# -- SQL -----------------------------------------------------------------------------------------

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM nodes) WHERE rn = 1 AND path IS NOT NULL)"
_DOCS = "docs AS (SELECT *, 'documents/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path, coalesce(lang, 'none') AS kind, lower(coalesce(text, '')) AS b, lower(coalesce(source, '')) AS z FROM documents)"


def _times(text: str, token: str, cap: int) -> str:
    return f"least((length({text}) - length(replace({text}, '{token}', ''))) // {len(token)}, {cap})"


def _doc_search(tokens: list[str], phrase: str, boost: str = "0", limit: int | None = None) -> str:
    body = " + ".join([_times("b", t, 6) for t in tokens] + [f"CASE WHEN contains(b, '{phrase}') THEN 8 ELSE 0 END"])
    source = " + ".join([f"8 * {_times('z', t, 1)}" for t in tokens] + [f"CASE WHEN contains(z, '{phrase}') THEN 15 ELSE 0 END"])
    tail = f" ORDER BY score DESC, path LIMIT {limit}" if limit else ""
    return f"""WITH {_DOCS}, x AS (SELECT path, kind, source, {body} AS sb, {source} AS sz FROM docs)
        SELECT path, CAST(sb + sz + {boost} AS DOUBLE) AS score, concat_ws(',', CASE WHEN sb <> 0 THEN 'body' END, CASE WHEN sz <> 0 THEN 'property:source' END) AS zones FROM x WHERE sb + sz <> 0{tail}"""


_WORDS = f"""{_DOCS}, words AS (SELECT path, unnest(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}]+')) AS term FROM docs),
posted AS (SELECT term, path, 0 AS zone, CAST(count(*) AS INTEGER) AS count FROM words WHERE length(term) > 1 AND term NOT IN ({", ".join(f"'{w}'" for w in X.STOP_WORDS)}) GROUP BY term, path)"""
_GIVEN = "given AS (SELECT term, CAST(file AS VARCHAR) AS path, zone, CAST(sum(count) AS INTEGER) AS count FROM (SELECT DISTINCT term, file, zone, count FROM postings WHERE term IS NOT NULL AND count > 0 AND file IS NOT NULL) GROUP BY 1, 2, 3)"
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> '' AND {test})"
_EDGES = "e AS (SELECT src AS source, coalesce(field, 'link') AS relation, dst AS target, provenance, source_location, coalesce(resolved, false) AS resolved FROM edges)"
_STAR = """n AS (SELECT 'region/' || r_regionkey AS id, 'region' AS kind FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation' FROM nation
    UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'customer/' || c_custkey, 'customer' FROM customer),
e AS (SELECT 'nation/' || n_nationkey AS s, 'region' AS r, 'region/' || n_regionkey AS t FROM nation UNION ALL SELECT 'supplier/' || s_suppkey, 'nation', 'nation/' || s_nationkey FROM supplier
    UNION ALL SELECT 'customer/' || c_custkey, 'nation', 'nation/' || c_nationkey FROM customer)"""


def _star_neighbors(start: str, depth: int, direction: str) -> str:
    steps = {"out": "SELECT s AS a, t AS b, r || ':out' AS w FROM e", "in": "SELECT t AS a, s AS b, r || ':in' AS w FROM e"}
    step = " UNION ALL ".join(steps.values()) if direction == "both" else steps[direction]
    ctes = [f"step AS ({step})", f"r0 AS (SELECT '{start}' AS id)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM r{i}" for i in range(k))
        ctes.append(f"g{k} AS (SELECT DISTINCT b AS id, w FROM step WHERE a IN (SELECT id FROM r{k - 1}) AND b NOT IN ({seen})), r{k} AS (SELECT DISTINCT id FROM g{k})")
    every = " UNION ALL ".join(f"SELECT id, w, {k} AS distance FROM g{k}" for k in range(1, depth + 1))
    return f"""WITH {_STAR}, {', '.join(ctes)}, found AS (SELECT id, CAST(distance AS INTEGER) AS distance, string_agg(w, ',' ORDER BY w) AS edges FROM ({every}) GROUP BY 1, 2),
        placed AS (SELECT found.*, n.kind, row_number() OVER (ORDER BY distance, id || '.md') AS rk, count(*) OVER () AS total FROM found JOIN n USING (id))
        SELECT id, kind, distance, edges, total > 50 AS truncated FROM placed WHERE rk <= 50"""


def _prop(name: str) -> str:
    return f"json_extract(properties_json, '$.{name}')"


def _field_sql() -> str:
    types = {"string": "'VARCHAR'", "integer": "'UBIGINT', 'BIGINT', 'HUGEINT'", "number": "'UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE'", "list": "'ARRAY'"}
    parts = []
    for kind, fields in FIELDS.items():
        for name, c in fields.items():
            kind_of = f"json_type(properties_json, '$.{name}')"
            if c.get("required"):
                parts.append(f"SELECT 'error' AS level, 'field.required' AS code, path FROM cur WHERE kind = '{kind}' AND {kind_of} IS NULL")
            parts.append(f"SELECT 'error' AS level, 'field.type' AS code, path FROM cur WHERE kind = '{kind}' AND {kind_of} NOT IN ({types[c['type']]})")
            if "enum" in c:
                allowed = ", ".join(f"'{v}'" for v in c["enum"])
                parts.append(f"SELECT 'error' AS level, 'field.enum' AS code, path FROM cur WHERE kind = '{kind}' AND {kind_of} = 'VARCHAR' AND json_extract_string(properties_json, '$.{name}') NOT IN ({allowed})")
    return " UNION ALL ".join(parts)


_MERGE_SQL = """
o AS (SELECT 'orders/' || o_orderkey || '.md' AS path, o_orderkey AS k, '"' || o_orderstatus || '"' AS st FROM orders),
rows_ AS (SELECT path, 'status' AS field, 'scalar' AS strategy, true AS bp, k % 13 <> 0 AS op, k % 17 <> 0 AS tp, st AS b,
        CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN '"X"' ELSE st END AS o,
        CASE WHEN k % 17 = 0 THEN NULL WHEN k % 7 = 0 THEN '"Y"' WHEN k % 3 = 0 THEN st WHEN k % 5 = 0 THEN '"X"' ELSE st END AS t FROM o
    UNION ALL SELECT path, 'labels', 'set', true, true, true, '["a","b"]', CASE WHEN k % 4 = 0 THEN '["b","c","b"]' ELSE '["a","b"]' END,
        CASE WHEN k % 6 = 0 THEN '["a","b","d"]' WHEN k % 11 = 0 THEN '"a"' ELSE '["a","b"]' END FROM o),
res AS (SELECT *, CASE WHEN strategy = 'set' AND t = '"a"' THEN NULL WHEN o IS NOT DISTINCT FROM t THEN CASE WHEN o IS NOT DISTINCT FROM b THEN 'unchanged' ELSE 'same-change' END
        WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN strategy = 'set' THEN 'set-merge' END AS resolution FROM rows_),
done AS (SELECT path, field, strategy, resolution,
        CASE WHEN resolution IS NULL THEN false WHEN resolution = 'theirs' THEN tp ELSE op END AS candidate_present,
        CASE WHEN resolution = 'set-merge' THEN '["b","c","d"]' WHEN resolution = 'theirs' THEN t WHEN resolution IS NULL THEN NULL WHEN strategy = 'set' AND o = '["b","c","b"]' THEN '["b","c"]' ELSE o END AS candidate_json,
        CASE WHEN resolution IS NULL THEN CASE WHEN strategy = 'set' THEN 'frontmatter.type-conflict' ELSE 'frontmatter.concurrent-change' END END AS conflict FROM res)"""


def oracle_sql() -> dict[str, str]:
    snippet = _LINES.format(test="contains(lower(x), 'glossary')")
    line = _LINES.format(test="(contains(lower(x), 'merge') OR contains(lower(x), 'plan'))")
    merge_plan = _doc_search(["merge", "plan"], "merge plan")
    return {
        "search_exact_topk": _doc_search(["merge", "plan"], "merge plan", "CASE WHEN kind = 'en' THEN 3 ELSE 0 END", 20),
        "search_phrase": _doc_search(["merge", "plan"], "the merge plan"),
        "search_boosts": _doc_search(["search", "page"], "search page", "CASE WHEN source = 'meetings' THEN 5 ELSE 0 END + CASE WHEN kind = 'de' THEN 2 ELSE 0 END", 50),
        "search_stopwords": _doc_search(["glossary"], "the of and в на glossary"),
        "postings_build": f"WITH {_WORDS} SELECT term, path, zone, count FROM posted",
        "postings_df_idf": f"WITH {_WORDS} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM posted GROUP BY term",
        "candidates_top200": f"""WITH {_GIVEN}, hit AS (SELECT *, CASE WHEN starts_with(term, 'note') THEN 1 ELSE 0 END + CASE WHEN starts_with(term, 'plan') THEN 1 ELSE 0 END AS factor FROM given WHERE zone < 7 AND NOT starts_with(term, 's:')),
            used AS (SELECT * FROM hit WHERE factor > 0), df AS (SELECT term, count(DISTINCT path) AS df FROM used GROUP BY term), n AS (SELECT count(DISTINCT path) AS n FROM files),
            s AS (SELECT path, sum([12, 9, 8, 7, 4, 4, 1][zone + 1] * least(count, [1, 1, 1, 1, 1, 1, 6][zone + 1]) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * factor) AS v FROM used JOIN df USING (term), n GROUP BY path)
            SELECT path, round(v, 6) AS candidate_score FROM s ORDER BY round(v, 9) DESC, path LIMIT 200""",
        "prefix_match": f"WITH {_GIVEN} SELECT term, count(DISTINCT path) AS files, CAST(sum(count) AS BIGINT) AS total FROM given WHERE starts_with(term, 'no') GROUP BY term",
        "freshness_rank": """WITH x AS (SELECT o_orderkey, o_totalprice * (1 + 0.15::DOUBLE * pow(0.5::DOUBLE, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01'), 0) / 365.0::DOUBLE)) AS s FROM orders)
            SELECT o_orderkey, round(s, 4) AS score FROM x ORDER BY s DESC, o_orderkey LIMIT 100""",
        "snippets_first_lines": f"SELECT doc_id, array_to_string(list_transform(({snippet})[1:2], lambda x: left(x, 80)), chr(10)) AS snippets FROM documents",
        "context_group_topn": f"""WITH hits AS ({merge_plan}), k AS (SELECT path, score, coalesce(upper(nullif(trim(source), '')), path) AS key FROM hits JOIN (SELECT source, 'documents/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path FROM documents) USING (path)),
            g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, path) AS place, max(score) OVER (PARTITION BY key) AS group_score, count(*) OVER (PARTITION BY key) AS count FROM k),
            f AS (SELECT *, min(CASE WHEN place = 1 THEN path END) OVER (PARTITION BY key) AS representative FROM g),
            r AS (SELECT *, dense_rank() OVER (ORDER BY group_score DESC, key) AS group_rank FROM f WHERE place <= 3)
            SELECT key, CAST(group_rank AS INTEGER) AS group_rank, CAST(place AS INTEGER) AS place, path, score, group_score, count, representative, CAST(NULL AS VARCHAR) AS top_match FROM r WHERE group_rank <= 8""",
        "context_budget": f"""WITH hits AS ({merge_plan}), top AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM hits QUALIFY rank <= 20),
            x AS (SELECT rank, top.path, coalesce(nullif(trim(regexp_extract(text, '(?m)^#[ \\t]+(.+?)[ \\t\\r]*$', 1)), ''), CAST(doc_id AS VARCHAR)) AS title, list_transform(({line})[1:2], lambda x: left(x, 120)) AS s FROM top JOIN (SELECT doc_id, text, 'documents/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path FROM documents) USING (path)),
            y AS (SELECT rank, path, title, CASE WHEN len(s) > 0 THEN s ELSE [left(title, 120)] END AS s FROM x),
            z AS (SELECT *, length(path) + length(title) + list_sum(list_transform(s, lambda x: length(x))) AS cost FROM y), u AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS used FROM z)
            SELECT CAST(rank AS INTEGER) AS rank, path, array_to_string(s, chr(10)) AS snippets, CAST(cost AS INTEGER) AS cost, CAST(used AS BIGINT) AS used FROM u WHERE used <= 3000""",
        "ticket_key": f"WITH {_CURRENT} SELECT path, list_filter(list_transform(string_split(path, '/'), lambda x: regexp_extract(x, '\\b(adhoc-\\d{{4}}-\\d{{2}}-\\d{{2}}-[A-Za-z0-9._-]+|[A-Za-z]{{2,}}-\\d{{2,}})\\b', 1)), lambda t: t <> '')[1] AS ticket FROM cur",
        "query_kind_where": f"WITH {_CURRENT} SELECT id, kind FROM cur WHERE kind IN ('task', 'document') AND {_prop('status')} = '\"open\"' AND json_type(properties_json, '$.priority') IN ('UBIGINT', 'DOUBLE') AND CAST({_prop('priority')} AS DOUBLE) = 2",
        "query_tags_superset": f"WITH {_CURRENT} SELECT id FROM cur WHERE list_contains(tags, 'inbox') AND list_contains(tags, 'roadmap')",
        "query_has_field": f"WITH {_CURRENT} SELECT id FROM cur WHERE list_contains(json_keys(properties_json), 'owner') AND list_contains(json_keys(properties_json), 'lang')",
        "query_path_glob": f"WITH {_CURRENT} SELECT id FROM cur WHERE regexp_full_match(path, 'notes/[^/]*/run[^/]*\\.md') OR starts_with(path, 'tickets/')",
        "query_limit": f"WITH {_CURRENT} SELECT id FROM cur WHERE kind = 'meeting' ORDER BY id LIMIT 25",
        "path_glob_tail": f"WITH {_CURRENT} SELECT path FROM cur WHERE regexp_full_match(path, '(.*/)?daily/r[^/]*')",
        "graph_edges_all": f"""WITH {_EDGES}, u AS (SELECT DISTINCT * FROM e) SELECT source, relation, target, provenance,
            CAST(row_number() OVER (PARTITION BY source ORDER BY relation NULLS FIRST, target NULLS FIRST, provenance NULLS FIRST, source_location NULLS FIRST) - 1 AS INTEGER) AS position FROM u""",
        "graph_incoming": "SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst",
        "graph_orphans": f"WITH {_CURRENT} SELECT id FROM cur WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = cur.id)",
        "neighbors_d1_both": _star_neighbors("region/1", 1, "both"),
        "neighbors_d2_out": _star_neighbors("customer/7", 2, "out"),
        "neighbors_d3_in": _star_neighbors("region/2", 3, "in"),
        "resolve_links": f"""WITH {_CURRENT}, ids AS (SELECT DISTINCT id FROM cur WHERE id IS NOT NULL), names AS (SELECT string_split(id, '/')[-1] AS name, min(id) AS target FROM ids GROUP BY 1 HAVING count(*) = 1),
            l AS (SELECT DISTINCT src AS id, string_split(dst, '/')[-1] AS raw FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
            r AS (SELECT l.*, CASE WHEN contains(l.id, '/') THEN regexp_replace(l.id, '/[^/]*$', '') || '/' || raw ELSE raw END AS near FROM l)
            SELECT r.id, raw, coalesce(CASE WHEN raw IN (SELECT id FROM ids) THEN raw WHEN near IN (SELECT id FROM ids) THEN near END, names.target, raw) AS target,
                raw IN (SELECT id FROM ids) OR near IN (SELECT id FROM ids) OR names.target IS NOT NULL AS resolved FROM r LEFT JOIN names ON names.name = raw""",
        "cycle_residual": f"""WITH RECURSIVE {_EDGES}, l AS (SELECT DISTINCT relation, source, target FROM e WHERE resolved AND relation IN ('depends_on', 'supersedes', 'parent') AND source IS NOT NULL AND target IS NOT NULL),
            reach AS (SELECT relation, source, target FROM l UNION SELECT r.relation, r.source, l.target FROM reach r JOIN l ON l.relation = r.relation AND l.source = r.target),
            loops AS (SELECT relation, source AS id FROM reach WHERE source = target)
            SELECT relation, min(id) AS id FROM (SELECT relation, id FROM loops UNION SELECT r.relation, r.source FROM reach r JOIN loops ON loops.relation = r.relation AND loops.id = r.target) GROUP BY relation""",
        "validate_fields": f"WITH {_CURRENT} {_field_sql()}",
        "validate_unresolved": f"WITH {_EDGES} SELECT CASE WHEN relation = 'link' THEN 'warning' ELSE 'error' END AS level, CASE WHEN relation = 'link' THEN 'link.unresolved' ELSE 'relation.unresolved' END AS code, source, relation, target, count(*) AS n FROM e WHERE NOT resolved GROUP BY source, relation, target",
        "validate_target_kind": f"WITH {_EDGES}, {_CURRENT} SELECT source, relation, target, cur.kind AS target_kind, provenance FROM (SELECT DISTINCT * FROM e) x JOIN cur ON cur.id = target WHERE resolved AND relation IN ('depends_on', 'supersedes') AND cur.kind NOT IN ('task', 'decision')",
        "validate_summary": f"""WITH {_EDGES}, {_CURRENT}, u AS (SELECT DISTINCT CASE WHEN relation = 'link' THEN 'warning' ELSE 'error' END AS level, source, relation, target FROM e WHERE NOT resolved), f AS ({_field_sql()}),
            c AS (SELECT (SELECT count(*) FROM cur) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM u WHERE level = 'error') + (SELECT count(*) FROM f) AS errors, (SELECT count(*) FROM u WHERE level = 'warning') AS warnings)
            SELECT nodes, edges, errors, warnings, errors = 0 AS valid FROM c""",
        "classify_kind": f"""WITH {_CURRENT}, x AS (SELECT id, list_filter([CASE WHEN regexp_full_match(path, 'notes/daily/[^/]*\\.md') THEN 'daily' END, CASE WHEN list_contains(tags, 'inbox') THEN 'inbox' END, CASE WHEN starts_with(path, 'tickets/') THEN 'ticket' END, CASE WHEN list_contains(json_keys(properties_json), 'priority') THEN 'urgent' END], lambda k: k IS NOT NULL) AS ks FROM cur)
            SELECT id, CASE WHEN len(ks) = 1 THEN ks[1] ELSE '__invalid__' END AS kind, CASE WHEN len(ks) = 0 THEN 'node.unclassified' WHEN len(ks) > 1 THEN 'node.ambiguous-kind' ELSE '' END AS codes FROM x""",
        "headings_of_bodies": f"WITH {_CURRENT} SELECT id, array_to_string(list_transform(regexp_extract_all(body, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t\\r]*$', 1), lambda x: trim(x)), '|') AS headings, coalesce(nullif(trim(regexp_extract(body, '(?m)^#[ \\t]+(.+?)[ \\t\\r]*$', 1)), ''), stem) AS title FROM cur WHERE body IS NOT NULL",
        "mask_code": "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?ms)^ {0,3}(?:```|~~~).*?^ {0,3}(?:```|~~~)[ \\t]*$', '', 'g'), '`+[^`\\n]*`+', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS masked FROM documents WHERE text IS NOT NULL",
        "source_hash_dups": "SELECT sha256(text) AS source_hash, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "index_diff": """WITH f AS (SELECT path, mtime_ns, size, is_escaped AS escaped, listed_at FROM files WHERE path IS NOT NULL),
            a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY listed_at) = 1), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY listed_at DESC) = 1),
            s AS (SELECT path, mtime_ns, size, false AS escaped FROM index_state WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, mtime_ns DESC, size DESC) = 1)
            SELECT b.path, 'changed' AS change, 'listings' AS between FROM a JOIN b USING (path) WHERE a.mtime_ns IS DISTINCT FROM b.mtime_ns OR a.size IS DISTINCT FROM b.size OR a.escaped IS DISTINCT FROM b.escaped
            UNION ALL SELECT coalesce(s.path, b.path), CASE WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END, 'state and listing' FROM s FULL JOIN b ON s.path = b.path WHERE s.path IS NULL OR b.path IS NULL OR s.mtime_ns IS DISTINCT FROM b.mtime_ns OR s.size IS DISTINCT FROM b.size OR s.escaped IS DISTINCT FROM b.escaped""",
        "index_status_counts": f"WITH {_CURRENT} SELECT (SELECT count(*) FROM cur) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM postings) AS postings, (SELECT count(DISTINCT term) FROM postings) AS terms",
        "merge_fields": f"WITH {_MERGE_SQL.strip()} SELECT * FROM done",
        "merge_summary": f"WITH {_MERGE_SQL.strip()} SELECT path, count(*) FILTER (conflict IS NULL) AS decisions, count(conflict) AS conflicts, CASE WHEN count(conflict) > 0 THEN 'conflict' ELSE 'clean' END AS state FROM done GROUP BY path",
        "overlay_scan": "SELECT 'documents/' || doc_id AS path, sha256(text) AS source_hash FROM documents WHERE doc_id <> 100004 UNION ALL SELECT 'documents/100004', sha256('replaced') UNION ALL SELECT 'documents/new', sha256('created')",
    }


