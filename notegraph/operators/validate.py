"""Classification and validation: each rule is an expression or a join that yields issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, loose
from ..functions.globs import matches
from ..manifest import Manifest
from . import graph
from .parse import body_links, clean_links, prop

INVALID_KIND = "__invalid__"
_ISSUE = "level string, code string, message string, path string"


def issue(level: str, code: str, message: Column | str, path: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"), (path if path is not None else F.col("path")).alias("path"))


def selector(spec: dict[str, str]) -> Column:
    """All conditions of a selector; an empty one matches nothing."""
    tests = {
        "path": lambda v: matches(F.col("path"), v),
        "type": lambda v: F.coalesce(prop("type") == F.lit(canonical(v)), F.lit(False)),
        "tag": lambda v: F.array_contains("tags", v.strip().lstrip("#")),
        "hasField": lambda v: F.exists("props", lambda p: p["name"] == v),
    }
    return reduce(lambda a, b: a & b, (tests[k](v) for k, v in spec.items())) if spec else F.lit(False)


def classify(nodes: DataFrame, manifest: Manifest) -> DataFrame:
    """``nodes`` with kind and classification issues (array ``found_issues``)."""
    hit = [F.when(reduce(lambda a, b: a | b, (selector(s) for s in spec["selectors"])), F.lit(kind)) for kind, spec in sorted(manifest.kinds.items())]
    rows = nodes.withColumn("kinds", F.array_compact(F.array(*hit)))
    n = F.size("kinds")
    rows = rows.withColumn("kind", F.when(n == 1, F.get("kinds", F.lit(0))).when(n == 0, F.lit(manifest.default_kind or INVALID_KIND)).otherwise(F.lit(INVALID_KIND)))
    several = F.when(n > 1, issue("error", "node.ambiguous-kind", F.concat(F.lit("node matches several kinds: "), F.array_join("kinds", ", "))))
    none = F.when((n == 0) & F.lit(manifest.default_kind is None), issue("error", "node.unclassified", "node matches no kind"))
    return rows.withColumn("found_issues", F.array_compact(F.array(several, none))).drop("kinds")


def field_issues(nodes: DataFrame, manifest: Manifest) -> DataFrame:
    """Required fields, types and enums of each kind, checked row by row without a shuffle."""
    checks = []
    for kind, spec in sorted(manifest.kinds.items()):
        for name, contract in sorted(spec.get("fields", {}).items()):
            own, kind_is = F.col("kind") == kind, contract["type"]
            have = prop(name, "json_type")
            right = have.isin("integer", "number") if kind_is == "number" else have == kind_is
            if contract.get("required"):
                checks.append(F.when(own & have.isNull(), issue("error", "field.required", f"required field '{name}' is missing")))
            checks.append(F.when(own & have.isNotNull() & ~right, issue("error", "field.type", F.concat(F.lit(f"field '{name}' must be {kind_is}, not "), have))))
            if "enum" in contract:
                allowed = [loose(v) for v in contract["enum"]]
                checks.append(F.when(own & right & ~prop(name, "value_loose").isin(allowed), issue("error", "field.enum", f"field '{name}' has a value that isn't allowed")))
    return _exploded(nodes, checks)


def _exploded(nodes: DataFrame, checks: list[Column]) -> DataFrame:
    if not checks:
        return nodes.sparkSession.createDataFrame([], _ISSUE)
    return nodes.select(F.explode(F.array_compact(F.array(*checks))).alias("i")).select("i.*")


def relation_values(nodes: DataFrame, manifest: Manifest) -> tuple[DataFrame | None, DataFrame]:
    """(id, relation, field, pos, raw) of well-formed relations, and the issues of the others; nodes are read once for each."""
    values, checks = [], []
    for name, spec in sorted(manifest.relations.items()):
        field, many = spec["field"], spec["cardinality"] == "0..*"
        kind, json = prop(field, "json_type"), prop(field)
        as_list = F.from_json(json, "array<string>") if many else F.array(F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
        right = (kind == "list") if many else (kind != "list")
        # a list of strings only keeps its JSON if every item is read back in quotes
        texts = F.forall(F.from_json(json, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING") if many else kind == "string"
        checks.append(F.when(kind.isNotNull() & ~right, issue("error", "relation.cardinality", f"relation '{name}' expects {'a list' if many else 'one value'} in '{field}'")))
        checks.append(F.when(right & ~F.coalesce(texts, F.lit(False)), issue("error", "relation.target-type", f"relation '{name}' has a target that isn't a string")))
        told = lambda v, i: F.struct(F.lit(name).alias("relation"), F.lit(field).alias("field"), i.alias("pos"), v.alias("raw"))  # noqa: E731, B023
        values.append(F.when(right & texts, F.transform(as_list, told)))
    found = nodes.select("id", F.explode(F.flatten(F.array_compact(F.array(*values)))).alias("v")).select("id", "v.*") if values else None
    return found, _exploded(nodes, checks)


def note_issues(nodes: DataFrame, manifest: Manifest) -> DataFrame:
    """What is wrong with the fields and relations of a note, whatever they lead to."""
    return relation_values(nodes, manifest)[1].unionByName(field_issues(nodes.where(F.col("kind") != INVALID_KIND), manifest))


def edges_of(nodes: DataFrame, manifest: Manifest) -> DataFrame:
    """Edges of classified nodes (with props and link texts): those of bodies and relations are cleaned and resolved together."""
    links = body_links(nodes)
    listed = sorted(manifest.relations)
    raw, _ = relation_values(nodes, manifest)
    stride = 1_000_000
    if raw is not None:
        # a position below zero encodes relation and place, so that the cleaned rows can be told apart
        coded = -(F.array_position(F.lit(listed), F.col("relation")) * stride + F.col("pos"))
        links = links.unionByName(raw.select("id", coded.cast("int").alias("pos"), "raw", F.lit("frontmatter").alias("syntax")))
    found = graph.resolve(clean_links(links), nodes.select("id"))
    place = F.floor(-F.col("pos") / stride).cast("int") - 1
    of = lambda values: F.get(F.lit(values) if values else F.array().cast("array<string>"), F.when(F.col("pos") < 0, place))
    field = of([manifest.relations[r]["field"] for r in listed])
    edges = found.select(
        F.col("id").alias("source"), F.coalesce(of(listed), F.lit("link")).alias("relation"), "target",
        F.when(field.isNull(), F.col("syntax")).otherwise(F.concat_ws(":", F.lit("frontmatter"), field, "syntax")).alias("provenance"), F.concat(F.lit("frontmatter."), field).alias("source_location"), "resolved",
    )
    return graph.positioned(edges)


def edge_issues(nodes: DataFrame, edges: DataFrame, manifest: Manifest) -> DataFrame:
    """Unresolved and wrongly typed targets, and loops in acyclic relations. ``edges`` is read several times."""
    told = lambda level, code, *message: F.struct("source", F.lit(level).alias("level"), F.lit(code).alias("code"), F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message)).alias("message")).alias("i")
    typed = F.col("source_location").isNotNull()
    missing = F.when(typed, told("error", "relation.unresolved", "relation '", F.col("relation"), "' has no target '", F.col("target"), "'"))
    missing = missing.otherwise(told("warning", "link.unresolved", "link target '", F.col("target"), "' doesn't exist"))
    found = edges.where(~F.col("resolved")).select(missing.alias("i"))
    if manifest.relations:
        allowed = F.create_map(*[x for r, spec in sorted(manifest.relations.items()) for x in (F.lit(r), F.lit(spec["targetKinds"]))])
        kinds = nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
        wrong = edges.where(typed & F.col("resolved")).join(kinds, "target").where(~F.array_contains(F.element_at(allowed, F.col("relation")), F.col("target_kind")))
        found = found.unionByName(wrong.select(told("error", "relation.target-kind", "relation '", F.col("relation"), "' doesn't allow kind '", F.col("target_kind"), "'")))
    out = found.select("i.*").join(nodes.select(F.col("id").alias("source"), "path"), "source").select("level", "code", "message", "path")
    acyclic = [r for r, spec in sorted(manifest.relations.items()) if spec.get("acyclic")]
    if acyclic:
        loops = graph.cycles(edges.where(typed & F.col("resolved") & F.col("relation").isin(acyclic)))
        out = out.unionByName(loops.join(nodes.select("id", "path"), "id").select(issue("error", "relation.cycle", F.concat(F.lit("acyclic relation '"), F.col("relation"), F.lit("' has a cycle"))).alias("i")).select("i.*"))
    return out


def ordered_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.coalesce("path", F.lit("")), "level", "code", "message")


def summary(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: nodes, edges, errors, warnings, valid."""
    counts = [
        nodes.select(F.lit("nodes").alias("what")), edges.select(F.lit("edges").alias("what")),
        issues.select(F.when(F.col("level") == "error", "errors").otherwise("warnings").alias("what")),
    ]
    n = lambda x: F.count(F.when(F.col("what") == x, 1)).alias(x)
    got = reduce(lambda a, b: a.unionByName(b), counts).agg(n("nodes"), n("edges"), n("errors"), n("warnings"))
    return got.withColumn("valid", F.col("errors") == 0)
