"""Three-way merges of many notes at once: fields aligned by joins, values resolved by expressions."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..errors import MergeError
from ..functions.canonical import canonical, digest, text_hash
from ..manifest import Manifest

SIDES = ("base", "ours", "theirs")
PLAN_SCHEMA = "notegraph.merge-plan/v1"


@F.pandas_udf(T.ArrayType(T.StringType()))
def items_of(values: pd.Series) -> pd.Series:
    """The items of JSON lists in canonical form; null for anything else."""

    def one(v: str | None) -> list[str] | None:
        got = json.loads(v) if v is not None else None
        return [canonical(x) for x in got] if isinstance(got, list) else None

    return values.map(one)


def align(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows (path, field) of any side (path, field, value_json), with ``*_present`` and ``*_json``: a missing
    field and a null value stay apart."""
    sides = [df.select("path", "field", F.lit(True).alias(f"{s}_present"), F.col("value_json").alias(f"{s}_json")) for s, df in zip(SIDES, (base, ours, theirs))]
    rows = sides[0].join(sides[1], ["path", "field"], "full_outer").join(sides[2], ["path", "field"], "full_outer")
    return rows.fillna(False, [f"{s}_present" for s in SIDES])


def strategies(rows: DataFrame, config: dict) -> DataFrame:
    """``rows`` with the strategy of each field by the policy."""
    own = {k: v["strategy"] for k, v in config.get("fields", {}).items()}
    chosen = F.lit(config.get("defaultFieldStrategy", "manual"))
    if own:
        chosen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("field")), chosen)
    return rows.withColumn("strategy", chosen)


def merged_items(base: Column, ours: Column, theirs: Column) -> Column:
    """What both sides kept in base's order, then what either added in canonical order."""
    none = F.array().cast("array<string>")
    b, o, t = (F.array_distinct(F.coalesce(x, none)) for x in (base, ours, theirs))
    kept = F.filter(b, lambda x: F.array_contains(o, x) & F.array_contains(t, x))
    return F.concat(kept, F.array_sort(F.array_except(F.array_union(o, t), b)))


def resolve(rows: DataFrame) -> DataFrame:
    """``rows`` (aligned, with strategy and ``*_items``) with resolution, candidate_present, candidate_json, conflict.

    Equal sides win first, then the side that changed, then a set merge; what's left is a conflict. A set with a
    value that's no list is a conflict before all else. Equality is that of canonical JSON.
    """
    side = lambda s: F.struct(F.col(f"{s}_present").alias("p"), F.col(f"{s}_json").alias("j"))
    b, o, t = (side(s) for s in SIDES)
    is_set = F.col("strategy") == "set"
    odd = F.lit(False)
    for s in SIDES:
        odd = odd | (F.col(f"{s}_present") & F.col(f"{s}_items").isNull())
    wrong = is_set & odd
    res = F.when(wrong, None).when(o.eqNullSafe(t), F.when(o.eqNullSafe(b), "unchanged").otherwise("same-change")).when(o.eqNullSafe(b), "theirs").when(t.eqNullSafe(b), "ours").when(is_set, "set-merge")
    rows = rows.withColumn("resolution", res)
    won = lambda c: F.when(F.col("resolution").isin("unchanged", "same-change", "ours"), F.col(f"ours_{c}")).when(F.col("resolution") == "theirs", F.col(f"theirs_{c}"))
    as_list = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    union = merged_items(*(F.col(f"{s}_items") for s in SIDES))
    value = F.when(F.col("resolution") == "set-merge", as_list(union)).when(is_set & won("items").isNotNull(), as_list(F.array_distinct(won("items")))).otherwise(won("json"))
    present = F.when(F.col("resolution") == "set-merge", True).otherwise(won("present"))
    conflict = F.when(F.col("resolution").isNull(), F.when(wrong, "frontmatter.type-conflict").when(F.col("field") == "\0body", "body.concurrent-change").otherwise("frontmatter.concurrent-change"))
    return rows.withColumns({"candidate_present": F.coalesce(present, F.lit(False)), "candidate_json": value, "conflict": conflict})


def merge_fields(base: DataFrame, ours: DataFrame, theirs: DataFrame, config: dict) -> DataFrame:
    """Resolved fields of all paths; a body is the field ``\\0body``, always manual."""
    rows = strategies(align(base, ours, theirs), {**config, "fields": {**config.get("fields", {}), "\0body": {"strategy": "manual"}}})
    return resolve(rows.withColumns({f"{s}_items": items_of(f"{s}_json") for s in SIDES}))


def merge_states(resolved: DataFrame) -> DataFrame:
    """path, state, decisions, conflicts of each path."""
    return resolved.groupBy("path").agg(F.count(F.when(F.col("conflict").isNull(), 1)).alias("decisions"), F.count("conflict").alias("conflicts")).withColumn("state", F.when(F.col("conflicts") > 0, "conflict").otherwise("clean"))


# -- plans of single notes, built on the driver from the same rules --------------------------------


def check_input(path: str, revisions: dict[str, str]) -> None:
    import posixpath

    if not path.endswith(".md") or path.startswith("/") or "\\" in path or posixpath.normpath(path) != path or path.startswith(".."):
        raise MergeError(f"{path!r} must be a normalised relative path of a note")
    for side, revision in revisions.items():
        if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", revision):
            raise MergeError(f"revision of {side} must be 40 or 64 hex digits")


def _snapshot(present: bool, value: str | None) -> dict[str, Any]:
    return {"present": True, "value": json.loads(value)} if present else {"present": False}


def _body_snapshot(body: str) -> dict[str, Any]:
    return {"sha256": text_hash(body.encode()), "length": len(body)}


def plan_merge(spark, manifest: Manifest, path: str, contents: dict[str, bytes], revisions: dict[str, str]) -> dict[str, Any]:
    """A merge plan: decisions, conflicts, and the candidate if there are none. Equal inputs give equal plans."""
    from .parse import parse_bytes

    check_input(path, revisions)
    notes = {s: parse_bytes(contents[s], manifest.legacy_colons) for s in SIDES}
    tables = {s: spark.createDataFrame([(path, k, canonical(v)) for k, v in props.items()] + [(path, "\0body", canonical(body))], "path string, field string, value_json string") for s, (props, body) in notes.items()}
    rows = merge_fields(tables["base"], tables["ours"], tables["theirs"], manifest.raw.get("merge", {})).collect()
    fields = sorted((r for r in rows if r.field != "\0body"), key=lambda r: r.field)
    body = next(r for r in rows if r.field == "\0body")
    decisions, conflicts, properties = [], [], {}
    for r in [*fields, body]:
        is_body = r is body
        location = "body" if is_body else f"frontmatter.{r.field}"
        shown = {s: _body_snapshot(notes[s][1]) if is_body else _snapshot(r[f"{s}_present"], r[f"{s}_json"]) for s in SIDES}
        if r.conflict:
            message = {"frontmatter.type-conflict": "a set needs lists on all sides", "body.concurrent-change": "both sides changed the body"}.get(r.conflict, "both sides changed the field")
            conflicts.append({"id": digest([r.conflict, path, location]), "kind": r.conflict, "path": path, "location": location, "strategy": r.strategy, "message": message, **shown})
            continue
        if not is_body and r.candidate_present:
            properties[r.field] = json.loads(r.candidate_json)
        candidate = _body_snapshot(json.loads(r.candidate_json)) if is_body else _snapshot(r.candidate_present, r.candidate_json)
        decisions.append({"location": location, "strategy": r.strategy, "resolution": r.resolution, "candidate": candidate})
    candidate = None
    if not conflicts:
        text = json.loads(body.candidate_json)
        candidate = {"properties": properties, "body": text, "contentHash": digest({"properties": properties, "body": text})}
    core = {
        "schemaVersion": PLAN_SCHEMA, "vaultId": manifest.vault_id, "path": path, "engineVersion": __version__, "manifestDigest": manifest.digest,
        "inputs": {s: {"revision": revisions[s], "sourceHash": text_hash(contents[s])} for s in SIDES},
        "state": "conflict" if conflicts else "clean", "decisions": decisions, "conflicts": conflicts, "candidate": candidate,
    }
    return core | {"planId": digest(core)}


def verify_plan(plan: dict[str, Any]) -> dict[str, Any]:
    """The plan, if its digests hold."""
    core = {k: v for k, v in plan.items() if k != "planId"}
    if plan.get("schemaVersion") != PLAN_SCHEMA or plan.get("planId") != digest(core):
        raise MergeError("the plan was changed or isn't a merge plan")
    candidate = plan.get("candidate")
    if candidate and candidate["contentHash"] != digest({"properties": candidate["properties"], "body": candidate["body"]}):
        raise MergeError("the candidate doesn't fit its hash")
    return plan
