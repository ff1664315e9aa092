"""Edges: resolving targets, assembling, incoming and orphan nodes, neighbours, cycles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..session import Stored, stored
from .heavy import heavy_keys, spread_join


def basename_index(ids: DataFrame) -> DataFrame:
    """name, target for names that exactly one id ends with."""
    named = ids.select(F.element_at(F.split("id", "/"), -1).alias("name"), "id").distinct()
    return named.groupBy("name").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "target")


def resolve(links: DataFrame, ids: DataFrame) -> DataFrame:
    """``links`` with target and resolved: the exact id, else the id as seen from the source's folder, else the only
    note of that name; else the target as written. Wikilinks to files that aren't notes are dropped.

    Links are stored, as making them is Python work. Distinct targets are looked up, and what is found comes back to the links by
    joins that don't gather those of a popular target, or without one, in one task.
    """
    links = stored(links, "links")
    known = ids.select("id").distinct()
    hot = heavy_keys(links, "clean_target")
    wanted = links.select(F.explode(F.array("clean_target", "relative_target")).alias("wanted")).where("wanted is not null").distinct()
    hits = wanted.join(known.withColumnRenamed("id", "wanted"), "wanted", "left_semi").select("wanted", F.lit(True).alias("hit"))
    targets = links.select("clean_target").where("clean_target is not null").distinct().withColumn("name", F.element_at(F.split("clean_target", "/"), -1))
    found = (
        targets.join(hits.select(F.col("wanted").alias("clean_target"), F.col("hit").alias("exact")), "clean_target", "left")
        .join(basename_index(known).withColumnRenamed("target", "by_name"), "name", "left")
        .select("clean_target", "exact", "by_name")
    )
    rows = spread_join(links, found, "clean_target", hot, F.struct("id", "pos"), ["exact", "by_name"])
    rows = spread_join(rows, hits.select(F.col("wanted").alias("relative_target"), F.col("hit").alias("near")), "relative_target", heavy_keys(links, "relative_target"), F.struct("id", "pos"), ["near"])
    best = F.when(F.col("exact"), F.col("clean_target")).when(F.col("near"), F.col("relative_target"))
    rows = rows.where(best.isNotNull() | ~((F.col("syntax") == "wikilink") & F.col("foreign")))
    best = F.coalesce(best, F.col("by_name"))
    return rows.select(*links.columns, F.coalesce(best, F.col("clean_target")).alias("target"), best.isNotNull().alias("resolved"))


def positioned(edges: DataFrame) -> DataFrame:
    """``edges`` with position: the place among the edges of the source by relation, target, provenance."""
    order = Window.partitionBy("source").orderBy("relation", "target", "provenance", F.col("source_location").asc_nulls_first())
    return edges.withColumn("position", (F.row_number().over(order) - 1).cast("int"))


def incoming(edges: DataFrame) -> DataFrame:
    """id, source, relation, provenance for every edge that points at ``id``, a row each: a popular target has millions."""
    return edges.select(F.col("target").alias("id"), "source", "relation", "provenance").where("id is not null")


def incoming_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def without_incoming(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge points at; a node that points at itself isn't one of them."""
    return nodes.join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def neighbors(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 1, direction: str = "both", limit: int = 20) -> DataFrame:
    """id, path, kind, title, distance, edges (field and direction from the previous ring), truncated; nearest first.

    A round joins only the last ring with the edges; rings are small tables of ids, and up to three
    rounds need no iteration on the driver.
    """
    if not 1 <= depth <= 3:
        raise QueryError("depth must be from 1 to 3")
    if direction not in ("in", "out", "both"):
        raise QueryError("direction must be in, out or both")
    if limit <= 0:
        raise QueryError("limit must be positive")
    start = target.strip().removesuffix(".md")
    ids = nodes.select("id")
    live = edges.where("resolved").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    out = live.select(F.col("source").alias("at"), F.col("target").alias("id"), F.struct(F.col("relation").alias("field"), F.lit("out").alias("direction")).alias("edge"))
    back = live.select(F.col("target").alias("at"), F.col("source").alias("id"), F.struct(F.col("relation").alias("field"), F.lit("in").alias("direction")).alias("edge"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    seen = ids.where(F.col("id") == start)
    if not seen.take(1):
        raise QueryError(f"no note {target!r}")
    ring, found = seen, None
    for level in range(1, depth + 1):
        got = steps.join(ring.withColumnRenamed("id", "at"), "at", "left_semi").join(seen, "id", "left_anti")
        ring_edges = got.groupBy("id").agg(F.array_sort(F.collect_set("edge")).alias("edges")).withColumn("distance", F.lit(level))
        if level < depth:  # the next round reads it several times
            ring_edges = Stored(ring_edges, "ring").df
        found = ring_edges if found is None else found.unionByName(ring_edges)
        ring = ring_edges.select("id")
        seen = seen.unionByName(ring)
    rows = found.join(nodes.select("id", "path", "kind", "title"), "id").orderBy("distance", "path").limit(limit + 1)
    rank = F.row_number().over(Window.orderBy("distance", "path"))
    rows = rows.withColumn("rank", rank).withColumn("truncated", F.max("rank").over(Window.partitionBy()) > limit)
    return rows.where(F.col("rank") <= limit).orderBy("rank").drop("rank")


def _least_before_loops(links: pa.Table, labels: pa.Table) -> pa.Table:
    """One row, relation and id, if one of ``links`` leads to a loop: the least label of the nodes left when those without a way on are peeled off."""
    n = links.num_rows
    ends = pa.chunked_array([*links["source"].chunks, *links["target"].chunks], links.schema.field("source").type).cast(pa.large_string()).combine_chunks().dictionary_encode()
    codes = ends.indices.to_numpy()
    source, target = codes[:n], codes[n:]
    ways = np.bincount(source, minlength=len(ends.dictionary)).tolist()
    order = np.argsort(target, kind="stable")
    begin = np.searchsorted(target[order], np.arange(len(ways) + 1)).tolist()
    before = source[order].tolist()
    sinks = [x for x, k in enumerate(ways) if k == 0]
    while sinks:
        x = sinks.pop()
        for y in before[begin[x] : begin[x + 1]]:
            ways[y] -= 1
            if not ways[y]:
                sinks.append(y)
    left = ends.dictionary.filter(pa.array([k > 0 for k in ways], pa.bool_()))
    least = pc.min(labels["least"].filter(pc.is_in(labels["id"].cast(pa.large_string()), left))).as_py()
    found = [] if least is None else [least]
    return pa.table({"relation": pa.array(labels["relation"].to_pylist()[:1] if found else [], pa.string()), "id": pa.array(found, pa.string())})


def cycles(edges: DataFrame, max_rounds: int = 10_000, room: int = 1_000_000) -> DataFrame:
    """relation, id: for each relation with a loop the least node from which one can be reached.

    ``edges`` has relation, source, target. Nodes without a way on are peeled off until every node has one; nodes
    nothing points at hand their least id on and go, too. A node with a single way on jumps over the next one if
    that has a single way on as well, so chains and trees of any depth take logarithmically many rounds. Each round is
    a table in the shared folder. As soon as links and labels have at most ``room`` rows, a task a relation peels off the rest.
    """
    step = edges.select("relation", "source", "target").where("source is not null and target is not null").distinct()
    names = step.select("relation", F.explode(F.array("source", "target")).alias("id")).distinct()
    links, labels = Stored(step, "links"), Stored(names.select("relation", "id", F.col("id").alias("least")), "labels")
    for _ in range(max_rounds):
        e, lab = links.df, labels.df
        if e.count() + lab.count() <= room:
            result = e.groupBy("relation").cogroup(lab.groupBy("relation")).applyInArrow(_least_before_loops, "relation string, id string")
            return Stored(result, "cycles").df
        out = F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"), F.col("target").alias("next"))
        into = F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(None).cast("string").alias("next"))
        degree = e.select("relation", F.explode(F.array(out, into)).alias("x")).groupBy("relation", "x.id").agg(F.sum("x.out").alias("out"), F.sum("x.into").alias("into"), F.max("x.next").alias("next"))
        goes = (F.col("out") == 0) | (F.col("into") == 0)
        seen = Observation()
        ranked = Stored(degree.withColumn("gone", goes).observe(seen, F.count(F.when(F.col("out") == 0, 1)).alias("sinks")), "degrees")
        if not seen.get["sinks"]:
            result = ranked.df.select("relation", "id").join(lab, ["relation", "id"]).groupBy("relation").agg(F.min("least").alias("id"))
            return Stored(result, "cycles").df
        at = lambda side: ranked.df.select("relation", F.col("id").alias(side), F.col("gone").alias(f"{side}_gone"), F.col("out").alias(f"{side}_out"), F.col("next").alias(f"{side}_next"))
        known = e.join(at("source"), ["relation", "source"]).join(at("target"), ["relation", "target"])
        handed = known.where("source_gone and not target_gone").join(lab.withColumnRenamed("id", "source"), ["relation", "source"]).select("relation", F.col("target").alias("id"), "least")
        jump = F.when((F.col("source_out") == 1) & (F.col("target_out") == 1), F.col("target_next")).otherwise(F.col("target"))
        moved = known.where("not source_gone and not target_gone").select("relation", "source", jump.alias("target"))
        left = ranked.df.where("not gone").select("relation", "id")
        moved = moved.join(left.withColumnRenamed("id", "target"), ["relation", "target"], "left_semi").select("relation", "source", "target").distinct()
        kept = lab.join(left, ["relation", "id"], "left_semi").select("relation", "id", "least").unionByName(handed)
        later = Stored(moved, "links"), Stored(kept.groupBy("relation", "id").agg(F.min("least").alias("least")), "labels")
        for old in (links, labels, ranked):
            old.drop()
        links, labels = later
    raise RuntimeError("the graph didn't shrink to nothing")
