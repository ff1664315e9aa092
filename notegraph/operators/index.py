"""Snapshot differences, upserts and counts of the materialised index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stat_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (``changed`` with new paths included, ``removed``) between two listings (path, mtime_ns, size, escaped)."""
    a = old.select("path", F.struct("mtime_ns", "size", "escaped").alias("was"))
    b = new.select("path", F.struct("mtime_ns", "size", "escaped").alias("now"))
    rows = a.join(b, "path", "full_outer")
    return rows.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def upsert(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "path") -> DataFrame:
    """``old`` without the rows of ``touched`` keys, and ``new``: what the index holds next."""
    return old.join(touched.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def counts(nodes: DataFrame, edges: DataFrame, files: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: nodes, edges, files, postings, terms."""
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias(what))
    terms = postings.agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"))
    parts = [n(nodes, "nodes"), n(edges, "edges"), n(files, "files"), terms]
    named = [p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c))])).alias("what", "n")) for p in parts]
    union = named[0]
    for p in named[1:]:
        union = union.unionByName(p)
    pick = lambda c: F.max(F.when(F.col("what") == c, F.col("n"))).alias(c)
    return union.agg(*(pick(c) for c in ("nodes", "edges", "files", "postings", "terms")))
