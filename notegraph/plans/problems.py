"""Queries of the general problems on the given tables: changed records, hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import changes, hierarchy
from ..session import read_table, shared_dir


def _run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of a fresh log over the changes; the result is what its sink holds."""
    tables = [read_table(spark, sf_dir, t) for t in ("files", "nodes", "index_state", "index_runs")]
    log = changes.ChangeLog(spark, f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}")
    log.run(lambda captured: changes.detect_changes(*tables, captured))
    got = log.results()
    return got if got is not None else spark.createDataFrame([], changes.RECORD)


def queries() -> dict:
    return {
        "p6_found": lambda s, d: _run_changes(s, d).select("path", "state"),
        "p6_changes": lambda s, d: changes.detect_changes(*(read_table(s, d, t) for t in ("files", "nodes", "index_state", "index_runs"))),
        "p7_found": lambda s, d: hierarchy.hierarchy(read_table(s, d, "edges")).select("id", "root", "depth"),
        "p7_tree": lambda s, d: hierarchy.hierarchy(read_table(s, d, "edges"), with_path=True).select("id", "parent", "root", "depth", "size", "path"),
        "p7_several_parents": lambda s, d: hierarchy.several_parents(read_table(s, d, "edges")),
        "p7_descendants": lambda s, d: _descendants(s, d),
    }


def _descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node of a tree, as ancestor, id, distance."""
    from ..session import Stored

    tree = Stored(hierarchy.hierarchy(read_table(spark, sf_dir, "edges")), "tree").df
    return hierarchy.descendants(tree, tree)


_CHANGES = """
WITH f AS (SELECT path, mtime_ns, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY listed_at DESC) AS rn FROM files) WHERE rn = 1 AND path IS NOT NULL),
n AS (SELECT path, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM nodes) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_id DESC) AS rn FROM index_state WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok')) WHERE rn = 1),
j AS (SELECT f.path, f.mtime_ns, f.size, n.source_hash,
        CASE WHEN s.path IS NULL THEN 'added'
             WHEN CASE WHEN n.source_hash IS NOT NULL AND s.source_hash IS NOT NULL THEN n.source_hash <> s.source_hash
                       ELSE f.mtime_ns IS DISTINCT FROM s.mtime_ns OR f.size IS DISTINCT FROM s.size END THEN 'changed' END AS state
      FROM f LEFT JOIN n USING (path) LEFT JOIN s USING (path))"""

_TREE = """
WITH RECURSIVE links AS (
    SELECT CASE WHEN field = 'parent' THEN src ELSE dst END AS id, CASE WHEN field = 'parent' THEN dst ELSE src END AS parent
    FROM edges WHERE resolved AND field IN ('parent', 'children')),
up AS (SELECT id, min(parent) AS parent FROM links GROUP BY id),
ids AS (SELECT id FROM links UNION SELECT parent FROM links),
tree AS (SELECT id, CAST(NULL AS VARCHAR) AS parent, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM ids WHERE id NOT IN (SELECT id FROM up)
    UNION ALL SELECT up.id, up.parent, tree.root, tree.depth + 1, tree.path || ' > ' || up.id FROM up JOIN tree ON up.parent = tree.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _CHANGES + " SELECT path, state FROM j WHERE state IS NOT NULL",
        "p6_changes": _CHANGES + " SELECT path, state, mtime_ns, size, source_hash FROM j WHERE state IS NOT NULL",
        "p7_several_parents": _TREE.partition(",\nup AS")[0] + " SELECT id, min(parent) AS parent FROM links GROUP BY id HAVING count(DISTINCT parent) > 1",
        "p7_tree": _TREE + """, anc AS (SELECT id AS ancestor, id, CAST(0 AS BIGINT) AS distance FROM tree UNION ALL SELECT ancestor, up.id, distance + 1 FROM anc JOIN up ON up.parent = anc.id),
            sizes AS (SELECT ancestor AS id, count(*) AS size FROM anc GROUP BY 1)
            SELECT ids.id, up.parent, coalesce(root, '(cycle)') AS root, coalesce(depth, -1) AS depth, size, path FROM ids LEFT JOIN tree ON tree.id = ids.id LEFT JOIN up ON up.id = ids.id LEFT JOIN sizes ON sizes.id = ids.id""",
        "p7_descendants": _TREE + """, anc AS (SELECT id AS ancestor, id, CAST(0 AS BIGINT) AS distance FROM tree UNION ALL SELECT ancestor, up.id, distance + 1 FROM anc JOIN up ON up.parent = anc.id)
            SELECT ancestor, id, distance FROM anc WHERE distance > 0""",
        "p7_found": _TREE + " SELECT ids.id, coalesce(root, '(cycle)') AS root, coalesce(depth, -1) AS depth FROM ids LEFT JOIN tree ON tree.id = ids.id",
    }
