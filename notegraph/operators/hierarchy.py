"""Parent-child rows to full hierarchies by nested-set ranges, with loops told.

Subtree sizes go up, then every node gets its range of the preorder by prefix sums over siblings, handed down. Depth and
root are read from the ranges alone: the depth of a node is its place less the number of ranges that end before it,
its root the last tree that begins at or before it. What the upward pass can't process lies on a loop or below one.

Both passes jump: after round k a row knows the node 2^k levels up and the sums between, so rounds are as many as the
*logarithm* of the depth, and rows that have arrived take no part in later ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import Stored

CYCLE = "(cycle)"
MAX_ROUNDS = 64


def parent_links(edges: DataFrame) -> DataFrame:
    """id, parent, n_parents of the resolved ``parent`` and ``children`` edges, each node once.

    Links stated several times or from both ends collapse. A node with several parents, which is no tree, keeps
    the least one; ``n_parents`` tells (two stands for two or more). Nodes that only occur as a parent have a null parent. Edges
    without source or target state nothing.
    """
    stated = edges.where(F.col("resolved") & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("field").isin("parent", "children"))
    up = F.col("field") == "parent"
    links = stated.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("id"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("parent"))
    nodes = links.select(F.explode(F.array(F.struct("id", "parent"), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))).alias("x")).select("x.*")
    least, most = F.min("parent"), F.max("parent")
    return nodes.groupBy("id").agg(least.alias("parent"), F.when(least.isNull(), 0).when(least == most, 1).otherwise(2).alias("n_parents"))


def _stored(df: DataFrame, name: str, what: Column, most: int | None = None) -> tuple[DataFrame, int, Stored]:
    """The stored table and how many of its rows ``what`` holds for, counted while they're written.

    ``most`` bounds its rows where that's known, so that small tables don't become many files."""
    seen = Observation()
    if most is not None:
        df = df.coalesce(max(1, -(-most // 250_000)))
    table = Stored(df.observe(seen, F.count(F.when(what, 1)).alias("n")), name)
    return table.df, seen.get["n"], table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, parent, size of the nodes of trees, and id, parent of those on or below a loop.

    In round k the rows still there are those at least 2^k levels deep. Each hands the nodes it has counted to the node
    2^k levels up, summed within tasks first, so a parent of millions costs one row for each task. Rows that stay for
    ever, as many as in the round before, have no end.
    """
    links, _, _ = _stored(links, "links", F.lit(True))
    live, n, _ = _stored(links.where("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "up", F.lit(True))
    rounds, endless = [live], False
    while n and not endless and len(rounds) <= MAX_ROUNDS:
        given = live.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        grown = live.join(given, "id", "left").select("id", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        above = live.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        later, left, _ = _stored(grown.join(above, "up").select("id", F.col("up2").alias("up"), "size"), "up", F.lit(True), n)
        endless, n, live = left == n, left, later
        rounds.append(live)
    loops = links.join(live.select("id"), "id", "left_semi").select("id", "parent")
    trees = links.join(live.select("id"), "id", "left_anti")
    got = _union([x.select(F.col("up").alias("id"), "size") for x in rounds]).groupBy("id").agg(F.sum("size").alias("more"))
    return trees.join(got, "id", "left").select("id", "parent", (F.lit(1) + F.coalesce("more", F.lit(0))).cast("long").alias("size")), loops


def sibling_offsets(sized: DataFrame, buckets: int = 256) -> DataFrame:
    """id, parent, size, offset: the sizes of the siblings that come earlier, and 1 more for the parent itself.

    Roots are siblings of one another, so that all trees share one preorder. Siblings are ordered by a bucket (hash of the
    id), then by id. A first window runs within a bucket of siblings, a second over the sums of at most ``buckets``
    buckets, so that no task holds all children of a hot parent.
    """
    own = sized.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).withColumn("at", F.coalesce("parent", F.lit("")))
    own = own.withColumn("is_root", F.col("parent").isNull())
    inside = Window.partitionBy("is_root", "at", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    within = own.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    sums = own.groupBy("is_root", "at", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("is_root", "at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("is_root", "at", "bucket", (F.sum("bucket_size").over(before) - F.col("bucket_size")).alias("before"))
    offset = F.col("before") + F.col("within") + F.when(F.col("is_root"), 0).otherwise(1)
    return within.join(starts, ["is_root", "at", "bucket"]).select("id", "parent", "size", offset.cast("long").alias("offset"))


def _handed_down(rows: DataFrame, value: str, together: Column) -> DataFrame:
    """``rows`` (id, up, ...) with ``value`` combined along the whole way to the root: ``together`` makes one of ``above`` and
    ``value``. A row that has reached the root stays as it is and is only looked up by others."""
    keep = [c for c in rows.columns if c not in ("id", "up", value)]
    now, n, _ = _stored(rows, "down", F.col("up").isNotNull())
    done = [now.where("up is null")]
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        live = now.where("up is not null")
        above = _union([x.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col(value).alias("above")) for x in (*done, live)])
        now, n, _ = _stored(live.join(above, "up").select("id", F.col("up2").alias("up"), together.alias(value), *keep), "down", F.col("up").isNotNull(), n)
        done.append(now.where("up is null"))
    return _union(done).select("id", value, *keep)


def preorder(offsets: DataFrame) -> DataFrame:
    """id, first, parent, size: the place of each node in the preorder, the sum of the offsets on its way from the root."""
    rows = offsets.select("id", F.col("parent").alias("up"), F.col("offset").alias("first"), "parent", "size")
    return _handed_down(rows, "first", F.col("above") + F.col("first"))


def paths(placed: DataFrame, separator: str = " > ") -> DataFrame:
    """id, path: the ids from the root down to the node."""
    return _handed_down(placed.select("id", F.col("parent").alias("up"), F.col("id").alias("path")), "path", F.concat_ws(separator, "above", "path"))


def from_ranges(ranges: DataFrame, n: int, max_cells: int = 65_536) -> DataFrame:
    """``ranges`` (id, first, size, ...) with root and depth, both told by the ranges.

    The preorder is cut into at most ``max_cells`` cells. A window within a cell counts the ranges that end and finds the
    last tree that begins; a second one carries both over the cells.
    """
    cell = max(4096, -(-n // max_cells))
    columns = [c for c in ranges.columns if c not in ("id", "first", "size", "parent")]
    begin = ranges.select(F.col("first").alias("pos"), F.lit(1).alias("kind"), F.when(F.col("parent").isNull(), F.struct("first", "id")).alias("tree"), F.struct("id", "first", "size", "parent", *columns).alias("node"))
    end = ranges.select((F.col("first") + F.col("size")).alias("pos"), F.lit(0).alias("kind"))
    events = begin.unionByName(end, allowMissingColumns=True).withColumn("cell", F.floor(F.col("pos") / cell))
    ends = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0))
    within = Window.partitionBy("cell").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("cell").agg(ends.alias("ends"), F.max("tree").alias("tree")).select("cell", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("ends_before"), F.max("tree").over(earlier).alias("tree_before"))
    rows = events.withColumn("ends", ends.over(within)).withColumn("tree", F.max("tree").over(within)).where("kind = 1").join(carried, "cell")
    return rows.select("node.*", F.coalesce("tree", "tree_before")["id"].alias("root"), (F.col("pos") - F.col("ends_before") - F.col("ends")).cast("long").alias("depth"))


def hierarchy(edges: DataFrame, with_path: bool = False) -> DataFrame:
    """id, parent, root, depth, size, first, last (and path) of every node of a stated hierarchy.

    ``first``..``last`` is the node's range in the preorder of all trees: its descendants are the nodes whose
    ``first`` lies within, its ancestors those whose range holds its ``first``. Nodes on a loop or below one have root
    ``(cycle)``, depth -1 and no size or range. An empty table gives no rows.
    """
    sizes, loops = subtree_sizes(parent_links(edges).select("id", "parent"))
    sized, n, _ = _stored(sizes, "sizes", F.lit(True))
    ranges = preorder(sibling_offsets(sized, max(256, -(-n // 1_000_000))))
    out = from_ranges(ranges, n)
    if with_path:
        out = out.join(paths(sized), "id")
    extra = ["path"] if with_path else []
    out = out.select("id", "parent", "root", "depth", "size", "first", (F.col("first") + F.col("size") - 1).alias("last"), *extra)
    none = lambda kind: F.lit(None).cast(kind)
    told = loops.select("id", "parent", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), none("long").alias("size"), none("long").alias("first"), none("long").alias("last"), *([none("string").alias("path")] if with_path else []))
    return out.unionByName(told)


def several_parents(edges: DataFrame) -> DataFrame:
    """id, parent (the one kept) of the nodes for which more than one parent is stated."""
    return parent_links(edges).where("n_parents > 1").select("id", "parent")


def descendants(tree: DataFrame, of: DataFrame, cell: int = 64, most_cells: int = 4096) -> DataFrame:
    """ancestor, id, distance for all descendants of the nodes ``of`` (column id).

    The range join is an equality join on cells of the preorder within a tree: a queried range touches the cells it spans, a
    node lies in one. Ranges of more than ``most_cells`` cells use cells as many times larger, so that no range becomes a
    long list, and a node only meets its ancestors and the ranges near it. A node is no descendant of itself.
    """
    wanted = tree.join(of.select("id").distinct(), "id", "left_semi").where("size > 1")
    most, sizes = wanted.agg(F.max("size")).first()[0] or 0, [cell]
    while sizes[-1] * most_cells < most:
        sizes.append(sizes[-1] * most_cells)
    level = F.lit(0)
    for k in range(1, len(sizes)):
        level = F.when(F.col("size") > sizes[k - 1] * most_cells, k).otherwise(level)
    width = lambda at: F.element_at(F.lit(sizes), at + 1)
    spans = wanted.withColumn("level", level).select(
        F.col("id").alias("ancestor"), "root", F.col("depth").alias("top"), F.col("first").alias("low"), F.col("last").alias("high"), "level", F.explode(F.sequence(F.floor(F.col("first") / width(F.col("level"))), F.floor(F.col("last") / width(F.col("level"))))).alias("cell")
    )
    inner = tree.where("first is not null").select("id", "root", "depth", F.col("first").alias("at"), F.explode(F.lit(list(range(len(sizes))))).alias("level")).withColumn("cell", F.floor(F.col("at") / width(F.col("level"))))
    return spans.join(inner, ["root", "level", "cell"]).where("at > low and at <= high").select("ancestor", "id", (F.col("depth") - F.col("top")).alias("distance"))


def ancestors(tree: DataFrame, of: DataFrame, cell: int = 64) -> DataFrame:
    """id, ancestor, distance for all ancestors of the nodes ``of`` (column id): the ranges that hold the node's place."""
    pairs = descendants(tree, tree.where("size > 1"), cell)
    return pairs.join(of.select("id").distinct(), "id", "left_semi").select("id", "ancestor", "distance")
