"""Items that appear together: pair counts over baskets of any size, and association scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.current import latest
from ..operators.heavy import spread_join
from ..session import Stored


def fold_tag(tag: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", tag).strip().lstrip("#").strip().lower())


def tag_baskets(nodes: DataFrame) -> DataFrame:
    """basket (path), items (sorted distinct folded tags, none empty) of each current node that has any tag."""
    rows = latest(nodes.select("path", "indexed_at", "source_hash", "tags"), "path", "indexed_at", "source_hash", "tags")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str] = {}
        for b in batches:
            items = []
            for tags in b.column(1).to_pylist():
                for t in tags:
                    if t is not None and t not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[t] = fold_tag(t)
                items.append(sorted({seen[t] if t in seen else fold_tag(t) for t in tags if t is not None} - {""}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.string()))], names=["basket", "items"])

    got = rows.where(F.size("tags") > 0).select("path", "tags").mapInArrow(fold, "basket string, items array<string>")
    return got.where(F.size("items") > 0)


def pair_counts(baskets: DataFrame, min_together: int = 1, chunk: int = 64, hot_share: float = 0.001) -> DataFrame:
    """item_a, item_b (a < b), together, n_a, n_b, n_baskets for each pair on at least ``min_together`` baskets.

    ``items`` must be distinct. Items on fewer than ``min_together`` baskets can't be in such a
    pair and leave the baskets first. A basket is cut into chunks of at most ``chunk`` items, and
    each pair of chunks becomes a row of its own that goes to any task, so a huge basket is spread and no
    row yields more than chunk squared pairs. Pairs are counted within tasks before the shuffle. Joins by item
    don't gather an item that holds more than ``hot_share`` of the rows: there are at most 1/``hot_share`` such items,
    whose counts are broadcast.
    """
    place = baskets.select("basket", F.ceil(F.size("items") / F.lit(chunk)).cast("int").alias("parts"), F.posexplode("items").alias("pos", "item"))
    items = place.select("basket", "parts", F.floor(F.col("pos") / F.lit(chunk)).cast("int").alias("part"), "item")
    counts = Stored(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items").df
    hot = counts.where(F.col("n") > F.lit(hot_share * (counts.agg(F.sum("n")).first()[0] or 0))).select(F.col("item").alias("key"))
    frequent = counts.where(F.col("n") >= min_together)
    n_baskets = baskets.count()
    kept = spread_join(items, frequent, "item", hot, F.col("basket"), ["n"]).where("n is not null")
    chunks = kept.groupBy("basket", "parts", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    large = chunks.where("parts > 1")
    first = large.where("part < parts - 1").select("basket", "items", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("other"))
    second = large.select("basket", F.col("part").alias("other"), F.col("items").alias("more"))
    crossed = first.join(second, ["basket", "other"])

    within = chunks.select("items").where(F.size("items") > 1)
    pairs = within.select(F.posexplode("items").alias("i", "a"), "items").select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    across = crossed.select(F.explode("items").alias("a"), "more").select("a", F.explode("more").alias("b"))
    pairs = pairs.unionByName(across).select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    together = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= min_together)
    for own, other, n in (("item_a", "item_b", "n_a"), ("item_b", "item_a", "n_b")):
        together = spread_join(together, frequent.select(F.col("item").alias(own), F.col("n").alias(n)), own, hot, F.col(other), [n])
    return together.select("item_a", "item_b", "together", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"))


def associations(baskets: DataFrame, min_together: int = 1, chunk: int = 64) -> DataFrame:
    """``pair_counts`` with lift (observed over expected), pmi, npmi and the log-likelihood ratio g2."""
    k, a, b, n = (F.col(x).cast("double") for x in ("together", "n_a", "n_b", "n_baskets"))
    lift = k * n / (a * b)
    x_logx = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    g2 = 2 * (x_logx(k, a * b / n) + x_logx(a - k, a * (n - b) / n) + x_logx(b - k, (n - a) * b / n) + x_logx(n - a - b + k, (n - a) * (n - b) / n))
    pmi = F.log2(lift)
    return pair_counts(baskets, min_together, chunk).select("*", lift.alias("lift"), pmi.alias("pmi"), F.when(k < n, pmi / -F.log2(k / n)).otherwise(F.lit(1.0)).alias("npmi"), g2.alias("g2"))


def associated_tags(nodes: DataFrame, min_together: int = 5, factor: int = 4, chunk: int = 64) -> DataFrame:
    """tag_a, tag_b of tags together on at least ``min_together`` current nodes and more than ``factor``
    times as often as chance. Null tags and nodes without tags don't count."""
    rows = associations(Stored(tag_baskets(nodes), "baskets").df, min_together, chunk)
    wide = lambda x: F.col(x).cast("decimal(18,0)")
    return rows.where(wide("together") * wide("n_baskets") > F.lit(factor).cast("decimal(2,0)") * (wide("n_a") * wide("n_b"))).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))
