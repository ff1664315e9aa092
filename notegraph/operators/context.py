"""Context packing: snippets, groups, and a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .parse import prop
from .search import iso_date

TICKET = r"(?<![\p{L}\p{N}_])(adhoc-\d{4}-\d{2}-\d{2}-[A-Za-z0-9._-]+|[A-Za-z]{2,}-\d{2,})(?![\p{L}\p{N}_])"
# Defaults of context policy.
BUDGET, SNIPPET_LINES, SNIPPET_CHARACTERS, NOTES_PER_GROUP = 12_000, 2, 220, 2
INACTIVE = ("archived", "superseded")


def snippets(tokens: list[str], n_lines: int = SNIPPET_LINES, n_characters: int = SNIPPET_CHARACTERS, fallback_to_title: bool = True) -> Column:
    """The first stripped lines that hold a token, cut to length; else the title."""
    if n_lines == 0:
        return F.array().cast("array<string>")
    wanted = lambda line: F.exists(F.lit(tokens), lambda t: F.contains(F.lower(line), t)) if tokens else F.lit(True)
    lines = F.filter(F.transform(X.lines(F.coalesce("body", F.lit(""))), X.strip), lambda line: (line != "") & wanted(line))
    cut = F.transform(F.slice(lines, 1, n_lines), lambda line: F.substring(line, 1, n_characters))
    if not fallback_to_title:
        return cut
    return F.when(F.size(cut) > 0, cut).when(F.coalesce("title", F.lit("")) != "", F.array(F.substring("title", 1, n_characters))).otherwise(cut)


def ticket(path: Column) -> Column:
    """The ticket of the first path segment that has one, null without any."""
    found = F.transform(F.split(path, "/"), lambda s: F.regexp_extract(s, TICKET, 1))
    return F.get(F.filter(found, lambda t: t != ""), F.lit(0))


def text_prop(name: str) -> Column:
    return F.when(prop(name, "json_type") == "string", prop(name, "value_text"))


def group_key(config: dict) -> Column:
    """First field with a string that isn't blank, else the ticket, both in the case wanted; else the path."""
    keys = [F.when(X.strip(text_prop(f)) != "", X.strip(text_prop(f))) for f in config.get("fields", [])]
    if config.get("pathToken") == "ticket":
        keys.append(ticket(F.col("path")))
    found = F.coalesce(*keys)
    case = {"upper": F.upper, "lower": F.lower}.get(config.get("keyCase", "preserve"), lambda c: c)
    return F.coalesce(case(found), F.col("path"))


def freshness_key(config: dict) -> Column:
    dated = [F.when(iso_date(text_prop(f)).isNotNull() & (F.length(text_prop(f)) <= 10), text_prop(f)) for f in config.get("freshnessFields", ("updated", "created"))]
    return F.coalesce(*dated, F.lit(""))


def grouped(hits: DataFrame, config: dict, limit: int) -> DataFrame:
    """The hits kept of the best ``limit`` groups: key, group_rank, place, group_score, count, representative, top_match.

    Members stand active first, then newest, best, by path; a group ranks by its best score, then key. Groups are
    summed up by an aggregation with partial results, so a group of any size is one row for each task; only the best groups'
    members are looked at again, and of them each task passes on no more than a group shows.
    """
    status = F.col("status") if "status" in hits.columns else text_prop(config.get("statusField", "status"))
    keyed = hits.withColumn("key", group_key(config)).withColumn("fresh", freshness_key(config)).withColumn("inactive", F.coalesce(status.isin(list(config.get("inactiveStatuses", INACTIVE))), F.lit(False)))
    groups = keyed.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("worse"), "path")).alias("best"), F.count(F.lit(1)).alias("count"))
    groups = groups.select("key", (-F.col("best.worse")).alias("group_score"), F.col("best.path").alias("best"), "count").orderBy(F.col("group_score").desc(), "key").limit(limit)
    groups = groups.withColumn("group_rank", F.row_number().over(Window.orderBy(F.col("group_score").desc(), "key")))
    members = keyed.join(F.broadcast(groups), "key")
    order = Window.partitionBy("key").orderBy("inactive", F.col("fresh").desc(), F.col("score").desc(), "path")
    rows = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.get("notesPerGroup", NOTES_PER_GROUP))
    first = F.min(F.when(F.col("place") == 1, F.col("path"))).over(Window.partitionBy("key"))
    return rows.withColumn("representative", first).withColumn("top_match", F.when(F.col("best") != F.col("representative"), F.col("best"))).drop("fresh", "inactive", "best")


def packed(rows: DataFrame, order: list[str], budget: int = BUDGET) -> DataFrame:
    """Rows in ``order`` up to the first that would pass the budget: with cost and used characters.

    The rows are the hits of one answer, at most the limit times the notes of a group, so one window is right.
    """
    cost = F.length("path") + F.length("title") + F.aggregate("snippets", F.lit(0), lambda a, s: a + F.length(s))
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cost", cost).withColumn("used", F.sum("cost").over(running)).where(F.col("used") <= budget)


def context(hits: DataFrame, tokens: list[str], config: dict | None = None, limit: int = 8) -> DataFrame:
    """The packed context of ranked hits, with snippets and, if the policy groups, group columns."""
    config = config or {}
    grouping = config.get("grouping")
    if grouping:
        rows, order = grouped(hits, grouping, limit), ["group_rank", "place"]
    else:
        rows = hits.orderBy(F.col("score").desc(), "path").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")))
        order = ["rank"]
    text = snippets(tokens, config.get("snippetLines", SNIPPET_LINES), config.get("snippetCharacters", SNIPPET_CHARACTERS), config.get("fallbackToTitle", True))
    return packed(rows.withColumn("snippets", text), order, config.get("maxCharacters", BUDGET)).orderBy(*order)
