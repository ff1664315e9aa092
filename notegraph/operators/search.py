"""Zone-scored search: exact over all nodes, or through postings with stems and freshness."""

from __future__ import annotations

import datetime
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.globs import matches
from ..functions.stem import stem, stem_terms
from ..manifest import DEFAULT_ZONES, Manifest
from ..schemas import POSTINGS
from .parse import prop

# Fixed values of the ranking.
STEM_WEIGHT = 0.8
STEM_PREFIX = "s:"
CANDIDATES = 200
HALF_LIFE_DAYS, FRESHNESS_WEIGHT = 90.0, 0.15


def stop_words(config: dict) -> list[str]:
    own = [w.lower() for w in config.get("stopWords", [])]
    return list(dict.fromkeys([*(X.STOP_WORDS if config.get("useDefaultStopWords", True) else ()), *own]))


def query_tokens(query: str, stop: list[str] | tuple[str, ...] = X.STOP_WORDS) -> list[str]:
    found = (t.lower() for t in re.findall(r"[^\W_]+", query) if len(t) > 1)
    return list(dict.fromkeys(t for t in found if t not in set(stop)))


def zone_name(zone: dict) -> str:
    return f"property:{zone['field']}" if zone["source"] == "property" else zone["source"]


def zone_text(zone: dict) -> Column:
    """The text of a zone, never null."""
    source = zone["source"]
    if source == "firstHeading":
        text = F.when(F.size("headings") > 0, F.get("headings", F.lit(0))).otherwise(X.humanised(F.col("stem")))
    elif source in ("tags", "headings"):
        text = F.array_join(source, " ")
    elif source == "property":
        text = prop(zone["field"], "value_text")
    elif source == "properties":
        text = F.array_join(F.transform("props", lambda p: F.concat(p["name"], F.lit(" "), p["value_text"])), " ")
    else:
        text = F.col(source)
    return F.coalesce(text, F.lit(""))


def _zone_scores(tokens: list[str], phrase: str, zones: list[dict], stem_count=None) -> list[Column]:
    """Score of each zone, over lower-cased zone columns ``z0``, ``z1``, ..."""
    out = []
    for i, zone in enumerate(zones):
        text, cap, weight = F.col(f"z{i}"), zone.get("countCap", 1), zone["weight"]
        parts = []
        for t in tokens:
            exact = F.least(X.occurrences(text, t), F.lit(cap))
            score = (exact * weight).cast("double")
            if stem_count is not None:
                by_stem = F.least(F.coalesce(stem_count(i, t), F.lit(0)), F.lit(cap)) * (weight * STEM_WEIGHT)
                score = F.when(exact > 0, score).otherwise(by_stem.cast("double"))
            parts.append(score)
        if tokens and phrase and zone.get("phraseWeight", 0):
            parts.append(F.when(F.contains(text, F.lit(phrase)), float(zone["phraseWeight"])).otherwise(0.0))
        out.append(reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0))
    return out


def score(nodes: DataFrame, query: str, zones: list[dict] | tuple[dict, ...] = DEFAULT_ZONES, boosts: list[dict] = (), stop: list[str] | tuple[str, ...] = X.STOP_WORDS, stem_count=None) -> DataFrame:
    """``nodes`` that match, with score (double) and matched_zones. A node without a zone that scores isn't there;
    boosts only raise what matched. All expressions stay in the JVM and in one stage."""
    zones, tokens, phrase = list(zones), query_tokens(query, stop), query.strip().lower()
    rows = nodes.select("*", *(F.lower(zone_text(z)).alias(f"z{i}") for i, z in enumerate(zones)))
    rows = rows.withColumns({f"s{i}": s for i, s in enumerate(_zone_scores(tokens, phrase, zones, stem_count))})
    total = reduce(lambda a, b: a + b, (F.col(f"s{i}") for i in range(len(zones))))
    matched = F.array_compact(F.array(*(F.when(F.col(f"s{i}") != 0, F.lit(zone_name(z))) for i, z in enumerate(zones))))
    raised = reduce(lambda a, b: a + b, (F.when(F.col("kind") == b["kind"] if "kind" in b else matches(F.col("path"), b["path"], tail=True), float(b["weight"])).otherwise(0.0) for b in boosts), F.lit(0.0))
    return rows.withColumn("plain_score", total).where("plain_score <> 0").withColumn("score", F.col("plain_score") + raised).withColumn("matched_zones", matched).select(*nodes.columns, "score", "matched_zones")


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), "path").limit(limit)


def search(nodes: DataFrame, query: str, limit: int | None = 20, manifest: Manifest | None = None, **options) -> DataFrame:
    """The exact mode: every node is scored; no stems, no freshness. Without a limit all hits, in no order."""
    if manifest is not None:
        options = {"zones": manifest.zones, "boosts": manifest.search.get("boosts", []), "stop": stop_words(manifest.search)} | options
    hits = score(nodes, query, **options)
    return hits if limit is None else ranked(hits, limit)


# -- postings ------------------------------------------------------------------------------------


def build_postings(nodes: DataFrame, zones: list[dict] | tuple[dict, ...] = DEFAULT_ZONES, stop: list[str] | tuple[str, ...] = X.STOP_WORDS) -> DataFrame:
    """term, path, zone, count: the tokens of each zone as they are, and their stems where those differ.

    ``nodes`` has a row for each path, so all of a zone's counts are formed within its row: nothing is shuffled. An Arrow batch
    is grouped as a whole, and stems are found once per distinct token of it.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    fields = F.array(*(F.struct(F.lit(i).alias("zone"), F.filter(X.tokens(zone_text(z)), lambda t: ~t.isin(list(stop)) if stop else F.lit(True)).alias("tokens")) for i, z in enumerate(zones)))
    words = nodes.select("path", F.explode(fields).alias("f")).select("path", "f.zone", "f.tokens").where(F.size("tokens") > 0)

    def rows(b, row, term, count):
        return pa.RecordBatch.from_arrays([term, b.column(0).take(row), b.column(1).take(row), count.cast(pa.int32())], names=["term", "path", "zone", "count"])

    def run(batches):
        for b in batches:
            said = pa.table([pc.list_parent_indices(b.column(2)), pc.list_flatten(b.column(2))], names=["row", "term"]).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            row, term, count = (said.column(c).combine_chunks() for c in ("row", "term", "count_all"))
            yield rows(b, row, term, count)
            stem_ = stem_terms(term)
            differs = pc.not_equal(stem_, term)
            stems = pa.table([row.filter(differs), pc.binary_join_element_wise(STEM_PREFIX, stem_.filter(differs), ""), count.filter(differs)], names=["row", "term", "n"]).group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            yield rows(b, *(stems.column(c).combine_chunks() for c in ("row", "term", "n_sum")))

    return words.mapInArrow(run, POSTINGS)


def idf(n: Column | int, df: Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def candidate_scores(postings: DataFrame, n_nodes: int, tokens: list[str], zones: list[dict] | tuple[dict, ...] = DEFAULT_ZONES, stemming: bool = True) -> DataFrame:
    """path, candidate_score: weight x capped count x idf, summed over every indexed term a token stands for.

    A token stands for the terms that begin with it, and, at a lower weight, for those of its stem. Terms are
    matched first, so only the rows of matching terms are counted and summed; idf is that of each term.
    """
    weights = F.lit([float(z["weight"]) for z in zones])
    caps = F.lit([int(z.get("countCap", 1)) for z in zones])
    known = postings.where(F.col("zone") < len(zones))
    factors = []
    for t in tokens:
        factors.append(F.when(F.col("term").startswith(t) & ~F.col("term").startswith(STEM_PREFIX), 1.0).otherwise(0.0))
        if stemming:
            s = stem(t)
            alike = [f"{STEM_PREFIX}{s}"] + ([s] if not s.startswith(t) else [])
            factors.append(F.when(F.col("term").isin(alike), STEM_WEIGHT).otherwise(0.0))
    factor = reduce(lambda a, b: a + b, factors) if factors else F.lit(0.0)
    rows = known.withColumn("factor", factor).where("factor > 0")
    df = rows.groupBy("term").agg(F.countDistinct("path").alias("df"))
    at = (F.col("zone") + 1).cast("int")
    part = F.element_at(weights, at) * F.least(F.col("count"), F.element_at(caps, at)) * idf(n_nodes, F.col("df")) * F.col("factor")
    return rows.join(df, "term").groupBy("path").agg(F.sum(part).alias("candidate_score"))


def candidates(postings: DataFrame, n_nodes: int, tokens: list[str], zones: list[dict] | tuple[dict, ...] = DEFAULT_ZONES, stemming: bool = True, most: int = CANDIDATES) -> DataFrame:
    """The best ``most`` paths. Sums of doubles depend on their order in the last digits, which must not decide ties."""
    return candidate_scores(postings, n_nodes, tokens, zones, stemming).orderBy(F.round("candidate_score", 9).desc(), "path").limit(most)


def stem_counts(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """path, zone, stem, count over the terms that are or restate the stems of ``tokens``."""
    stems = list(dict.fromkeys(stem(t) for t in tokens))
    rows = postings.where(F.col("term").isin([*stems, *(STEM_PREFIX + s for s in stems)]))
    return rows.groupBy("path", "zone", F.regexp_replace("term", "^" + STEM_PREFIX, "").alias("stem")).agg(F.sum("count").cast("int").alias("count"))


def iso_date(text: Column) -> Column:
    day = F.substring(text, 1, 10)
    return F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")), F.when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd")))


def freshness(score_: Column, updated: Column, created: Column, mtime_ns: Column, as_of: datetime.date, half_life: float = HALF_LIFE_DAYS, weight: float = FRESHNESS_WEIGHT) -> Column:
    """The score raised by up to ``weight``, half of it lost with every half-life of age."""
    known = F.coalesce(iso_date(updated), iso_date(created), F.to_date(F.timestamp_seconds((mtime_ns / F.lit(1_000_000_000)).cast("long"))))
    age = F.coalesce(F.greatest(F.datediff(F.lit(as_of), known), F.lit(0)), F.lit(0))
    return score_ * (1 + weight * F.pow(F.lit(0.5), age / F.lit(float(half_life))))


def search_indexed(nodes: DataFrame, postings: DataFrame, query: str, limit: int = 20, as_of: datetime.date | None = None, n_nodes: int | None = None, manifest: Manifest | None = None, zones: list[dict] | tuple[dict, ...] = DEFAULT_ZONES, boosts: list[dict] = (), stop: list[str] | tuple[str, ...] = X.STOP_WORDS, stemming: bool = True, half_life: float = HALF_LIFE_DAYS, weight: float = FRESHNESS_WEIGHT) -> DataFrame:
    """The indexed mode: candidates by postings, rescored with stems and freshness.

    At most ``CANDIDATES`` nodes are rescored, which is what bounds the side that's broadcast. ``nodes`` needs
    props, and mtime_ns if undated nodes shall age by their files.
    """
    if manifest is not None:
        config = manifest.search
        zones, boosts, stop = manifest.zones, config.get("boosts", []), stop_words(config)
        stemming = config.get("stemming", {}).get("enabled", True)
        half_life = config.get("freshness", {}).get("halfLifeDays", HALF_LIFE_DAYS)
        weight = config.get("freshness", {}).get("weight", FRESHNESS_WEIGHT)
    tokens = query_tokens(query, stop)
    total = n_nodes if n_nodes is not None else nodes.count()
    best = F.broadcast(candidates(postings, total, tokens, zones, stemming).select("path"))
    chosen = nodes.join(best, "path", "left_semi")
    count = None
    if stemming and tokens:
        counts = stem_counts(postings.join(best, "path", "left_semi"), tokens)
        by_node = counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", F.col("zone").cast("string"), "stem").alias("k"), "count"))).alias("stem_map"))
        chosen = chosen.join(by_node, "path", "left")
        count = lambda i, t: F.element_at("stem_map", f"{i}|{stem(t)}")
    hits = score(chosen, query, zones, boosts, stop, count)
    mtime = F.col("mtime_ns") if "mtime_ns" in nodes.columns else F.lit(None).cast("long")
    text = lambda f: F.when(prop(f, "json_type") == "string", prop(f, "value_text"))
    fresh = freshness(F.col("score"), text("updated"), text("created"), mtime, as_of or datetime.date.today(), half_life, weight)
    return ranked(hits.drop("stem_map").withColumn("score", fresh), limit)


def shown_score(value: float) -> float | int:
    """The score as reports show it: three digits, whole numbers without a point."""
    got = round(value, 3)
    return int(got) if math.isfinite(got) and float(got).is_integer() else got


def ranks(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")))
