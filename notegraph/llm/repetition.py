"""Repetition inside a document: rule statistics, an isolation forest over them, and the share repeated.

Words are maximal runs of letters or digits, lower-cased. A repeat is a run of ``run`` words that has
occurred already, starting at an earlier word of the same document; ``repeated_share`` is the
share of a document's words that repeats cover.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored

WORD = re.compile(r"[^\W_]+")
FEATURES = ("repeated_share", "line_share", "top_run_share", "distinct_share")
Extents = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # nodes (tree * size + place); rows, least and greatest values in each
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_statistics(texts: list[str], run: int) -> dict[str, np.ndarray]:
    """The statistics of each text, all computed over whole arrays of words.

    Runs are compared by 64-bit hashes together with the document they stand in.
    """
    index: defaultdict[str, int] = defaultdict(count().__next__)
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    n, total = len(texts), len(ids)
    covered, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs = np.maximum(sizes - run + 1, 0)
    if total >= run:
        codes = _mix(ids + np.uint64(1))
        value = np.zeros(total - run + 1, np.uint64)
        for j in range(run):
            value = value * _MIX + codes[j : total - run + 1 + j]
        start = np.flatnonzero(doc[: total - run + 1] == doc[run - 1 :])
        key = _mix(value[start] + doc[start].astype(np.uint64) * _MIX)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        again = np.zeros(len(start), bool)
        again[order[1:]] = ranked[1:] == ranked[:-1]
        edge = np.zeros(total + 1, np.int64)
        begins = start[again]
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + run, -1)
        inside = np.cumsum(edge)[:total] > 0
        covered = np.bincount(doc[inside], minlength=n)
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(ranked)])
        np.maximum.at(most, doc[start[order[first]]], times)
    pair = np.unique(doc.astype(np.uint64) * np.uint64(len(index) + 1) + ids)
    distinct = np.bincount((pair // np.uint64(len(index) + 1)).astype(np.int64), minlength=n)
    lines = np.zeros(n)
    for i, t in enumerate(texts):
        own = [x for x in t.split("\n") if len(x) > 20]
        if own:
            chars = sum(map(len, own))
            lines[i] = 1 - sum(map(len, set(own))) / chars
    at_least = np.maximum(sizes, 1)
    return {
        "n_words": sizes,
        "n_covered": covered,
        "repeated_share": covered / at_least,
        "line_share": lines,
        "top_run_share": np.where(most > 1, most / np.maximum(runs, 1), 0.0),
        "distinct_share": distinct / at_least,
    }


def _joined(parts: list[Extents]) -> Extents:
    """Extents of disjoint sets of rows as those of all of them, by node."""
    node, n, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(node, kind="stable")
    ranked = node[order]
    if not len(order):
        return node, n, low, high
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


class IsolationForest:
    """Random axis-parallel splits; anomalous rows end on short paths. Trees grow a level at a time: a level takes only the
    number of rows in each node and their least and greatest value of each feature, so that they may be grown from rows
    that lie in tasks (``grown``). The constructor grows each tree from ``sample`` of the given rows. Scored in tasks over arrays."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int):
        rng = np.random.default_rng(seed)
        each = min(sample, len(rows))
        parts = [rows[rng.choice(len(rows), each, replace=False)] if each else rows for _ in range(trees)]
        self._build(lambda level: _joined([self._extents(k, part, level) for k, part in enumerate(parts)]), trees, max(1, int(np.ceil(np.log2(max(2, each))))), rng)

    @classmethod
    def grown(cls, measure: Callable[[IsolationForest, int], Extents], trees: int, height: int, seed: int) -> IsolationForest:
        """Trees of at most ``height`` levels, each grown from all the rows that ``measure`` gives the ``extents`` of. What
        the lowest leaves still hold goes into their length."""
        forest = cls.__new__(cls)
        forest._build(lambda level: measure(forest, level), trees, height, np.random.default_rng(seed))
        return forest

    def _build(self, measure: Callable[[int], Extents], trees: int, depth: int, rng: np.random.Generator) -> None:
        self.depth, self.size = depth, 2 ** (depth + 1) - 1
        self.feature = np.full((trees, self.size), -1, np.int64)
        self.cut = np.zeros((trees, self.size))
        self.length = np.zeros((trees, self.size))
        for level in range(depth + 1):
            node, n, low, high = measure(level)
            if level == 0:  # rows of a tree
                self.norm = float(self._mean_path(np.maximum(2, n.sum() // max(1, trees))))
            if not self._grow(level, node, n, low, high, rng):
                break

    @staticmethod
    def _mean_path(n: np.ndarray) -> np.ndarray:
        """The mean path length of an unsuccessful search in a binary tree of n rows."""
        m = np.maximum(n, 3).astype(np.float64)
        return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))

    def _grow(self, level: int, node: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> bool:
        """Sets length, and split if any, of the nodes of a level; tells whether there are splits."""
        k, at = node // self.size, node % self.size
        self.length[k, at] = level + self._mean_path(n)
        inner = (n > 1) & (high > low).any(1) & (level < self.depth)
        k, at, low, high = k[inner], at[inner], low[inner], high[inner]
        f = np.where(high > low, rng.random(low.shape), -1.0).argmax(1)
        each = np.arange(len(f))
        self.feature[k, at] = f
        self.cut[k, at] = low[each, f] + rng.random(len(f)) * (high - low)[each, f]
        for child in (2 * at + 1, 2 * at + 2):  # a child without rows is never measured
            self.length[k, child] = level + 1
        return len(f) > 0

    def _walk(self, k: int, flat: np.ndarray, n: int, levels: int) -> np.ndarray:
        """The node of tree ``k`` that each of ``n`` rows is in after so many levels; ``flat`` holds one feature after another."""
        at, every = np.zeros(n, np.int64), np.arange(n)
        for _ in range(levels):
            f = self.feature[k].take(at)
            right = flat.take(np.maximum(f, 0) * n + every) >= self.cut[k].take(at)
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def _extents(self, k: int, rows: np.ndarray, level: int) -> Extents:
        columns = np.ascontiguousarray(rows.T, np.float64)
        begin = 2**level - 1
        at = self._walk(k, columns.ravel(), len(rows), level) - begin
        order = np.argsort(at.astype(np.int32), kind="stable")
        order = order[np.searchsorted(at[order], 0) :]  # the others ended above
        ranked, own = at[order], columns[:, order]
        if not len(order):
            return ranked, ranked, own.T, own.T
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        return k * self.size + begin + ranked[first], np.diff(np.r_[first, len(order)]), np.minimum.reduceat(own, first, axis=1).T, np.maximum.reduceat(own, first, axis=1).T

    def extents(self, rows: np.ndarray, level: int) -> Extents:
        """The nodes of a level that rows are in, in all trees; rows, least and greatest values in each."""
        return _joined([self._extents(k, rows, level) for k in range(len(self.feature))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus mean path over the expected one: near 1 for anomalies, under 0.5 for the usual."""
        total = np.zeros(len(rows))
        flat = np.ascontiguousarray(rows.T, np.float64).ravel()
        for k in range(len(self.feature)):
            total += self.length[k].take(self._walk(k, flat, len(rows), self.depth))
        return 2.0 ** (-total / len(self.feature) / self.norm)


STATISTICS = "n_words bigint, n_covered bigint, " + ", ".join(f"{x} double" for x in FEATURES)


def statistics(documents: DataFrame, run: int = 8, part_chars: int = 1_000_000) -> DataFrame:
    """doc_id and the rule statistics of each document with a text; null texts have none, empty ones zeros.

    Texts are taken whole; an Arrow batch is worked off in parts of about ``part_chars`` characters
    so that long texts don't add up in a worker.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, keys = f["text"].tolist(), f["doc_id"]
            begin, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= part_chars or i == len(texts) - 1:
                    yield pd.DataFrame({"doc_id": keys.iloc[begin : i + 1].reset_index(drop=True), **run_statistics(texts[begin : i + 1], run)})
                    begin, chars = i + 1, 0

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(compute, f"doc_id {kind}, {STATISTICS}")


def _labelled(min_share: float) -> Column:
    return (F.col("n_words") > 0) & (F.col("n_covered") >= F.lit(min_share) * F.col("n_words") - F.lit(1e-9))


@dataclass
class Detector:
    """A forest and the anomaly from which a document counts as repetitive; null flags nothing."""

    forest: IsolationForest
    threshold: float | None

    def flags(self, anomaly: str) -> Column:
        return F.lit(False) if self.threshold is None else F.col(anomaly) >= F.lit(self.threshold)


def _extents_of(stats: DataFrame, forest: IsolationForest, level: int) -> Extents:
    """The extents of a level over all of ``stats``: one row a node and task, one row a node to the driver."""
    bounds = [f"{side}{i}" for side in ("low", "high") for i in range(len(FEATURES))]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far: list[Extents] = []
        for f in frames:
            so_far = [_joined([*so_far, forest.extents(f.to_numpy(np.float64), level)])]
        for node, n, low, high in so_far:
            yield pd.DataFrame({"node": node, "n": n} | dict(zip(bounds, np.hstack([low, high]).T)))

    rows = stats.select(*FEATURES).mapInPandas(measure, "node bigint, n bigint, " + ", ".join(f"{x} double" for x in bounds))
    side = {"low": F.min, "high": F.max}
    got = rows.groupBy("node").agg(F.sum("n").alias("n"), *(side[x.rstrip("0123456789")](x).alias(x) for x in bounds)).toPandas().sort_values("node")
    values = got[bounds].to_numpy(np.float64).reshape(-1, len(bounds))
    return got["node"].to_numpy(np.int64), got["n"].to_numpy(np.int64), values[:, : len(FEATURES)], values[:, len(FEATURES) :]


def _scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["anomaly"] = forest.score(f[list(FEATURES)].to_numpy(np.float64)) if len(f) else np.zeros(0)
            yield f

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInPandas(score, f"doc_id {kind}, {STATISTICS}, anomaly double")


def _drawn(stats: DataFrame, n: int, seed: int) -> np.ndarray:
    """``n`` random rows, those of lowest hash of id and statistics."""
    place = F.xxhash64(F.lit(seed), "doc_id", *FEATURES)
    got = stats.select(*FEATURES, place.alias("place")).orderBy("place", *FEATURES).limit(n).toPandas()
    return got[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES))


def fit(stats: DataFrame, min_share: float = 0.3, trees: int = 128, sample: int | None = None, height: int = 8, margin: float = 0.02, seed: int = 17) -> Detector:
    """Grows the forest from all rows and takes its threshold from all labelled ones.

    Labelled are the documents that the rule (``min_share`` of the words repeated) calls repetitive. The threshold is
    their lowest anomaly less ``margin``, so none of them lies below it; the margin is for documents that
    weren't in ``stats``. Without labelled rows there's no threshold. ``stats`` is read once a level of the trees and once
    for the threshold; the driver gets one row a node. Only a caller that names a ``sample`` gets trees
    grown from so many random rows each.
    """
    if sample is None:
        forest = IsolationForest.grown(lambda forest, level: _extents_of(stats, forest, level), trees, height, seed)
    else:
        forest = IsolationForest(_drawn(stats, trees * sample, seed), trees, sample, seed)
    lowest = _scored(stats.where(_labelled(min_share)), forest).agg(F.min("anomaly")).first()[0]
    return Detector(forest, None if lowest is None else lowest - margin)


def repetition(documents: DataFrame, min_share: float = 0.3, run: int = 8, **options) -> DataFrame:
    """doc_id, n_words, n_covered, the rule statistics, anomaly and flagged for each document with a text.

    ``flagged`` is the forest's verdict alone: anomaly at or above the calibrated threshold (see ``fit``, which takes
    ``options``). Every document is scored. An empty table gives no rows.
    """
    stats = Stored(statistics(documents, run), "statistics").df
    detector = fit(stats, min_share, **options)
    return _scored(stats, detector.forest).withColumn("flagged", detector.flags("anomaly"))


def repetitive(documents: DataFrame, min_share: float = 0.3, run: int = 8, **options) -> DataFrame:
    """doc_id of the documents whose words are covered by repeats to at least ``min_share``, all of them: the forest's flags
    leave out none, as the threshold is taken from every such document, and the exact check drops what else they hold."""
    rows = repetition(documents, min_share, run, **options).where("flagged")
    return rows.where(_labelled(min_share)).select("doc_id").distinct()
