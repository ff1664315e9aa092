"""Term frequencies over a whole index, and how distinctive a term is of a record.

The rows counted are those with a non-null term without the stem prefix and a positive count, exact
copies once. Terms equal after trimming, lower-casing and Unicode NFC are one term.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.heavy import heavy_keys, spread_join
from ..session import Stored

STEM_PREFIX = "s:"


def fold_terms(terms: pa.Array) -> pa.Array:
    """Trimmed, lower-cased, NFC; each distinct spelling of a batch is folded once."""
    coded = terms.dictionary_encode()
    folded = [unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).lower().strip()) for t in coded.dictionary.to_pylist()]
    return pa.array(folded, pa.string()).take(coded.indices)


def counted(postings: DataFrame, stem_prefix: str = STEM_PREFIX) -> DataFrame:
    """The counted rows by term and file: columns term (folded), file, count (bigint, summed over zones).

    Exact copies (before terms are folded) count once. Terms are folded first, so one shuffle by folded term and file
    is enough: copies meet there, and their sums need no other one. Copies within an Arrow batch are dropped
    before it, so many copies of one row don't gather. A term that is empty after folding
    stays a term; rows with a null file count as the file null.
    """
    rows = postings.select("term", "file", "zone", "count").where(F.col("term").isNotNull() & ~F.col("term").startswith(stem_prefix) & (F.col("count") > 0))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term = fold_terms(b.column(0))
            # the spelling matters for telling copies only, and is mostly the folded term itself
            spelling = pc.if_else(pc.equal(term, b.column(0)), pa.scalar(None, pa.string()), b.column(0))
            once = pa.table([term, b.column(1), spelling, b.column(2), b.column(3)], names=["term", "file", "spelling", "zone", "count"]).group_by(["term", "file", "spelling", "zone", "count"], use_threads=False).aggregate([])
            yield from once.select(["term", "file", "spelling", "zone", "count"]).combine_chunks().to_batches()

    kind = lambda c: postings.schema[c].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("file", kind("file")), T.StructField("spelling", T.StringType()), T.StructField("zone", kind("zone")), T.StructField("count", kind("count"))])
    once = rows.mapInArrow(fold, schema).repartition("term", "file").groupBy("term", "file", "spelling", "zone", "count").agg(F.lit(1).alias("one"))
    return once.groupBy("term", "file").agg(F.sum(F.col("count").cast("long")).alias("count"))


def term_totals(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """Total count and number of files of each term of ``pairs`` (one row per term and file).

    Heavy-light: each task adds the rows of heavy terms to exact counter arrays of its own, one place
    for each heavy term, and emits the arrays once at its end; only the rows of other terms are
    shuffled by term. Both tables together hold every term once. ``heavy`` comes from
    ``heavy_keys``, which bounds its size.
    """
    listed = [r.key for r in heavy.select("key").collect()]
    place = {k: i for i, k in enumerate(listed)}
    flag = F.broadcast(heavy.select(F.col("key").alias("term"), F.lit(True).alias("is_heavy")))
    marked = pairs.select("term", "count").join(flag, "term", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, files = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
        for b in batches:
            coded = b.column(0).dictionary_encode()
            at = np.array([place[t] for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            np.add.at(total, at, b.column(1).to_numpy(zero_copy_only=False))
            files += np.bincount(at, minlength=len(listed))
        used = np.flatnonzero(files)
        yield pa.RecordBatch.from_arrays([pa.array([listed[i] for i in used], pa.string()), pa.array(total[used]), pa.array(files[used])], names=["term", "total", "files"])

    schema = "term string, total bigint, files bigint"
    arrays = marked.where("is_heavy").select("term", "count").mapInArrow(count, schema)
    hot = arrays.groupBy("term").agg(F.sum("total").alias("total"), F.sum("files").alias("files"))
    light = marked.where("is_heavy is null").groupBy("term").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("files"))
    return hot.unionByName(light)


def term_frequencies(postings: DataFrame, rare_total: int = 4, rare_files: int = 2, common_share: float = 0.12, heavy_share: float = 0.01) -> DataFrame:
    """term, total, files, mark for every distinct term of the counted rows.

    mark is ``rare`` (total at most ``rare_total``, in at most ``rare_files`` files), ``common`` (in more than
    ``common_share`` of the files that have counted rows) or null; a term that is both, which only a
    tiny index has, is common. An empty table gives no rows.
    """
    pairs = Stored(counted(postings), "counted").df
    n_files = pairs.select("file").distinct().count()
    totals = term_totals(pairs, heavy_keys(pairs, "term", heavy_share))
    mark = F.when(F.col("files") > F.lit(common_share) * F.lit(n_files), "common").when((F.col("total") <= rare_total) & (F.col("files") <= rare_files), "rare")
    return totals.withColumn("mark", mark)


def marked_terms(postings: DataFrame, **options) -> DataFrame:
    """Terms that are too rare or too common: a row for each mark, so a term of a tiny index may have both."""
    rare_total, rare_files = options.get("rare_total", 4), options.get("rare_files", 2)
    table = term_frequencies(postings, **options)
    rare = F.when((F.col("total") <= rare_total) & (F.col("files") <= rare_files), "rare")
    common = F.when(F.col("mark") == "common", "common")
    return table.select("term", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))


def least_z(n: int, files: int, prior: float, min_count: int, lift: int, ratio: float = 1.02) -> float:
    """A lower bound of z for every term with a count c >= ``min_count`` in a file of f, a total t > c elsewhere too, and
    c n >= ``lift`` f t, in an index of n.

    z falls with f, so f is at most c n / (lift t). Over a grid of cells of c and t that grow by ``ratio``, each part of
    z takes its least value in the cell. Minus infinity if nothing bounds it.
    """
    if n < lift or files < 1:
        return float("-inf")
    edges = np.unique(np.floor(min_count * ratio ** np.arange(int(np.log(max(2.0, n / min_count)) / np.log(ratio)) + 3)))
    edges = np.unique(np.r_[np.arange(min_count, min_count + 64), edges])
    c1, c2 = edges[:-1, None], edges[1:, None] - 1
    t1, t2 = edges[None, :-1], edges[None, 1:] - 1
    real = (t2 > c1) & (t1 * lift <= n) & (c1 <= n)  # f is at least c
    t1 = np.maximum(t1, c1 + 1)
    a1, a2 = prior * t1 / n, prior * np.minimum(t2, n / lift) / n
    f2 = np.maximum(c2 * n / (lift * t1), c1)
    inside = f2 + prior - c1 - a1
    outside = n - f2 + prior - np.maximum(t2 - c1, 1) - a2
    with np.errstate(all="ignore"):
        low = np.log((c1 + a1) / inside) + np.log(outside / (np.maximum(t2 - c1, 1) + a2))
        low = np.where((inside > 0) & (outside > 0), low, -np.inf)
        most = np.sqrt(1 / (c1 + a1) + 1 / (np.maximum(t1 - c2, 1) + a1))
        least = np.sqrt(1 / (c2 + a2) + 1 / (np.maximum(t2 - c1, 1) + a2))
        z = np.where(low > 0, low / most, low / least)
    return float(z[real].min()) if real.any() else float("-inf")


@dataclass
class Distinctiveness:
    """Scores of an index, with the totals they rest on."""

    rows: DataFrame
    n: int
    files: int
    prior: float


def distinctiveness(postings: DataFrame, prior_weight: float | None = None, heavy_share: float = 0.01, min_count: int = 1) -> Distinctiveness:
    """rows: file, term, n_term, n_file, n_all_term, files, log_odds, z for each term on at least ``min_count`` places of a file.

    Weighted log-odds of the file against the rest of the index, with an informative Dirichlet
    prior: a term's prior count is ``prior`` (by default the mean size of a file) times its
    share of the whole index. z is the log-odds ratio over its standard error. Null where the
    ratio isn't defined (the file is the whole index). Totals are those of all counted rows, whatever
    ``min_count`` is. An empty table gives no rows.
    """
    pairs = Stored(counted(postings), "counted").df
    heavy_terms, heavy_files = heavy_keys(pairs, "term", heavy_share), heavy_keys(pairs, "file", heavy_share)
    sizes = Stored(pairs.groupBy("file").agg(F.sum("count").alias("n_file")), "sizes").df
    whole = sizes.agg(F.sum("n_file").alias("n"), F.count(F.lit(1)).alias("files")).first()
    n, n_files = whole.n or 0, whole.files
    totals = term_totals(pairs, heavy_terms).select("term", F.col("total").alias("n_all_term"), "files")
    scored = pairs.withColumnRenamed("count", "n_term").where(F.col("n_term") >= min_count)
    rows = spread_join(scored, totals, "term", heavy_terms, F.col("file"), ["n_all_term", "files"])
    rows = spread_join(rows, sizes, "file", heavy_files, F.col("term"), ["n_file"])
    prior = float(prior_weight if prior_weight is not None else (n / n_files if n_files else 1.0))
    c, f, t = (F.col(x).cast("double") for x in ("n_term", "n_file", "n_all_term"))
    a0 = F.lit(prior)
    a = a0 * t / F.lit(float(n or 1))
    inside, outside = f + a0 - c - a, F.lit(float(n)) - f + a0 - (t - c) - a
    defined = (inside > 0) & (outside > 0)
    ratio = F.when(defined, F.log((c + a) / inside) - F.log((t - c + a) / outside))
    error = F.sqrt(1.0 / (c + a) + 1.0 / (t - c + a))
    return Distinctiveness(rows.select("file", "term", "n_term", "n_file", "n_all_term", "files", ratio.alias("log_odds"), (ratio / error).alias("z")), n, n_files, prior)


def distinctive_terms(postings: DataFrame, min_count: int = 6, lift: int = 25, min_files: int = 2, max_share: int = 20, **options) -> DataFrame:
    """file, term of the terms that set a file apart.

    They are selected by their z-score: at or above ``least_z``, which no term that occurs at least ``min_count`` times in the
    file and ``lift`` times as often as its size lets expect, and also elsewhere, falls below. Of those selected an exact
    check keeps the terms with that count and lift in at least ``min_files`` files (two or more) and at most one in
    ``max_share`` of all. Products are compared as exact decimals of 38 digits, which hold totals up to 10^18.
    """
    if min_files < 2:
        raise ValueError("a term that stands in one file only has no rest to be compared with")
    d = distinctiveness(postings, min_count=min_count, **options)
    rows = d.rows.where(F.col("z") >= F.lit(least_z(d.n, d.files, d.prior, min_count, lift) - 1e-6))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    exact = (F.col("n_term") >= min_count) & (wide("n_term") * F.lit(d.n).cast("decimal(19,0)") >= wide("n_file") * (wide("n_all_term") * F.lit(lift).cast("decimal(6,0)")).cast("decimal(19,0)")) & (F.col("files") >= min_files) & (F.col("files") * max_share <= F.lit(d.files))
    return rows.where(exact).select("file", "term")
