"""Streaming upkeep of postings: batches of changed nodes replace their rows, each batch once.

A batch writes the postings of its nodes and the paths it touched, and nothing else. What's current is told on reading: of each path the rows of the
last batch that touched it. Every ``compact_every`` batches the current rows become a base, and what lies under the base before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.current import latest
from ..schemas import POSTINGS
from ..session import delete_path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The finished tables ``folder/<number>``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = lambda x: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit() and done(x))


def current_postings(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """The postings after batch ``until`` (by default the last one): the base before it and the batches since."""
    upto = lambda kind: [n for n in _numbers(spark, f"{folder}/{kind}") if until is None or n <= until]
    bases = [n for n in upto("base") if until is None or n < until]
    base = spark.read.schema(POSTINGS).parquet(f"{folder}/base/{bases[-1]}") if bases else spark.createDataFrame([], POSTINGS)
    numbers = [n for n in upto("touched") if not bases or n > bases[-1]]
    if not numbers:
        return base
    # the batch is a column, as each touched table and each table of postings bears its number
    touched = spark.read.parquet(*(f"{folder}/touched/{n}" for n in numbers)).groupBy("path").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(*(f"{folder}/postings/{n}" for n in numbers))
    return base.join(touched, "path", "left_anti").select("term", "path", "zone", "count").unionByName(rows.join(touched, ["path", "batch"], "left_semi").select("term", "path", "zone", "count"))


def postings_stream(changes: DataFrame, folder: str, checkpoint: str, zones: list[dict] | tuple[dict, ...] = search.DEFAULT_ZONES, compact_every: int = 32):
    """A writer for a stream of nodes (with props, indexed_at and deleted). A batch that is run again after a failure
    overwrites what it wrote before; ``current_postings`` reads the result."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        now = latest(batch, "path", "indexed_at", *[c for c in batch.columns if c not in ("path", "indexed_at")])
        at = F.lit(number).cast("long").alias("batch")
        new = search.build_postings(now.where(~F.coalesce("deleted", F.lit(False))), zones)
        new.select("*", at).write.mode("overwrite").parquet(f"{folder}/postings/{number}")
        now.select("path", at).write.mode("overwrite").parquet(f"{folder}/touched/{number}")
        if (number + 1) % compact_every == 0:
            current_postings(spark, folder, number).write.mode("overwrite").parquet(f"{folder}/base/{number}")
            before = [n for n in _numbers(spark, f"{folder}/base") if n < number]
            for kind, gone in (("base", before[:-1]), *((k, [n for n in _numbers(spark, f"{folder}/{k}") if before and n <= before[-1]]) for k in ("postings", "touched"))):
                for n in gone:
                    delete_path(spark, f"{folder}/{kind}/{n}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
