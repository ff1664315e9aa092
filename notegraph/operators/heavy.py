"""Heavy keys: finding them in one pass, and joins that don't gather them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys that hold at least ``share`` of the non-null rows of ``df``, perhaps a few others.

    Each task keeps counters for at most ``4/share`` keys (Misra-Gries by whole Arrow batches:
    when there are more, all are lowered by the largest one that is dropped); the tasks' counters
    are added, those below ``share/2`` of the rows dropped. The result has at most ``2/share``
    rows whatever the input's size, which is what makes it safe to broadcast. Columns: ``key``, ``weight``.
    """
    room = max(16, round(4 / share))
    kind = df.schema[key].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        rows = 0
        arrow_type = None
        for batch in batches:
            col = batch.column(0)
            arrow_type = col.type
            rows += len(col) - col.null_count
            vc = pc.value_counts(col.drop_null())
            for k, n in zip(vc.field("values").to_pylist(), vc.field("counts").to_pylist()):
                counts[k] = counts.get(k, 0) + n
            if len(counts) > room:
                floor = sorted(counts.values(), reverse=True)[room]
                counts = {k: n - floor for k, n in counts.items() if n > floor}
        if arrow_type is None:
            return
        keys = [*counts, None]
        yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_type), pa.array([*counts.values(), rows], pa.int64())], names=["key", "weight"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("weight", T.LongType())])
    parts = df.select(F.col(key).alias("key")).mapInArrow(sketch, schema).groupBy("key").agg(F.sum("weight").alias("weight"))
    found = parts.orderBy(F.col("weight").desc(), "key").limit(round(2 / share) + 1).collect()
    total = next((r.weight for r in found if r.key is None), 0)
    rows = [(r.key, r.weight) for r in found if r.key is not None and r.weight >= share / 2 * total]
    return df.sparkSession.createDataFrame(rows, schema)


def spread_join(big: DataFrame, small: DataFrame, key: str, heavy: DataFrame, salt: Column, values: list[str]) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row per ``key``) that never shuffles heavy rows by key.

    The rows of ``small`` for ``heavy`` keys (at most as many as ``heavy`` has) and for the null key are broadcast; null equals null.
    Rows of ``big`` with such a key then go to the shuffle under a key of their own made of ``salt``,
    which matches nothing and is spread evenly, so one pass over ``big`` is enough.
    """
    known = small.join(F.broadcast(heavy.select(F.col("key").alias(key))), key, "left_semi").unionByName(small.where(F.col(key).isNull()))
    hot = F.broadcast(known.select(F.col(key).alias("__hot_key"), *(F.col(v).alias(f"__hot_{v}") for v in values), F.lit(True).alias("__hot")))
    cold = small.select(F.struct(F.col(key).alias("k"), F.lit(-1).cast("long").alias("s")).alias("__key"), *values)
    is_hot = F.col("__hot").isNotNull() | F.col(key).isNull()
    marked = big.join(hot, F.col(key).eqNullSafe(F.col("__hot_key")), "left").withColumn(
        "__key", F.struct(F.when(~is_hot, F.col(key)).alias("k"), F.when(is_hot, F.pmod(F.xxhash64(salt), F.lit(1 << 20))).otherwise(F.lit(-1).cast("long")).alias("s"))
    )
    joined = marked.join(cold, "__key", "left")
    keep = [c for c in big.columns]
    return joined.select(*keep, *(F.coalesce(F.col(f"__hot_{v}"), F.col(v)).alias(v) for v in values))
