"""Mixing sources to target shares of tokens, by Sainte-Laguë apportionment of equal-token blocks.

Each source is cut into shards of documents, each shard, in a seeded order, into blocks of ``block_tokens`` tokens. The
blocks of a mix go to its sources by the highest quotients, then those of a source to its shards, which gives every shard an
integer quota. A quota takes all blocks of its shard as often as it fits, and for the rest a run of blocks that begins at a
seeded one. A document belongs to the block that it begins in, so a run may be off by part of a document at either end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stored

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
UNCAPPED = 1 << 30
#: A plan of more rows isn't broadcast but joined by a shuffle.
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function that gives the number of tokens of each text, for a file of a public tokenizer."""
    kind = Path(path).suffix
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if kind == ".json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no tokenizer is known for {path}")


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, part_chars: int = 500_000) -> DataFrame:
    """doc_id, source, tokens of each document. Null texts have none and stay out; repeated rows of a
    doc_id count once (the greatest source, then size)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _counter(tokenizer)
        for f in frames:
            texts, out = f["text"].tolist(), []
            begin, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= part_chars or i == len(texts) - 1:
                    out += sizes(texts[begin : i + 1])
                    begin, chars = i + 1, 0
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": np.array(out, np.int64)})

    rows = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counted = rows.mapInPandas(count, f"doc_id {kind}, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients w/(2s+1), none beyond ``most``; ties go to the earlier place.

    Quotients aren't listed one by one: for a divisor d the seats won are round(w/d), so bisection
    finds the largest d that gives no more than ``seats``, and the few left go one at a time.
    """
    w = np.asarray(weights, np.float64)
    most = np.full(len(w), np.inf) if most is None else np.asarray(most, np.float64)
    most = np.where(w > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    won = lambda d: np.minimum(np.floor(w / d + 0.5), most)
    high, low = 4 * w.max(), 2 * w.max()
    while won(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if won(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = won(high)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where(got < most, w / (2 * got + 1), -1.0)
        for i in np.argsort(-quotient, kind="stable")[:left]:
            if quotient[i] > 0:
                got[i] += 1
    return got.astype(np.int64)


class Mixture:
    """Selections and shares of each mix; built once, read by ``selection`` and ``shares``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, total_share: float = 0.5, block_tokens: int = 1024, shard_tokens: int = 1 << 24, most_shards: int = 1_000_000, seed: int = 11, tokenizer: str = TOKENIZER, max_targets: int = 100_000):
        """``total_tokens`` is the size of each mix; without it ``total_share`` of the tokens of all documents.

        A shard holds about ``shard_tokens`` tokens or a ``most_shards``-th of all, whichever is more: the plan, with a row for each
        mix and shard, is made on the driver, and a shard is ordered in one task.
        """
        spark = documents.sparkSession
        goals = targets.where("mix_id is not null and source is not null and target_share > 0").groupBy("mix_id", "source").agg(F.max("target_share").alias("share"), F.max(F.coalesce(F.col("max_repeats"), F.lit(UNCAPPED))).alias("cap")).limit(max_targets + 1).toPandas()
        if len(goals) > max_targets:
            raise ValueError(f"more than {max_targets} targets: the plan of a mix is made on the driver")
        goals = goals.sort_values(["mix_id", "source"]).reset_index(drop=True)
        sizes = Stored(token_sizes(documents, tokenizer), "sizes").df
        names = spark.createDataFrame([(x,) for x in sorted(set(goals["source"]))] or [("",)], "source string")
        by_source = {r.source: r.tokens or 0 for r in sizes.join(F.broadcast(names), "source", "left").groupBy("source").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(names), "source").collect()}
        every = sizes.agg(F.sum("tokens")).first()[0] or 0
        self.total = int(total_tokens if total_tokens is not None else total_share * every)
        share = max(shard_tokens, -(-every // most_shards))
        shards = spark.createDataFrame([(s, max(1, -(-n // share))) for s, n in by_source.items()], "source string, shards bigint")
        placed = sizes.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
        # a source's shards are many and alike in size, so no window holds a whole source
        order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
        begin = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
        self.placed = Stored(placed.withColumn("block", F.floor(begin / block_tokens)).select("doc_id", "source", "shard", "tokens", "block"), "placed").df
        held = dict(list(self.placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(["source", "shard"]).groupby("source")))
        plan, self.goals = [], []
        for mix, g in goals.groupby("mix_id", sort=True):
            quota = sainte_lague(g["share"].to_numpy(), round(self.total / block_tokens))
            for target, blocks in zip(g.itertuples(), quota.tolist()):
                own = held.get(target.source, pd.DataFrame({"shard": [], "tokens": []}))
                own = own[own["tokens"] > 0]
                tokens = own["tokens"].to_numpy(np.int64)
                size = -(-tokens // block_tokens)
                got = sainte_lague(tokens, blocks, size * float(target.cap))
                available = int(min(float(tokens.sum()) * float(target.cap), 2**62))
                self.goals.append((int(mix), target.source, float(target.share), None if target.cap >= UNCAPPED else int(target.cap), blocks, int(got.sum()), available))
                start = np.random.default_rng([seed, int(mix) & 0xFFFFFFFF, zlib.crc32(target.source.encode())]).integers(0, np.maximum(size, 1))
                plan.append(pd.DataFrame({"mix_id": np.int32(mix), "source": target.source, "shard": own["shard"].to_numpy(np.int64), "size": size, "start": start, "passes": got // np.maximum(size, 1), "rest": got % np.maximum(size, 1)}))
        rows = pd.concat(plan) if plan else pd.DataFrame({c: [] for c in ("mix_id", "source", "shard", "size", "start", "passes", "rest")})
        self.plan_rows = len(rows)
        self.plan = Stored(spark.createDataFrame(rows, "mix_id int, source string, shard bigint, size bigint, start bigint, passes bigint, rest bigint"), "plan").df

    def selection(self) -> DataFrame:
        """mix_id, doc_id, source, tokens, repeats (1 or more) of each document in each mix."""
        plan = F.broadcast(self.plan) if self.plan_rows <= BROADCAST_ROWS else self.plan
        rows = self.placed.join(plan, ["source", "shard"])
        # documents without tokens at the end of a shard may begin a block beyond the last
        chosen = F.pmod(F.least("block", F.col("size") - 1) - F.col("start"), F.col("size")) < F.col("rest")
        repeats = F.col("passes") + chosen.cast("int")
        return rows.select("mix_id", "doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")

    def shares(self) -> DataFrame:
        """One row per target: quota and blocks given, tokens reached, their share of the requested total and
        of the mix as it came out, and whether the source falls short of its quota."""
        spark = self.plan.sparkSession
        goals = spark.createDataFrame(self.goals, "mix_id int, source string, target_share double, max_repeats int, quota_blocks bigint, given_blocks bigint, available_tokens bigint")
        got = self.selection().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("documents"))
        rows = goals.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "most_repeats", "documents"])
        whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
        return rows.select("*", (F.col("tokens") / F.lit(float(self.total or 1))).alias("share_of_total"), F.when(whole > 0, F.col("tokens") / whole).alias("share_of_mix"), (F.col("given_blocks") < F.col("quota_blocks")).alias("falls_short"))
