"""Processing only new or changed records: a log of changes, write-ahead batch plans, a deduplicating sink.

``detect_changes`` compares the listing with what is known of each path. ``ChangeLog`` keeps what it finds as a log cut
into partitions by a hash of the path, each record with an offset that runs on within its partition. A batch is a
plan, written before any work: for each partition the offsets from the last commit to the end of the log. A run that finds
a plan without a commit replays exactly those offsets; the sink holds each record once by path and offset. What is known of a
path is its last record in the log, else what earlier runs left in the given state, so a record that was captured is never
captured again unless it changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Stored, delete_path
from .current import latest

RECORD = "path string, state string, mtime_ns bigint, size bigint, source_hash string"
KNOWN = ["path", "mtime_ns", "size", "source_hash"]


class Fenced(RuntimeError):
    """Another driver has taken over the log."""


def last_states(index_state: DataFrame, index_runs: DataFrame) -> DataFrame:
    """path and mtime_ns, size, source_hash of its row with the highest run among those of status ``ok``."""
    done = index_runs.where((F.col("status") == "ok") & F.col("run_id").isNotNull()).select("run_id").distinct()
    return latest(index_state.join(done, "run_id", "left_semi"), "path", "run_id", "mtime_ns", "size", "source_hash")


def detect_changes(files: DataFrame, nodes: DataFrame, index_state: DataFrame, index_runs: DataFrame, captured: DataFrame | None = None) -> DataFrame:
    """path, state (``added``, ``changed``), mtime_ns, size, source_hash of the paths the next run has to process.

    ``added``: no successful run left a row for the path. ``changed``: the hash of the current node differs from that
    row's; where either is null, mtime or size differ (null only equals null). Vanished and unchanged paths
    don't occur. ``captured`` (path, mtime_ns, size, source_hash, seq) is what a change log holds already; its row with
    the highest seq takes the place of that row. Every side is one row per path before it's joined, so hot paths don't meet.
    """
    now = latest(files, "path", "listed_at", "mtime_ns", "size")
    hashes = latest(nodes, "path", "indexed_at", "source_hash")
    was = last_states(index_state, index_runs).select(*KNOWN)
    if captured is not None:
        was = latest(was.withColumn("seq", F.lit(-1).cast("long")).unionByName(captured.select(*KNOWN, F.col("seq").cast("long").alias("seq"))), "path", "seq", "mtime_ns", "size", "source_hash")
    was = was.select("path", F.col("mtime_ns").alias("was_mtime"), F.col("size").alias("was_size"), F.col("source_hash").alias("was_hash"), F.lit(True).alias("known"))
    rows = now.join(hashes, "path", "left").join(was, "path", "left")
    same_stat = F.col("mtime_ns").eqNullSafe(F.col("was_mtime")) & F.col("size").eqNullSafe(F.col("was_size"))
    differs = F.when(F.col("source_hash").isNotNull() & F.col("was_hash").isNotNull(), F.col("source_hash") != F.col("was_hash")).otherwise(~same_stat)
    state = F.when(F.col("known").isNull(), "added").when(differs, "changed")
    return rows.withColumn("state", state).where("state is not null").select("path", "state", "mtime_ns", "size", "source_hash")


class ChangeLog:
    """A log of changes in a folder all executors share, and the batches over it.

    ``log/<n>`` holds the records of a capture, ``plans/<b>.json`` a batch's offsets, ``sink/<b>-<token>`` its results and
    ``commits/<b>.json`` names the results that count. A Parquet folder counts once its marker is there. Each driver takes
    a higher epoch than any before (``epochs/``); one that finds a higher epoch than its own stops before it writes a marker.

    The number of partitions is set by the first capture: one for each ``rows_per_partition`` records, ``partitions`` at least.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = 64, rows_per_partition: int = 1_000_000, snapshot_every: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.partitions, self.rows_per_partition, self.snapshot_every = partitions, rows_per_partition, snapshot_every
        self.epoch = self._take_epoch()

    # -- small files through Hadoop's file system, as the folder needn't be local
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _take_epoch(self) -> int:
        while True:
            mine = max(self._numbers("epochs"), default=-1) + 1
            p, fs = self._fs(f"{self.folder}/epochs/{mine}.json")
            try:
                fs.create(p, False).close()  # fails if it's there
                return mine
            except Exception:
                if not fs.exists(p):
                    raise

    def _write(self, path: str, value: dict) -> None:
        """Written beside, then renamed, so that a file is there as a whole or not at all; never over another."""
        if max(self._numbers("epochs")) != self.epoch:
            raise Fenced(f"another driver has taken over {self.folder}")
        p, fs = self._fs(path)
        beside, _ = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, False)
            raise Fenced(f"{path} was written by another driver")

    def _numbers(self, kind: str) -> list[int]:
        p, fs = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, kind: str, n: int) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/{kind}/{n}.json").collect()))

    # -- the log
    def _log_end(self) -> dict:
        """partitions and ends (last offset of each partition) of the log; of an empty one no partitions."""
        parts = self._numbers("log")
        return self._read("log", parts[-1]) if parts else {"partitions": 0, "ends": {}}

    def records(self, since: int = 0) -> DataFrame | None:
        """The records captured, from capture ``since`` on, with seq (the capture), partition and offset."""
        at = [f"{self.folder}/log/{self._read('log', n)['folder']}" for n in self._numbers("log") if n >= since]
        return self.spark.read.parquet(*at) if at else None

    def captured(self) -> DataFrame | None:
        """The last record of each path, or several of a path told apart by seq: the newest snapshot and the captures since."""
        kept = self._numbers("snapshots")
        later = self.records(kept[-1] + 1 if kept else 0)
        parts = [x.select(*KNOWN, "seq") for x in (self.spark.read.parquet(f"{self.folder}/snapshots/{self._read('snapshots', kept[-1])['folder']}") if kept else None, later) if x is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def capture(self, changes: Callable[[DataFrame | None], DataFrame]) -> int:
        """Appends ``changes(captured)`` to the log and gives their number. Offsets run on from where each partition ended."""
        end = self._log_end()
        rows = Stored(changes(self.captured()), "changes")
        n = rows.df.count()
        if n:
            seq = max(self._numbers("log"), default=-1) + 1
            parts = end["partitions"] or max(self.partitions, -(-n // self.rows_per_partition))
            ends = {int(k): v for k, v in end["ends"].items()}
            start = self.spark.createDataFrame(list(ends.items()), "partition int, start bigint")
            placed = rows.df.withColumn("partition", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).join(F.broadcast(start), "partition", "left")
            order = Window.partitionBy("partition").orderBy("path")
            folder = f"{seq}-{uuid.uuid4().hex}"
            at = f"{self.folder}/log/{folder}"
            placed.withColumn("offset", F.coalesce("start", F.lit(0)) + F.row_number().over(order)).drop("start").withColumn("seq", F.lit(seq).cast("long")).write.parquet(at)
            got = self.spark.read.parquet(at).groupBy("partition").agg(F.max("offset").alias("high")).collect()
            self._write(f"{self.folder}/log/{seq}.json", {"folder": folder, "partitions": parts, "ends": {str(k): v for k, v in (ends | {r.partition: r.high for r in got}).items()}})
            if (seq + 1) % self.snapshot_every == 0:
                self.snapshot(seq)
        rows.drop()
        return n

    def snapshot(self, seq: int) -> None:
        """The last record of each path up to capture ``seq`` as one table, so that a capture needn't read the whole log."""
        folder = f"{seq}-{uuid.uuid4().hex}"
        latest(self.captured(), "path", "seq", *KNOWN[1:], "seq").write.parquet(f"{self.folder}/snapshots/{folder}")
        self._write(f"{self.folder}/snapshots/{seq}.json", {"folder": folder})

    # -- batches
    def pending(self) -> int | None:
        """The batch that was planned but not committed."""
        return next(iter(sorted(set(self._numbers("plans")) - set(self._numbers("commits")))), None)

    def plan(self) -> int | None:
        """Writes the next batch, from the last plan's offsets to the log's end; None if the log has nothing new."""
        batch = max(self._numbers("plans"), default=-1) + 1
        begin, end = (self._read("plans", batch - 1) if batch else {"to": {}, "seq": -1}), self._log_end()
        seq = max(self._numbers("log"), default=-1)
        if begin["to"] == end["ends"]:
            return None
        self._write(f"{self.folder}/plans/{batch}.json", {"batch": batch, "from": begin["to"], "to": end["ends"], "since": begin["seq"] + 1, "seq": seq})
        return batch

    def planned(self, batch: int) -> DataFrame:
        """The records of a batch, by the offsets of its plan."""
        plan = self._read("plans", batch)
        spans = self.spark.createDataFrame([(int(p), plan["from"].get(p, 0), high) for p, high in plan["to"].items()], "partition int, low bigint, high bigint")
        rows = self.records(plan["since"]).where(F.col("seq") <= plan["seq"])
        return rows.join(F.broadcast(spans), "partition").where("offset > low and offset <= high").drop("low", "high").withColumn("batch", F.lit(batch))

    def run(self, changes: Callable[[DataFrame | None], DataFrame], process: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int | None:
        """One batch: an unfinished plan is replayed as it stands, else ``changes`` are captured and planned. ``process`` maps
        planned records to results that keep path, partition and offset. The batch counts once its commit is written.
        None if there's nothing to do."""
        batch = self.pending()
        if batch is None:
            self.capture(changes)
            batch = self.plan()
        if batch is None:
            return None
        folder = f"{batch}-{uuid.uuid4().hex}"
        process(self.planned(batch)).dropDuplicates(["path", "partition", "offset"]).write.parquet(f"{self.folder}/sink/{folder}")
        self._write(f"{self.folder}/commits/{batch}.json", {"batch": batch, "folder": folder})
        return batch

    def results(self) -> DataFrame | None:
        """The records of all committed batches. Each path and offset is there once: plans don't overlap, and a
        batch has one folder that counts."""
        done = [f"{self.folder}/sink/{self._read('commits', b)['folder']}" for b in self._numbers("commits")]
        return self.spark.read.parquet(*done) if done else None

    def clean(self) -> int:
        """Deletes folders that no marker names (left by failed runs) and gives their number."""
        gone = 0
        for kind, markers in (("log", "log"), ("snapshots", "snapshots"), ("sink", "commits")):
            named = {self._read(markers, n)["folder"] for n in self._numbers(markers)}
            p, fs = self._fs(f"{self.folder}/{kind}")
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if x.isDirectory() and x.getPath().getName() not in named:
                    delete_path(self.spark, x.getPath().toString())
                    gone += 1
        return gone
