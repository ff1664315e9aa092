"""Session helper and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[tempfile.TemporaryDirectory] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests, the bench and the command line; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("notegraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where the session
    names none and runs in one process (tests) is a temporary one made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.TemporaryDirectory(prefix="notegraph-"))
        atexit.register(_own_dirs[0].cleanup)
    return _own_dirs[0].name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_live: dict[str, SparkSession] = {}


def release(spark: SparkSession, keep: set[str] | None = None) -> int:
    """Deletes the stored tables of this process but those in ``keep``, and gives their number: for callers that are done with a result."""
    gone = [p for p, s in _live.items() if p not in (keep or set())]
    for path in gone:
        _live.pop(path, None)
        delete_path(spark, path)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were stored within; what is read from them has to be written before."""
    before = set(_live)
    try:
        yield
    finally:
        release(spark, before)


def _release_all() -> None:
    try:
        for spark in set(_live.values()):
            release(spark)
    except Exception:  # the session may be gone, and its tables with it
        _live.clear()


atexit.register(_release_all)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs within deletes its shuffle files at its end: for queries that are run once, as their result is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Stored:
    """A table written to the shared folder; ``df`` reads it, ``drop()`` deletes it. Tables that nobody drops go with the
    process, or with ``release`` and ``scratch``."""

    def __init__(self, df: DataFrame, name: str = "stage"):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _live[self.path] = spark
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _live.pop(self.path, None)
        delete_path(self.spark, self.path)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder. One pass over ``df``,
    and the loss of an executor costs no more than reading the table again."""
    return Stored(df, name).df


def parts_of(spark: SparkSession) -> int:
    """Partitions for work in Python: rows that are small, but costly each, would be put together in few tasks by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
