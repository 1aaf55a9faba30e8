"""Session defaults and the few helpers that depend on the size of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "tidings", **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC timestamps and Arrow transfer.

    Master, memory and shuffle width are left to ``spark-submit`` or ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, which has
    no other machine to share with, falls back to a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidings-"))
    return context.getCheckpointDir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder for tables that outlive one plan."""
    return f"{shared_dir(spark).rstrip('/')}/tidings/{purpose}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so row order and ids stay fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For input of several passes that is costly to derive, such as cleaned tokens.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def staged(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``stage`` for as long as the block runs; then the table is deleted.

    Nothing that still reads the table may leave the block unevaluated.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it has ended, for as long as the block runs.

    For jobs of many steps that store what they go on with. Spark else keeps the files until
    the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path as it wants it."""
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()), there


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``; none if there is no such path."""
    system, there = _file_system(spark, path)
    if not system.exists(there):
        return []
    return [s.getPath().getName() for s in system.listStatus(there) if s.isDirectory()]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    system, there = _file_system(spark, path)
    return system.getContentSummary(there).getLength() if system.exists(there) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that nothing reads any more."""
    system, there = _file_system(spark, path)
    system.delete(there, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a bare scan that has fewer splits than the session has cores.

    Text cleaning is CPU-bound, so a handful of splits would leave cores idle. A large
    input has more splits than cores and passes through without a shuffle. Pass the
    scan itself: asking a plan with shuffles for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast ``df`` only once it is known to be small in rows and in bytes.

    The frame is evaluated once, into the shared folder, and measured there. Above a bound
    it goes back unhinted and the join is left to Spark, which shuffles both sides and
    splits skewed partitions at run time.
    """
    stored = stage(df, "small")
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, held = stored.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    if rows > max_rows or (held or 0) > max_bytes:
        return stored
    return F.broadcast(stored)
