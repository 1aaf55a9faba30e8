"""Replaying a stored table as a stream of fixed-size slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.session import shuffle_width
from tidings.sources.position import index_rows


def slices(
    df: DataFrame, *order_by: str, size: int = 50, drop_tail: bool = False
) -> DataFrame:
    """Add ``seq`` (position in ``order_by``) and ``slice`` = ``seq // size``.

    ``drop_tail`` leaves out the rows behind the last full slice.
    """
    indexed = index_rows(df, *order_by, column="seq").withColumn(
        "slice", F.floor(F.col("seq") / size)
    )
    if drop_tail:
        indexed = indexed.where(F.col("slice") < F.floor(F.col("seq_total") / size))
    return indexed.drop("seq_total")


def peek(sliced: DataFrame, *columns: str) -> DataFrame:
    """The first row of every slice. A slice without rows has none."""
    first: Column = F.min_by(F.struct(*columns), "seq").alias("first")
    return sliced.groupBy("slice").agg(first).select("slice", "first.*")


def write_slices(sliced: DataFrame, path: str) -> None:
    """Store slices in slice order, so that reading one slice touches few row groups."""
    width = shuffle_width(sliced.sparkSession)
    (
        sliced.repartitionByRange(width, "slice", "seq")
        .sortWithinPartitions("slice", "seq")
        .write.mode("overwrite")
        .parquet(path)
    )


_HANDED_OVER = "batch_id BIGINT, last BIGINT"


def _handed_over(spark: SparkSession, state: str, batch_id: int) -> int:
    """The last slice that batches before ``batch_id`` have handed over, or -1."""
    empty = spark.createDataFrame([], _HANDED_OVER)
    empty.coalesce(1).write.mode("ignore").parquet(f"{state}/start")
    marks = (
        spark.read.schema(_HANDED_OVER)
        .option("recursiveFileLookup", "true")
        .parquet(state)
        .where(F.col("batch_id") < batch_id)
    )
    last = marks.agg(F.max("last")).first()[0]
    return -1 if last is None else last


def replay(
    spark: SparkSession,
    path: str,
    batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str = "1 second",
    slices_per_batch: int = 1,
) -> StreamingQuery:
    """Hand the stored slices to ``batch`` in order, some at each trigger.

    A counting stream names the slices of a micro-batch; its checkpoint makes a restart
    resume where the last run stopped. Slices stored later are handed over as well: a tick
    that finds nothing new is made up for by the next that does. ``batch`` is called with
    the slices between the last one handed over and the number of ticks so far.
    """
    state = f"{checkpoint.rstrip('/')}/handed-over"

    def run(ticks: DataFrame, batch_id: int) -> None:
        session = ticks.sparkSession
        high = ticks.agg(F.max("value")).first()[0]
        if high is None:
            return
        done = _handed_over(session, state, batch_id)
        rows = session.read.parquet(path).where(F.col("slice").between(done + 1, high))
        last = rows.agg(F.max("slice")).first()[0]
        if last is None:
            return
        batch(rows.where(F.col("slice") <= last), batch_id)
        mark = session.createDataFrame([(batch_id, last)], _HANDED_OVER)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", slices_per_batch)
        .option("numPartitions", 1)
        .load()
    )
    return (
        ticks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
