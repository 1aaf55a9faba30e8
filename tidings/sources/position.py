"""Row positions 0, 1, 2, ... without pulling rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.session import pin, shuffle_width, small_side

# monotonically_increasing_id() keeps the row number inside a partition in its low bits.
_ROW_BITS = (1 << 33) - 1


def positional_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder as ``id``, ``value`` in file order.

    A first pass counts the lines of each file block; the second adds the number of
    lines before the block. Only one row per block is ever ordered or joined, so the
    lines themselves do not move.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("rows"), F.min("at").alias("first")
    )
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "file",
        "block",
        "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
    )
    return lines.join(small_side(starts), ["file", "block"]).select(
        (F.col("offset") + F.col("at") - F.col("first")).alias("id"), "value"
    )


def index_rows(df: DataFrame, *order_by: Column | str, column: str = "idx") -> DataFrame:
    """Number the rows of ``df`` in the total order of ``order_by``.

    Range partitions are checkpointed so that both passes see the same rows in the same
    partition; what is joined back is one row per partition. ``order_by`` should end in
    a unique column: then no value can pile up in one range. ``<column>_total`` holds
    the row count.
    """
    width = shuffle_width(df.sparkSession)
    ordered = df.repartitionByRange(width, *order_by).sortWithinPartitions(*order_by)
    placed = (
        pin(ordered)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("_part").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias(f"{column}_total"),
    )
    # at most one row per partition of the checkpoint
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_offset") + F.col("_row")).alias(column),
        f"{column}_total",
    )
