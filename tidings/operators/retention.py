"""Slots of documents: append, merge, keep the newest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.grouping import first_per_group, join_groups
from tidings.session import small_side
from tidings.sources.position import index_rows

SLOTS = ("boot", "global", "local", "warehouse")


def append(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns match by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_slots(state: DataFrame, *slots: str) -> DataFrame:
    """The rows held in any of the slots."""
    return state.where(F.col("slot").isin(*slots))


def keep_newest(
    df: DataFrame,
    keys: Sequence[str],
    limit: int,
    newest_first: Sequence[str] = ("batch_id", "seq"),
) -> DataFrame:
    """The ``limit`` newest rows of every group.

    Up to the optimizer's threshold each task cuts its own rows first. A larger limit is
    compared with the counts of the groups, for which only the keys are read. Groups within it
    stay as they are and move nowhere; rows of the others are numbered in range partitions,
    so that a group is never whole in one task.
    """
    order = [F.desc(c) for c in newest_first]
    threshold = df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    if limit <= int(threshold):
        return first_per_group(df, keys, order, limit, "_newest").drop("_newest")
    over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > limit)
    if over.isEmpty():
        return df
    over = small_side(over.select(*keys))
    numbered = index_rows(join_groups(df, over, keys, "left_semi"), *keys, *order, column="_at")
    first = small_side(numbered.groupBy(*keys).agg(F.min("_at").alias("_first")))
    newest = join_groups(numbered, first, keys).where(F.col("_at") - F.col("_first") < limit)
    within = join_groups(df, over, keys, "left_anti")
    return within.select(*df.columns).unionByName(newest.select(*df.columns))


def slot_counts(state: DataFrame) -> DataFrame:
    """Rows of every slot and cluster in one aggregation."""
    return state.groupBy("slot", "cluster").agg(F.count("*").alias("documents"))
