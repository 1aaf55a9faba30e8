"""Joins and rankings by group that hold up when one group owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.session import small_side

_SALTS = 64
#: Rows from which on a group is joined where its rows are, instead of in one task.
HOT_ROWS = 1_000_000


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a NULL group matches the NULL group; keys come from ``left``."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    match = reduce(
        lambda a, b: a & b,
        [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys],
    )
    return left.join(renamed, match, how).drop(*[f"_r_{key}" for key in keys])


def join_many_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rows: Column
) -> DataFrame:
    """Inner ``join_groups`` for more groups of ``right`` than may be broadcast.

    ``rows`` is an upper bound, from columns of ``right``, of a group's rows in ``left``. Groups of
    more than ``HOT_ROWS`` are few, for their rows are counted in ``left``: they are broadcast once
    their size is checked, and their rows stay where they are. The others are shuffled, and
    none of them is large.
    """
    hot = small_side(right.where(rows > HOT_ROWS))
    cold = right.where(~F.coalesce(rows > HOT_ROWS, F.lit(False)))
    small = join_groups(left, hot.select(*keys), keys, "left_anti")
    return join_groups(left, hot, keys).unionByName(join_groups(small, cold, keys))


def few_groups(df: DataFrame, keys: Sequence[str], most: int = 100_000) -> bool:
    """Whether ``keys`` take at most ``most`` values; reads the key columns only."""
    return df.select(*keys).distinct().limit(most + 1).count() <= most


def first_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int | Column,
    position: str = "position",
    salted: bool | None = None,
) -> DataFrame:
    """The first ``limit`` rows of every group with their 1-based ``position``.

    Up to the optimizer's threshold, Spark cuts each task's rows to a constant ``limit``
    per group before the shuffle. Where it cannot, ``salted`` first cuts every group in
    parts, so a hot group never meets whole in one task.
    """
    if salted is None:
        conf = df.sparkSession.conf
        threshold = int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
        salted = not isinstance(limit, int) or limit > threshold
    if salted:
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
            .withColumn("_at", F.row_number().over(part))
            .where(F.col("_at") <= limit)
            .drop("_salt", "_at")
        )
    whole = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(whole)).where(
        F.col(position) <= limit
    )
