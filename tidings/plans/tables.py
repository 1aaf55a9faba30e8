"""The published tables of a topic hierarchy: topics, pairs and costs under one version.

``version=<n>`` holds the three tables of a version, ``shown/n=<n>`` the line that makes it
visible. It is written last, so readers see all tables of a version or none of it, and a
publication that failed half-way leaves the earlier version as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators.labels import topic_pairs
from tidings.session import folder_names, remove

TABLES = ("topics", "pairs", "costs")


def _versions(spark: SparkSession, path: str, folder: str, name: str) -> list[int]:
    found = folder_names(spark, f"{path.rstrip('/')}/{folder}".rstrip("/"))
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))


def shown_version(spark: SparkSession, path: str) -> int | None:
    """The newest version that is visible."""
    shown = _versions(spark, path, "shown", "n")
    return shown[-1] if shown else None


def publish_tables(
    topics: DataFrame, costs: DataFrame, path: str, keep: int = 2
) -> int:
    """Store ``topics``, their distinct pairs and ``costs`` as the next version and show it.

    ``topics`` has ``MainTopic, SubTopic`` at least. Of older versions the ``keep - 1`` newest stay
    for readers that are under way; others are deleted, as is what failed attempts left.
    One writer at a time.
    """
    spark = topics.sparkSession
    path = path.rstrip("/")
    shown = _versions(spark, path, "shown", "n")
    version = (shown[-1] if shown else 0) + 1
    stored = f"{path}/version={version}"
    topics.write.mode("overwrite").parquet(f"{stored}/topics")
    listed = spark.read.schema(topics.schema).parquet(f"{stored}/topics")
    topic_pairs(listed).write.mode("overwrite").parquet(f"{stored}/pairs")
    costs.write.mode("overwrite").parquet(f"{stored}/costs")
    spark.range(1, numPartitions=1).select(F.lit(str(version)).alias("value")).write.mode(
        "overwrite"
    ).text(f"{path}/shown/n={version}")
    kept = {*shown[max(0, len(shown) - keep + 1) :], version} if keep > 1 else {version}
    for old in set(shown) - kept:
        remove(spark, f"{path}/shown/n={old}")
    for old in set(_versions(spark, path, "", "version")) - kept:
        remove(spark, f"{path}/version={old}")
    return version


def read_table(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the version in sight, or of the one given."""
    if table not in TABLES:
        raise ValueError(f"{table} is none of {', '.join(TABLES)}")
    version = version or shown_version(spark, path)
    if version is None:
        raise ValueError(f"nothing is published below {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}/{table}")
