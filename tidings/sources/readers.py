"""File and stream scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.sources.position import positional_lines

RECORD_SCHEMA = (
    "doc_id BIGINT, words ARRAY<STRING>, batch_id BIGINT, seq BIGINT"
)


def read_articles(
    spark: SparkSession, directory: str, min_partitions: int | None = None
) -> DataFrame:
    """One row per article file, folders included: ``value``, ``file_path``."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .text(directory, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file_path"))
    )
    return _at_least(files, min_partitions)


def read_packed_articles(
    spark: SparkSession, path: str, separator: str = "\x1e", min_partitions: int | None = None
) -> DataFrame:
    """Many articles in a file, each ended by ``separator``: ``value``, ``file_path``.

    Corpora of many small files are packed like this before they are read at scale; blocks
    of one file go to several tasks. ``file_path`` also names the place in the file, so that it
    stays unique and orders articles as they stand in it.
    """
    lines = spark.read.option("lineSep", separator).text(path)
    # the low bits number rows in a block; the block is named by its own start
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.concat_ws(
        "-", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
        F.lpad(row.cast("string"), 12, "0"),
    )
    named = F.concat(F.col("_metadata.file_path"), F.lit("#"), place)
    return _at_least(lines.select("value", named.alias("file_path")), min_partitions)


def read_lines(
    spark: SparkSession, path: str, min_partitions: int | None = None
) -> DataFrame:
    """One row per line: ``value``."""
    return _at_least(spark.read.text(path), min_partitions)


def read_records(
    spark: SparkSession, path: str, min_partitions: int | None = None
) -> DataFrame:
    """Tagged lines as ``timestamp``, ``title``, ``content``."""
    return text.tagged_fields(read_lines(spark, path, min_partitions))


def _at_least(df: DataFrame, partitions: int | None) -> DataFrame:
    if partitions and df.rdd.getNumPartitions() < partitions:
        return df.repartition(partitions)
    return df


def line_stream(
    spark: SparkSession, path: str | None = None, source: str = "text", **options: object
) -> DataFrame:
    """An unbounded frame with a ``value`` line column.

    ``source`` is any line-valued streaming source; the default watches a directory.
    """
    reader = spark.readStream.format(source).options(**options)
    return reader.load(path) if path else reader.load()


def read_export(spark: SparkSession, labels: str, vectors: str) -> tuple[DataFrame, DataFrame]:
    """Label and vector lines of an export, numbered by position in their files."""
    return (
        positional_lines(spark, labels).select(
            "id", text.strip_label("value").alias("labels")
        ),
        positional_lines(spark, vectors).select(
            "id", text.strip_vector("value").alias("vectors")
        ),
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary lines without brackets: ``term``."""
    return spark.read.text(path).select(text.strip_label("value").alias("term"))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)
