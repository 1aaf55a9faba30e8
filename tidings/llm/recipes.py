"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions only.

Every text is cut where its own content says so. Its recipe is the ordered list of chunk
identifiers, some eight bytes per few hundred characters, and texts are equal when their
recipes are. So long documents are never moved to be compared: only distinct chunks are
shuffled, once, to verify that an identifier stands for one chunk alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import whole_text
from tidings.session import stage

#: A chunk ends behind the first line or sentence end after 256 characters; a text without
#: one is cut after 4096. The cut depends on what the chunk holds, not on its position in
#: the file system or table.
CHUNK = r"(?s).{256,4096}?(?:\n|[.!?] )|.{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    chunk_id: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Per row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    NULL counts as the empty text. Of rows with equal texts the one with the largest key
    stays; rows that repeat this key stay together. Only ``key`` and ``text`` are read.
    ``chunk_id`` proposes identifiers. Two chunks that get the same one are told apart by
    their order among the chunks of this identifier, so a collision cannot merge texts.
    """
    read = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    cut = read.select(
        "key",
        F.transform(chunks(F.col("text")), lambda c: chunk_id(c)).alias("recipe"),
        F.sha2("text", 256).alias("text_sha256"),
    )
    recipes = stage(cut, "recipes").withColumn("detail", F.array().cast("array<int>"))

    distinct = (
        read.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .select(chunk_id(F.col("chunk")).alias("id"), "chunk")
        .distinct()
    )
    shared = distinct.groupBy("id").count().where(F.col("count") > 1).select("id")
    shared = stage(shared, "shared-identifiers")
    if not shared.isEmpty():
        recipes = _told_apart(read, recipes, distinct, shared, chunk_id)

    groups = recipes.groupBy("recipe", "detail").agg(
        F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return recipes.join(groups, ["recipe", "detail"]).select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _told_apart(
    read: DataFrame,
    recipes: DataFrame,
    distinct: DataFrame,
    shared: DataFrame,
    chunk_id: Callable[[Column], Column],
) -> DataFrame:
    """Recipes with a second list: which of the chunks of a shared identifier it is."""
    from pyspark.sql import Window as W

    ordinals = distinct.join(shared, "id").withColumn(
        "ordinal", F.row_number().over(W.partitionBy("id").orderBy("chunk"))
    )
    rows = read.select(
        F.xxhash64("key", "text").alias("row"),
        "key",
        F.sha2("text", 256).alias("text_sha256"),
        F.posexplode(chunks(F.col("text"))).alias("at", "chunk"),
    ).withColumn("id", chunk_id(F.col("chunk")))
    detail = (
        rows.join(ordinals, ["id", "chunk"])
        .groupBy("key", "text_sha256", "row")
        .agg(F.array_sort(F.collect_set(F.struct("at", "ordinal"))).alias("found"))
        .select("key", "text_sha256", F.col("found.ordinal").alias("detail"))
        .dropDuplicates(["key", "text_sha256"])
        .withColumnRenamed("key", "_key")
        .withColumnRenamed("text_sha256", "_sha")
    )
    same = recipes["key"].eqNullSafe(detail["_key"]) & (
        recipes["text_sha256"] == detail["_sha"]
    )
    return recipes.drop("detail").join(detail, same, "left").select(
        "key",
        "recipe",
        "text_sha256",
        F.coalesce("detail", F.array().cast("array<int>")).alias("detail"),
    )
