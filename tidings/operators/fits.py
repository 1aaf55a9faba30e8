"""Two levels of K-means over TF-IDF vectors.

Fits are reproducible: rows are hashed by ``doc_id`` into a number of partitions that follows
from the number of rows, and sorted there, because K-means sampling depends on the layout of
its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.functions.vectors import squared_distance
from tidings.operators.features import FeatureSpace, fit_features, fit_features_by_group
from tidings.operators.labels import (
    FIXED_LABELS,
    LabelParams,
    label_two_levels,
    topic_hierarchy_table,
)
from tidings.session import remove

# Rows of a partition in the layout of a fit.
LAYOUT_ROWS = 8192

# Stands for the first level among the nodes, which are numbered from 0.
LEVEL1 = -1

T = TypeVar("T")
R = TypeVar("R")


@dataclass(frozen=True)
class LevelParams:
    """One level of the hierarchy. No ``vocab_size`` / ``min_df`` means adaptive."""

    k: int
    label_length: int
    max_iter: int = 500
    vocab_size: int | None = None
    min_df: float | None = None
    normalize: bool = False
    seed: int = 17


# The defaults of the adaptive and of the fixed-parameter hierarchy.
ADAPTIVE = (
    LevelParams(k=4, label_length=5),
    LevelParams(k=2, label_length=4),
)
FIXED = (
    LevelParams(k=3, label_length=4, max_iter=100, vocab_size=100, min_df=5),
    LevelParams(k=2, label_length=4, max_iter=100, vocab_size=50, min_df=1),
)


@dataclass
class LevelModel:
    """TF, IDF and K-means of one node; ``pipeline`` is None for a leaf."""

    pipeline: PipelineModel | None

    @property
    def centres(self) -> list[list[float]]:
        if self.pipeline is None:
            return []
        return [c.tolist() for c in self.pipeline.stages[-1].clusterCenters()]

    def save(self, path: str) -> None:
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "LevelModel":
        return cls(PipelineModel.load(path))


def layout_partitions(rows: int) -> int:
    """Partitions for so many rows: ``LAYOUT_ROWS`` each, whatever the cluster."""
    return max(1, -(-rows // LAYOUT_ROWS))


def lay_out(df: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """The canonical layout of a fit's input: hashed by a unique key, sorted inside.

    The number of partitions depends on the number of rows alone, so a fit does not depend
    on the session, and no task grows with the data: ten times the rows are ten times the
    partitions. Counting reads no column but what filters need.
    """
    width = partitions or layout_partitions(df.count())
    return df.repartition(width, key).sortWithinPartitions(key)


def usable_k(features: DataFrame, column: str, k: int) -> int:
    """``k``, or the number of distinct vectors where that is smaller.

    The estimate settles it in one map-side combined pass; only data with few distinct
    vectors is counted exactly, and then a handful of hashes is shuffled.
    """
    hashed = features.select(F.xxhash64(column).alias("h"))
    roughly = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if roughly > 4 * k + 64:
        return k
    return min(k, hashed.distinct().count())


def fit_space(
    df: DataFrame,
    space: FeatureSpace,
    params: LevelParams,
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
) -> LevelModel:
    """Fit K-means on ``df`` in a given feature space.

    A node that cannot be divided - no vocabulary or a single distinct vector - is a leaf.
    """
    if not len(space):
        return LevelModel(None)
    stages = space.model(words).stages
    if params.normalize:
        stages.append(Normalizer(inputCol="tfidf", outputCol="features", p=2.0))
    column = "features" if params.normalize else "tfidf"
    filled = text.filled(df.select(key, words), words)
    vectors = PipelineModel(stages).transform(filled).select(key, column)
    features = lay_out(vectors, key, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        k = usable_k(features, column, params.k)
        if k < 2 <= params.k or k < 1:
            return LevelModel(None)
        kmeans = KMeans(
            k=k,
            initMode="k-means||",
            maxIter=params.max_iter,
            seed=params.seed,
            featuresCol=column,
            predictionCol="_node",
        )
        return LevelModel(PipelineModel([*stages, kmeans.fit(features)]))
    finally:
        features.unpersist()


def fit_level(
    df: DataFrame,
    params: LevelParams,
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
) -> tuple[LevelModel, DataFrame]:
    """Fit one level on ``key, words`` and return the model and the assigned documents."""
    space = fit_features(df, params.vocab_size, params.min_df, words)
    model = fit_space(df, space, params, key, words, partitions)
    return model, assign(df, model)


def assign(
    df: DataFrame, model: LevelModel, cluster: str = "cluster", distance: str = "distance"
) -> DataFrame:
    """Add the cluster of each document and the squared distance to its centre.

    Row by row: the model is the only thing that travels. A leaf has the single cluster
    0 and no distance.
    """
    kept = [c for c in df.columns if c not in (cluster, distance)]
    df = df.select(*kept)
    if model.pipeline is None:
        return df.withColumn(cluster, F.lit(0)).withColumn(
            distance, F.lit(None).cast("double")
        )
    features = model.pipeline.stages[-1].getFeaturesCol()
    centres = df.sparkSession.createDataFrame(
        list(enumerate(model.centres)), "_cluster INT, _centre ARRAY<DOUBLE>"
    )
    words = model.pipeline.stages[0].getInputCol()
    placed = model.pipeline.transform(text.filled(df, words))
    # k rows
    met = placed.join(
        F.broadcast(centres), placed["_node"] == centres["_cluster"], "left"
    )
    return met.select(
        *kept,
        F.col("_cluster").alias(cluster),
        squared_distance(vector_to_array(features), F.col("_centre")).alias(distance),
    )


def in_parallel(
    session: SparkSession, work: Callable[[T], R], items: Iterable[T], threads: int
) -> list[R]:
    """Run independent fits side by side, so small nodes do not wait for each other."""
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        jobs = [pool.submit(inheritable_thread_target(session)(work), i) for i in items]
        return [job.result() for job in jobs]


@dataclass
class Hierarchy:
    """A fitted two-level model with its assignments and labels."""

    level1: LevelModel
    level2: dict[int, LevelModel]
    assigned: DataFrame
    topics: DataFrame
    params: tuple[LevelParams, LevelParams] = field(default=ADAPTIVE)


def assign_level2(
    placed: DataFrame,
    nodes: dict[int, LevelModel],
    cluster: str = "cluster",
) -> DataFrame:
    """Add ``subcluster`` and ``subdistance`` with the model of each row's cluster.

    One branch per first-level cluster, each a filter and a row-by-row transform. Read
    ``placed`` from a table partitioned by cluster and every branch scans its own part.
    """
    parts = [
        assign(
            placed.where(F.col(cluster) == index), model, "subcluster", "subdistance"
        )
        for index, model in sorted(nodes.items())
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def fit_hierarchy(
    df: DataFrame,
    path: str,
    params: tuple[LevelParams, LevelParams] = ADAPTIVE,
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
    threads: int = 4,
) -> Hierarchy:
    """Fit level 1, then level 2 inside each cluster, label every node, save the models.

    First-level assignments are written once, partitioned by cluster: the second level
    then reads each cluster's folder instead of filtering the corpus again and again, and
    a lost executor costs a re-read, not a refit. The vocabularies of all second-level
    nodes come from one pass, and so do the labels of a level.
    """
    spark = df.sparkSession
    first, second = params
    level1, placed = fit_level(df, first, key, words, partitions)
    placed.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/level1")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/level1")
    spaces = fit_features_by_group(
        placed, "cluster", second.vocab_size, second.min_df, words
    )
    clusters = range(max(1, len(level1.centres)))

    def fit_node(index: int) -> LevelModel:
        if index == LEVEL1:
            level1.save(f"{path}/firstLevel")
            return level1
        space = spaces.get(index)
        if space is None:
            return LevelModel(None)
        members = placed.where(F.col("cluster") == index)
        model = fit_space(members, space, second, key, words, partitions)
        model.save(f"{path}/secondLevel/node={index}")
        return model

    work = [LEVEL1, *clusters]
    level2 = dict(zip(work, in_parallel(spark, fit_node, work, threads)))
    del level2[LEVEL1]
    assigned = assign_level2(placed, level2)
    assigned.write.mode("overwrite").partitionBy("cluster", "subcluster").parquet(
        f"{path}/assigned"
    )
    assigned = spark.read.schema(assigned.schema).parquet(f"{path}/assigned")
    remove(spark, f"{path}/level1")  # the assignments hold it all

    main, sub = label_two_levels(
        assigned, label_params(first), label_params(second), words=words
    )
    topic_hierarchy_table(main, sub).write.mode("overwrite").parquet(f"{path}/topics")
    return Hierarchy(
        level1, level2, assigned, spark.read.parquet(f"{path}/topics"), params
    )


def label_params(params: LevelParams) -> LabelParams:
    """Labels as the level asks for: adaptive, or fixed where its features are."""
    if params.vocab_size is None:
        return LabelParams(params.label_length)
    return replace(FIXED_LABELS, length=params.label_length)
