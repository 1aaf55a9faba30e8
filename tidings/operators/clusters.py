"""Centres, distances, cost and routing of clustered vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.vectors import nearest_of, squared_distance
from tidings.session import small_side, stage

# Centres that the driver and a task hold at a time; this is 400 MB of doubles.
MAX_CENTRE_VALUES = 50_000_000


def centroids(df: DataFrame, *groups: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group as an array: ``groups..., centre``.

    Partial means are combined before the shuffle; no vector is exploded.
    """
    values = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(*groups).agg(
        vector_to_array(Summarizer.mean(values)).alias("centre")
    )


def cluster_sizes(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("documents"))


def with_distance(
    df: DataFrame, centres: DataFrame, cluster: str = "cluster", vector: str = "vector"
) -> DataFrame:
    """Add ``distance``, the squared distance of a vector to its own cluster's centre.

    Rows without a vector, without a cluster or with one that has no centre stay and have
    a NULL distance.
    """
    values = F.col(vector).cast("array<double>")
    return (
        df.join(small_side(centres.select(cluster, "centre")), cluster, "left")
        .withColumn(
            "distance",
            F.when(F.col("centre").isNotNull(), squared_distance(values, F.col("centre"))),
        )
        .select(*[c for c in df.columns if c != "distance"], "distance")
    )


def centre_blocks(centres: DataFrame) -> int:
    """In how many parts the centres have to be so that a task can hold one of them."""
    size = F.count("centre").alias("rows"), F.max(F.size("centre")).alias("width")
    held = centres.agg(*size).first()
    return -(-held["rows"] * max(held["width"] or 1, 1) // MAX_CENTRE_VALUES) or 1


def collect_centres(centres: DataFrame, cluster: str = "cluster"):
    """Ids and centres as arrays, ordered by id. Their number is bounded by the caller."""
    rows = centres.select(cluster, "centre").where(F.col("centre").isNotNull())
    rows = rows.orderBy(cluster).collect()
    ids = np.array([r[cluster] for r in rows], dtype=np.int32)
    return ids, np.array([r["centre"] for r in rows], dtype=np.float64)


def closest_of(vectors: np.ndarray, ids: np.ndarray, points: np.ndarray):
    """Id and squared distance of the closest point of each vector; ties go to the lower id.

    Products of matrices give all distances roughly; points that may be the closest within
    the rounding error are measured exactly.
    """
    best_id = np.zeros(len(vectors), np.int32)
    best = np.full(len(vectors), np.inf)
    squares = (points**2).sum(1)
    rows = max(1, _STEP_VALUES // max(len(points), 1))
    for first in range(0, len(vectors), rows):
        part = vectors[first : first + rows]
        rough = squares - 2 * part @ points.T
        size = (part**2).sum(1) + squares.max()
        near, which = np.nonzero(rough <= (rough.min(1) + 1e-9 * size)[:, None])
        exact = ((part[near] - points[which]) ** 2).sum(1)
        order = np.lexsort([ids[which], exact, near])
        row, at = np.unique(near[order], return_index=True)
        best_id[first + row] = ids[which[order[at]]]
        best[first + row] = exact[order[at]]
    return best_id, best


def nearest_centroid(
    df: DataFrame, centres: DataFrame, cluster: str = "cluster", vector: str = "vector"
) -> DataFrame:
    """Add ``cluster`` and squared ``distance`` of the closest of all centres.

    Each Arrow batch of vectors meets every centre in NumPy, and no pair of rows is ever
    formed. Centres that are too many for a task come in parts, one pass over the vectors
    for each, and the best so far is kept. A vector that is NULL or holds a NULL or NaN has
    no closest centre: both columns are NULL, as they are without any centre.
    """
    centres = stage(centres.select(cluster, "centre"), "centres")  # evaluated once
    blocks = centre_blocks(centres)
    kept = [c for c in df.columns if c not in (cluster, "distance")]
    found = df.select(*kept, F.lit(None).cast(_NEAR).alias("_near"))
    for block in range(blocks):
        mine = centres
        if blocks > 1:
            mine = centres.where(F.pmod(F.xxhash64(cluster), F.lit(blocks)) == block)
        found = _nearer(found, *collect_centres(mine, cluster), vector)
        if block + 1 < blocks:
            found = stage(found, "nearest")
    return found.select(
        *kept,
        F.col("_near.cluster").alias(cluster),
        F.col("_near.distance").alias("distance"),
    )


_NEAR = "struct<cluster: int, distance: double>"
# Distances held at a time while a batch meets its centres; this is 32 MB of doubles.
_STEP_VALUES = 4_000_000


def _matrix(batch: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector without NULL and NaN, and these vectors as one matrix."""
    lengths = pc.fill_null(pc.list_value_length(batch), -1).to_numpy(zero_copy_only=False)
    there = lengths >= 0
    flat = batch.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    gaps = np.append(0, np.cumsum(np.isnan(flat)))
    ends = np.cumsum(lengths[there])
    usable = there.copy()
    usable[there] = gaps[ends] == gaps[ends - lengths[there]]
    if (lengths[usable] != width).any():
        raise ValueError("vector and centre differ in length")
    if not usable[there].all():
        flat = flat[np.repeat(usable[there], lengths[there])]
    return usable, flat.reshape(-1, width)


def _nearer(df: DataFrame, ids: np.ndarray, matrix: np.ndarray, vector: str) -> DataFrame:
    """Update ``_near`` where one of the given centres is closer."""
    if not len(ids):
        return df
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))

    @F.arrow_udf(_NEAR)
    def closest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, points = shared.value
        for batch in batches:
            usable, vectors = _matrix(batch, points.shape[1])
            name = np.zeros(len(batch), np.int32)
            distance = np.zeros(len(batch))
            name[usable], distance[usable] = closest_of(vectors, known, points)
            yield pa.StructArray.from_arrays(
                [pa.array(name, mask=~usable), pa.array(distance, mask=~usable)],
                ["cluster", "distance"],
            )

    new, old = F.col("_new"), F.col("_near")
    closer = old.isNull() | (new["distance"] < old["distance"]) | (
        (new["distance"] == old["distance"]) & (new["cluster"] < old["cluster"])
    )
    measured = df.withColumn("_new", closest(F.col(vector)))
    return measured.withColumn(
        "_near", F.when(new["cluster"].isNotNull() & closer, new).otherwise(old)
    ).drop("_new")


def nearest_subcentre(
    df: DataFrame,
    subcentres: DataFrame,
    cluster: str = "cluster",
    subcluster: str = "subcluster",
    vector: str = "vector",
) -> DataFrame:
    """Add ``subcluster`` and ``subdistance`` among the centres of the row's own cluster.

    A cluster without subcentres leaves both NULL.
    """
    per_cluster = subcentres.groupBy(cluster).agg(
        # the few second-level centres of one node
        F.collect_list(F.struct(F.col(subcluster).alias("id"), "centre")).alias("_subs")
    )
    near = nearest_of(F.col(vector).cast("array<double>"), F.col("_subs"))
    return (
        df.join(small_side(per_cluster), cluster, "left")
        .withColumn("_near", near)
        .withColumn(subcluster, F.col("_near.id"))
        .withColumn("subdistance", F.col("_near.distance"))
        .drop("_near", "_subs")
    )


def novelty_split(df: DataFrame, threshold: float, distance: str = "distance") -> DataFrame:
    """Add ``fit``: ``novel`` beyond the threshold, ``fitted`` up to and including it."""
    return df.withColumn(
        "fit", F.when(F.col(distance) > threshold, "novel").otherwise("fitted")
    )


def route(df: DataFrame, threshold1: float, threshold2: float) -> DataFrame:
    """Add ``slot`` from ``distance`` (level 1) and ``subdistance`` (level 2).

    Novel at level 1 goes to the ``global`` container; fitted there but novel at level 2,
    or without any subtopic, to the cluster's ``local`` container; fitted at both to its
    ``warehouse``.
    """
    return df.withColumn(
        "slot",
        F.when(F.col("distance") > threshold1, "global")
        .when(F.col("subdistance") <= threshold2, "warehouse")
        .otherwise("local"),
    )


def cluster_cost(assigned: DataFrame, computed_at: str) -> DataFrame:
    """Sum of squared distances of every cluster beside those of its subclusters.

    ``assigned`` has ``cluster, distance, subcluster, subdistance`` for each document.
    Subcluster sums come first, so the per-cluster sum adds up few rows.
    """
    parts = assigned.groupBy("cluster", "subcluster").agg(
        F.sum("distance").alias("part"), F.sum("subdistance").alias("subcost")
    )
    # one row per subcluster is left
    whole = F.sum("part").over(W.partitionBy("cluster"))
    return parts.select(
        F.lit(computed_at).alias("TimeStamp"),
        F.col("cluster").cast("int").alias("firstLevelClusterIndex"),
        whole.alias("firstLevelClusterCost"),
        F.col("subcluster").cast("int").alias("secondLevelClusterIndex"),
        F.col("subcost").alias("secondLevelClusterCost"),
    )
