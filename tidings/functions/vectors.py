"""Distances between numeric arrays, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(left: Column, right: Column) -> Column:
    """Squared Euclidean distance; arrays of different length are an error."""
    total = F.aggregate(
        F.zip_with(left, right, lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(
        F.size(left) != F.size(right),
        F.raise_error(F.lit("vector and centre differ in length")).cast("double"),
    ).otherwise(total)


def nearest_of(vector: Column, centres: Column) -> Column:
    """Closest of an array of ``struct(id, centre)`` as ``struct(distance, id)``.

    Meant for the few centres of one node; equal distances go to the lower id.
    """
    return F.array_min(
        F.transform(
            centres,
            lambda c: F.struct(
                squared_distance(vector, c["centre"]).alias("distance"),
                c["id"].alias("id"),
            ),
        )
    )
