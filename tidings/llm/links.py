"""Links between similar items that share a key, and the groups they form.

Items that share no key cannot be similar, so similar pairs are looked for within keys. A
key of many items is never spelled out in pairs. First each item is compared with one
centre: the item it shares most keys with, among the most connected of each key. That joins
nearly all that belongs together. Then only keys that still hold items of different groups
are searched, and within them only across groups. No link between groups is lost: two
similar items either are in one group already or are compared in a key they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.session import stage

Candidates = Callable[[list, np.ndarray], Iterator[tuple[int, int]]]

#: Items of a key that one task compares at a time; a larger key is cut in blocks, and
#: every two blocks meet in a task.
BLOCK = 2048
#: Parts that keys are searched in if their items' contents are shuffled key by key.
PARTS = 4


def shared_keys(postings: DataFrame) -> DataFrame:
    """``key, id`` for keys that hold at least two different items.

    ``postings`` has ``key, id`` and may have ``same``; rows of a key with equal ``same``
    are copies, of which the smallest ``id`` stands for all.
    """
    same = "same" if "same" in postings.columns else "id"  # one column less to shuffle
    order = W.partitionBy("key").orderBy(same, "id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = postings.select(
        "*", F.lag(same).over(order).alias("before"), F.max(same).over(whole).alias("last")
    )
    first = F.col("before").isNull() & (F.col(same) < F.col("last"))
    return ranked.where(first | (F.col("before") != F.col(same))).select("key", "id")


def different_keys(shared: DataFrame) -> DataFrame:
    """``key, id, weight``: of keys that the same items share one stays, its weight their number.

    Texts that differ in a few places have most of their keys in common, so most keys tell
    nothing new. Sets of items are told apart by their number, ends and 128 bits of hashes.
    """
    hashes = [F.xxhash64("id"), F.xxhash64("id", F.lit(1))]
    parts = [half for h in hashes for half in (F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    sums = [F.sum(part).alias(f"s{k}") for k, part in enumerate(parts)]
    marks = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.max("id").alias("most"), *sums
    )
    kept = (
        marks.groupBy(*[c for c in marks.columns if c != "key"])
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
        .select("key", "weight")
    )
    return shared.join(kept, "key").select("key", "id", "weight")


def centres(shared: DataFrame) -> DataFrame:
    """``id, other``: each item with the centre it shares most keys with."""
    degree = shared.groupBy("id").agg(F.sum("weight").alias("degree"))
    lead = (
        shared.join(degree, "id")
        .groupBy("key")
        .agg(F.max(F.struct("degree", F.col("id").alias("other"))).alias("lead"))
        .select("key", F.col("lead.other").alias("other"))
    )
    return (
        shared.join(lead, "key")
        .where("id <> other")
        .groupBy("id", "other")
        .agg(F.sum("weight").alias("votes"))
        .groupBy("id")
        .agg(F.max(F.struct("votes", "other")).alias("best"))
        .select("id", F.col("best.other").alias("other"))
    )


def verified(
    pairs: DataFrame, items: DataFrame, similar: Callable[[bytes, bytes], bool]
) -> DataFrame:
    """The pairs ``id, other`` whose contents are similar. ``items`` has ``id, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            kept = [similar(x.as_py(), y.as_py()) for x, y in zip(a, b)]
            found = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], ["id", "other"])

    own = items.select("id", F.col("content").alias("a"))
    others = items.select(F.col("id").alias("other"), F.col("content").alias("b"))
    kind = pairs.schema["id"].dataType.simpleString()
    both = pairs.join(own, "id").join(others, "other").select("id", "other", "a", "b")
    return both.mapInArrow(run, f"id {kind}, other {kind}")


def groups(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id, component`` for all items with a link; the component is its smallest id.

    Every round takes the smallest label among neighbours and then the label of the label,
    so paths shorten by half or more. Each round is written to the shared folder.
    """
    edges = stage(
        links.select("id", "other")
        .union(links.select("other", "id"))
        .where("id <> other")
        .distinct(),
        "edges",
    )
    nearest = edges.groupBy("id").agg(F.min("other").alias("near"))
    labels = stage(
        nearest.select("id", F.least("id", "near").alias("component")), "labels"
    )
    for _ in range(most_rounds):
        known = labels.select(F.col("id").alias("other"), F.col("component").alias("theirs"))
        near = edges.join(known, "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(near, "id").select(
            "id",
            F.col("component").alias("was"),
            F.least("component", "theirs").alias("label"),
        )
        up = labels.select(F.col("id").alias("label"), F.col("component").alias("top"))
        moved = stage(
            nearer.join(up, "label", "left").select(
                "id", "was", F.least("label", "top").alias("component")
            ),
            "labels",
        )
        labels = moved.select("id", "component")
        if moved.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"groups have not settled in {most_rounds} rounds")


def across(
    shared: DataFrame,
    labels: DataFrame,
    items: DataFrame,
    candidates: Candidates,
    similar: Callable[[bytes, bytes], bool] | None,
    members: bool = False,
    forest: bool = False,
    parts: int = 1,
) -> DataFrame:
    """Links between items of a key that are in different groups so far.

    ``candidates`` gets the contents of the items of a task and their groups, and yields
    the pairs that may be similar. A pair is compared unless earlier links of the task
    already join its groups; without ``similar`` all candidates are returned, each once, or
    with ``members`` each item that has one, beside itself, or with ``forest`` only those
    that would join groups which earlier ones of the task would not.
    Keys of more than ``BLOCK`` items are compared block by block. With ``parts``, so many
    parts of the keys are searched one after the other, and links of each are stored, so that
    contents of one part alone are shuffled at a time.
    """
    known = labels.withColumnRenamed("component", "group")
    labelled = shared.join(known, "id", "left").withColumn("group", F.coalesce("group", "id"))
    mixed = (
        labelled.groupBy("key")
        .agg(
            F.min("group").alias("least"),
            F.max("group").alias("most"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("least <> most")
        .select("key", "size")
    )
    rows = stage(labelled.join(mixed, "key"), "mixed")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.struct(
                F.least("block", j).alias("low"), F.greatest("block", j).alias("high")
            ),
        )
    )
    spread = (
        rows.withColumn("blocks", blocks)
        .withColumn("block", block)
        .select("key", "id", "group", "block", met.alias("met"))
        .join(items, "id")
        .select("key", "met", "id", "group", "content")
    )
    kind = shared.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _runs(batches):
            found += _search(rows, candidates, similar, members, forest)
            if len(found) > 10_000:
                yield _links(found, batch_type)
                found = []
        yield _links(found, batch_type)

    batch_type = pa.int64() if kind == "bigint" else pa.string()

    def searched(some: DataFrame) -> DataFrame:
        sorted_rows = some.repartition("key", "met").sortWithinPartitions("key", "met")
        return sorted_rows.select(
            "key", F.col("met.low").alias("low"), F.col("met.high").alias("high"),
            "id", "group", "content",
        ).mapInArrow(search, f"id {kind}, other {kind}")

    if parts == 1:
        found = searched(spread)
    else:
        part = F.pmod(F.xxhash64("key"), F.lit(parts))
        stored = [stage(searched(spread.where(part == p)), "found") for p in range(parts)]
        found = reduce(DataFrame.unionByName, stored)
    return found if similar or members else found.select(
        F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")
    ).distinct()


def _links(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["id", "other"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows ``id, group, content`` that agree in key and blocks."""
    name, rows = None, []
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for key, low, high, *row in zip(*columns):
            if (key, low, high) != name:
                if rows:
                    yield rows
                name, rows = (key, low, high), []
            rows.append(tuple(row))
    if rows:
        yield rows


def _search(rows: list[tuple], candidates, similar, members: bool, forest: bool) -> list[tuple]:
    """Links between groups in one run; those that earlier ones imply are not compared."""
    ids, own, contents = zip(*rows)
    top = {g: g for g in own}

    def root(g):
        while top[g] != g:
            top[g] = top[top[g]]
            g = top[g]
        return g

    if len(top) < 2:  # of all blocks of a key, these two may hold one group only
        return []
    if members:
        having = {k for pair in candidates(list(contents), np.array(own)) for k in pair}
        return [(ids[k], ids[k]) for k in having]
    found = []
    for i, j in candidates(list(contents), np.array(own)):
        if similar is None and not forest:
            found.append((ids[i], ids[j]))
            continue
        a, b = root(own[i]), root(own[j])
        if a != b and (forest or similar(contents[i], contents[j])):
            top[a] = b
            found.append((ids[i], ids[j]))
    return found


def linked_groups(
    shared: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    candidates: Candidates,
    similar: Callable[[bytes, bytes], bool],
    points: DataFrame | None = None,
    bound: Callable[[bytes, bytes], bool] | None = None,
    within: Candidates | None = None,
    finer: DataFrame | None = None,
) -> DataFrame:
    """``id, component`` of all items with a similar one; see the head of this module.

    ``contents`` gives ``id, content`` of at least the items in a frame of ``id``. With
    ``points``, a small ``id, content`` of all items, and ``bound``, which tells from two
    points whether their items may be similar, only contents of pairs that pass are
    fetched: first of as many pairs as would join the groups of a key, the likeliest ones,
    then of those that are still in different groups. Both are searched for among items that
    have any candidate by ``points``, by ``finer`` points if given. With ``within``, candidates
    among contents, items that have any candidate by points are searched key by key on their
    contents, so that pairs which earlier links imply are not compared; this suits small
    contents. ``shared`` and ``points`` are read several times and should be stored tables.
    """
    shared = stage(different_keys(shared), "keys")
    pairs = centres(shared)
    if points is not None:
        pairs = stage(verified(pairs, points, bound), "likely")
    first = stage(verified(pairs, contents(_members(pairs)), similar), "links")
    labels = groups(first)
    if points is None:
        second = across(shared, labels, contents(shared.select("id")), candidates, similar)
    elif within is None:
        met = across(shared, labels, points, candidates, None, members=True)
        met = stage(met.select("id").distinct(), "likely")
        kept = stage(shared.join(met, "id", "left_semi"), "keys")
        near = (points if finer is None else finer).join(met, "id", "left_semi")
        tried = stage(across(kept, labels, near, candidates, None, forest=True), "likely")
        if tried.isEmpty():
            return labels
        linked = stage(verified(tried, contents(_members(tried)), similar), "links")
        first = first.union(linked)
        labels = groups(first)
        if linked.count() == tried.count():  # the links join whatever may be similar
            return labels
        left = across(kept, labels, near, candidates, None).join(tried, ["id", "other"], "left_anti")
        pairs = stage(left, "likely")
        second = verified(pairs, contents(_members(pairs)), similar)
    else:
        met = across(shared, labels, points, candidates, None, members=True)
        met = stage(met.select("id").distinct(), "likely")
        kept = shared.join(met, "id", "left_semi")
        second = across(kept, labels, contents(met), within, similar, parts=PARTS)
    second = stage(second, "links")
    if second.isEmpty():
        return labels
    return groups(first.union(second))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select("id").union(pairs.select(F.col("other").alias("id"))).distinct()
