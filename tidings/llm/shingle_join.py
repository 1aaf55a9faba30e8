"""N-gram Jaccard join with R-trees over count vectors.

A document is the set of its distinct five-word shingles. Shingles are hashed to groups;
how many of a set fall in each group is a point. Two sets share at most the sum over all
groups of the smaller count, and what lies below a node of an R-tree shares at most the sum
of the smaller of count and upper bound. A tree leaves out whole nodes by that bound, and
pairs by the counts; what is left is verified on the sets.

Points of unrelated texts are spread evenly, so one tree over a corpus would leave out next
to nothing. Trees are therefore built per shingle: similar sets share one of their first
shingles in any order that is common to all sets, so each set goes to the trees of those.
The order is by hash with the most frequent shingles last, so that a passage that many
documents share makes no large tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    LOWER,
    byte_class,
    map_blocks,
    mix,
    shingle_hashes,
    span_hashes,
    text_bytes,
    whole_text,
    word_spans,
)
from tidings.llm.links import linked_groups, shared_keys
from tidings.session import small_side, stage

WIDTH = 5
#: Pairs link when ``100 * shared >= PERCENT * all``.
PERCENT = 80
#: Fewest coordinates of a count vector, and shingles that a coordinate stands for at most: by
#: default, and in the fine points that make pairs. Finer counts leave out more pairs that do not
#: link, but are larger, so they travel only for sets that have a candidate by the others.
GROUPS, GROUP_SIZE, FINE = 128, 4, 1
#: Entries of a tree node.
NODE = 16
#: Shingles in more rows than this may go to the end of the order, the most frequent
#: ``MOST_COMMON`` of them. This moves work only: results are the same for any choice.
COMMON = 64
MOST_COMMON = 1 << 18
_SPACES = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row.

    A row of fewer words than ``WIDTH`` has its whole sequence as one shingle, a row
    without words none.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, _SPACES)
    words = span_hashes(data, starts, ends)
    for i in range(len(column)):
        mine = words[first[i] : first[i + 1]]
        yield np.unique(shingle_hashes(mine, min(WIDTH, len(mine)))) if len(mine) else mine


def _prefix(size: int) -> int:
    """Shingles of a set of which a similar set must hold one: all but those it may lack."""
    return size - -(-PERCENT * size // 100) + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums over a set; equal sets have equal sums."""
    with np.errstate(over="ignore"):
        a = mix(tokens).sum(dtype=np.uint64)
        b = mix(tokens ^ _OTHER).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """``id, n, a, b`` per row of ``id, text``: size and fingerprint of its set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(1)))
        marks = [_fingerprint(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()),
                pa.array([m[1] for m in marks], pa.int64()),
            ],
            ["id", "n", "a", "b"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return map_blocks(docs, f"id {kind}, n long, a long, b long", run)


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``key, same, id``: the first shingles of every set, ``common`` ones last in order.

    ``same`` is the fingerprint of the set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = sent.value
        keys, marks, sizes = [], [], []
        for tokens in shingle_sets(batch.column(1)):
            marks.append(_fingerprint(tokens)[0])
            if len(last) and len(tokens):
                at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                is_common = last[at] == tokens
                tokens = np.concatenate([tokens[~is_common], tokens[is_common]])
            keys.append(tokens[: _prefix(len(tokens))] if len(tokens) else tokens)
            sizes.append(len(keys[-1]))
        rows = np.repeat(np.arange(len(keys)), sizes)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(_signed(key)),
                pa.array(marks, pa.int64()).take(pa.array(rows, pa.int64())),
                batch.column(0).take(pa.array(rows, pa.int64())),
            ],
            ["key", "same", "id"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    return map_blocks(docs, f"key long, same long, id {kind}", run)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent of all shingles by which unlike sets meet; at most a fixed number."""
    found = (
        prefixes(docs, np.zeros(0, np.uint64))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("same").alias("least"),
            F.max("same").alias("most"),
        )
        .where((F.col("rows") > COMMON) & (F.col("least") != F.col("most")))
        .orderBy(F.desc("rows"), "key")
        .limit(MOST_COMMON)
        .select("key")
    )
    return np.array([r[0] for r in found.collect()], np.int64).view(np.uint64)


def sets_of(docs: DataFrame, whole: bool) -> DataFrame:
    """``id, point`` with packed count vectors, and ``fine`` ones or if ``whole`` ``content``, the sets.

    Of rows with the same id the one with the smallest vector counts.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(1)))
        columns = [batch.column(0), pa.array([count_vector(s) for s in sets], pa.binary())]
        last = [s.tobytes() if whole else count_vector(s, FINE) for s in sets]
        columns.append(pa.array(last, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["id", "point", name])

    kind = docs.schema["id"].dataType.simpleString()
    name = "content" if whole else "fine"
    found = map_blocks(docs, f"id {kind}, point binary, {name} binary", run)
    return found.groupBy("id").agg(F.min(F.struct("point", name)).alias("least")).select("id", "least.*")


def count_vector(tokens: np.ndarray, group_size: int = GROUP_SIZE) -> bytes:
    """Shingles per group, the number of groups following the size of the set.

    A group holds some ``group_size`` shingles: with many more of them, unlike sets would have
    like counts. A first byte tells how many bytes a count takes.
    """
    groups = GROUPS
    while groups * group_size < len(tokens):
        groups *= 2
    place = (tokens >> np.uint64(17)).astype(np.int64) & (groups - 1)
    counts = np.bincount(place, minlength=groups)
    kind = np.uint8 if counts.max() < 256 else np.uint32
    return bytes([kind().itemsize]) + counts.astype(kind).tobytes()


def _packed(point: bytes) -> np.ndarray:
    kind = np.uint8 if point[0] == 1 else np.uint32
    return np.frombuffer(point, kind, offset=1)


def unpacked(point: bytes) -> np.ndarray:
    return _packed(point).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups; numbers of groups are powers of two."""
    return point.reshape(-1, groups).sum(0)


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


class CountTree:
    """An R-tree over count vectors of one length, packed by size and counts.

    ``names`` are the numbers of the sets and ``own`` their groups so far.
    """

    def __init__(self, points: np.ndarray, names: np.ndarray, own: np.ndarray):
        self.points, self.names, self.own = points, names, own
        self.size = points.sum(1, dtype=np.int64)
        # neighbours in this order have like sizes and like counts
        self.order = np.lexsort([*self.points.T[:4][::-1], self.size])
        level = [self._leaf(self.order[i : i + NODE]) for i in range(0, len(points), NODE)]
        while len(level) > 1:
            level = [self._node(level[i : i + NODE]) for i in range(0, len(level), NODE)]
        self.root = level[0] if level else None

    def _leaf(self, rows: np.ndarray) -> dict:
        groups = np.unique(self.own[rows])
        return {
            "rows": rows,
            "upper": self.points[rows].max(0),
            "smallest": self.size[rows].min(),
            "largest": self.size[rows].max(),
            "group": groups[0] if len(groups) == 1 else None,
        }

    def _node(self, children: list[dict]) -> dict:
        group = children[0]["group"]
        return {
            "children": children,
            "upper": np.max([c["upper"] for c in children], 0),
            "smallest": min(c["smallest"] for c in children),
            "largest": max(c["largest"] for c in children),
            "group": group if all(c["group"] == group for c in children) else None,
        }


def tree_pairs(one: CountTree, two: CountTree) -> list[tuple]:
    """Names and bounds of pairs of different groups that may link, by pairs of nodes.

    A pair of nodes is left out by its bound, two leaves are compared at once. A tree joined
    with itself gives each pair once.
    """
    found, todo = [], [(one.root, two.root)]
    while todo:
        a, b = todo.pop()
        if a["group"] is not None and a["group"] == b["group"]:
            continue
        if a is not b:
            if 100 * a["largest"] < PERCENT * b["smallest"] or 100 * b["largest"] < PERCENT * a["smallest"]:
                continue
            shared = np.minimum(a["upper"], b["upper"]).sum(dtype=np.int64)
            # a link needs shared >= p / (100 + p) of both sizes together
            if (100 + PERCENT) * shared < PERCENT * (a["smallest"] + b["smallest"]):
                continue
        if a is b and "children" in a:
            todo += [(x, y) for k, x in enumerate(a["children"]) for y in a["children"][k:]]
        elif "children" in a:
            todo += [(x, b) for x in a["children"]]
        elif "children" in b:
            todo += [(a, y) for y in b["children"]]
        else:
            rows, others = a["rows"], b["rows"]
            bound = np.minimum(one.points[rows][:, None], two.points[others]).sum(2, dtype=np.int64)
            both = one.size[rows][:, None] + two.size[others]
            fits = ((100 + PERCENT) * bound >= PERCENT * both) & (one.own[rows][:, None] != two.own[others])
            i, j = np.nonzero(np.triu(fits, 1) if a is b else fits)
            found.append((one.names[rows[i]], two.names[others[j]], bound[i, j] / both[i, j]))
    return found


def may_link(a: bytes, b: bytes) -> bool:
    """The bound of a tree on a single pair of points."""
    x, y = unpacked(a), unpacked(b)
    groups = min(len(x), len(y))
    shared = np.minimum(folded(x, groups), folded(y, groups)).sum()
    return (100 + PERCENT) * shared >= PERCENT * (x.sum() + y.sum())


def candidates(points: list[bytes], own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different groups whose bound allows a link, those of the highest bound first.

    A tree holds the points of one length. Points of twice the length are folded to meet
    it; longer ones have more than twice the shingles and link with none of it.
    """
    if len(points) == 2:  # a tree of one pair is the pair
        if may_link(*points):
            yield 0, 1
        return
    by_length: dict[int, list[int]] = {}
    vectors = [_packed(p) for p in points]
    for i, v in enumerate(vectors):
        by_length.setdefault(len(v), []).append(i)
    parts = []
    for groups, names in by_length.items():
        tree = CountTree(np.stack([vectors[i] for i in names]), np.array(names), own[names])
        parts += tree_pairs(tree, tree)
        longer = by_length.get(2 * groups, [])
        if longer:
            short = np.stack([folded(vectors[i].astype(np.int32), groups) for i in longer])
            parts += tree_pairs(CountTree(short, np.array(longer), own[longer]), tree)
    if parts:
        i, j, bound = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(-bound, kind="stable")
        yield from zip(i[order].tolist(), j[order].tolist())


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id`` (its smallest reachable key).

    NULL, empty and blank texts have no shingles and link with nothing. Rows that repeat a
    key or a text get a row each, and rows of equal sets are linked. Keys are integers; a
    row with a NULL key links with nothing. If rows give a key different texts, its links are
    those of the one with the smallest count vector. Other columns are not read. Rare
    accidents aside (equal 64-bit hashes), links are exact.
    """
    read = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text"))
    rows = stage(sketches(read), "sketches")
    classes = (
        rows.where("n > 0 and id is not null")
        .groupBy("n", "a", "b")
        .agg(F.min("id").alias("first"))
    )
    common = common_shingles(read)
    shared = stage(shared_keys(prefixes(read.where("id is not null"), common)), "shared")
    named = read.where("id is not null")

    def held(ids: DataFrame, whole: bool) -> DataFrame:
        return sets_of(named.join(small_side(ids), "id", "left_semi"), whole)

    points = stage(held(shared.select("id").distinct(), False), "points")
    labels = linked_groups(
        shared,
        lambda ids: held(ids, True).select("id", "content"),
        candidates,
        similar,
        points.select("id", F.col("point").alias("content")),
        may_link,
        finer=points.select("id", F.col("fine").alias("content")),
    )
    placed = (
        classes.join(labels.withColumnRenamed("id", "first"), "first", "left")
        .select("n", "a", "b", F.coalesce("component", "first").alias("component"))
    )
    return rows.join(placed, ["n", "a", "b"], "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )
