"""Helpers the operators of this package share: inputs, Arrow batches, byte spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.session import spread

#: Bytes of text that one numpy step handles at most, unless a single text is longer.
BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of a data folder, spread over the cores when it has fewer splits."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


def whole_text(column: str = "text") -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def map_blocks(
    df: DataFrame,
    schema: str,
    step: Callable[[pa.RecordBatch], pa.RecordBatch],
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Apply ``step`` to slices of the Arrow batches, each of bounded text.

    The last column of ``df`` is the text. A slice holds up to ``block_bytes`` of it, or
    one longer text, so the memory of a task does not depend on how rows are batched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count in _block_rows(batch.column(batch.num_columns - 1), block_bytes):
                yield step(batch.slice(first, count))

    return df.mapInArrow(run, schema)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a column, each of up to ``block_bytes`` of text or one longer text."""
    for first, count in _block_rows(column, block_bytes):
        yield column.slice(first, count)


def _block_rows(column: pa.Array, block_bytes: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of every slice of bounded text."""
    _, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        limit = int(offsets[first]) + block_bytes
        last = int(np.searchsorted(offsets, limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last - first
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of every row, without a copy."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * kind().itemsize)
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    size = int(offsets[-1] - offsets[0])
    return np.frombuffer(data, np.uint8, size, int(offsets[0])), offsets - offsets[0]


# -- words as spans of bytes ---------------------------------------------------------

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: bytes) -> np.ndarray:
    """A table that is true for the bytes a word may hold."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row where its words begin.

    Words are maximal runs of bytes in the class ``inside`` within one row. Row ``i`` has
    the words ``first[i]:first[i + 1]``.
    """
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(flags[1:] & (~flags[:-1] | edge))
    ends = np.flatnonzero(flags[:-1] & (~flags[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        with np.errstate(over="ignore"):
            inverse = pow(int(_BASE), -1, 1 << 64)
            for at, base in enumerate((_BASE, np.uint64(inverse))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand.

    A polynomial over random byte values, from one prefix sum: no loop over words.
    """
    with np.errstate(over="ignore"):
        powers, inverse = _power_table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes."""
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.zeros(max(count, 0), np.uint64)
        if count > 0:
            for k in range(width):
                total = (total * _BASE) ^ mix(words[k : k + count] + np.uint64(k))
        return mix(total)
