"""Cleaned tokens of whole Arrow batches, from the bytes of their texts.

The same tokens as ``text.tokens`` of ``text.clean_article`` (trimmed) or ``text.clean_for_lda``,
without stop words. All that either keeps is ASCII, and no byte of a longer UTF-8 character is,
so bytes can be judged one by one, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at a time, unless a single text is longer.
BLOCK_BYTES = 1 << 20

_DROPPED, _BLANK, _DIGIT, _LETTER = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\x0b\f\r")] = _BLANK
_KIND[list(b"0123456789")] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND[65:91] = _KIND[97:123] = _LETTER


def article_words(df: DataFrame, text: str, stop_words: Sequence[str], output: str = "words") -> DataFrame:
    """Add the tokens of ``text`` as ``clean_article`` leaves it, trimmed, without stop words."""
    return df.withColumn(output, _column(F.col(text), _article, stop_words))


def lda_words(df: DataFrame, text: str, stop_words: Sequence[str], output: str = "words") -> DataFrame:
    """Add the tokens of ``text`` as ``clean_for_lda`` leaves it, without stop words in any case."""
    listed = [w.lower() for w in stop_words]
    return df.withColumn(output, _column(F.lower(F.col(text)), _lda, listed))


Split = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _column(text: Column, split: Split, stop_words: Sequence[str]) -> Column:
    listed = list(stop_words)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        gone = pa.array(listed, pa.string())
        found = [_without(*split(block), gone) for block in _blocks(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    return words(text)


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of bounded text, or one longer text each."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = done = 0
    while first < len(texts):
        last = max(int(np.searchsorted(ends, done + BLOCK_BYTES, side="right")), first + 1)
        yield texts.slice(first, last - first)
        first, done = last, int(ends[last - 1])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice of large strings, and the offset of every row, with the end."""
    texts = texts.fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8, size, int(offsets[0])), offsets - offsets[0]


def _without(
    data: np.ndarray, sizes: np.ndarray, first: np.ndarray, stop_words: pa.Array
) -> pa.ListArray:
    """Lists of tokens that are not stop words: those of row ``i`` are ``first[i]:first[i + 1]``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    tokens = pa.StringArray.from_buffers(len(sizes), buffers[1], buffers[2])
    kept = pc.invert(pc.is_in(tokens, stop_words))
    places = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places[first], pa.int32()), tokens.filter(kept))


def _nulls(texts: pa.Array) -> np.ndarray:
    return texts.is_null().to_numpy(zero_copy_only=False)


def _article(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the tokens, their sizes, and where each row's begin, with the end."""
    data, offsets = _bytes(texts)
    kind = _KIND[data]
    kept = kind != _DROPPED  # what is dropped does not part words
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    data, kind = _LOWER[data[kept]], kind[kept]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind > _BLANK
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    short = (ends - starts <= 2) & (kind[starts] == _LETTER) & (kind[ends - 1] == _LETTER)
    starts, ends = starts[~short], ends[~short]
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] = 1
    change[ends] -= 1
    data = data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    first = np.searchsorted(starts, offsets)
    # a text that nothing is left of has one empty token
    empty = (first[1:] == first[:-1]) & ~_nulls(texts)
    sizes = np.insert(ends - starts, first[:-1][empty], 0)
    return data, sizes, first + np.concatenate([[0], np.cumsum(empty)])


def _lda(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for lower-case texts: each run of blanks parts two tokens, which may be empty."""
    data, offsets = _bytes(texts)
    kind = _KIND[data]
    blank = np.zeros(len(data) + 1, bool)
    blank[1:] = kind == _BLANK
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    parts = np.concatenate([[0], np.cumsum(blank[1:] & (~blank[:-1] | edge[:-1]))])
    rows = len(texts)
    start = parts[offsets] + np.arange(rows + 1)  # the first token of every row, with the end
    letter = np.flatnonzero(kind == _LETTER)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    token = parts[letter + 1] + row[letter]
    sizes = np.bincount(token, minlength=int(start[-1]))
    sizes[sizes <= 2] = 0
    data = data[letter[sizes[token] > 0]]
    # empty tokens behind the last other one go; a text of one empty token has that
    at = np.arange(len(sizes))
    last = np.maximum.reduceat(np.where(sizes > 0, at, -1), start[:-1])
    count = np.where(last >= 0, last + 1 - start[:-1], np.diff(start) == 1) * ~_nulls(texts)
    kept = at < np.repeat(start[:-1] + count, np.diff(start))
    return data, sizes[kept], np.concatenate([[0], np.cumsum(count)])
