"""Benchmark items in documents, found by exact pieces and verified by edit distance.

An item may occur with some errors, its budget. Cut in one piece more than the budget, at
least one piece occurs unchanged wherever the item does (the pigeonhole principle). All pieces
of all items are found in one pass over a text, and the surroundings of each hit are
verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import map_blocks, whole_text
from tidings.llm.edits import best_end, masks

#: Errors allowed, as a share of an item's normalised characters.
MAX_ERROR = 0.05
#: Characters of items that are compiled to one automaton; more are searched in turns.
BLOCK_CHARS = 8 << 20
_WORDS = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Lower-case words with one space between."""
    return " ".join(_WORDS.findall(text.lower()))


class Finder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], max_error: float):
        self.items = []
        pieces = defaultdict(list)
        for item_id, text in items:
            text = normalise(text or "")
            if not text:
                continue
            budget = int(max_error * len(text))
            number, count = len(self.items), budget + 1
            self.items.append((item_id, text, budget, masks(text)))
            for k in range(count):
                first, last = k * len(text) // count, (k + 1) * len(text) // count
                pieces[text[first:last]].append((number, last))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, distance, budget, end`` of the best place of each item in the text."""
        if not self.items:
            return []
        windows = defaultdict(list)
        for end, places in self.automaton.iter(text):
            for number, last in places:
                # where the item would end if it went on without an error
                windows[number].append(end + 1 - last + len(self.items[number][1]))
        found = []
        for number, ends in windows.items():
            item_id, pattern, budget, positions = self.items[number]
            reach, best = budget, None
            ends.sort()
            first = last = ends[0]
            for end in [*ends[1:], None]:
                if end is not None and end - last <= 2 * reach + 1:
                    last = end
                    continue
                begin = max(0, first - len(pattern) - reach)
                window = text[begin : last + reach]
                if len(window) >= len(pattern) - budget:
                    score, place = best_end(positions, len(pattern), window)
                    if score <= budget and (best is None or score < best[0]):
                        best = (score, begin + place)
                first = last = end
            if best is not None:
                found.append((item_id, best[0], budget, best[1]))
        return found


_RESULT = pa.schema(
    [
        ("item_id", pa.int64()),
        ("distance", pa.int64()),
        ("budget", pa.int64()),
        ("end", pa.int64()),
    ]
)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    max_error: float = MAX_ERROR,
    key: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``key, item_id, distance, budget, end`` per row and item it holds.

    ``items`` has ``item_id, text``. ``distance`` is the least edit distance of the item to
    a part of the text, both as lower-case words, ``end`` where that part ends. Texts and
    items without words hold and match nothing; NULL is empty. Repeated rows and items give
    repeated results. Items are searched in blocks of bounded size, each sent to the tasks
    in a broadcast, so their number is not limited; documents are read once per block.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    found = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        rows = [(r["item_id"], r["text"]) for r in items.where(mine).collect()]
        sent = spark.sparkContext.broadcast(rows)
        part = _search(read, sent, max_error, f"key {kind}")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)


_finders: dict[str, Finder] = {}


def _search(read: DataFrame, sent, max_error: float, key: str) -> DataFrame:
    name = uuid.uuid4().hex  # a worker compiles each block of items once

    def finder() -> Finder:
        if name not in _finders:
            _finders.clear()
            _finders[name] = Finder(sent.value, max_error)
        return _finders[name]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at = [], []
        search = finder()
        for i, text in enumerate(batch.column(1)):
            for found in search.find(normalise(text.as_py())):
                rows.append(found)
                at.append(i)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)] if rows else [
            pa.array([], t) for t in _RESULT.types
        ]
        keys = batch.column(0).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *columns], ["key", *_RESULT.names])

    schema = f"{key}, item_id long, distance long, budget long, `end` long"
    return map_blocks(read, schema, run)
