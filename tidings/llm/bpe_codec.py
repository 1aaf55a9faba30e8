"""Byte-level BPE by dynamic programming over prefixes.

Byte pair encoding has a useful property: a sequence of tokens is the encoding of its bytes
exactly when every two neighbours are the encoding of theirs. So each prefix of a byte
string has one valid last token: the token that ends there and may follow the last token
of the prefix before it. Storing just that token per prefix encodes from left to right.
Appending bytes only adds entries, and after an edit the entries are as before as soon as
a longest token's worth of them in a row agrees.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import map_blocks, whole_text
from tidings.llm.splitting import Memory, public_split

RANKS = "byte_bpe_50k.tiktoken"
#: Encoded pre-tokens that a worker remembers per generation, and pairs it has judged.
REMEMBERED = 400_000


class PrefixCodec:
    """Encodes and decodes single pre-tokens with the ranks of one vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in list(self.ranks.items()):
            parts = self._merged_below(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
            elif len(parts) > 2:  # its own merges do not reach it: it never occurs
                del self.ranks[token]
        self.joined = {halves: rank for rank, halves in self.halves.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merged_below(self, data: bytes, limit: int) -> list[bytes]:
        """Parts after all merges of a rank below ``limit``, lowest and leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]
            lowest = min(ranked)
            if lowest >= limit:
                break
            at = ranked.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes together."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge across the seam comes before those inside the two tokens.

        Undoes the merges next to the seam from the last to the first. At each point the
        tokens that meet at the seam exist until the merge undone last (``before``); a
        merge of them with a lower rank would have come first.
        """
        before = 1 << 62
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            # of merges with equal rank the left one comes first
            undo_left = left > right
            if (left if undo_left else right) not in self.halves:
                undo_left = not undo_left
                if (left if undo_left else right) not in self.halves:
                    return True
            if undo_left:
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Fill in the last tokens of all prefixes of ``data`` that ``last`` lacks.

        ``last[i]`` is the last token of the first ``i`` bytes, ``last[0]`` is -1.
        """
        ranks, tokens, longest = self.ranks, self.tokens, self.longest
        pairs, may_follow = self.pairs, self.may_follow
        for end in range(len(last), (len(data) if until is None else until) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                before = last[start]
                if before < 0:
                    break
                known = pairs.get((before, token))
                if known or (known is None and may_follow(before, token)):
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            last.append(token)
        return last

    def splice(
        self, data: bytes, last: list[int], start: int, stop: int, new: bytes
    ) -> tuple[bytes, list[int]]:
        """The data with ``start:stop`` replaced by ``new``, and its last tokens.

        Entries before the edit stay. Behind it, entries are found anew until as many in
        a row as the longest token has bytes equal the old ones; the rest is unchanged.
        """
        edited = data[:start] + new + data[stop:]
        shift = len(new) - (stop - start)
        found, alike = last[: start + 1], 0
        while len(found) <= len(edited):
            self.extend(edited, found, len(found))
            end = len(found) - 1
            behind = end - (start + len(new))
            same = behind > 0 and found[end] == last[end - shift]
            alike = alike + 1 if same else 0
            if alike >= self.longest:
                found += last[end - shift + 1 :]
        return edited, found

    def ids(self, last: list[int]) -> list[int]:
        """Tokens of the whole string, read from its end."""
        found, end = [], len(last) - 1
        while end > 0:
            found.append(last[end])
            end -= len(self.tokens[last[end]])
        return found[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.ids(self.extend(data, [-1]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextCodec:
    """Encodes texts pre-token by pre-token, and remembers pre-tokens as packed ids."""

    def __init__(self, path: str):
        self.codec = PrefixCodec(path)
        self.split = public_split()
        self.known = Memory(self._packed, REMEMBERED)
        self.piece, self.last = b"", [-1]

    def _packed(self, piece: str) -> bytes:
        data = piece.encode()
        shared = 0
        for a, b in zip(data, self.piece):
            if a != b:
                break
            shared += 1
        # the prefix in common with the pre-token encoded before is an append
        self.last = self.codec.extend(data, self.last[: shared + 1])
        self.piece = data
        ids = self.codec.ids(self.last)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.

        Pre-tokens not known yet are encoded in order, as neighbours share prefixes.
        """
        self.known.turn()
        pieces = [self.split(text) for text in texts]
        known = self.known
        for piece in sorted(p for p in set().union(*pieces) if p not in known):
            known[piece]
        return [b"".join(map(known.__getitem__, ps)) for ps in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return self.codec.decode(np.frombuffer(packed, "<u4").tolist())


@lru_cache(maxsize=2)
def text_codec(name: str = RANKS) -> TextCodec:
    return TextCodec(public_tokenizers.path(name))


def encode(
    docs: DataFrame,
    ranks: str = RANKS,
    key: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """Per row: ``key``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``.

    Each match of the splitting pattern is encoded separately, without special tokens.
    NULL and empty texts have no ids. Repeated keys give a row each; an empty table gives
    none; other columns are not read. With ``decoded`` the ids are decoded again in the
    same pass, to the binary column of this name.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = text_codec(ranks)
        ids = codec.encode_all([text.as_py() for text in batch.column(1)])
        columns = [
            batch.column(0),
            pa.array(ids, pa.binary()),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
        ]
        names = ["key", "ids", "n_tokens"]
        if decoded:
            columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = f"key {kind}, ids binary, n_tokens long" + ", decoded binary" * decoded
    return map_blocks(read, schema, run).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Add ``decoded``, the bytes that the column ``ids`` stands for (NULL: no bytes)."""

    @F.pandas_udf("binary")
    def bytes_of(ids):
        codec = text_codec(ranks)
        return ids.map(lambda packed: codec.decode(packed) if packed is not None else b"")

    return encoded.withColumn("decoded", bytes_of("ids"))
