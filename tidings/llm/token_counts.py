"""Token counts with a shortcut for text that is one token as a whole.

A tokenizer of this kind cuts a text into pre-tokens and merges the bytes of each. Most
pre-tokens of running text are themselves entries of the vocabulary, and of nearly every
entry it can be proved beforehand that it encodes alone as one token: its string is one
pre-token and its merges end in it. Those are counted by a look-up. Only the rest is merged.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidings.llm.common import map_blocks, whole_text
from tidings.llm.splitting import Memory, Splitter

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more tokens than this are over the limit.
LIMIT = 1024
#: Counts of merged pre-tokens that a worker remembers per generation.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Counter:
    """Tokens of a text: proved pre-tokens by look-up, others merged and remembered."""

    def __init__(self, path: str, proved: frozenset[str] = frozenset()):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.split = Splitter(self._library_split)
        self.proved = proved
        self.known = Memory(self._tokens, REMEMBERED)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = frozenset(special)
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def _library_split(self, text: str) -> list[str]:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[first:last] for _, (first, last) in cut]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings are pieces of their own."""
        if not self.special or not self.cut.search(text):
            return self.split(text)
        found: list[str] = []
        for part in self.cut.split(text):
            found += [part] if part in self.special else self.split(part)
        return found

    def _tokens(self, piece: str) -> int:
        if piece in self.proved or piece in self.special:
            return 1
        return self.merged(piece)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token by the merges of the tokenizer."""
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return len(self.tokenizer.model.tokenize(mapped))

    def of(self, text: str) -> int:
        self.known.turn()
        return sum(map(self.known.__getitem__, self.pieces(text)))


@lru_cache(maxsize=2)
def proved_entries(path: str) -> frozenset[str]:
    """Entries of the vocabulary that encode alone as exactly one token.

    An entry passes when its bytes are text, the splitter leaves that text in one piece,
    and its merges give one token. Others, such as parts of characters and entries that no
    merge reaches, are not looked up.
    """
    counter = Counter(path)
    to_byte = {letter: b for b, letter in byte_letters().items()}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    proved = set()
    for entry in vocabulary:
        try:
            text = bytes(to_byte[letter] for letter in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if counter.pieces(text) == [text] and counter.merged(text) == 1:
            proved.add(text)
    return frozenset(proved)


@lru_cache(maxsize=2)
def _counter(path: str, proved: frozenset[str]) -> Counter:
    return Counter(path, proved)


def token_counts(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    NULL and empty texts have 0 tokens. Special strings inside a text count as the one
    token the tokenizer makes of them. Repeated keys give a row each, an empty table
    none; other columns are not read. The proof runs once, on the driver, and the proved
    entries (at most the vocabulary) are broadcast; the vocabulary file is read by name
    from the package that every worker has.
    """
    path = public_tokenizers.path(vocabulary)
    proved = docs.sparkSession.sparkContext.broadcast(proved_entries(path))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(public_tokenizers.path(vocabulary), proved.value)
        tokens = [counter.of(text.as_py()) for text in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(tokens, pa.int64())],
            ["key", "n_bytes", "n_tokens"],
        )

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(
        F.col(key).alias("key"),
        F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
        whole_text(text).alias("text"),
    )
    counted = map_blocks(read, f"key {kind}, n_bytes long, n_tokens long", count)
    return counted.select(
        F.col("key").alias(key),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
