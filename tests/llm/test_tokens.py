"""Token counts and the codec against the libraries whose vocabularies they use."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidings.llm import bpe_codec, token_counts
from tidings.llm.splitting import Memory, public_split

TEXTS = [
    "", " ", "Hello world's end", "<|endoftext|> a<|endoftext|>b", "x" * 3000,
    "日本語 🤖🤖 a՘b Ⴀᲀ 12", "\x1c\x1d  x\n\n\n y\t\t", "it's 'LL don't\r\n  ok ", "é" * 50 + "\x85\xa0",
    "  \n leading", "trailing   ", "a\x00b", "thon thon theation " * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(99, None, "y", 8), (2, TEXTS[2], "x", 7)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, key STRING, n_tokens INT").repartition(3)


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_counts_are_those_of_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_counts.token_counts(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = TEXTS[r["doc_id"]] if r["doc_id"] < 99 else ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.token_counts(docs.where("doc_id < 0")).count() == 0


def test_proved_entries_are_single_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    proved = token_counts.proved_entries(path)
    assert len(proved) > 49_000 and "<|endoftext|>" not in proved
    for entry in random.Random(0).sample(sorted(proved), 300):
        assert len(library.encode(entry, add_special_tokens=False).ids) == 1


def test_codec_is_the_library(docs, reference):
    found = bpe_codec.encode(docs, decoded=True).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = TEXTS[r["doc_id"]] if r["doc_id"] < 99 else ""
        ids = reference.encode_ordinary(text)
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
    again = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert {bytes(r["decoded"]) for r in again} == {bytes(r["decoded"]) for r in found}


def test_appends_and_edits_equal_encoding_anew(reference):
    codec, rng = bpe_codec.text_codec().codec, random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdet hionrs,.'") for _ in range(rng.randint(1, 60)))
        last = codec.extend(data, [-1])
        assert codec.ids(last) == reference._encode_single_piece(data)
        longer = data + b"tion"
        assert codec.ids(codec.extend(longer, list(last))) == reference._encode_single_piece(longer)
        low, high = sorted(rng.randint(0, len(data)) for _ in range(2))
        edited, found = codec.splice(data * 8, codec.extend(data * 8, [-1]), low, high, b"the")
        assert edited == data[:low] + b"the" + data[high:] + data * 7
        assert found == codec.extend(edited, [-1])


def test_queries_digest_what_they_encode(spark):
    from tidings.llm.catalog import QUERIES

    row = QUERIES["op9_bpe_codec"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = docs.where(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_memory_is_bounded_and_splitter_agrees():
    memory = Memory(len, 2)
    for word in ("a", "bb", "ccc", "bb"):
        memory.turn()
        assert memory[word] == len(word)
    assert len(memory) <= 2 and len(memory.old) <= 2
    split = public_split()
    for text in TEXTS:
        assert split(text) == split.exact(text)
