"""Vocabulary, term frequency and TF-IDF.

Statistics come from one pass over the tokens and one shuffle of map-side combined
``(group, term)`` rows. Vectors are then made row by row from a vocabulary of bounded
size, so no document is ever shuffled to be featurised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.operators.grouping import (
    few_groups,
    first_per_group,
    join_groups,
    join_many_groups,
)

_ALL = "_all"
#: Tokens that are counted at a time, or one longer document.
PART = 1 << 18


def adaptive_params(
    df: DataFrame, group_cols: Sequence[str], words: str = "words"
) -> DataFrame:
    """Documents, vocabulary size and minimum document frequency of each group.

    The vocabulary size is the average number of distinct tokens, the minimum document
    frequency a fifth of the documents; both are cut to whole numbers.
    """
    return df.groupBy(*group_cols).agg(
        F.count("*").alias("documents"),
        F.floor(F.avg(text.distinct_token_count(words))).cast("int").alias("vocab_size"),
        F.floor(F.count("*") / 5).cast("long").alias("min_df"),
    )


def term_rows(df: DataFrame, group_cols: Sequence[str], words: str) -> DataFrame:
    """Occurrences ``n`` and document frequency ``df`` of every ``(group, term)``.

    Tokens are counted where they lie, a part of an Arrow batch at a time, so only counts
    leave the tasks' workers and are summed. Each document adds one to a NULL term: a row with
    ``df`` 0 whose count is the number of documents.
    """
    groups = df.select(*group_cols).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups]
    schema = ", ".join([*kinds, "_found array<struct<term: string, n: bigint, df: bigint>>"])
    counted = df.select(*group_cols, F.col(words).alias("_words")).mapInArrow(_counts, schema)
    return counted.select(*group_cols, F.inline("_found")).groupBy(*group_cols, "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df")
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``group..., _found`` of rows ``group..., words``: a group's terms in a part of a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(int(np.searchsorted(ends, before + PART, side="right")), low + 1)
            yield _part_counts(batch.slice(low, high - low))
            low = high


def _part_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    *groups, words = batch.columns
    rows = len(words)
    group = np.zeros(rows, np.int64)  # numbers the different groups
    for column in groups:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.unique(group * (rows + 1) + codes, return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), sizes)
    tokens = words.flatten().dictionary_encode()
    held = tokens.is_valid().to_numpy(zero_copy_only=False)
    code = tokens.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(len(tokens.dictionary), 1)
    # documents' terms, then groups' terms: how often, and in how many documents
    met, times = np.unique(row[held] * width + code[held], return_counts=True)
    pair, at = np.unique(group[met // width] * width + met % width, return_inverse=True)
    n = np.bincount(at, times, len(pair)).astype(np.int64)
    in_docs = np.bincount(at, minlength=len(pair))
    # a NULL token counts as the one NULL that each document adds
    nulls = np.bincount(group, minlength=len(first))
    nulls += np.bincount(group[row[~held]], minlength=len(first))
    owner = np.concatenate([pair // width, np.arange(len(first))])
    order = np.argsort(owner, kind="stable")
    terms = tokens.dictionary.take(pa.array(pair % width))
    found = pa.StructArray.from_arrays(
        [
            pa.concat_arrays([terms, pa.nulls(len(first), terms.type)]).take(pa.array(order)),
            pa.array(np.concatenate([n, nulls])[order], pa.int64()),
            pa.array(np.concatenate([in_docs, np.zeros(len(first), np.int64)])[order], pa.int64()),
        ],
        ["term", "n", "df"],
    )
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))])
    return pa.RecordBatch.from_arrays(
        [*[c.take(pa.array(first)) for c in groups], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)],
        [*batch.schema.names[:-1], "_found"],
    )


def _group_totals(terms: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Documents and distinct tokens of each group, from :func:`term_rows`."""
    return terms.groupBy(*group_cols).agg(
        F.sum(F.when(F.col("df") == 0, F.col("n")).otherwise(0)).alias("documents"),
        F.sum("df").alias("distinct_tokens"),
    )


def vocabulary(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    vocab_size: int | None = None,
    min_df: float | None = None,
    words: str = "words",
) -> DataFrame:
    """The terms each group is described by: ``rank, term, n, df, documents, idf``.

    Terms found in fewer than ``min_df`` documents go (below 1 it is a share of the
    documents). The ``vocab_size`` most frequent stay, equal counts in term order; rank 0
    is the most frequent. What is not given follows from the group as in
    :func:`adaptive_params`. ``idf`` is ``ln((documents + 1) / (df + 1))``.
    """
    return vocabulary_and_totals(df, group_cols, vocab_size, min_df, words)[0]


def vocabulary_and_totals(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    vocab_size: int | None = None,
    min_df: float | None = None,
    words: str = "words",
) -> tuple[DataFrame, DataFrame]:
    """:func:`vocabulary` and one row per group with ``documents``, for groups without terms.

    Both hang on the same shuffle of term rows, which Spark runs once; filters are put on
    aggregates, not on ``term``, so that they do not reach below it and set the two apart.

    Ranking one group in one task is safe. A fixed size is cut before the shuffle. An
    adaptive minimum leaves few terms to rank: no more than nine times the average number
    of distinct tokens can be in a fifth of the documents. An adaptive size under a given
    minimum has no such bound and is cut in salted parts.
    """
    keys = list(group_cols) or [_ALL]
    if not group_cols:
        df = df.withColumn(_ALL, F.lit(0))
    return describe_groups(
        term_rows(df, keys, words),
        keys,
        vocab_size,
        min_df,
        few=not group_cols or few_groups(df, keys),
        single=not group_cols,
    )


def coarser(terms: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Term rows of larger groups from those of the groups they consist of."""
    return terms.groupBy(*group_cols, "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df")
    )


def describe_groups(
    terms: DataFrame,
    keys: Sequence[str],
    vocab_size: int | None,
    min_df: float | None,
    few: bool,
    single: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """:func:`vocabulary_and_totals` from term rows.

    ``few`` says that the number of groups is known to be small, ``single`` that there is
    but one.
    """
    totals = _group_totals(terms, keys)
    listed = terms.where(F.col("df") > 0)
    if few:
        known = join_groups(listed, F.broadcast(totals), keys)
    else:  # a term's row stands for at least one distinct token of a document
        known = join_many_groups(listed, totals, keys, F.col("distinct_tokens"))
    if min_df is None:
        floor = F.floor(F.col("documents") / 5)
    elif min_df < 1:
        floor = F.col("documents") * F.lit(float(min_df))
    else:
        floor = F.lit(min_df)
    known = known.where(F.col("df") >= floor)

    order = [F.desc("n"), F.asc("term")]
    if vocab_size is not None:
        if single:
            known = known.orderBy(*order).limit(vocab_size)
        ranked = first_per_group(known, keys, order, vocab_size)
    else:
        size = F.floor(F.col("distinct_tokens") / F.col("documents"))
        ranked = first_per_group(known, keys, order, size, salted=min_df is not None)
    kept = [k for k in keys if k != _ALL]
    found = ranked.select(
        *kept,
        (F.col("position") - 1).alias("rank"),
        "term",
        "n",
        "df",
        "documents",
        F.log((F.col("documents") + 1) / (F.col("df") + 1)).alias("idf"),
    )
    # The condition always holds. It keeps the sum in the plan when a caller drops the
    # column, and with it the shuffle in the shape that the branches share.
    return found, totals.where(F.col("documents") >= 0).select(*kept, "documents")


@dataclass(frozen=True)
class FeatureSpace:
    """A fitted vocabulary. Its size is bounded by ``vocab_size`` or a document's length."""

    terms: list[str]
    counts: list[int]
    doc_freq: list[int]
    idf: list[float]
    documents: int

    @classmethod
    def from_rows(cls, rows: Sequence) -> "FeatureSpace":
        rows = sorted(rows, key=lambda r: r["rank"])
        return cls(
            terms=[r["term"] for r in rows],
            counts=[r["n"] for r in rows],
            doc_freq=[r["df"] for r in rows],
            idf=[r["idf"] for r in rows],
            documents=rows[0]["documents"] if rows else 0,
        )

    def __len__(self) -> int:
        return len(self.terms)

    def counter(self, words: str = "words", output: str = "tf") -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(self.terms, words, output)

    def weigher(self, tf: str = "tf", output: str = "tfidf") -> ElementwiseProduct:
        """TF to TF-IDF. The document frequencies are known, so nothing is fitted."""
        return ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol=tf, outputCol=output
        )

    def model(self, words: str = "words") -> PipelineModel:
        return PipelineModel([self.counter(words), self.weigher()])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, *row)
            for i, row in enumerate(zip(self.terms, self.counts, self.doc_freq, self.idf))
        ]
        schema = "rank INT, term STRING, n BIGINT, df BIGINT, idf DOUBLE"
        return spark.createDataFrame(rows, schema)


def fit_features(
    df: DataFrame,
    vocab_size: int | None = None,
    min_df: float | None = None,
    words: str = "words",
) -> FeatureSpace:
    """Fit the vocabulary of all of ``df``; only its terms reach the driver."""
    return FeatureSpace.from_rows(
        vocabulary(df, (), vocab_size, min_df, words).collect()
    )


def fit_features_by_group(
    df: DataFrame,
    group_col: str,
    vocab_size: int | None = None,
    min_df: float | None = None,
    words: str = "words",
) -> dict:
    """The same for every value of ``group_col`` in a single pass."""
    by_group: dict = {}
    for row in vocabulary(df, [group_col], vocab_size, min_df, words).collect():
        by_group.setdefault(row[group_col], []).append(row)
    return {group: FeatureSpace.from_rows(rows) for group, rows in by_group.items()}


def tfidf(
    df: DataFrame,
    vocab_size: int | None = None,
    min_df: float | None = None,
    words: str = "words",
) -> DataFrame:
    """``df`` with sparse ``tf`` and ``tfidf`` vectors."""
    space = fit_features(df, vocab_size, min_df, words)
    return space.model(words).transform(text.filled(df, words))


def term_weights(
    df: DataFrame, space: FeatureSpace, id_col: str = "doc_id", words: str = "words"
) -> DataFrame:
    """Long form ``id, term, tf, idf, tfidf``, one row per vocabulary term of a document."""
    vector = F.unwrap_udt("tf")
    entries = (
        space.counter(words)
        .transform(text.filled(df.select(id_col, words), words))
        .select(
            id_col,
            F.inline(F.arrays_zip(vector["indices"], vector["values"])).alias("rank", "tf"),
        )
    )
    # as many rows as the vocabulary has terms
    terms = F.broadcast(space.table(df.sparkSession).select("rank", "term", "idf"))
    return entries.join(terms, "rank").select(
        id_col,
        "term",
        F.col("tf").cast("long").alias("tf"),
        "idf",
        (F.col("tf") * F.col("idf")).alias("tfidf"),
    )


def with_known_terms(
    df: DataFrame, space: FeatureSpace, words: str = "words"
) -> DataFrame:
    """Documents with at least one vocabulary term.

    Stored entries decide, not weights: a term of every document has weight 0 yet counts.
    """
    counted = space.counter(words, "_tf").transform(text.filled(df, words))
    return counted.where(F.size(F.unwrap_udt("_tf")["indices"]) > 0).drop("_tf")
