"""Two levels of LDA topics with soft membership."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidings.functions import byte_words, text
from tidings.operators.features import FeatureSpace, fit_features, fit_features_by_group
from tidings.operators.fits import in_parallel, lay_out
from tidings.session import folder_names, small_side, stage


@dataclass(frozen=True)
class LdaParams:
    k: int
    topic_length: int = 3
    max_iter: int = 20
    vocab_size: int = 20
    min_df: float = 1
    min_probability: float = 0.3
    seed: int = 17


LEMMAS_IN_PLACE = 100_000

# The defaults of the two levels, and of the variant with lemmas.
LDA_LEVELS = (
    LdaParams(k=3, vocab_size=20),
    LdaParams(k=2, vocab_size=10),
)
LDA_LEMMA_LEVELS = (
    LdaParams(k=4, topic_length=4, vocab_size=60, min_df=15),
    LdaParams(k=3, max_iter=15, vocab_size=40, min_df=10, min_probability=0.1),
)


def normalise_with_lemmas(
    df: DataFrame,
    lemmas: DataFrame,
    stop_words: Sequence[str] = text.DEFAULT_STOP_WORDS,
    key: str = "doc_id",
    words: str = "words",
) -> DataFrame:
    """Replace tokens by their lemma and join them back to one string per document.

    ``lemmas`` maps ``form`` to ``lemma``; a token that is not listed is its own lemma.
    Lemmas of one or two letters and stop words go, the rest is lower-cased. Documents
    without any token left keep an empty string, and so do those with NULL words. Of a form
    with several lemmas the first in order counts. Every row of ``df`` gives a row.

    A table of up to ``LEMMAS_IN_PLACE`` forms is broadcast as a dictionary: tokens are
    looked up in their arrays and never leave their row. A larger one is joined with the
    different tokens of each row, and what is found goes back to the row.
    """
    forms = lemmas.where(F.col("form").isNotNull()).groupBy("form").agg(F.min("lemma").alias("lemma"))
    listed = forms.limit(LEMMAS_IN_PLACE + 1).collect()
    if len(listed) <= LEMMAS_IN_PLACE:
        found = {r["form"]: r["lemma"] for r in listed if r["lemma"] is not None}
        return _lemmas_in_place(df, found, stop_words, key, words)
    df = df.select(key, words).withColumn("_row", F.monotonically_increasing_id())
    df = stage(df, "lemma-rows")  # row numbers must not change when a task is run again
    # only what has to be looked up travels: the different tokens of a row, without places
    different = F.explode(F.array_distinct(words)).alias("token")
    known = small_side(forms.where(F.col("lemma").isNotNull()))
    met = df.select("_row", different).join(known, F.col("token") == F.col("form"))
    found = met.groupBy("_row").agg(
        F.collect_list("form").alias("_forms"), F.collect_list("lemma").alias("_lemmas")
    )
    replaced = _replaced(words, "_forms", "_lemmas").alias("_found")
    placed = text.filled(df, words).join(found, "_row", "left")
    return _content(placed.select(key, replaced), stop_words, key)


@F.pandas_udf(ArrayType(StringType()))
def _replaced(rows: pd.Series, forms: pd.Series, lemmas: pd.Series) -> pd.Series:
    """Tokens by their lemmas, which stand beside their forms; others stay."""

    def one(row, own, theirs):
        known = {} if own is None else dict(zip(own, theirs))
        return [known.get(w, w) for w in row]

    return pd.Series([one(*row) for row in zip(rows, forms, lemmas)], dtype=object)


def _lemmas_in_place(
    df: DataFrame, lemmas: dict[str, str], stop_words: Sequence[str], key: str, words: str
) -> DataFrame:
    filled = text.filled(df.select(key, words), words)
    shared = df.sparkSession.sparkContext.broadcast(lemmas)

    @F.pandas_udf("array<string>")
    def looked_up(rows: pd.Series) -> pd.Series:
        known = shared.value
        return rows.map(lambda row: [known.get(w, w) for w in row])

    return _content(filled.select(key, looked_up(words).alias("_found")), stop_words, key)


def _content(found: DataFrame, stop_words: Sequence[str], key: str) -> DataFrame:
    """``key, content`` of ``key, _found``: lemmas that are kept, lower-cased, as one string."""
    listed = list(stop_words)
    kept = F.filter(
        "_found", lambda w: w.isNotNull() & (F.length(w) > 2) & ~w.isin(listed)
    )
    return found.select(
        key, F.array_join(F.transform(kept, lambda w: F.lower(w)), " ").alias("content")
    )


def prepare_lda(
    df: DataFrame,
    text_col: str = "text",
    key: str = "doc_id",
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] = text.DEFAULT_STOP_WORDS,
) -> DataFrame:
    """``key, words``: cleaned, tokenised, without stop words.

    With ``lemmas`` the text is stripped of punctuation and lemmatised instead.
    """
    if lemmas is None:
        return byte_words.lda_words(df, text_col, stop_words).select(key, "words")
    plain = F.regexp_replace(F.col(text_col), r"[^\p{Alnum}\s]+", "")
    tokens = df.select(key, F.filter(F.split(plain, r"\s+"), lambda w: w != "").alias("words"))
    joined = normalise_with_lemmas(tokens, lemmas, stop_words, key)
    return joined.select(key, text.tokens("content").alias("words"))


@dataclass
class LdaLevel:
    """One fitted topic model and its vocabulary; ``model`` is None without vocabulary."""

    space: FeatureSpace
    model: LDAModel | None
    params: LdaParams

    def distributions(self, df: DataFrame, words: str = "words") -> DataFrame:
        """``df`` with the ``topic_dist`` array of each document, NULL without a model."""
        if self.model is None:
            return df.withColumn("topic_dist", F.lit(None).cast("array<double>"))
        counted = self.space.counter(words, "_tf").transform(text.filled(df, words))
        return (
            self.model.transform(counted)
            .withColumn("topic_dist", vector_to_array("topicDistribution"))
            .drop("_tf", "topicDistribution")
        )

    def topics(self) -> DataFrame:
        """``topic, termIndices, termWeights, terms``: the top terms of each topic."""
        described = self.model.describeTopics(self.params.topic_length)
        return described.withColumn(
            "terms", term_names("termIndices", self.space.terms)
        )

    def save(self, path: str) -> None:
        if self.model is not None:
            self.space.counter(output="_tf").write().overwrite().save(f"{path}/tf")
            self.model.write().overwrite().save(f"{path}/lda")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: LdaParams) -> "LdaLevel":
        """A saved level; a folder without a model stands for a topic without vocabulary.

        The vocabulary is all that is needed to apply a model: counts of it are not kept.
        """
        if "lda" not in folder_names(spark, path):
            return cls(FeatureSpace([], [], [], [], 0), None, params)
        terms = CountVectorizerModel.load(f"{path}/tf").vocabulary
        return cls(FeatureSpace(terms, [], [], [], 0), LocalLDAModel.load(f"{path}/lda"), params)


def term_names(indices: Column | str, terms: Sequence[str]) -> Column:
    """Vocabulary positions as terms; the vocabulary is as long as its size parameter."""
    listed = F.lit(list(terms))
    return F.transform(indices, lambda i: F.get(listed, i))


def fit_lda_space(
    df: DataFrame,
    space: FeatureSpace,
    params: LdaParams,
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
) -> LdaLevel:
    if not len(space):
        return LdaLevel(space, None, params)
    filled = text.filled(df.select(key, words), words)
    counted = space.counter(words, "_tf").transform(filled).select(key, "_tf")
    features = lay_out(counted, key, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lda = LDA(k=params.k, maxIter=params.max_iter, seed=params.seed, featuresCol="_tf")
        return LdaLevel(space, lda.fit(features), params)
    finally:
        features.unpersist()


def fit_lda(
    df: DataFrame,
    params: LdaParams = LDA_LEVELS[0],
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
) -> LdaLevel:
    """One level of topics on ``key, words``."""
    space = fit_features(df, params.vocab_size, params.min_df, words)
    return fit_lda_space(df, space, params, key, words, partitions)


def membership(
    df: DataFrame, min_probability: float, dist: str = "topic_dist"
) -> DataFrame:
    """One row per topic that a document belongs to with at least ``min_probability``."""
    others = [c for c in df.columns if c != dist]
    return (
        text.exploded(df, *others, words=dist)
        .withColumnsRenamed({"pos": "topic", "token": "probability"})
        .where(F.col("probability") >= min_probability)
    )


def lda_topic_table(level1: DataFrame, level2: DataFrame) -> DataFrame:
    """``topic, firstLevelTopic, subtopic, secondLevelTopic``, terms joined by blanks."""
    main = level1.select("topic", F.array_join("terms", " ").alias("firstLevelTopic"))
    sub = level2.select(
        "topic", "subtopic", F.array_join("terms", " ").alias("secondLevelTopic")
    )
    return main.join(sub, "topic", "left")


@dataclass
class LdaHierarchy:
    level1: LdaLevel
    level2: dict[int, LdaLevel]
    members: DataFrame
    topics: DataFrame

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, params: tuple[LdaParams, LdaParams] = LDA_LEVELS
    ) -> "LdaHierarchy":
        """What ``fit_lda_hierarchy`` stored below ``path``."""
        first, second = params
        names = [n for n in folder_names(spark, f"{path}/secondLevel") if n.startswith("topic=")]
        level1 = LdaLevel.load(spark, f"{path}/firstLevel", first)
        level2 = {
            int(n.split("=")[1]): LdaLevel.load(spark, f"{path}/secondLevel/{n}", second) for n in names
        }
        tables = (spark.read.parquet(f"{path}/{t}") for t in ("members", "topics"))
        return cls(level1, dict(sorted(level2.items())), *tables)

    def apply(self, df: DataFrame, key: str = "doc_id", words: str = "words") -> DataFrame:
        """``key, topic, probability, subtopic_dist`` of new documents.

        A document has a row for each topic it belongs to. ``subtopic_dist`` is NULL under topics
        that have no model of their own.
        """
        least = self.level1.params.min_probability
        members = membership(self.level1.distributions(df.select(key, words), words), least)
        parts = [
            level.distributions(members.where(F.col("topic") == topic), words)
            for topic, level in self.level2.items()
        ]
        others = members.where(~F.col("topic").isin(list(self.level2)))
        found = LdaLevel(self.level1.space, None, self.level1.params).distributions(others)
        for part in parts:
            found = found.unionByName(part)
        return found.select(key, "topic", "probability", F.col("topic_dist").alias("subtopic_dist"))


def fit_lda_hierarchy(
    df: DataFrame,
    path: str,
    params: tuple[LdaParams, LdaParams] = LDA_LEVELS,
    key: str = "doc_id",
    words: str = "words",
    partitions: int | None = None,
    threads: int = 4,
) -> LdaHierarchy:
    """Fit topics, then subtopics on the members of each topic; save models and topics.

    Memberships are written once, partitioned by topic, so that every second-level fit
    reads only its own folder; second-level vocabularies come from one pass.
    """
    spark = df.sparkSession
    first, second = params
    level1 = fit_lda(df, first, key, words, partitions)
    level1.save(f"{path}/firstLevel")
    if level1.model is None:
        raise ValueError("no term reaches min_df: lower it")

    membership(
        level1.distributions(df.select(key, words), words), first.min_probability
    ).write.mode("overwrite").partitionBy("topic").parquet(f"{path}/members")
    schema = f"{key} {dict(df.dtypes)[key]}, {words} ARRAY<STRING>, probability DOUBLE, topic INT"
    members = spark.read.schema(schema).parquet(f"{path}/members")
    spaces = fit_features_by_group(
        members, "topic", second.vocab_size, second.min_df, words
    )

    def fit_topic(topic: int) -> LdaLevel:
        inside = members.where(F.col("topic") == topic)
        level = fit_lda_space(inside, spaces[topic], second, key, words, partitions)
        level.save(f"{path}/secondLevel/topic={topic}")
        return level

    found = sorted(spaces)
    level2 = dict(zip(found, in_parallel(spark, fit_topic, found, threads)))
    described = [
        level.topics().select(
            F.lit(topic).alias("topic"), F.col("topic").alias("subtopic"), "terms"
        )
        for topic, level in level2.items()
        if level.model is not None
    ]
    if described:
        sub = described[0]
        for part in described[1:]:
            sub = sub.unionByName(part)
    else:
        sub = spark.createDataFrame([], "topic INT, subtopic INT, terms ARRAY<STRING>")
    lda_topic_table(level1.topics(), sub).write.mode("overwrite").parquet(f"{path}/topics")
    return LdaHierarchy(level1, level2, members, spark.read.parquet(f"{path}/topics"))
