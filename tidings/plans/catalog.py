"""The registered queries: each operator over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import byte_words, text
from tidings.operators import clusters, features, fits, labels, lda, retention, skipgram, word_maps
from tidings.plans import jobs, tables
from tidings.session import spread, stage, work_dir
from tidings.sources import readers, sinks
from tidings.sources import replay as replays
from tidings.sources.position import index_rows, positional_lines
from tidings.streaming.maintain import StreamConfig, TopicMaintainer
from tidings.streaming.store import TopicStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOVEL_LEVEL1 = 0.95
NOVEL_LEVEL2 = 0.9
KEEP_NEWEST = 100
COST_TIME = "2024-01-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- inputs --------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def words(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as cleaned tokens without stop words."""
    found = byte_words.article_words(documents(spark, sf_dir), "text", text.DEFAULT_STOP_WORDS)
    return found.select("doc_id", *columns, "words")


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cleaned tokens, stop words included."""
    cleaned = text.clean_article("text")
    return text.with_words(documents(spark, sf_dir), cleaned).select("doc_id", "words")


def _minutes(doc_id: str) -> Column:
    """2024-01-01 plus ``doc_id`` minutes, as 14 digits."""
    start = F.to_timestamp(F.lit("2024-01-01"))
    return F.date_format(F.timestamp_add("MINUTE", F.col(doc_id), start), "yyyyMMddHHmmss")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as article files, the headers varying with the language.

    German articles have no usable timestamp, French titles contain ``": "`` and Spanish
    articles an empty text header.
    """
    stamp = F.when(F.col("lang") == "de", "unknown").otherwise(_minutes("doc_id"))
    title = F.when(
        F.col("lang") == "fr", F.concat("source", F.lit(": "), "lang")
    ).otherwise(F.col("source"))
    gap = F.when(F.col("lang") == "es", "\n").otherwise("")
    value = F.concat(
        F.lit("Timestamp: "), stamp, F.lit("\nTitle: "), title,
        F.lit("\nText: "), gap, "text",
    )
    return documents(spark, sf_dir).select(
        "doc_id", value.alias("value"), F.col("doc_id").cast("string").alias("file_path")
    )


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tagged record lines."""
    stamp = F.to_timestamp(_minutes("doc_id"), "yyyyMMddHHmmss")
    line = text.tagged_record(stamp, F.col("source"), text.clean_article("text"))
    return documents(spark, sf_dir).select("doc_id", line.alias("value"))


def _exploded(df: DataFrame) -> DataFrame:
    return text.exploded(df, "doc_id").withColumn("pos", F.col("pos").cast("bigint"))


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# -- text ----------------------------------------------------------------------------


@query
def article_fields(spark, sf_dir):
    parsed = text.article_fields(articles(spark, sf_dir))
    return parsed.select("doc_id", _time("ts"), "title", "text", "reject_reason")


@query
def article_fields_strict(spark, sf_dir):
    parsed = text.article_fields(articles(spark, sf_dir), strict_headers=True)
    return parsed.select("doc_id", _time("ts"), "title", "text", "reject_reason")


@query
def article_ts(spark, sf_dir):
    stamp = _minutes("doc_id")
    digits = (
        F.when(F.col("lang") == "en", stamp)
        .when(F.col("lang") == "fr", F.concat(stamp, F.lit("123")))
        .when(F.col("lang") == "de", F.substring(stamp, 1, 8))
        .otherwise(F.col("source"))
    )
    return documents(spark, sf_dir).select(
        "doc_id", text.article_timestamp(digits).alias("ts")
    ).select("doc_id", _time("ts"))


@query
def article_valid(spark, sf_dir):
    parsed = text.article_fields(articles(spark, sf_dir))
    return jobs.accepted(parsed).select("doc_id", _time("ts"), "title")


@query
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.clean_article("text").alias("cleaned")
    )


@query
def clean_text_lda(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.clean_for_lda("text").alias("cleaned")
    )


@query
def stopwords_string(spark, sf_dir):
    return text.with_content(documents(spark, sf_dir), "text").select("doc_id", "content")


@query
def stopwords_tokens(spark, sf_dir):
    kept = text.drop_stop_words("words")
    return _exploded(all_tokens(spark, sf_dir).withColumn("words", kept))


@query
def stopwords_default(spark, sf_dir):
    cased = F.split(F.trim(text.clean_article("text")), " ")
    kept = text.drop_stop_words(cased, case_sensitive=False)
    return _exploded(documents(spark, sf_dir).select("doc_id", kept.alias("words")))


@query
def tokens(spark, sf_dir):
    return _exploded(all_tokens(spark, sf_dir))


@query
def token_counts(spark, sf_dir):
    return all_tokens(spark, sf_dir).select(
        "doc_id",
        text.token_count("words").cast("bigint").alias("total_words"),
        text.distinct_token_count("words").cast("bigint").alias("distinct_words"),
    )


@query
def tagged_format(spark, sf_dir):
    return tagged_lines(spark, sf_dir).select("doc_id", F.col("value").alias("line"))


@query
def tagged_fields(spark, sf_dir):
    return text.tagged_fields(tagged_lines(spark, sf_dir))


@query
def stream_tokens(spark, sf_dir):
    return _exploded(jobs.line_words(tagged_lines(spark, sf_dir)))


@query
def preprocess_articles(spark, sf_dir):
    done = jobs.accepted(jobs.prepare_articles(articles(spark, sf_dir)))
    return done.select(
        F.col("file_path").alias("doc_id"),
        text.tagged_record("ts", "title", "content").alias("line"),
    )


@query
def articles_sorted(spark, sf_dir):
    parsed = jobs.accepted(text.article_fields(articles(spark, sf_dir)))
    ranked = index_rows(parsed.select("ts", "doc_id"), "ts", "doc_id", column="rank")
    return ranked.select("rank", "doc_id", _time("ts"))


@query
def lemma_normalise(spark, sf_dir):
    cleaned = F.trim(text.clean_article("text"))
    found = stage(
        text.with_words(documents(spark, sf_dir), cleaned).select("doc_id", "words"), "words"
    )
    forms = text.exploded(found).select(F.col("token").alias("form")).distinct()
    suffixed = F.length("form") > 5
    lemmas = forms.where(suffixed & F.col("form").rlike("(ing|ed|s)$")).select(
        "form", F.regexp_replace("form", "(ing|ed|s)$", "").alias("lemma")
    )
    return lda.normalise_with_lemmas(found, stage(lemmas, "lemmas"))


@query
def strip_export(spark, sf_dir):
    lines = _export_lines(spark, sf_dir)
    return lines.select(
        "vec_id",
        text.strip_label("label_line").alias("labels"),
        text.strip_vector("vector_line").alias("vectors"),
    )


def _export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as bracketed label and vector lines of an export."""

    def part(i: int) -> Column:
        return F.floor(F.col("embedding")[i].cast("double") * 1000000).cast("string")

    label = F.concat(F.lit("[topic"), F.repeat(F.lit("x"), F.col("label") * 3), F.lit("]"))
    vector = F.concat(F.lit("[["), part(0), F.lit(","), part(1), F.lit("]]"))
    return embeddings(spark, sf_dir).select(
        "vec_id", label.alias("label_line"), vector.alias("vector_line")
    )


def _export_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both columns numbered in one go; each is a frame of its own afterwards."""
    lines = index_rows(_export_lines(spark, sf_dir), "vec_id", column="id")
    return (
        lines.select("id", text.strip_label("label_line").alias("labels")),
        lines.select("id", text.strip_vector("vector_line").alias("vectors")),
    )


@query
def positional_join(spark, sf_dir):
    return word_maps.join_by_position(*_export_frames(spark, sf_dir))


def _export_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second label of the export, as vocabulary terms."""
    term = F.concat(F.lit("topic"), F.repeat(F.lit("x"), F.col("label") * 6))
    return embeddings(spark, sf_dir).select(term.alias("term"))


@query
def vocab_semi_join(spark, sf_dir):
    lines = _export_lines(spark, sf_dir).select(
        "vec_id", text.strip_label("label_line").alias("labels")
    )
    return word_maps.keep_vocabulary(lines, _export_vocabulary(spark, sf_dir))


@query
def export_finish(spark, sf_dir):
    label_rows, vector_rows = _export_frames(spark, sf_dir)
    return word_maps.finish_export(
        label_rows, vector_rows, _export_vocabulary(spark, sf_dir)
    )


# -- features and labels -------------------------------------------------------------


@query
def adaptive_params(spark, sf_dir):
    found = features.adaptive_params(words(spark, sf_dir, "lang"), ["lang"])
    return found.select(
        "lang", "documents", F.col("vocab_size").cast("bigint").alias("vocab_size"), "min_df"
    )


@query
def vocabulary(spark, sf_dir):
    found = features.vocabulary(words(spark, sf_dir), (), vocab_size=100, min_df=5)
    return found.select(
        F.col("rank").cast("bigint").alias("rank"),
        "term", "n", "df", F.round("idf", 6).alias("idf"),
    )


@query
def vocabulary_by_group(spark, sf_dir):
    found = features.vocabulary(words(spark, sf_dir, "source"), ["source"])
    return found.select(
        "source", F.col("rank").cast("bigint").alias("rank"),
        "term", "n", "df", F.round("idf", 6).alias("idf"),
    )


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(words(spark, sf_dir), "words")
    space = features.fit_features(docs, vocab_size=100, min_df=5)
    return features.term_weights(docs, space)


@query
def doc_term_tf(spark, sf_dir):
    return _weights(spark, sf_dir).select("doc_id", "term", "tf")


@query
def doc_term_tfidf(spark, sf_dir):
    return _weights(spark, sf_dir).select(
        "doc_id", "term", "tf",
        F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"),
    )


@query
def nonzero_docs(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    space = features.fit_features(docs, vocab_size=3, min_df=5)
    return features.with_known_terms(docs, space).select("doc_id")


@query
def cluster_labels(spark, sf_dir):
    found = labels.label_groups(words(spark, sf_dir, "lang"), ["lang"], length=5)
    return found.select("lang", "documents", "label")


@query
def cluster_labels_fixed(spark, sf_dir):
    found = labels.label_groups_fixed(words(spark, sf_dir, "source"), ["source"], length=4)
    return found.select("source", "documents", "label")


@query
def topic_pairs(spark, sf_dir):
    docs = words(spark, sf_dir, "source", "lang").select(
        "doc_id", F.col("source").alias("cluster"), F.col("lang").alias("subcluster"), "words"
    )
    main, sub = labels.label_two_levels(
        docs, labels.LabelParams(4, 20, 1), labels.LabelParams(4, 20, 1)
    )
    return labels.topic_pairs(labels.topic_hierarchy_table(main, sub))


@query
def cluster_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clusters.cluster_sizes(docs, "source", "lang")


# -- vectors -------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        "vec_id", F.col("embedding").alias("vector"), F.col("label").alias("cluster")
    )


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroids(_points(spark, sf_dir), "cluster", vector="vector")


def _side() -> Column:
    """Two fixed halves of the vectors, by the sign of the first value."""
    return F.when(F.col("vector")[0] < 0, 0).otherwise(1)


def _two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest first-level centre, then the nearest of its cluster's two halves."""
    near = clusters.nearest_centroid(_points(spark, sf_dir), _centres(spark, sf_dir))
    halves = _points(spark, sf_dir).withColumn("subcluster", _side())
    subcentres = clusters.centroids(halves, "cluster", "subcluster", vector="vector")
    return clusters.nearest_subcentre(near, subcentres)


@query
def centroids(spark, sf_dir):
    found = _centres(spark, sf_dir).select("cluster", F.posexplode("centre").alias("dim", "v"))
    return found.select(
        F.col("cluster").cast("bigint").alias("cluster"),
        F.col("dim").cast("bigint").alias("dim"),
        F.round("v", 6).alias("value"),
    )


@query
def centroid_distance(spark, sf_dir):
    found = clusters.with_distance(_points(spark, sf_dir), _centres(spark, sf_dir))
    return found.select(
        "vec_id", F.col("cluster").cast("bigint").alias("cluster"),
        F.round("distance", 6).alias("distance"),
    )


@query
def nearest_centroid(spark, sf_dir):
    found = clusters.nearest_centroid(_points(spark, sf_dir), _centres(spark, sf_dir))
    return found.select(
        "vec_id", F.col("cluster").cast("bigint").alias("cluster"),
        F.round("distance", 6).alias("distance"),
    )


@query
def novelty_split(spark, sf_dir):
    near = clusters.nearest_centroid(_points(spark, sf_dir), _centres(spark, sf_dir))
    return clusters.novelty_split(near, NOVEL_LEVEL1).select("vec_id", "fit")


@query
def route_docs(spark, sf_dir):
    routed = clusters.route(_two_levels(spark, sf_dir), NOVEL_LEVEL1, NOVEL_LEVEL2)
    return routed.select(
        "vec_id",
        F.col("cluster").cast("bigint").alias("cluster"),
        F.col("subcluster").cast("bigint").alias("subcluster"),
        "slot",
    )


@query
def cluster_cost(spark, sf_dir):
    cost = clusters.cluster_cost(_two_levels(spark, sf_dir), COST_TIME)
    return cost.select(
        "TimeStamp",
        F.col("firstLevelClusterIndex").cast("bigint").alias("firstLevelClusterIndex"),
        F.round("firstLevelClusterCost", 6).alias("firstLevelClusterCost"),
        F.col("secondLevelClusterIndex").cast("bigint").alias("secondLevelClusterIndex"),
        F.round("secondLevelClusterCost", 6).alias("secondLevelClusterCost"),
    )


# -- replay and retention ------------------------------------------------------------


@query
def replay_slices(spark, sf_dir):
    # every column that is there is sorted and stored, so only the key is handed over
    ids = events(spark, sf_dir).select("event_id")
    sliced = replays.slices(ids, "event_id", size=50)
    return sliced.groupBy("slice").agg(
        F.count("*").alias("rows"),
        F.min("event_id").alias("min_id"),
        F.max("event_id").alias("max_id"),
    )


@query
def replay_peek(spark, sf_dir):
    shown = events(spark, sf_dir).select("event_id", "event_type", "value")
    sliced = replays.slices(shown, "event_id", size=50, drop_tail=True)
    return replays.peek(sliced, "event_id", "event_type", "value")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents of a cluster (the event type) that arrive in batches (users)."""
    return events(spark, sf_dir).select(
        "event_id",
        F.col("event_type").alias("cluster"),
        F.col("user_id").alias("batch_id"),
        F.col("event_id").alias("seq"),
    )


@query
def retain_newest(spark, sf_dir):
    kept = retention.keep_newest(_state(spark, sf_dir), ["cluster"], KEEP_NEWEST)
    return kept.select("event_id", "cluster", "batch_id")


@query
def union_slots(spark, sf_dir):
    held = _state(spark, sf_dir)
    container = held.where(F.col("cluster").eqNullSafe("error")).withColumn("slot", F.lit("global"))
    stored = held.where(~F.col("cluster").eqNullSafe("error")).withColumn("slot", F.lit("warehouse"))
    again = container.withColumn("slot", F.lit("boot"))
    state = retention.append(container, stored, again)
    return retention.merge_slots(state, "global", "warehouse").select("event_id", "slot")


# -- fits ----------------------------------------------------------------------------


@query
def kmeans_level1(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    model, placed = fits.fit_level(docs, fits.ADAPTIVE[0])
    return placed.select("doc_id", "cluster", "distance")


@query
def kmeans_fixed(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    model, placed = fits.fit_level(docs, fits.FIXED[0])
    return placed.select("doc_id", "cluster", "distance")


@query
def assign_level1(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    model, _ = fits.fit_level(docs, fits.FIXED[0])
    path = work_dir(spark, "assign")
    model.save(path)
    placed = fits.assign(docs, fits.LevelModel.load(path))
    return placed.select("doc_id", "cluster", "distance")


@query
def topic_hierarchy(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    fitted = fits.fit_hierarchy(docs, work_dir(spark, "hierarchy"))
    return fitted.topics.select(
        "cluster", "MainTopic", "subcluster", "documents", "SubTopic"
    )


def _measures(values: dict[str, Column], df: DataFrame) -> DataFrame:
    """One ``measure, value`` row per named aggregate of ``df``."""
    row = df.agg(*[v.cast("bigint").alias(k) for k, v in values.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in values])
    return row.select(F.inline(pairs))


@query
def kmeans_invariants(spark, sf_dir):
    """Documents assigned, and how many break a rule of the fit (none should).

    The nearest centre is found a second way, and by the model after a reload.
    """
    from pyspark.ml.functions import vector_to_array

    docs = stage(words(spark, sf_dir), "words")
    model, placed = fits.fit_level(docs, fits.FIXED[0])
    path = work_dir(spark, "assign")
    model.save(path)
    loaded = fits.LevelModel.load(path)
    again = fits.assign(docs, loaded, "reloaded", "_d").select("doc_id", "reloaded")
    centres = spark.createDataFrame(
        list(enumerate(model.centres)), "nearest INT, centre ARRAY<DOUBLE>"
    )
    vectors = loaded.pipeline.transform(docs).select(
        "doc_id", vector_to_array("tfidf").alias("vector")
    )
    near = clusters.nearest_centroid(vectors, centres, cluster="nearest").select(
        "doc_id", "nearest", F.col("distance").alias("least")
    )
    joined = placed.drop("words").join(again, "doc_id").join(near, "doc_id")
    cost = F.lit(model.pipeline.stages[-1].summary.trainingCost)
    off = F.abs(F.sum("distance") - cost) > F.lit(1e-6) * cost
    checks = {
        "documents": F.countDistinct("doc_id"),
        "rows": F.count("*"),
        "not_nearest": F.count_if(F.col("distance") > F.col("least") + 1e-6),
        "differs_when_reloaded": F.count_if(F.col("cluster") != F.col("reloaded")),
        "cost_is_off": F.when(off, 1).otherwise(0),
    }
    return _measures(checks, joined)


@query
def hierarchy_invariants(spark, sf_dir):
    """Documents of the assignments and of the topic table, and unlabelled topics."""
    docs = stage(words(spark, sf_dir), "words")
    path = work_dir(spark, "hierarchy")
    fitted = fits.fit_hierarchy(docs, path, fits.FIXED)
    topics = _measures(
        {
            "documents_in_topics": F.sum("documents"),
            "missing_labels": F.count_if(F.col("MainTopic") == ""),
        },
        fitted.topics,
    )
    assigned = _measures(
        {"documents_assigned": F.countDistinct("doc_id")}, fitted.assigned
    )
    return topics.unionByName(assigned)


@query
def lda_invariants(spark, sf_dir):
    """Documents, those without any vocabulary term, and sums that are neither 0 nor 1.

    A document without terms has no topic: its distribution is all zeros.
    """
    docs = _lda_words(spark, sf_dir)
    found = lda.fit_lda(docs).distributions(docs)
    total = F.aggregate("topic_dist", F.lit(0.0), lambda a, b: a + b)
    return _measures(
        {
            "documents": F.countDistinct("doc_id"),
            "without_terms": F.count_if(total == 0),
            "do_not_add_up": F.count_if((total != 0) & (F.abs(total - 1) > 1e-6)),
        },
        found,
    )


@query
def word_vectors_words(spark, sf_dir):
    """The words that get a vector: all that occur often enough, before any training."""
    least = word_maps.WordParams().min_count
    return skipgram.word_counts(words(spark, sf_dir)).where(F.col("count") >= least).select("word")


def _lda_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(lda.prepare_lda(documents(spark, sf_dir)), "words")


@query
def lda_level1(spark, sf_dir):
    docs = _lda_words(spark, sf_dir)
    found = lda.fit_lda(docs).distributions(docs)
    return found.select("doc_id", "topic_dist")


@query
def lda_topics(spark, sf_dir):
    return lda.fit_lda(_lda_words(spark, sf_dir)).topics()


@query
def lda_membership(spark, sf_dir):
    docs = _lda_words(spark, sf_dir)
    found = lda.fit_lda(docs).distributions(docs)
    return lda.membership(found.select("doc_id", "topic_dist"), 0.3)


@query
def lda_hierarchy(spark, sf_dir):
    docs = _lda_words(spark, sf_dir)
    return lda.fit_lda_hierarchy(docs, work_dir(spark, "lda")).topics


@query
def word_vectors(spark, sf_dir):
    return word_maps.word_vectors(stage(words(spark, sf_dir), "words"))


@query
def pca2(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    vectors = _points(spark, sf_dir).select(
        "vec_id", array_to_vector(F.col("vector").cast("array<double>")).alias("vector")
    )
    return word_maps.project_2d(vectors).select("vec_id", "x", "y")


@query
def inspect_export(spark, sf_dir):
    docs = stage(words(spark, sf_dir), "words")
    _, maps = jobs.inspect(docs, work_dir(spark, "inspect"))
    return maps.select("level", "cluster", "subcluster", "word", "x", "y")


@query
def inspect_words(spark, sf_dir):
    """Words and counts of the corpus, of every language and of its sources."""
    placed = words(spark, sf_dir, "lang", "source")
    return word_maps.node_words(placed, "lang", "source")


# -- what holds for every fit, and round trips through files ---------------------------


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as arrays, every seventh NULL and every eleventh with a NaN."""
    values = F.col("embedding").cast("array<double>")
    broken = F.transform(
        values, lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v)
    )
    return embeddings(spark, sf_dir).select(
        "vec_id",
        "label",
        F.when(F.col("vec_id") % 7 != 0, F.when(F.col("vec_id") % 11 == 0, broken).otherwise(values))
        .alias("vector"),
    )


@query
def assign_with_gaps(spark, sf_dir):
    """Nearest centres of vectors some of which are NULL or NaN, and own distances."""
    means = clusters.centroids(embeddings(spark, sf_dir), "label")
    centres = stage(means.withColumnRenamed("label", "cluster"), "centres")
    near = clusters.nearest_centroid(_gaps(spark, sf_dir), centres)
    unlisted = F.when(F.col("label") % 2 == 0, F.col("label"))
    own = clusters.with_distance(
        near.withColumnRenamed("distance", "least").withColumnRenamed("cluster", "nearest")
        .withColumn("cluster", unlisted),
        centres,
    )
    return own.select(
        "vec_id",
        F.col("nearest").cast("bigint").alias("nearest"),
        F.when(~F.isnan("least"), F.round("least", 6)).alias("least"),
        F.when(~F.isnan("distance"), F.round("distance", 6)).alias("own"),
    )


@query
def words_with_gaps(spark, sf_dir):
    """Documents by whether they hold a known term; every fifth text is NULL."""
    holed = documents(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    )
    docs = stage(
        text.with_words(holed, F.trim(text.clean_article("text")), text.DEFAULT_STOP_WORDS)
        .select("doc_id", F.when(F.col("text").isNotNull(), F.col("words")).alias("words")),
        "words",
    )
    model, placed = fits.fit_level(docs, fits.FIXED[0])
    checks = {
        "documents": F.countDistinct("doc_id"),
        "without_words": F.count_if(F.size("words") == 0),
        "without_cluster": F.count_if(F.col("cluster").isNull()),
    }
    return _measures(checks, placed)


@query
def adaptive_fit_invariants(spark, sf_dir):
    """The adaptive fit: its vocabulary, and clusters of all documents."""
    docs = stage(words(spark, sf_dir), "words")
    model, placed = fits.fit_level(docs, fits.ADAPTIVE[0])
    checks = {
        "documents": F.countDistinct("doc_id"),
        "terms": F.lit(len(model.pipeline.stages[0].vocabulary)),
        "not_a_cluster": F.count_if(~F.col("cluster").between(0, len(model.centres) - 1)),
        "negative_distance": F.count_if(F.col("distance") < 0),
    }
    return _measures(checks, placed)


@query
def lda_topic_invariants(spark, sf_dir):
    """Topics of the fit: terms stand at their indices and weights descend."""
    level = lda.fit_lda(_lda_words(spark, sf_dir))
    terms = F.array(*[F.lit(t) for t in level.space.terms])
    named = F.transform("termIndices", lambda i: F.get(terms, i))
    falling = F.forall(
        F.sequence(F.lit(1), F.size("termWeights") - 1),
        lambda i: F.get("termWeights", i - 1) >= F.get("termWeights", i),
    )
    checks = {
        "topics": F.count("*"),
        "terms_listed": F.sum(F.size("terms")),
        "other_terms": F.count_if(named != F.col("terms")),
        "weights_rise": F.count_if(~falling),
    }
    return _measures(checks, level.topics())


@query
def lda_membership_invariants(spark, sf_dir):
    """Memberships against the distributions they come from."""
    docs = _lda_words(spark, sf_dir)
    found = stage(lda.fit_lda(docs).distributions(docs).select("doc_id", "topic_dist"), "dist")
    expected = found.select(
        "doc_id", F.size(F.filter("topic_dist", lambda p: p >= 0.3)).alias("expected")
    )
    got = lda.membership(found, 0.3).groupBy("doc_id").agg(
        F.count("*").alias("members"), F.min("probability").alias("least")
    )
    joined = expected.join(got, "doc_id", "left")
    checks = {
        "documents": F.count("*"),
        "differ": F.count_if(F.col("expected") != F.coalesce("members", F.lit(0))),
        "too_low": F.count_if(F.col("least") < 0.3),
        "no_topic": F.count_if(F.col("members").isNull()),
    }
    return _measures(checks, joined)


@query
def lda_hierarchy_invariants(spark, sf_dir):
    """Every topic is listed with its subtopics, and every list has its length."""
    fitted = lda.fit_lda_hierarchy(_lda_words(spark, sf_dir), work_dir(spark, "lda"))
    first, second = lda.LDA_LEVELS
    checks = {
        "topics": F.countDistinct("topic"),
        "subtopics": F.count("subtopic"),
        "short_topics": F.count_if(F.size(F.split("firstLevelTopic", " ")) != first.topic_length),
        "short_subtopics": F.count_if(
            F.size(F.split("secondLevelTopic", " ")) != second.topic_length
        ),
    }
    return _measures(checks, fitted.topics)


@query
def pca_invariants(spark, sf_dir):
    """Two components: uncorrelated, the first the wider, no more than all variance."""
    placed = stage(pca2(spark, sf_dir), "pca")
    spread_x, spread_y = F.var_samp("x"), F.var_samp("y")
    values = _points(spark, sf_dir).select(F.posexplode("vector").alias("at", "v"))
    total = values.groupBy("at").agg(F.var_samp("v").alias("s")).agg(F.sum("s")).first()[0]
    checks = {
        "rows": F.count("*"),
        "correlated": F.when(
            F.abs(F.covar_samp("x", "y")) > 1e-6 * (spread_x + spread_y), 1
        ).otherwise(0),
        "second_is_wider": F.when(spread_y > spread_x + 1e-9, 1).otherwise(0),
        "too_wide": F.when(spread_x + spread_y > total * (1 + 1e-9), 1).otherwise(0),
    }
    return _measures(checks, placed)


def _minutes_at() -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))


@query
def line_scan(spark, sf_dir):
    """Tagged lines written in time order and read back by position."""
    path = work_dir(spark, "lines")
    articles = documents(spark, sf_dir).select(
        _minutes_at().alias("ts"),
        F.col("source").alias("title"),
        F.regexp_replace("text", r"[\s<>]+", " ").alias("content"),
        F.col("doc_id").cast("string").alias("file_path"),
    )
    sinks.write_tagged(articles, path)
    fields = text.tagged_fields(positional_lines(spark, path))
    return fields.select("id", "timestamp", "title", F.length("content").alias("content_chars"))


@query
def article_scan(spark, sf_dir):
    """Article files to the sorted file of tagged lines, read back by position."""
    path = work_dir(spark, "articles")
    packed = articles(spark, sf_dir).select("value")
    packed.write.option("lineSep", "\x1e").text(f"{path}/in")
    jobs.preprocess_articles(spark, f"{path}/in", f"{path}/out", packed="\x1e")
    return text.tagged_fields(positional_lines(spark, f"{path}/out"))


@query
def topic_tables(spark, sf_dir):
    """Topics, pairs and costs published twice; rows of the second version, read back."""
    path = work_dir(spark, "tables")
    main, sub = labels.label_two_levels(
        words(spark, sf_dir, "source", "lang").select(
            "doc_id", F.col("source").alias("cluster"), F.col("lang").alias("subcluster"), "words"
        ),
        labels.LabelParams(4, 20, 1), labels.LabelParams(4, 20, 1),
    )
    topics = stage(labels.topic_hierarchy_table(main, sub), "topics")
    costs = QUERIES["cluster_cost"](spark, sf_dir)
    tables.publish_tables(topics.where("documents > 5"), costs.limit(0), path)
    tables.publish_tables(topics, costs, path)
    pairs, cost = (tables.read_table(spark, path, t) for t in ("pairs", "costs"))
    listed = tables.read_table(spark, path, "topics")
    as_text = lambda c: F.col(c).cast("string")
    return (
        listed.select(
            F.lit("topics").alias("part"), F.col("cluster").alias("a"), F.col("subcluster").alias("b"),
            F.concat_ws("|", "MainTopic", "SubTopic").alias("label"), F.col("documents").cast("double").alias("value"),
        )
        .unionByName(pairs.select(
            F.lit("pairs").alias("part"), F.lit("").alias("a"), F.lit("").alias("b"),
            F.concat_ws("|", "MainTopic", "SubTopic").alias("label"), F.lit(0.0).alias("value"),
        ))
        .unionByName(cost.select(
            F.lit("costs").alias("part"), as_text("firstLevelClusterIndex").alias("a"),
            as_text("secondLevelClusterIndex").alias("b"), F.col("TimeStamp").alias("label"),
            F.round(F.col("firstLevelClusterCost") + F.col("secondLevelClusterCost"), 5).alias("value"),
        ))
    )


@query
def lda_reload(spark, sf_dir):
    """A stored two-level LDA, loaded and applied to the documents it was fitted on."""
    docs, path = _lda_words(spark, sf_dir), work_dir(spark, "lda")
    fitted = lda.fit_lda_hierarchy(docs, path)
    loaded = lda.LdaHierarchy.load(spark, path)
    found = stage(loaded.apply(docs), "applied")
    known = fitted.members.select("doc_id", "topic", F.col("probability").alias("fitted"))
    met = found.join(known, ["doc_id", "topic"], "full")
    total = F.aggregate("subtopic_dist", F.lit(0.0), lambda a, b: a + b)
    apart = F.abs(F.col("probability") - F.col("fitted")) > 1e-6
    checks = {
        "only_fitted_or_only_applied": F.count_if(F.col("fitted").isNull() | F.col("probability").isNull()),
        "apart": F.count_if(apart),
        "topics": F.countDistinct("topic"),
        "without_subtopics": F.count_if(F.col("subtopic_dist").isNull()),
        "do_not_add_up": F.count_if((total != 0) & (F.abs(total - 1) > 1e-6)),
        "documents": F.countDistinct("doc_id"),
    }
    return _measures(checks, met)


@query
def export_scan(spark, sf_dir):
    """Label and vector files written from the two-dimensional map and read by position."""
    path = work_dir(spark, "export")
    signs = pca2(spark, sf_dir).select(
        F.concat(F.lit("w"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("word"),
        F.col("vec_id").cast("double").alias("x"),
        F.lit(0.5).alias("y"),
    )
    sinks.write_word_map_text(signs, path)
    labels, vectors = readers.read_export(spark, f"{path}/labels", f"{path}/vectors")
    return word_maps.join_by_position(labels, vectors)


@query
def export_map(spark, sf_dir):
    """Both coordinates of the real map through label and vector files and the export job.

    Files are read by line, matched by position, finished with the vocabulary of a file, stored
    and read again; each label must carry the coordinates that the projection gave it, and no
    label may be missing, moved or there twice.
    """
    path = work_dir(spark, "export")
    placed = stage(
        pca2(spark, sf_dir).select(
            F.concat(F.lit("w"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("word"), "x", "y"
        ),
        "map",
    )
    sinks.write_word_map_text(placed, path)
    placed.select(F.concat(F.lit("["), "word", F.lit("]"))).write.text(f"{path}/vocabulary")
    finished = jobs.export(
        spark, f"{path}/labels", f"{path}/vectors", f"{path}/finished", f"{path}/vocabulary"
    )
    parts = F.transform(F.split("vectors", ","), lambda v: v.cast("double"))
    met = placed.join(finished.withColumn("xy", parts), F.col("word") == F.col("labels"), "full")
    moved = (F.abs(F.col("x") - F.col("xy")[0]) > 1e-12) | (F.abs(F.col("y") - F.col("xy")[1]) > 1e-12)
    checks = {
        "labels": F.count("labels"),
        "positions": F.countDistinct("id"),
        "unmatched": F.count_if(F.col("word").isNull() | F.col("labels").isNull()),
        "moved": F.count_if(moved),
        "flat": F.when((F.stddev("x") > 0) & (F.stddev("y") > 0), 0).otherwise(1),
    }
    return _measures(checks, met)


@query
def vocabulary_sink(spark, sf_dir):
    """The vocabulary of every source through its table, and as lines read back."""
    path = work_dir(spark, "vocabulary")
    found = QUERIES["vocabulary_by_group"](spark, sf_dir)
    sinks.write_vocabulary(
        found.select(
            F.lit(1).alias("level"), F.col("source").alias("cluster"), "rank", "term"
        ),
        f"{path}/table",
    )
    stored = spark.read.parquet(f"{path}/table")
    stored.select(F.concat(F.lit("["), "term", F.lit("]"))).write.text(f"{path}/lines")
    lines = readers.read_vocabulary(spark, f"{path}/lines")
    return lines.groupBy("term").agg(F.count("*").alias("groups"))


@query
def stream_conservation(spark, sf_dir):
    """A topic stream over all documents in four batches: what does not depend on the fit."""
    docs = stage(words(spark, sf_dir), "words")
    sliced = replays.slices(docs, "doc_id", size=-(-docs.count() // 4))
    sliced = stage(sliced, "slices")
    config = StreamConfig(
        level1=fits.FIXED[0], level2=fits.FIXED[1], threshold1=1e12, threshold2=1e12,
        bootstrap=2, global_limit=1 << 40, local_limit=1 << 40, warehouse_limit=1 << 30,
    )
    maintainer = TopicMaintainer(spark, work_dir(spark, "stream"), config)
    for batch_id in range(4):
        maintainer.process(sliced.where(F.col("slice") == batch_id), batch_id)
    store = maintainer.store
    state = store.state(spark, store.in_force(spark, 4), 3, config.warehouse_limit)
    checks = {
        "documents": F.countDistinct("doc_id"),
        "in_boot": F.count_if(F.col("slot") == "boot"),
        "without_cluster": F.count_if(F.col("cluster").isNull()),
        "first_fit": F.min("model_version"),
    }
    return _measures(checks, state)


STREAM_LIMIT = 100
STREAM_SLICES = 5


def _arriving(
    spark: SparkSession, sf_dir: str, batches: int
) -> tuple[int, Callable[[int], DataFrame]]:
    """Documents in order of their ids, in batches of equal size: that size, and each batch.

    Only ids are ordered; a batch is a range of them, which the scan filters by.
    """
    ids = documents(spark, sf_dir).select("doc_id")
    size = -(-ids.count() // batches)
    slices = replays.slices(ids, "doc_id", size=size).groupBy("slice")
    ranges = {r["slice"]: r for r in slices.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    docs = words(spark, sf_dir).withColumn("key", F.col("doc_id").cast("string"))

    def batch(number: int) -> DataFrame:
        found = ranges.get(number)  # the last ones of a tiny table have no rows
        within = F.col("doc_id").between(found["low"], found["high"]) if found else F.lit(False)
        return docs.where(within)

    return size, batch


@query
def stream_refits(spark, sf_dir):
    """A topic stream whose containers fill up, checked behind every batch.

    All documents in five batches. The first fits the hierarchy, the second is novel to all
    topics, the third fits a topic but no subtopic, and two fit both. Limits and retention are
    100. Counts come from the ledger, the rest from the state behind each batch.
    """
    size, arriving = _arriving(spark, sf_dir, STREAM_SLICES)
    base = StreamConfig(
        level1=replace(fits.FIXED[0], k=2), level2=fits.FIXED[1], bootstrap=2,
        global_limit=STREAM_LIMIT, local_limit=STREAM_LIMIT, warehouse_limit=STREAM_LIMIT,
        vacuum_every=1, vacuum_margin=1,
    )
    never, always = -1.0, 1e12
    fit = (always, always)
    phases = [fit, (never, never), (always, never), fit, fit]
    maintainer = TopicMaintainer(spark, work_dir(spark, "stream"), base)
    store, seen = maintainer.store, []
    for batch_id, (first, second) in enumerate(phases):
        maintainer.config = replace(base, threshold1=first, threshold2=second)
        maintainer.process(arriving(batch_id), batch_id)
        force = store.in_force(spark, batch_id + 1)
        state = store.state(spark, force, batch_id, STREAM_LIMIT)
        seen.append(stage(
            state.select("key", "slot", "cluster", "model_version", F.lit(batch_id).alias("behind")), "seen"
        ))
    behind = retention.append(*seen)
    places = behind.groupBy("behind", "slot", "cluster").agg(
        F.count("*").alias("held"), F.count_if(F.col("cluster").isNull()).alias("unplaced")
    )
    repeated = behind.groupBy("behind", "key").count().where("count > 1")
    full = (F.col("slot") != "warehouse") & (F.col("held") >= STREAM_LIMIT)
    # everything fits in the last two batches, so both containers only keep what they held
    novel = F.col("slot") == "global"
    ledger = store.ledger(spark)
    rows = _measures(
        {
            "containers_left_full": F.count_if(full),
            "warehouses_over": F.count_if((F.col("slot") == "warehouse") & (F.col("held") > STREAM_LIMIT)),
            "without_cluster": F.sum(F.when(~novel, F.col("unplaced")).otherwise(0)),
            "global_held_last": F.sum(
                F.when(novel & (F.col("behind") == STREAM_SLICES - 1), F.col("held")).otherwise(0)
            ),
        },
        places,
    )
    counted = _measures(
        {
            "documents": F.sum("arrived"),
            "global_refits": F.sum(F.when(F.col("batch_id") == 1, F.col("refits")).otherwise(0)),
            "global_used": F.sum("global_used"),
            "some_local_refit": F.max((F.col("batch_id") == 2) & (F.col("refits") > 0)).cast("int"),
        },
        ledger,
    )
    twice = _measures({"keys_twice": F.count("*")}, repeated)
    return rows.unionByName(counted).unionByName(twice)


@query
def stream_bootstrap(spark, sf_dir):
    """Documents gather over two batches before the first fit, then a third is routed.

    Where documents are behind each batch, by slot; the fit belongs to the second.
    """
    size, arriving = _arriving(spark, sf_dir, 3)
    config = StreamConfig(
        level1=fits.FIXED[0], level2=fits.FIXED[1], threshold1=1e12, threshold2=1e12,
        bootstrap=2 * size, global_limit=1 << 40, local_limit=1 << 40, warehouse_limit=1 << 30,
    )
    maintainer = TopicMaintainer(spark, work_dir(spark, "stream"), config)
    store, seen = maintainer.store, []
    for batch_id in range(3):
        maintainer.process(arriving(batch_id), batch_id)
        state = store.state(spark, store.in_force(spark, batch_id + 1), batch_id, 1 << 30)
        slot = F.when(F.col("slot") == "boot", "boot").otherwise("placed")
        seen.append(state.select(F.lit(batch_id).alias("behind"), slot.alias("slot"), "key", "model_version"))
    return retention.append(*seen).groupBy("behind", "slot").agg(
        F.countDistinct("key").alias("documents"),
        F.coalesce(F.min("model_version"), F.lit(-1)).alias("version"),
    )


@query
def topic_views(spark, sf_dir):
    """Results as views, asked in SQL: documents of each source beside its vocabulary.

    The view of records starts from an empty frame of their schema, as a stream does.
    """
    found = words(spark, sf_dir, "source")
    none = readers.empty_records(spark).select("doc_id", "words", F.lit("").alias("source"))
    records = none.unionByName(found.select("doc_id", "words", "source"))
    name = f"v{uuid.uuid4().hex}"
    sinks.register_views({
        f"{name}_records": records,
        f"{name}_terms": features.vocabulary(found, ["source"], vocab_size=20, min_df=1),
    })
    return spark.sql(f"""
        SELECT r.source, r.documents, r.tokens, t.terms, t.best
        FROM (SELECT source, count(*) AS documents, sum(size(words)) AS tokens
              FROM {name}_records GROUP BY source) r
        JOIN (SELECT source, count(*) AS terms, max(CASE WHEN rank = 0 THEN term END) AS best
              FROM {name}_terms GROUP BY source) t ON t.source = r.source
    """)


@query
def stream_resume(spark, sf_dir):
    """Tagged lines in files through Structured Streaming, killed half-way and resumed.

    The stream reads a fifth of the files a trigger. Its third batch is lost behind its work and in front
    of its acknowledgement, so the restart runs it again from the checkpoint. Each document is
    named by its line; the result is where it ended up, and how often it is there.
    """
    path = work_dir(spark, "resume")
    lines = documents(spark, sf_dir).select(
        text.tagged_record(
            F.to_timestamp(_minutes("doc_id"), "yyyyMMddHHmmss"), F.col("doc_id").cast("string"),
            text.clean_article("text"),
        ).alias("value"),
        "doc_id",
    )
    # a fifth of the documents a trigger, in files that do not grow with them
    files = max(1, -(-lines.count() // (STREAM_SLICES * fits.LAYOUT_ROWS)))
    sliced = lines.repartitionByRange(STREAM_SLICES * files, "doc_id").select("value")
    sliced.write.text(f"{path}/in")
    config = StreamConfig(
        level1=fits.FIXED[0], level2=fits.FIXED[1], threshold1=1e12, threshold2=1e12,
        bootstrap=2, global_limit=1 << 40, local_limit=1 << 40, warehouse_limit=1 << 30,
    )

    def run(done: Callable[[int], None]) -> None:
        maintainer = TopicMaintainer(spark, f"{path}/topics", config)

        def batch(frame: DataFrame, batch_id: int) -> None:
            maintainer.process(frame, batch_id)
            done(batch_id)

        source = readers.line_stream(spark, f"{path}/in", maxFilesPerTrigger=files)
        found = jobs.line_words(source).select("words", text.tagged_field("value", "title").alias("key"))
        running = (
            found.writeStream.foreachBatch(batch)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        try:
            running.awaitTermination()
        finally:
            running.stop()

    def lost(batch_id: int) -> None:
        if batch_id == 2:
            raise RuntimeError("lost behind its work")

    try:
        run(lost)
    except StreamingQueryException:
        pass  # the batch that was made to fail
    run(lambda batch_id: None)
    store = TopicStore(spark, f"{path}/topics")
    state = store.state(spark, store.in_force(spark, 1 << 40), 1 << 40, config.warehouse_limit)
    # a leaf of the hierarchy has no subtopic to fit: its documents are in its container
    slot = F.when(F.col("slot").isin("local", "warehouse"), "placed").otherwise(F.col("slot"))
    return state.groupBy("key", slot.alias("slot")).agg(
        F.count("*").alias("times"), F.count("cluster").alias("clusters")
    )
