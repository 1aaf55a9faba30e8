"""The queries of this package over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidings.llm import (
    arc,
    bpe_codec,
    chat,
    divergence,
    fuzzy_lines,
    leaks,
    licences,
    personal,
    recipes,
    repair,
    shingle_join,
    token_counts,
    toxicity,
)
from tidings.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents", "doc_id"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    network = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(documents, network).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_groups(read_table(spark, sf_dir, "documents", "doc_id"))


@query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.find_leaks(read_table(spark, sf_dir, "documents", "doc_id"), items)


@query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.license_scan(read_table(spark, sf_dir, "documents", "doc_id"))
    return found.drop("spans")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text, and how many of its lines went."""
    left = fuzzy_lines.dedup_lines(read_table(spark, sf_dir, "documents", "doc_id"))
    return left.select("doc_id", "n_lines", "n_dropped", "text")


def conversation_log(conversations: DataFrame) -> DataFrame:
    """The log that a chat service would have kept of finished conversations.

    Messages are numbered by turn; equal turns by role and text, so that none is lost. A user's
    message is a draft that an edit replaces. Any other is streamed: a first attempt is given up
    for a regeneration, whose text comes in two deltas. Folding the log gives the stored texts.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.concat(F.lit("draft "), F.substr(text, F.lit(1), F.least(half, F.lit(40))))
    typed = F.array(event("delta", draft), event("edit", text))
    streamed = F.array(
        event("delta", draft),
        event("regenerate", F.lit("")),
        event("delta", F.substr(text, F.lit(1), half)),
        event("delta", F.substr(text, half + 1)),
    )
    numbered = conversations.select(
        "conv_id",
        F.row_number().over(order).alias("message"),
        "role",
        F.when(F.col("role") == "user", typed).otherwise(streamed).alias("events"),
    )
    return numbered.select(
        "conv_id", "message", "role", F.posexplode("events").alias("place", "event")
    ).select(
        "conv_id", "message", (F.col("message") * 4 + F.col("place")).cast("long").alias("seq"),
        "role", "event.kind", "event.text",
    )


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    columns = ["conv_id", "turn", "role", "text"]
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    log = conversation_log(stored.select(*columns).unionByName(probe))
    read = chat.read_back(chat.format_log(log))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op7_chat_formatting"] = r"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            role NULLS FIRST, text NULLS FIRST) AS place
    FROM given
), escaped AS (
    SELECT *,
        regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])',
            '\1\3\\\2\4', 'g') AS body,
        replace(regexp_replace(replace(role, '\', '\\'),
            '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'),
            chr(10), '\' || chr(10)) AS head
    FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)
        ::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(read_table(spark, sf_dir, "documents", "doc_id"))


ORACLES["op8_exact_dedup"] = """
SELECT doc_id,
    max(doc_id) OVER same AS keep_id,
    count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id")
    return bpe_codec.encode(documents, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_pages(read_table(spark, sf_dir, "pages", "page_id"))


@query
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(read_table(spark, sf_dir, "documents", "doc_id"))


ORACLES["op12_divergence_audit"] = divergence.SQL


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit_report(read_table(spark, sf_dir, "conversations", "conv_id"))


ORACLES["op13_conversation_repair"] = repair.SQL


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id")
    found = personal.find_personal(documents, personal.fit(documents), redacted=False)

    def listed(spans: str) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in personal.KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
