"""Conversations rebuilt from their event logs and rendered for training, in DataFrames.

A log has the columns ``conv_id, seq, message, role, kind, text``. Events of a message are
folded in the order of ``seq``: a ``delta`` appends its text, an ``edit`` replaces the
message by its text, a ``regenerate`` starts the message afresh. Other kinds append.

Each message is rendered as ``<|im_start|>role, newline, text, <|im_end|>, newline``.
Inside roles and texts a backslash is doubled, and one is set behind the first character
of every control string, so a text cannot pose as a turn and can be restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Control strings of common chat templates, cut behind their first character.
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"
_ESCAPED = r"(?s)\\(.)"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _escape_role(role: Column) -> Column:
    """A role ends at the first newline that no backslash precedes."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, message, role, text``.

    Events with equal ``seq`` are ordered by kind, role and text. A NULL text is empty, a
    NULL kind a delta; the role is that of the last event that names one, else empty. One
    shuffle by conversation serves this and the rendering.
    """
    order = F.struct(
        F.col("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    folded = (
        events.repartition(F.col("conv_id"))
        .groupBy("conv_id", "message")
        .agg(F.array_sort(F.collect_list(order)).alias("log"))
    )
    last = F.expr(
        "array_max(transform(log,"
        " (e, i) -> if(e.kind in ('edit', 'regenerate'), i, 0)))"
    )
    live = F.expr("slice(log, _last + 1, size(log))")
    pieces = F.transform(
        live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])
    )
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return folded.withColumn("_last", last).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(pieces, "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, formatted, loss``.

    ``loss`` lists the spans (``start``, ``length`` in code points, from 0) of assistant
    texts; nothing else is learned.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select(
        "conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumn(
        "start",
        F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("message", "turn", "role", "start", F.length("body").alias("length"))
            )
        ).alias("turns")
    )
    learned = F.filter("turns", lambda t: t["role"] == LEARNED)
    return grouped.select(
        "conv_id",
        F.array_join("turns.turn", "").alias("formatted"),
        F.transform(
            learned, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))
        ).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned texts of rendered conversations, without the escapes.

    Columns: ``conv_id``, ``turns`` (role and text), ``learned`` (texts), ``formatted``.
    """
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(START) + 1))
        role = F.regexp_extract(inner, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substr(inner, F.length(role) + 2)).alias("text"),
        )

    def span(s: Column) -> Column:
        piece = F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return unescape(piece)

    return formatted.select(
        "conv_id",
        F.transform(bodies, turn).alias("turns"),
        F.transform("loss", span).alias("learned"),
        "formatted",
    )


def format_log(events: DataFrame) -> DataFrame:
    """Fold and render a log. An empty log gives no conversation."""
    return render(fold(events))
