"""Text expressions: article headers, cleaning, tokens, stop words, tagged records.

``tokens`` and ``drop_stop_words_text`` mention their input more than once. Give them a
column of the frame, not a long expression: Spark then computes the expression once, in
the projection below. The functions on frames here and in ``plans`` do that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default English list of Spark's StopWordsRemover.
DEFAULT_STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
    you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
    let's ought that's there's what's when's where's who's why's would
    """.split()
)

# The tags of a record line.
RECORD_TAGS = ("timestamp", "title", "content")

_WHITESPACE = " \t\n\x0b\f\r"
_UP_TO_BLANK = "".join(map(chr, range(33)))
_LONG_MAX = "9223372036854775807"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- cleaning ------------------------------------------------------------------------

# \p{Alnum} and \p{Alpha} are the ASCII letters and digits, like a-zA-Z0-9. Matched by
# several threads of one JVM they are many times faster than the same class as ranges.

def clean_article(text: Column | str) -> Column:
    """Keep letters, digits and whitespace, drop 1-2 letter words, collapse blanks."""
    kept = F.regexp_replace(_column(text), r"[^\p{Alnum}\s]+", "")
    longer = F.regexp_replace(kept, r"\b\p{Alpha}{1,2}\b", "")
    return F.regexp_replace(longer, r"\s+", " ")


def clean_for_lda(text: Column | str) -> Column:
    """Lower-case, collapse blanks, keep letters, drop 1-2 letter words - in that order.

    Words dropped last leave double blanks behind, hence empty tokens.
    """
    single = F.regexp_replace(F.lower(_column(text)), r"\s+", " ")
    letters = F.regexp_replace(single, r"[^\p{Alpha}\s]+", "")
    return F.regexp_replace(letters, r"\b\p{Alpha}{1,2}\b", "")


# -- tokens --------------------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Lower-case and split on each whitespace character, as ``Tokenizer`` does.

    Empty tokens inside the text stay, trailing ones go; blanks alone give no token.
    """
    lowered = F.lower(_column(text))
    body = F.rtrim(lowered, F.lit(_WHITESPACE))
    only_blanks = (F.length(body) == 0) & (F.length(lowered) > 0)
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(
        F.split(body, r"\s")
    )


def token_count(words: Column | str) -> Column:
    return F.size(_column(words))


def distinct_token_count(words: Column | str) -> Column:
    return F.size(F.array_distinct(_column(words)))


def drop_stop_words(
    words: Column | str,
    stop_words: Sequence[str] = DEFAULT_STOP_WORDS,
    case_sensitive: bool = True,
) -> Column:
    """Tokens that are not stop words; order and repeats are kept."""
    if case_sensitive:
        listed = list(stop_words)
        return F.filter(_column(words), lambda w: ~w.isin(listed))
    listed = [w.lower() for w in stop_words]
    return F.filter(_column(words), lambda w: ~F.lower(w).isin(listed))


def drop_stop_words_text(
    text: Column | str, stop_words: Sequence[str] = DEFAULT_STOP_WORDS
) -> Column:
    """The same on a blank-separated string. Every word kept is followed by a blank."""
    body = F.rtrim(_column(text))
    only_blanks = (F.length(body) == 0) & (F.length(_column(text)) > 0)
    kept = drop_stop_words(F.split(body, " "), stop_words)
    return F.when(only_blanks | (F.size(kept) == 0), F.lit("")).otherwise(
        F.concat(F.array_join(kept, " "), F.lit(" "))
    )


def exploded(df: DataFrame, *keep: str, words: str = "words") -> DataFrame:
    """``keep..., pos, token``: one row per token.

    Exploding a bare column makes Spark infer the filter ``size(words) > 0`` and push it
    down to the scan, where all the cleaning is done a second time. The zip prevents it.
    """
    zipped = F.posexplode(F.arrays_zip(words)).alias("pos", "_entry")
    return df.select(*keep, zipped).select(
        *keep, "pos", F.col("_entry")[words].alias("token")
    )


# -- article files -------------------------------------------------------------------


def article_timestamp(digits: Column | str) -> Column:
    """``yyyyMMddHHmmss`` followed by any further digits of a 64-bit number, or NULL."""
    value = _column(digits)
    fits = value.rlike(r"^[0-9]{14,18}\z") | (
        value.rlike(r"^[0-9]{19}\z") & (value <= F.lit(_LONG_MAX))
    )
    return F.try_to_timestamp(
        F.when(fits, F.substring(value, 1, 14)), F.lit("yyyyMMddHHmmss")
    )


def header_value(line: Column | str, strict: bool = False) -> Column:
    """What follows ``": "`` in a header line, NULL where the line is not a header.

    ``strict`` accepts a line only when ``": "`` cuts it into exactly two parts, trailing
    empty parts aside. Otherwise the first ``": "`` counts and the value may be empty.
    """
    line = _column(line)
    if strict:
        parts = F.split(F.regexp_replace(line, r"(: )+\z", ""), ": ")
        return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))
    parts = F.split(line, ": ", 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).when(
        line.endswith(":"), F.lit("")
    )


def article_fields(
    df: DataFrame, text_col: str = "value", strict_headers: bool = False
) -> DataFrame:
    """Add ``ts``, ``title``, ``text`` and ``reject_reason`` (NULL for a good article).

    Line 1 is the timestamp, line 2 the title, line 3 and all that follow the text.
    With ``strict_headers`` an unusable title or text header reads ``error`` and only
    the timestamp rejects; without it an empty header is an empty value.
    """
    lines = F.split(F.rtrim(F.col(text_col), F.lit("\n")), "\n")
    cut = df.withColumn("_lines", lines)

    def header(i: int) -> Column:
        return header_value(F.get("_lines", F.lit(i)), strict_headers)

    rest = F.slice("_lines", F.lit(4), F.size("_lines"))
    if strict_headers:
        title = F.coalesce(header(1), F.lit("error"))
        has_text = F.size("_lines") >= 3
        head = F.coalesce(header(2), F.lit("error"))
        text = F.when(has_text, F.concat_ws(" ", head, rest)).otherwise(F.lit("error"))
    else:
        title = header(1)
        head = header(2)
        text = F.when(
            head.isNotNull(), F.concat_ws(" ", F.nullif(head, F.lit("")), rest)
        )
    return (
        cut.withColumn("ts", article_timestamp(header(0)))
        .withColumn("title", title)
        .withColumn("text", text)
        .drop("_lines")
        .withColumn(
            "reject_reason",
            F.when(F.col("ts").isNull(), "bad_timestamp")
            .when(F.col("title").isNull(), "bad_title")
            .when(F.col("text").isNull(), "bad_text"),
        )
    )


def with_content(
    df: DataFrame,
    *parts: str,
    stop_words: Sequence[str] = DEFAULT_STOP_WORDS,
    output: str = "content",
) -> DataFrame:
    """Add the columns ``parts``, joined by blanks, cleaned and without stop words."""
    cleaned = clean_article(F.concat_ws(" ", *parts))
    return (
        df.withColumn("_cleaned", cleaned)
        .withColumn(output, drop_stop_words_text("_cleaned", stop_words))
        .drop("_cleaned")
    )


def filled(df: DataFrame, words: str = "words") -> DataFrame:
    """``df`` with an empty array where ``words`` is NULL: models refuse a NULL array."""
    empty = F.array().cast("array<string>")
    return df.withColumn(words, F.coalesce(F.col(words), empty))


def with_words(
    df: DataFrame,
    content: Column,
    stop_words: Sequence[str] = (),
    case_sensitive: bool = True,
    output: str = "words",
) -> DataFrame:
    """Add the tokens of ``content``; stop words are left out when given.

    A NULL content has no tokens.
    """
    placed = df.withColumn("_content", content)
    words = tokens("_content")
    if stop_words:
        words = drop_stop_words(words, stop_words, case_sensitive)
    return filled(placed.withColumn(output, words), output).drop("_content")


# -- tagged records ------------------------------------------------------------------


def tagged_record(
    ts: Column | str,
    title: Column | str,
    content: Column | str,
    ts_format: str = "yyyy-MM-dd HH:mm:ss",
) -> Column:
    """``<timestamp>..</timestamp><title>..</title><content>..</content>`` on one line."""
    values = (F.date_format(_column(ts), ts_format), _column(title), _column(content))
    pieces = [
        piece
        for tag, value in zip(RECORD_TAGS, values)
        for piece in (F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    ]
    return F.concat(*pieces)


def tagged_field(line: Column | str, tag: str) -> Column:
    """The value of one tag; empty when the tag is unknown or not in the line."""
    tag = tag.lower()
    if tag not in RECORD_TAGS:
        return F.lit("")
    value = F.regexp_extract(_column(line), f"<{tag}>(.*)</{tag}>", 1)
    value = F.replace(value, F.lit(f"<{tag}>"), F.lit(""))
    value = F.replace(value, F.lit(f"</{tag}>"), F.lit(""))
    if tag == "title":
        value = F.regexp_replace(value, r"\s+", " ")
    if tag != "timestamp":
        value = F.btrim(value, F.lit(_UP_TO_BLANK))
    return value


def tagged_fields(df: DataFrame, line_col: str = "value") -> DataFrame:
    """The three fields of each tagged line as columns."""
    return df.select(
        *[c for c in df.columns if c != line_col],
        *[tagged_field(line_col, tag).alias(tag) for tag in RECORD_TAGS],
    )


# -- exported labels and vectors -----------------------------------------------------


def strip_label(line: Column | str) -> Column:
    """``[word]`` without brackets."""
    return F.regexp_replace(_column(line), r"[\[\]]", "")


def strip_vector(line: Column | str) -> Column:
    """``[[x,y]]`` without the double brackets."""
    return F.regexp_replace(_column(line), r"\[\[|\]\]", "")


def vector_values(line: Column | str) -> Column:
    """``[[x,y]]`` as an array of doubles; a part that is no number becomes NULL."""
    return F.transform(
        F.split(strip_vector(line), ","), lambda part: F.trim(part).try_cast("double")
    )
