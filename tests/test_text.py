import random

from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from tidings.functions import byte_words, text
from tidings.plans import jobs

ARTICLE = (
    "Timestamp: 20240102030405\nTitle: Bank of Aldra raises rates\n"
    "Text: The bank raised its key rate to 4%.\nMarkets in UK fell."
)


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "value STRING").select(*columns).first()


def fields(spark, value, strict=False):
    frame = spark.createDataFrame([(value,)], "value STRING")
    return text.article_fields(frame, strict_headers=strict).first()


def test_article_fields_and_cleaning(spark):
    row = fields(spark, ARTICLE)
    assert str(row.ts) == "2024-01-02 03:04:05"
    assert row.title == "Bank of Aldra raises rates"
    assert row.text == "The bank raised its key rate to 4%. Markets in UK fell."
    assert row.reject_reason is None
    cleaned = one(
        spark, f"{row.title} {row.text}", text.clean_article("value").alias("c")
    ).c
    expected = "Bank Aldra raises rates The bank raised its key rate 4 Markets fell"
    assert cleaned.strip() == expected


def test_header_edge_cases(spark):
    def article(ts="20240102030405", title="T", body="x"):
        return f"Timestamp: {ts}\nTitle: {title}\nText: {body}"

    for stamp in ("2024", "abc", "20241302030405"):
        for strict in (True, False):
            row = fields(spark, article(ts=stamp), strict)
            assert row.ts is None and row.reject_reason == "bad_timestamp"
    longer = fields(spark, article(ts="202401020304059"))
    assert str(longer.ts) == "2024-01-02 03:04:05"

    assert fields(spark, article(title="Rates: what next"), True).title == "error"
    assert fields(spark, article(title="Rates: what next")).title == "Rates: what next"
    assert fields(spark, article(title="Rates: "), True).title == "Rates"
    assert fields(spark, article(title=""), True).title == "error"
    assert fields(spark, article(title="")).title == ""
    assert fields(spark, article(body="\nMore."), True).text == "error More."
    assert fields(spark, article(body="\nMore.")).text == "More."


def test_missing_lines(spark):
    row = fields(spark, "Timestamp: 20240102030405")
    assert row.title is None and row.reject_reason == "bad_title"
    strict = fields(spark, "Timestamp: 20240102030405", True)
    assert (strict.title, strict.text, strict.reject_reason) == ("error", "error", None)


def test_tagged_fields(spark):
    lines = [
        ("<timestamp>t1</timestamp><title> a   b </title><content> x y </content>",),
        ("<title>a</title><title>b</title>",),
        ("no tags",),
    ]
    rows = text.tagged_fields(spark.createDataFrame(lines, "value STRING")).collect()
    assert [tuple(r) for r in rows] == [("t1", "a b", "x y"), ("", "ab", ""), ("", "", "")]
    assert one(spark, lines[0][0], text.tagged_field("value", "TITLE")).asDict()
    assert one(spark, lines[0][0], text.tagged_field("value", "other").alias("v")).v == ""


def test_record_round_trip(spark):
    frame = spark.sql("SELECT TIMESTAMP'2024-01-02 03:04:05' ts, 'a' title, 'b c ' content")
    line = frame.select(text.tagged_record("ts", "title", "content").alias("value"))
    assert tuple(text.tagged_fields(line).first()) == ("2024-01-02 03:04:05", "a", "b c")


def test_tokens_match_the_tokenizer(spark):
    samples = ["A  b c ", "", " x", "   ", "a\tb\nc", "Ä\x0bB", "one"]
    frame = spark.createDataFrame([(s,) for s in samples], "value STRING")
    theirs = Tokenizer(inputCol="value", outputCol="theirs").transform(frame)
    rows = theirs.withColumn("ours", text.tokens("value")).collect()
    for row in rows:
        assert row.ours == row.theirs, row.value
    assert rows[0].ours == ["a", "", "b", "c"]
    assert rows[1].ours == [""]
    assert rows[2].ours == ["", "x"]


def test_stop_words(spark):
    listed = ["the", "of"]
    kept = one(
        spark, "The end of the road", text.drop_stop_words_text("value", listed).alias("v")
    ).v
    assert kept == "The end road "
    frame = spark.createDataFrame([(["road", "the", "road"],)], "words ARRAY<STRING>")
    assert frame.select(text.drop_stop_words("words", listed).alias("v")).first().v == [
        "road",
        "road",
    ]
    for blank in (" ", ""):
        assert one(spark, blank, text.drop_stop_words_text("value").alias("v")).v.strip() == ""


def test_default_stop_words_are_the_library_list(spark):
    assert sorted(text.DEFAULT_STOP_WORDS) == sorted(
        StopWordsRemover.loadDefaultStopWords("english")
    )
    frame = spark.createDataFrame([(["The", "Cat", "isn't", "", "a"],)], "words ARRAY<STRING>")
    theirs = StopWordsRemover(inputCol="words", outputCol="theirs").transform(frame)
    row = theirs.withColumn(
        "ours", text.drop_stop_words("words", case_sensitive=False)
    ).first()
    assert row.ours == row.theirs == ["Cat", ""]


def test_lda_cleaning_keeps_double_blanks(spark):
    # "it", "is" and "t" go and leave their blanks
    cleaned = one(spark, "It is\n an \u00c9T\u00c9 Test", text.clean_for_lda("value").alias("v")).v
    assert cleaned == "    test"


def test_strip_export_lines(spark):
    assert one(spark, "[word]", text.strip_label("value").alias("v")).v == "word"
    assert one(spark, "[[1.5,-2]]", text.strip_vector("value").alias("v")).v == "1.5,-2"
    assert one(spark, "[[1.5,-2]]", text.vector_values("value").alias("v")).v == [1.5, -2.0]


def test_line_words(spark):
    line = "<title>x</title><content> Alpha the beta </content>"
    frame = spark.createDataFrame([(line,)], "value STRING")
    assert jobs.line_words(frame).first().words == ["alpha", "beta"]


def test_byte_words_are_those_of_the_expressions(spark, monkeypatch):
    """Also of NULL, empty and odd texts, of any length of a block."""
    rng = random.Random(4)
    parts = ["a", "It", "the", "The", "don't", "x1", "12", "Été", "Kelvin", "İx", " ", "  ", "\n", "\t\x0b", "\r\f", "-",
             " ", " ", "\U0001f600", "_", "ab_cd", "foo", "Bar,", "...", "q", "\x1c", "ét"]
    texts = [None, "", " ", "a", "12", "a b", "1 2", " \n", "the", "foo", " foo ", "é", "the a", "- foo -", "foo\x00bar"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, value STRING").repartition(3)
    stops = ["The", "foo", "it"]
    for size in (1 << 20, 40):
        monkeypatch.setattr(byte_words, "BLOCK_BYTES", size)
        for made, content, cased in (
            (byte_words.article_words, F.trim(text.clean_article("value")), True),
            (byte_words.lda_words, text.clean_for_lda("value"), False),
        ):
            both = text.with_words(made(df, "value", stops, "found"), content, stops, cased)
            rows = both.collect()
            assert len(rows) == len(texts)
            assert [(r.value, r.found) for r in rows] == [(r.value, r.words) for r in rows]


def test_byte_words_of_no_rows_and_no_stop_words(spark):
    df = spark.createDataFrame([(1, "One two")], "id INT, value STRING")
    assert byte_words.article_words(df, "value", []).first().words == ["one", "two"]
    assert byte_words.lda_words(df.where("id > 1"), "value", []).collect() == []
