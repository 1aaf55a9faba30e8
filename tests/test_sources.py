import time

import pytest
from pyspark.sql import functions as F

from tidings.operators.word_maps import finish_export, join_by_position, keep_vocabulary
from tidings.plans import jobs, tables
from tidings.session import small_side, spread
from tidings.sources import readers, replay, sinks
from tidings.sources.position import index_rows, positional_lines


@pytest.fixture
def article_dir(tmp_path):
    folder = tmp_path / "articles"
    (folder / "sport").mkdir(parents=True)
    (folder / "b.txt").write_text(
        "Timestamp: 20240102000000\nTitle: Second: story\nText: The cats ran.\nFar away."
    )
    (folder / "sport" / "a.txt").write_text(
        "Timestamp: 20240101000000\nTitle: First\nText: Dogs bark loudly"
    )
    (folder / "bad.txt").write_text("Timestamp: never\nTitle: x\nText: y")
    return str(folder)


def test_preprocessing_writes_lines_in_time_order(spark, article_dir, tmp_path):
    out = str(tmp_path / "out")
    articles = jobs.preprocess_articles(spark, article_dir, out)
    assert articles.count() == 2
    lines = [r["value"] for r in positional_lines(spark, out).orderBy("id").collect()]
    assert lines == [
        "<timestamp>2024-01-01 00:00:00</timestamp><title>First</title>"
        "<content>First Dogs bark loudly </content>",
        "<timestamp>2024-01-02 00:00:00</timestamp><title>Second: story</title>"
        "<content>Second story The cats ran Far away </content>",
    ]
    records = readers.read_records(spark, out).orderBy("timestamp").collect()
    assert [r["title"] for r in records] == ["First", "Second: story"]
    single = str(tmp_path / "single")
    sinks.write_tagged(articles, single, single_file=True)
    assert spark.read.text(single).count() == 2


def test_strict_headers(spark, article_dir):
    titles = {
        r["title"]
        for r in jobs.preprocess_articles(spark, article_dir, strict_headers=True).collect()
    }
    assert titles == {"First", "error"}


def test_positions_follow_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "part-00000").write_text("".join(f"a{i}\n" for i in range(10)))
    (folder / "part-00001").write_text("".join(f"b{i}\n" for i in range(5000)))
    (folder / "part-00002").write_text("c0\nc1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = positional_lines(spark, str(folder))
        assert numbered.rdd.getNumPartitions() > 3
        rows = [r["value"] for r in numbered.orderBy("id").collect()]
        ids = [r["id"] for r in numbered.orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [f"a{i}" for i in range(10)] + [f"b{i}" for i in range(5000)] + ["c0", "c1"]
    assert rows == expected
    assert ids == list(range(len(expected)))


def test_index_rows_is_dense_under_ties(spark):
    # one first key holds a third of the rows
    frame = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id"
    )
    rows = index_rows(frame.repartition(5), "k", "id").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(900))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)
    assert rows[0]["idx_total"] == 900


def test_slices_and_peek(spark):
    frame = spark.range(7)
    cut = replay.slices(frame, "id", size=3)
    assert {(r["slice"], r["id"]) for r in cut.collect()} == {(i // 3, i) for i in range(7)}
    assert [r["id"] for r in replay.peek(cut, "id").orderBy("slice").collect()] == [0, 3, 6]
    full = replay.slices(frame, "id", size=3, drop_tail=True)
    assert sorted(r["id"] for r in full.collect()) == list(range(6))


def test_replay_hands_over_one_slice_per_trigger(spark, tmp_path):
    path, seen = str(tmp_path / "slices"), {}
    replay.write_slices(replay.slices(spark.range(7), "id", size=3), path)

    def take(rows, batch_id):
        seen[batch_id] = sorted(r["id"] for r in rows.collect())

    stream = replay.replay(spark, path, take, str(tmp_path / "check"), interval="0 seconds")
    try:
        deadline = time.time() + 60
        while len(seen) < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        stream.stop()
    assert list(seen.values()) == [[0, 1, 2], [3, 4, 5], [6]]


def test_export_files(spark, tmp_path):
    long = "x" * 25
    (tmp_path / "labels").write_text(f"[ape]\n[bee]\n[{long}]\n")
    (tmp_path / "vectors").write_text("[[1,2]]\n[[3,4]]\n[[5,6]]\n")
    (tmp_path / "vocabulary").write_text("[bee]\n[bee]\n")
    labels, vectors = readers.read_export(
        spark, str(tmp_path / "labels"), str(tmp_path / "vectors")
    )
    assert join_by_position(labels, vectors).count() == 3
    assert finish_export(labels, vectors).count() == 2
    done = jobs.export(
        spark,
        str(tmp_path / "labels"),
        str(tmp_path / "vectors"),
        str(tmp_path / "out"),
        str(tmp_path / "vocabulary"),
    )
    assert [tuple(r) for r in done.collect()] == [(1, "bee", "3,4")]


def test_semi_join_keeps_repeats(spark):
    labels = spark.createDataFrame([("a",), ("a",), ("b",)], "labels STRING")
    terms = spark.createDataFrame([("a",), ("a",)], "term STRING")
    assert keep_vocabulary(labels, terms).count() == 2


def test_word_map_text_sink_pairs_lines(spark, tmp_path):
    words = spark.createDataFrame(
        [(f"w{i}", float(i), -float(i)) for i in range(40)], "word STRING, x DOUBLE, y DOUBLE"
    )
    sinks.write_word_map_text(words, str(tmp_path))
    labels, vectors = readers.read_export(
        spark, str(tmp_path / "labels"), str(tmp_path / "vectors")
    )
    for row in join_by_position(labels, vectors).collect():
        i = float(row["labels"][1:])
        assert row["vectors"] == f"{i},{-i}"


def test_vocabulary_and_map_tables(spark, tmp_path):
    terms = spark.createDataFrame(
        [(1, -1, 0, "a"), (2, 0, 0, "b")], "level INT, cluster INT, rank INT, term STRING"
    )
    sinks.write_vocabulary(terms, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("level = 2").first()["term"] == "b"
    words = spark.createDataFrame(
        [(0, -1, -1, "a", 0.0, 1.0)],
        "level INT, cluster INT, subcluster INT, word STRING, x DOUBLE, y DOUBLE",
    )
    sinks.write_word_map(words, str(tmp_path / "m"))
    sinks.register_views({"word_map": spark.read.parquet(str(tmp_path / "m"))})
    assert spark.sql("SELECT word FROM word_map WHERE level = 0").first()["word"] == "a"


def test_small_sources(spark, tmp_path):
    assert readers.empty_records(spark).count() == 0
    (tmp_path / "one").write_text("a\nb\n")
    assert readers.read_lines(spark, str(tmp_path / "one"), 4).rdd.getNumPartitions() == 4
    stream = readers.line_stream(spark, str(tmp_path), maxFilesPerTrigger=1)
    assert stream.isStreaming and stream.columns == ["value"]


def test_size_checks(spark):
    def hinted(frame):
        return "broadcast" in frame._jdf.queryExecution().logical().toString().lower()

    frame = spark.range(10)
    assert hinted(small_side(frame, 10))
    assert not hinted(small_side(frame, 9))
    assert spread(spark.range(0, 10, 1, 2)).rdd.getNumPartitions() == 8
    assert spread(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20


def test_articles_are_cleaned_once(spark, tmp_path, monkeypatch):
    """Sorting samples its input; what is costly must lie behind it."""
    rows = [(f"Timestamp: 2024010112{i:04d}\nTitle: t{i}\nText: some words here",) for i in range(200)]
    rows += [("Timestamp: never\nTitle: t\nText: x",), ("",), (None,), ("Timestamp: 20240101120000\nTitle: t",)]
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(value):
        cleaned.add(1)
        return value

    monkeypatch.setattr(jobs.text, "clean_article", lambda column: counting(column))
    files = spark.createDataFrame(rows, "value STRING").withColumn(
        "file_path", F.monotonically_increasing_id().cast("string")
    )
    found = jobs.ordered_articles(files)
    sinks.write_tagged(found, str(tmp_path / "out"), ordered=True)
    lines = positional_lines(spark, str(tmp_path / "out")).orderBy("id").collect()
    good = [i for i in range(200) if i % 100 < 60 and i < 6000]
    assert len(lines) == len(good) == cleaned.value  # rejected ones are not cleaned at all
    assert [r["value"] for r in lines] == sorted(r["value"] for r in lines)


def test_packed_articles(spark, tmp_path):
    """Files of many articles give what files of one article give, whatever the blocks."""
    texts = [f"Timestamp: 20240101120{i:03d}\nTitle: t{i}\nText: word{i}\nmore" for i in range(50)]
    for k in range(2):
        (tmp_path / f"part-{k}").write_text("\x1e".join(texts[k::2]) + "\x1e")
    for size in ("134217728", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = readers.read_packed_articles(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(r["value"] for r in found) == sorted(texts)
        assert len({r["file_path"] for r in found}) == 50
        for k in range(2):
            own = sorted((r["file_path"], r["value"]) for r in found if f"part-{k}#" in r["file_path"])
            assert [v for _, v in own] == texts[k::2]


def test_tables_are_shown_together(spark, tmp_path, monkeypatch):
    """A crash between the writes leaves the earlier version; the next attempt replaces it."""
    path = str(tmp_path / "tables")
    topics = lambda n: spark.createDataFrame([(f"m{n}", f"s{n}"), (f"m{n}", f"s{n}")], "MainTopic STRING, SubTopic STRING")  # noqa: E731,E501
    costs = lambda n: spark.createDataFrame([(n, float(n))], "cluster INT, cost DOUBLE")
    with pytest.raises(ValueError, match="nothing"):
        tables.read_table(spark, path, "pairs")
    assert tables.publish_tables(topics(1), costs(1), path) == 1

    def broken(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "topic_pairs", broken)
    with pytest.raises(RuntimeError):
        tables.publish_tables(topics(2), costs(2), path)
    monkeypatch.undo()
    assert tables.shown_version(spark, path) == 1
    assert tables.read_table(spark, path, "topics").first()["MainTopic"] == "m1"
    for n in (3, 4):
        tables.publish_tables(topics(n), costs(n), path)
    assert tables.shown_version(spark, path) == 3
    assert [tuple(r) for r in tables.read_table(spark, path, "pairs").collect()] == [("m4", "s4")]
    assert tables.read_table(spark, path, "costs", 2).first()["cost"] == 3.0
    with pytest.raises(Exception):
        tables.read_table(spark, path, "costs", 1).collect()
    with pytest.raises(ValueError, match="none of"):
        tables.read_table(spark, path, "other")
