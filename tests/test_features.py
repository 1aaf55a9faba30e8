import math

import pytest
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import functions as F

from tidings.operators import features, grouping, labels

SCHEMA = "doc_id BIGINT, words ARRAY<STRING>"
SMALL = [(1, list("baac")), (2, list("bcd")), (3, list("bef"))]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, SCHEMA).cache()


def test_vocabulary_of_the_small_case(small):
    rows = features.vocabulary(small).orderBy("rank").collect()
    assert [(r["term"], r["n"], r["df"]) for r in rows] == [("b", 3, 3), ("a", 2, 1), ("c", 2, 2)]
    assert [round(r["idf"], 6) for r in rows] == [0.0, 0.693147, 0.287682]
    assert rows[0]["documents"] == 3


def test_adaptive_minimum_and_ties(spark):
    docs = [(i, list("baac")) for i in range(10)] + [(99, ["z"])]
    frame = spark.createDataFrame(docs, SCHEMA)
    rows = features.vocabulary(frame).orderBy("rank").collect()
    assert [(r["term"], r["n"]) for r in rows] == [("a", 20), ("b", 10)]
    params = features.adaptive_params(frame.withColumn("g", F.lit("x")), ["g"]).first()
    assert (params["documents"], params["vocab_size"], params["min_df"]) == (11, 2, 2)


def test_label_of_the_small_case(small):
    grouped = small.withColumn("g", F.lit(0))
    assert labels.label_groups(grouped, ["g"], 2).first()["label"] == "a c"


def test_group_without_terms_and_null_group(spark):
    docs = [("x", ["a", "a"]), ("y", []), (None, ["b"])]
    frame = spark.createDataFrame(docs, "g STRING, words ARRAY<STRING>")
    found = {r["g"]: r["label"] for r in labels.label_groups_fixed(frame, ["g"]).collect()}
    assert found == {"x": "a", "y": "", None: "b"}


def test_same_vocabulary_whatever_the_partitioning(spark, small):
    wide = small.crossJoin(spark.range(40)).select("doc_id", "words")
    seen = {
        tuple(features.fit_features(wide.repartition(n), 4, 1).terms) for n in (1, 3, 7)
    }
    assert len(seen) == 1


def test_against_the_library_estimators(spark, small):
    ours = features.fit_features(small, vocab_size=6, min_df=1)
    model = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=6, minDF=1).fit(small)
    assert sorted(ours.terms) == sorted(model.vocabulary)
    counted = ours.counter().transform(small)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted)
    assert ours.idf == pytest.approx(idf.idf.toArray().tolist())
    theirs = {r["doc_id"]: r["tfidf"] for r in idf.transform(counted).collect()}
    for row in ours.model().transform(small).collect():
        assert row["tfidf"].toArray() == pytest.approx(theirs[row["doc_id"]].toArray())


def test_long_form_equals_vectors(small):
    space = features.fit_features(small, 3, 1)
    rows = features.term_weights(small, space).collect()
    assert {(r["doc_id"], r["term"], r["tf"]) for r in rows} == {
        (1, "b", 1), (1, "a", 2), (1, "c", 1), (2, "b", 1), (2, "c", 1), (3, "b", 1),
    }
    weights = {(r["doc_id"], r["term"]): r["tfidf"] for r in rows}
    assert weights[(1, "a")] == pytest.approx(2 * math.log(2))


def test_zero_weight_terms_still_count(small):
    space = features.fit_features(small, 1, 1)
    assert space.terms == ["b"] and space.idf == [0.0]
    assert features.with_known_terms(small, space).count() == 3


def test_min_df_as_a_share(small):
    assert features.fit_features(small, 10, 0.6).terms == ["b", "c"]


@pytest.mark.parametrize("salted", [True, False])
def test_first_per_group_is_exact(spark, salted):
    # one group holds nearly everything
    frame = spark.range(3000).select(
        F.when(F.col("id") < 2900, 0).otherwise(F.col("id") % 3).alias("g"), "id"
    )
    kept = grouping.first_per_group(frame, ["g"], [F.desc("id")], 5, salted=salted)
    found = {}
    for row in kept.collect():
        found.setdefault(row["g"], []).append(row["id"])
    rows = [(0 if i < 2900 else i % 3, i) for i in range(3000)]
    for g in (0, 1, 2):
        expected = sorted((i for h, i in rows if h == g), reverse=True)[:5]
        assert sorted(found[g], reverse=True) == expected


def test_hot_group_is_cut_before_the_shuffle(spark, small):
    grouped = small.withColumn("g", F.col("doc_id") % 2)
    assert plan_of(labels.label_groups_fixed(grouped, ["g"])).count("WindowGroupLimit") >= 3


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("size", [None, 4])
def test_documents_are_exploded_once(spark, small, tmp_path, size):
    small.withColumn("g", F.col("doc_id") % 2).write.parquet(f"{tmp_path}/docs")
    grouped = spark.read.parquet(f"{tmp_path}/docs")
    plan = plan_of(labels.label_groups(grouped, ["g"], 2, vocab_size=size))
    assert plan.count("Generate inline") == 1
    assert "ReusedExchange" in plan


def test_two_levels_share_the_scan(spark, small, tmp_path):
    keyed = small.withColumn("cluster", F.col("doc_id") % 2)
    keyed.withColumn("subcluster", F.col("doc_id")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    fixed = labels.FIXED_LABELS
    main, sub = labels.label_two_levels(docs, fixed, fixed)
    pairs = labels.topic_pairs(labels.topic_hierarchy_table(main, sub))
    assert plan_of(pairs).count("Generate inline") == 1
    apart = labels.topic_hierarchy_table(
        labels.label_groups_fixed(docs, ["cluster"]),
        labels.label_groups_fixed(docs, ["cluster", "subcluster"]),
    )
    assert sorted(pairs.collect()) == sorted(labels.topic_pairs(apart).collect())


def test_a_hot_group_among_many(spark, monkeypatch):
    """Above the number of groups that may be broadcast, a hot one is not sent to one task."""
    rows = [(i, "hot", [f"t{(i * 7 + k) % 900}" for k in range(9)]) for i in range(1200)]
    rows += [(9000 + i, f"g{i}", [f"t{i}", f"t{i + 1}"]) for i in range(300)]
    rows += [(20_000, None, ["x", "y"]), (20_001, "none", [])]
    docs = spark.createDataFrame(rows, "doc_id INT, grp STRING, words ARRAY<STRING>")
    expected = features.vocabulary(docs, ["grp"], vocab_size=5, min_df=1).collect()
    monkeypatch.setattr(features, "few_groups", lambda *_: False)
    monkeypatch.setattr(grouping, "HOT_ROWS", 500)
    found = features.vocabulary(docs, ["grp"], vocab_size=5, min_df=1).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)

    terms = features.term_rows(docs, ["grp"], "words").repartition(8).where("df > 0")
    totals = features._group_totals(features.term_rows(docs, ["grp"], "words"), ["grp"])
    joined = grouping.join_many_groups(terms, totals, ["grp"], F.col("distinct_tokens"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 900 + 600 + 2
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("part", [1 << 20, 4])
def test_terms_are_counted_before_they_leave_a_task(spark, monkeypatch, part):
    """NULL tokens, words and groups count as they did when each token was a row."""
    monkeypatch.setattr(features, "PART", part)
    rows = [
        ("a", 1, ["x", "y", "x"]), ("a", 1, ["x", None]), ("a", None, None), (None, 1, ["zß", ""]), (None, 1, []),
    ]
    found = features.term_rows(spark.createDataFrame(rows, "g string, h int, w array<string>"), ["g", "h"], "w")
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["g"], r["h"], r["term"]): (r["n"], r["df"]) for r in found.collect()} == {
        ("a", 1, "x"): (3, 2), ("a", 1, "y"): (1, 1), ("a", 1, None): (3, 0), ("a", None, None): (1, 0),
        (None, 1, "zß"): (1, 1), (None, 1, ""): (1, 1), (None, 1, None): (2, 0),
    }
