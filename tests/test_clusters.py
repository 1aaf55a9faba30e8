import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidings.operators import clusters, retention
from tidings.operators.labels import topic_pairs
from tidings.operators.lda import lda_topic_table, membership, normalise_with_lemmas

POINTS = [(0, [0.0, 1.0]), (1, [3.0, 3.0]), (2, [3.0, 4.5])]
CENTRES = [(0, [0.0, 0.0]), (1, [3.0, 4.0])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "vec_id BIGINT, vector ARRAY<DOUBLE>")


@pytest.fixture(scope="module")
def centres(spark):
    return spark.createDataFrame(CENTRES, "cluster INT, centre ARRAY<DOUBLE>")


def test_distance_split_and_cost(points, centres):
    near = clusters.nearest_centroid(points, centres)
    rows = {
        r["vec_id"]: (r["cluster"], r["distance"], r["fit"])
        for r in clusters.novelty_split(near, 0.5).collect()
    }
    assert rows == {0: (0, 1.0, "novel"), 1: (1, 1.0, "novel"), 2: (1, 0.25, "fitted")}
    own = clusters.with_distance(near.drop("distance"), centres).collect()
    assert {r["vec_id"]: r["distance"] for r in own} == {0: 1.0, 1: 1.0, 2: 0.25}

    placed = near.withColumn("subcluster", F.lit(0)).withColumn("subdistance", F.lit(0.5))
    cost = clusters.cluster_cost(placed, "now").collect()
    assert {
        r["firstLevelClusterIndex"]: (r["firstLevelClusterCost"], r["secondLevelClusterCost"])
        for r in cost
    } == {0: (1.0, 0.5), 1: (1.25, 1.0)}
    assert cost[0]["TimeStamp"] == "now"


def test_length_mismatch_raises(spark, centres):
    odd = spark.createDataFrame([(0, [1.0], 0)], "vec_id INT, vector ARRAY<DOUBLE>, cluster INT")
    with pytest.raises(PySparkException, match="differ in length"):
        clusters.with_distance(odd, centres).collect()
    with pytest.raises(PySparkException, match="differ in length"):
        clusters.nearest_centroid(odd, centres).collect()


def test_centroids(spark, points):
    grouped = points.withColumn("cluster", F.when(F.col("vec_id") == 0, 0).otherwise(1))
    found = {
        r["cluster"]: r["centre"]
        for r in clusters.centroids(grouped, "cluster", vector="vector").collect()
    }
    assert found[1] == pytest.approx([3.0, 3.75])


def test_many_centres_come_in_parts(points, centres, monkeypatch):
    whole = clusters.nearest_centroid(points, centres).orderBy("vec_id").collect()
    monkeypatch.setattr(clusters, "MAX_CENTRE_VALUES", 2)
    assert clusters.nearest_centroid(points, centres).orderBy("vec_id").collect() == whole


def test_gaps_have_no_nearest_centre(spark, centres):
    nan = float("nan")
    rows = [(0, None), (1, [nan, 1.0]), (2, [3.0, 4.0]), (3, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id INT, vector ARRAY<DOUBLE>")
    found = {r["vec_id"]: r for r in clusters.nearest_centroid(frame, centres).collect()}
    assert found[2]["cluster"] == 1 and found[2]["distance"] == 0.0
    assert all(found[i]["cluster"] is None for i in (0, 1, 3))
    first_null = clusters.nearest_centroid(frame.where("vec_id = 0"), centres).first()
    assert first_null["cluster"] is None
    assert clusters.nearest_centroid(frame.where("vec_id > 9"), centres).count() == 0


def test_unlisted_clusters_keep_their_rows(spark, centres):
    rows = [(0, [0.0, 1.0], 0), (1, [0.0, 1.0], 9), (2, [0.0, 1.0], None), (3, None, 0)]
    frame = spark.createDataFrame(rows, "vec_id INT, vector ARRAY<DOUBLE>, cluster INT")
    found = clusters.with_distance(frame, centres).orderBy("vec_id").collect()
    assert [r["distance"] for r in found] == [1.0, None, None, None]


def test_closest_of_settles_ties_and_rounding():
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(20, 3)) * 1e3, 2, axis=0)
    vectors = rng.normal(size=(50, 3)) * 1e3
    ids, distances = clusters.closest_of(vectors, np.arange(40), points)
    exact = ((vectors[:, None] - points) ** 2).sum(2)
    assert ids.tolist() == exact.argmin(1).tolist()
    assert distances.tolist() == exact.min(1).tolist()


def test_routing_bounds(spark):
    frame = spark.createDataFrame(
        [(0.6, None), (0.5, 0.31), (0.2, 0.3), (0.2, None)],
        "distance DOUBLE, subdistance DOUBLE",
    )
    assert [r["slot"] for r in clusters.route(frame, 0.5, 0.3).collect()] == [
        "global", "local", "warehouse", "local",
    ]


def test_newest_per_cluster(spark):
    rows = [(0, 1, 0), (0, 1, 1), (0, 2, 0), (1, 1, 2)]
    frame = spark.createDataFrame(rows, "cluster INT, batch_id INT, seq INT")
    kept = retention.keep_newest(frame, ["cluster"], 2)
    assert {tuple(r) for r in kept.collect()} == {(0, 2, 0), (0, 1, 1), (1, 1, 2)}


def test_newest_under_a_large_limit_move_no_rows(spark):
    frame = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int").alias("cluster"),
        F.lit(1).alias("batch_id"), F.col("id").alias("seq"),
    )
    kept = retention.keep_newest(frame, ["cluster"], 1500)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 4000


def test_newest_beyond_a_large_limit(spark):
    # a group without a name, one within the limit, and rows whose order is equal or not known
    rows = [(i % 4 or None, i // 2000, i // 2 if i % 7 else None) for i in range(6000)]
    rows += [(9, 0, i) for i in range(1100)]
    frame = spark.createDataFrame(rows, "cluster INT, batch_id INT, seq INT").repartition(8)
    kept = retention.keep_newest(frame, ["cluster"], 1100)
    assert "Window [row_number" not in kept._jdf.queryExecution().optimizedPlan().toString()
    found: dict = {}
    for r in kept.collect():
        found.setdefault(r["cluster"], []).append((r["batch_id"], -1 if r["seq"] is None else r["seq"]))
    for cluster in (None, 1, 2, 3, 9):
        own = [(b, -1 if s is None else s) for c, b, s in rows if c == cluster]
        assert sorted(found[cluster]) == sorted(own)[-1100:]


def test_topic_pairs(spark):
    rows = [("m1", "s1"), ("m1", "s1"), ("m1", "s2"), ("m0", "s3")]
    frame = spark.createDataFrame(rows, "MainTopic STRING, SubTopic STRING")
    assert [tuple(r) for r in topic_pairs(frame).collect()] == [
        ("m0", "s3"), ("m1", "s1"), ("m1", "s2"),
    ]


def test_soft_membership(spark):
    frame = spark.createDataFrame([(7, [0.5, 0.35, 0.15])], "doc_id INT, topic_dist ARRAY<DOUBLE>")
    assert [(r["doc_id"], r["topic"]) for r in membership(frame, 0.3).collect()] == [(7, 0), (7, 1)]


def test_lda_table(spark):
    main = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "topic INT, terms ARRAY<STRING>")
    sub = spark.createDataFrame([(0, 1, ["d"])], "topic INT, subtopic INT, terms ARRAY<STRING>")
    rows = {tuple(r) for r in lda_topic_table(main, sub).collect()}
    assert rows == {(0, "a b", 1, "d"), (1, "c", None, None)}


def test_lemmas(spark):
    docs = spark.createDataFrame(
        [(1, ["Cats", "ran", "the", "to", "Cats"]), (2, ["of"])],
        "doc_id INT, words ARRAY<STRING>",
    )
    lemmas = spark.createDataFrame([("Cats", "cat"), ("ran", "Run")], "form STRING, lemma STRING")
    found = {r["doc_id"]: r["content"] for r in normalise_with_lemmas(docs, lemmas).collect()}
    assert found == {1: "cat run cat", 2: ""}


def test_lemmas_of_a_large_table(spark, monkeypatch):
    rows = [(1, ["Cats", "the", "ran", "Cats", None, "ox"]), (1, ["Dogs"]), (None, []), (3, None), (4, ["was"])]
    docs = spark.createDataFrame(rows, "doc_id INT, words ARRAY<STRING>")
    lemmas = spark.createDataFrame(
        [("Cats", "cat"), ("Cats", "hat"), ("ran", "Run"), ("Dogs", None), ("was", "be"), (None, "x")],
        "form STRING, lemma STRING",
    )
    small = normalise_with_lemmas(docs, lemmas)
    monkeypatch.setattr("tidings.operators.lda.LEMMAS_IN_PLACE", 1)
    large = normalise_with_lemmas(docs, lemmas)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, large.collect()), key=key) == sorted(map(tuple, small.collect()), key=key)
    # places of tokens do not travel, nor do tokens that no form is equal to
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan
