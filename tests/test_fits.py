import shutil

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidings.operators import fits, lda, skipgram, word_maps
from tidings.plans import catalog, jobs

TOPICS = {
    "fruit": "apple pear plum grape melon".split(),
    "metal": "iron zinc lead gold tin".split(),
    "bird": "owl hawk wren swan crow".split(),
}
SMALL = fits.LevelParams(k=3, label_length=3, max_iter=20, vocab_size=30, min_df=1)
SUB = fits.LevelParams(k=2, label_length=2, max_iter=20, vocab_size=10, min_df=1)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = []
    for t, (name, pool) in enumerate(TOPICS.items()):
        for i in range(30):
            words = [pool[(i + j) % 5] for j in range(4)] + [pool[i % 5]] * (i % 3)
            rows.append((t * 100 + i, name, words))
    path = str(tmp_path_factory.mktemp("docs"))
    frame = spark.createDataFrame(rows, "doc_id BIGINT, topic STRING, words ARRAY<STRING>")
    frame.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_distance_sums_to_the_training_cost(docs):
    model, placed = fits.fit_level(docs, SMALL)
    total = placed.agg(F.sum("distance")).first()[0]
    kmeans = model.pipeline.stages[-1]
    assert total == pytest.approx(kmeans.summary.trainingCost)
    assert placed.count() == docs.count()
    assert placed.select("doc_id").distinct().count() == docs.count()


def test_assigned_centre_is_the_nearest(docs):
    model, placed = fits.fit_level(docs, SMALL)
    vectors = model.pipeline.transform(docs).select(
        "doc_id", vector_to_array("tfidf").alias("v")
    )
    centres = np.array(model.centres)
    for row in placed.join(vectors, "doc_id").collect():
        distances = ((centres - np.array(row["v"])) ** 2).sum(axis=1)
        assert row["distance"] == pytest.approx(distances.min(), abs=1e-9)
        assert row["distance"] == pytest.approx(distances[row["cluster"]], abs=1e-9)


def test_same_seed_and_layout_give_the_same_cost(docs):
    costs = {
        round(fits.fit_level(docs.repartition(n), SMALL, partitions=4)[1]
              .agg(F.sum("distance")).first()[0], 9)
        for n in (1, 3, 5)
    }
    assert len(costs) == 1


def test_saved_model_assigns_alike(docs, tmp_path):
    model, placed = fits.fit_level(docs, SMALL)
    model.save(str(tmp_path / "m"))
    again = fits.assign(docs, fits.LevelModel.load(str(tmp_path / "m")))
    same = placed.select("doc_id", "cluster").exceptAll(again.select("doc_id", "cluster"))
    assert same.count() == 0


def test_normalised_vectors_stay_within_four(docs):
    params = fits.LevelParams(k=3, label_length=3, vocab_size=30, min_df=1, normalize=True)
    _, placed = fits.fit_level(docs, params)
    assert placed.agg(F.max("distance")).first()[0] <= 4.0


def test_guards(spark):
    schema = "doc_id BIGINT, words ARRAY<STRING>"
    same = spark.createDataFrame([(i, ["a", "b"]) for i in range(5)], schema)
    model, placed = fits.fit_level(same, SMALL)
    assert model.pipeline is None
    assert {r["cluster"] for r in placed.collect()} == {0}

    two = spark.createDataFrame([(0, ["a"]), (1, ["b", "b"]), (2, ["a"])], schema)
    model, _ = fits.fit_level(two, SMALL)
    assert len(model.centres) == 2

    empty = spark.createDataFrame([(0, [])], schema)
    assert fits.fit_level(empty, SMALL)[0].pipeline is None
    nothing = spark.createDataFrame([], schema)
    assert fits.fit_level(nothing, fits.ADAPTIVE[0])[0].pipeline is None


def test_hierarchy(spark, docs, tmp_path):
    # one of many layouts in which K-means finds the pools from this seed
    found = fits.fit_hierarchy(docs, str(tmp_path / "h"), (SMALL, SUB), partitions=16)
    assert found.assigned.count() == docs.count()
    topics = found.topics.collect()
    assert sum(r["documents"] for r in topics) == docs.count()
    # every first-level label comes from one pool of words
    for row in topics:
        terms = set(row["MainTopic"].split())
        assert any(terms <= set(pool) for pool in TOPICS.values())
    cost = jobs.hierarchy_cost(found, "now").collect()
    level1 = {r["firstLevelClusterIndex"]: r["firstLevelClusterCost"] for r in cost}
    kmeans = found.level1.pipeline.stages[-1]
    assert sum(level1.values()) == pytest.approx(kmeans.summary.trainingCost)


def test_adaptive_hierarchy_runs_on_skewed_clusters(spark, docs, tmp_path):
    one = docs.limit(1).withColumn("words", F.array(*[F.lit("zebra")] * 40))
    found = fits.fit_hierarchy(docs.union(one), str(tmp_path / "a"))
    assert found.topics.agg(F.sum("documents")).first()[0] == docs.count() + 1


def test_lda_levels(spark, docs, tmp_path):
    params = (
        lda.LdaParams(k=3, max_iter=10, vocab_size=20),
        lda.LdaParams(k=2, max_iter=5, vocab_size=10),
    )
    level = lda.fit_lda(docs, params[0])
    for row in level.distributions(docs).collect():
        assert sum(row["topic_dist"]) == pytest.approx(1.0)
    for row in level.topics().collect():
        assert row["terms"] == [level.space.terms[i] for i in row["termIndices"]]
    found = lda.fit_lda_hierarchy(docs, str(tmp_path / "l"), params)
    assert found.members.agg(F.min("probability")).first()[0] >= 0.3
    assert {r["topic"] for r in found.topics.collect()} == {0, 1, 2}


def test_prepare_lda_with_lemmas(spark):
    frame = spark.createDataFrame([(1, "The Cats, ran!")], "doc_id BIGINT, text STRING")
    lemmas = spark.createDataFrame([("Cats", "cat")], "form STRING, lemma STRING")
    assert lda.prepare_lda(frame, lemmas=lemmas).first()["words"] == ["the", "cat", "ran"]
    assert lda.prepare_lda(frame).first()["words"] == ["cats", "ran"]


def test_word_map(docs):
    params = word_maps.WordParams(size=8, max_iter=1)
    assert word_maps.word_map(docs, params).count() == 15
    vectors = word_maps.word_vectors(docs, params).collect()
    assert len(vectors) == 15 and all(len(r["vector"]) == 8 for r in vectors)
    assert word_maps.word_map(docs.limit(0), params).count() == 0


def test_shards_follow_the_words_alone():
    small, few, large = skipgram.SMALL, skipgram.FEW, skipgram.LARGE
    assert [skipgram.shard_count(n) for n in (0, 1, small, small + 1, small * few)] == [1, 1, 1, 2, few]
    assert skipgram.shard_count(large * few) == few and skipgram.shard_count(large * 90) == 90


def topic_texts(spark, count=240):
    """Sentences of two topics that share no word but ``both``, and a group of each half."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(count):
        topic = "ab"[k % 2]
        rows.append((k, [f"{topic}{i}" for i in rng.integers(0, 12, 30)] + ["both"], f"g{k % 4 // 2}"))
    rows += [(count, None, "g0"), (count + 1, [], "g1"), (count + 2, ["alone"], "g1"), (count + 3, [None, "a1", "a2"], "g0")]
    return spark.createDataFrame(rows, "doc_id INT, words ARRAY<STRING>, grp STRING")


def test_vectors_tell_topics_apart(spark, monkeypatch):
    """Several shards, averaged; the same in any layout; groups train apart."""
    monkeypatch.setattr(skipgram, "SMALL", 1500)
    texts = topic_texts(spark)
    train = lambda df, group=None: word_maps.group_vectors(
        df, group, word_maps.WordParams(size=16, max_iter=60, rounds=3)
    )
    found = {(r["grp"], r["word"]): np.array(r["vector"]) for r in train(texts).collect()}
    assert {w for _, w in found} == {f"{t}{i}" for t in "ab" for i in range(12)} | {"both", "alone"}
    assert all(np.isfinite(v).all() for v in found.values())
    unit = {w: v / np.linalg.norm(v) for (_, w), v in found.items()}
    within = np.mean([unit["a1"] @ unit[f"a{i}"] for i in range(2, 12)])
    across = np.mean([unit["a1"] @ unit[f"b{i}"] for i in range(2, 12)])
    assert within > across + 0.3
    again = {(r["grp"], r["word"]): np.array(r["vector"]) for r in train(texts.repartition(5)).collect()}
    assert all(np.allclose(found[k], again[k], atol=1e-5) for k in found)
    grouped = train(texts, "grp").collect()
    assert {r["grp"] for r in grouped} == {"g0", "g1"}
    assert sum(r["word"] == "alone" for r in grouped) == 1
    once = word_maps.group_vectors(texts, None, word_maps.WordParams(size=4, max_iter=1, min_count=2))
    assert "alone" not in {r["word"] for r in once.collect()}


def test_groups_are_projected_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    data = {g: rng.normal(size=(40 + 20 * g, 5)) * np.array([5, 3, 1, 1, 1]) for g in range(2)}
    rows = [(str(g), f"w{i}", row.tolist()) for g, x in data.items() for i, row in enumerate(x)]
    rows.append(("one", "w", [1.0] * 5))
    frame = spark.createDataFrame(rows, "grp STRING, word STRING, vector ARRAY<FLOAT>").repartition(4)
    placed = skipgram.project_groups(frame, 5).toPandas()
    for g, x in data.items():
        own = placed[placed["grp"] == str(g)][["x", "y"]].to_numpy()
        expected = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
        assert np.var(own, axis=0, ddof=1) == pytest.approx(expected, rel=1e-4)
    assert placed[placed["grp"] == "one"][["x", "y"]].to_numpy().tolist() == [[0.0, 0.0]]


def test_stored_lda_hierarchy_is_applied(spark, tmp_path):
    """A topic whose folder holds no model gives NULL; other documents can be asked about."""
    rng = np.random.default_rng(1)
    rows = [(i, [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 6, 20)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id INT, words ARRAY<STRING>")
    params = tuple(lda.LdaParams(k=2, max_iter=5, vocab_size=12) for _ in range(2))
    path = str(tmp_path / "lda")
    fitted = lda.fit_lda_hierarchy(docs, path, params)
    loaded = lda.LdaHierarchy.load(spark, path, params)
    assert set(loaded.level2) == set(fitted.level2)
    assert loaded.level1.space.terms == fitted.level1.space.terms
    assert loaded.members.count() == fitted.members.count() == loaded.apply(docs).count()
    shutil.rmtree(f"{path}/secondLevel/topic=1")
    fresh = docs.limit(4).union(spark.createDataFrame([(90, None), (91, ["new"])], docs.schema))
    found = lda.LdaHierarchy.load(spark, path, params).apply(fresh).collect()
    assert {r["subtopic_dist"] is None for r in found if r["topic"] == 1} <= {True}
    assert all(sum(r["subtopic_dist"]) == pytest.approx(1) for r in found if r["topic"] == 0)
    nothing = lda.LdaLevel.load(spark, f"{path}/none", params[0])
    assert nothing.model is None
    assert {r["topic_dist"] for r in nothing.distributions(docs).collect()} == {None}


def test_steps_equal_a_plain_loop(monkeypatch):
    """One step of the trainer, pair by pair."""
    monkeypatch.setattr(skipgram, "STEP", 2)
    rng = np.random.default_rng(2)
    tokens, sentence = rng.integers(0, 6, 70), np.repeat([0, 1], [40, 30])
    inner, outer = rng.normal(size=(2, 6, 3)).astype(np.float32)
    x, y = inner.copy(), outer.copy()
    skipgram.train_shard(tokens, sentence, inner, outer, range(1), 1, 2, 9)
    draw, size = np.random.default_rng([9, 0]), skipgram.BLOCK
    offset = int(draw.integers(size))
    blocks = -(-(70 + offset) // size)
    reach = draw.integers(1, 3, blocks * size)
    words = [[p for p in range(b * size - offset, (b + 1) * size - offset) if 0 <= p < 70] for b in range(blocks)]
    order, sums = draw.permutation(blocks), np.ones((2, 6))
    for first in range(0, blocks, 2):
        step, slopes = order[first : first + 2], np.zeros((2, 6, 3))
        for block, after in zip(step, np.roll(step, -1)):
            for i in words[block]:
                near = [j for j in words[block] if 0 < abs(i - j) <= reach[i + offset] and sentence[i] == sentence[j]]
                far = [j for j in words[after] if tokens[i] != tokens[j] and (block != after or j not in near)]
                for j, sign in [(j, 1) for j in near] + [(j, 0) for j in far]:
                    p = 1 / (1 + np.exp(-x[tokens[i]] @ y[tokens[j]]))
                    slope = 1 - p if sign else -p * skipgram.NEGATIVES * len(near) / len(far)
                    slopes[0, tokens[i]] += slope * y[tokens[j]]
                    slopes[1, tokens[j]] += slope * x[tokens[i]]
        sums += (slopes**2).mean(2)
        change = skipgram.RATE * slopes / np.sqrt(sums)[:, :, None]
        x, y = x + change[0], y + change[1]
    assert np.allclose(inner, x, atol=1e-4) and np.allclose(outer, y, atol=1e-4)


def test_repeats_are_summed_once_and_as_reduceat_does(monkeypatch):
    """Words that occur once, a few times and often in a step; one sort serves both tables."""
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 9, 300), rng.integers(0, 200, 300), np.arange(20), np.zeros(40, int), np.zeros(1, int)):
        slopes = rng.normal(size=(len(ids), 7)).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        repeats = skipgram._Repeats(ids)
        assert np.array_equal(repeats.rows, rows)
        assert np.array_equal(repeats.sums(slopes), np.add.reduceat(slopes[order], first, axis=0))
    made = []
    whole = skipgram._Repeats
    monkeypatch.setattr(skipgram, "_Repeats", lambda ids: made.append(len(ids)) or whole(ids))
    tables = np.zeros((2, 6, 3), np.float32)
    skipgram.train_shard(rng.integers(0, 6, 70), np.zeros(70, int), *tables, range(1), 1, 2, 9)
    assert len(made) == 1  # three or four blocks are one step


def test_pca_variance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 5)) * np.array([5, 3, 1, 1, 1])
    frame = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(data)], "id INT, v ARRAY<DOUBLE>"
    ).select("id", array_to_vector("v").alias("vector"))
    placed = np.array([(r["x"], r["y"]) for r in word_maps.project_2d(frame).collect()])
    expected = np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1][:2]
    assert np.var(placed, axis=0, ddof=1) == pytest.approx(expected)
    assert word_maps.project_2d(frame.limit(1)).first()["x"] == 0.0


def test_inspection_covers_every_node(spark, docs, tmp_path):
    params = word_maps.WordParams(size=4, max_iter=1)
    found, maps = jobs.inspect(docs, str(tmp_path / "i"), (SMALL, SUB), params)
    nodes = {(r["level"], r["cluster"], r["subcluster"]) for r in
             maps.select("level", "cluster", "subcluster").distinct().collect()}
    leaves = found.assigned.select("cluster", "subcluster").distinct().count()
    assert len(nodes) == 1 + len(found.level2) + leaves
    terms = spark.read.parquet(str(tmp_path / "i" / "vocabularies"))
    assert {r["level"] for r in terms.select("level").distinct().collect()} == {1, 2}


@pytest.mark.parametrize("name", ["word_vectors", "inspect_export"])
def test_registered_queries_train_as_the_reference(spark, docs, monkeypatch, name):
    trained = []

    def record(df, size, max_iter, *rest):
        trained.append((size, max_iter))
        raise InterruptedError

    monkeypatch.setattr(skipgram, "train_words", record)
    monkeypatch.setattr(catalog, "words", lambda *_: docs)
    with pytest.raises(InterruptedError):
        catalog.QUERIES[name](spark, "")
    assert trained == [(200, 100)]
