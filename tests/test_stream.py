import shutil

import pytest
from pyspark.sql import functions as F

from tidings.operators.fits import LevelParams
from tidings.session import folder_names, stored_bytes
from tidings.streaming import maintain
from tidings.streaming.maintain import StreamConfig, TopicMaintainer, maintain_topics
from tidings.streaming.store import InForce, TopicStore

LEVEL1 = LevelParams(k=2, label_length=2, max_iter=20, vocab_size=12, min_df=1)
LEVEL2 = LevelParams(k=2, label_length=2, max_iter=20, vocab_size=8, min_df=1)


def config(**changes):
    values = dict(
        level1=LEVEL1, level2=LEVEL2, threshold1=2.0, threshold2=1e9,
        bootstrap=6, global_limit=3, local_limit=3, warehouse_limit=50,
        compact_every=1000, partitions=2, stop_words=("the",),
    )
    return StreamConfig(**{**values, **changes})


def batch(spark, *texts):
    rows = [(t.split(),) for t in texts]
    return spark.createDataFrame(rows, "words ARRAY<STRING>")


A, I = "apple " * 8, "iron " * 8
PEAR, PLUM, ZINC, LEAD = A + "pear", A + "plum", I + "zinc", I + "lead"
BOOT = [PEAR] * 3 + [PLUM] * 2, [ZINC] * 3 + [LEAD] * 2
FAR = [A + I] * 3


def slots(maintainer, spark, batch_id):
    store = maintainer.store
    force = store.in_force(spark, batch_id + 1)
    state = store.state(spark, force, batch_id, maintainer.config.warehouse_limit)
    return {
        r["slot"]: r["n"] for r in state.groupBy("slot").agg(F.count("*").alias("n")).collect()
    }


def snapshot(maintainer, spark, batch_id):
    store = maintainer.store
    force = store.in_force(spark, batch_id + 1)
    state = store.state(spark, force, batch_id, maintainer.config.warehouse_limit)
    rows = state.select("doc_id", "slot", "cluster", "model_version", "batch_id").collect()
    registry = store.registry(spark).drop("committed_at").collect()
    return sorted(map(tuple, rows), key=repr), sorted(map(tuple, registry), key=repr)


@pytest.fixture(scope="module")
def boot_store(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("boot") / "store"
    maintainer = TopicMaintainer(spark, str(path), config())
    maintainer.process(batch(spark, *BOOT[0]), 0)
    assert maintainer.store.in_force(spark, 1).version is None
    assert slots(maintainer, spark, 0) == {"boot": 5}
    maintainer.process(batch(spark, *BOOT[1]), 1)
    return path


@pytest.fixture
def booted(spark, boot_store, tmp_path):
    """A store behind its first fit; all paths inside are relative, so a copy will do."""
    shutil.copytree(boot_store, tmp_path / "store")
    return TopicMaintainer(spark, str(tmp_path / "store"), config())


def test_bootstrap_fits_when_enough_documents_are_there(spark, booted):
    force = booted.store.in_force(spark, 2)
    assert force.version == 1 and set(force.nodes) == {0, 1}
    assert slots(booted, spark, 1) == {"warehouse": 10}
    topics = booted.store.topics(spark).collect()
    assert sum(r["documents"] for r in topics) == 10
    assert {r["MainTopic"].split()[0] for r in topics} <= {
        "apple", "pear", "plum", "iron", "zinc", "lead",
    }


def test_documents_are_routed(spark, booted):
    booted.process(batch(spark, FAR[0], PEAR, ZINC), 2)
    assert slots(booted, spark, 2) == {"warehouse": 12, "global": 1}
    assert booted.store.in_force(spark, 3).version == 1


def test_global_refit_empties_the_container_and_reassigns(spark, booted):
    booted.process(batch(spark, *FAR[:2]), 2)
    booted.process(batch(spark, FAR[0], PEAR), 3)
    force = booted.store.in_force(spark, 4)
    assert force.version == 3
    assert slots(booted, spark, 3) == {"warehouse": 11}
    state = booted.store.state(spark, force, 3, 50)
    assert {r[0] for r in state.select("model_version").distinct().collect()} == {3}
    assert state.where(F.col("cluster").isNull()).count() == 0
    # older batches still see what they saw
    assert booted.store.in_force(spark, 3).version == 1


def test_local_refit_touches_one_node(spark, booted):
    booted.config = config(threshold1=1e9, threshold2=1e-9)
    before = booted.store.in_force(spark, 2)
    booted.process(batch(spark, PEAR + " plum", PLUM + " plum", PEAR + " pear"), 2)
    after = booted.store.in_force(spark, 3)
    changed = [n for n in after.nodes if after.nodes[n] != before.nodes[n]]
    assert len(changed) == 1 and after.version == 1
    assert after.refitted == {changed[0]: 2}
    assert "local" not in slots(booted, spark, 2)
    topics = booted.store.topics(spark)
    assert topics.select("cluster").distinct().count() == 2
    # the other node keeps its documents and its name
    assert set(r["cluster"] for r in topics.collect()) == set(after.nodes)


def test_retention_keeps_the_newest(spark, booted):
    booted.config = config(warehouse_limit=4)
    booted.process(batch(spark, *[PEAR] * 9), 2)
    force = booted.store.in_force(spark, 3)
    kept = booted.store.state(spark, force, 2, 4)
    sizes = {
        r["cluster"]: r["n"] for r in kept.groupBy("cluster").agg(F.count("*").alias("n")).collect()
    }
    assert set(sizes.values()) == {4}
    apples = kept.where(F.array_contains("words", "pear"))
    assert {r["batch_id"] for r in apples.collect()} == {2}


def test_compaction_changes_nothing_visible(spark, booted):
    booted.process(batch(spark, FAR[0], PEAR), 2)
    before = slots(booted, spark, 2)
    booted.config = config(compact_every=1)
    booted.process(batch(spark, ZINC), 3)
    force = booted.store.in_force(spark, 4)
    assert force.generation == 3 and force.version == 1
    assert slots(booted, spark, 3) == {**before, "warehouse": before["warehouse"] + 1}
    booted.process(batch(spark, ZINC), 4)
    assert slots(booted, spark, 4)["warehouse"] == before["warehouse"] + 2


def test_a_committed_batch_can_run_again(spark, booted):
    docs = batch(spark, *FAR)
    booted.process(docs, 2)
    once = snapshot(booted, spark, 2)
    again = TopicMaintainer(spark, booted.store.path, config())
    again.process(docs, 2)
    assert snapshot(again, spark, 2) == once


def test_crash_before_the_registry_keeps_the_old_version(spark, booted, monkeypatch):
    docs = batch(spark, *FAR)
    real = TopicStore.commit

    def crash(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(TopicStore, "commit", crash)
    with pytest.raises(RuntimeError):
        booted.process(docs, 2)
    assert booted.store.in_force(spark, 3).version == 1
    monkeypatch.setattr(TopicStore, "commit", real)
    TopicMaintainer(spark, booted.store.path, config()).process(docs, 2)
    assert booted.store.in_force(spark, 3).version == 2
    assert slots(booted, spark, 2) == {"warehouse": 10}


def test_nothing_is_lost_whatever_the_batch_size(spark, booted):
    texts = [PEAR, LEAD, FAR[0], PLUM, FAR[1]]
    booted.process(batch(spark, *texts), 2)
    together = slots(booted, spark, 2)
    other = TopicMaintainer(spark, booted.store.path, config())
    for i, text in enumerate(texts):
        other.process(batch(spark, text), 2 + i)
    assert slots(other, spark, 6) == together


def test_stream_of_files(spark, tmp_path):
    """Files replayed one per batch, with a crash and a restart in between."""
    source = tmp_path / "in"
    source.mkdir()

    def put(name, texts):
        lines = [f"<title>t</title><content>the {t}</content>" for t in texts]
        (source / name).write_text("\n".join(lines) + "\n")

    def run():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        query = maintain_topics(lines, str(tmp_path / "s"), config(), available_now=True)
        query.awaitTermination(120)

    put("a", BOOT[0] + BOOT[1])
    run()
    store = TopicStore(spark, str(tmp_path / "s"))
    assert store.in_force(spark, 1).version == 0

    put("b", FAR)
    calls = []
    real = maintain.TopicMaintainer._refit_all

    def crash(self, *args):
        calls.append(1)
        raise RuntimeError("lost")

    maintain.TopicMaintainer._refit_all = crash
    try:
        with pytest.raises(Exception):
            run()
    finally:
        maintain.TopicMaintainer._refit_all = real
    assert calls and store.in_force(spark, 9).version == 0

    run()
    force = store.in_force(spark, 9)
    assert force.version == 1
    state = store.state(spark, force, 9, 50)
    assert state.count() == 10
    assert state.select("doc_id").distinct().count() == 10
    assert state.where(F.array_contains("words", "the")).count() == 0
    run()
    assert store.in_force(spark, 9).version == 1


def test_one_key_is_one_document_whatever_the_layout(spark, booted):
    """Rows of a key count once, and a batch that runs again gives keys the same places."""
    rows = [(t.split(), k) for k, t in zip("abcab", [PEAR, ZINC, FAR[0], PEAR, ZINC])]
    rows.append((LEAD.split(), None))
    docs = spark.createDataFrame(rows, "words ARRAY<STRING>, key STRING")

    def places(frame):
        TopicMaintainer(spark, booted.store.path, config()).process(frame, 2)
        state = booted.store.rows(spark, booted.store.in_force(spark, 3), 2).where("batch_id = 2")
        found = state.select("key", "doc_id", "slot", "cluster").collect()
        return sorted((tuple(r) for r in found if len(r["key"]) == 1))

    once = places(docs)
    assert [r[0] for r in once] == ["a", "b", "c"]
    assert places(docs.repartition(5)) == once == places(docs.coalesce(1))
    assert booted.store.ledger(spark).where("batch_id = 2").first()["arrived"] == 4


def test_ledger_accounts_for_every_document(spark, booted):
    arriving = [FAR[:2], [FAR[0], PEAR], [ZINC] * 2, FAR, [PEAR, PLUM]]
    for k, texts in enumerate(arriving):
        booted.process(batch(spark, *texts), 2 + k)
    rows = {r["batch_id"]: r for r in booted.store.ledger(spark).collect()}
    assert [rows[b]["arrived"] for b in range(7)] == [5, 5, *map(len, arriving)]
    used = sum(r["global_used"] + r["local_used"] for r in rows.values())
    state = booted.store.state(spark, booted.store.in_force(spark, 7), 6, 50)
    assert used >= 3 and state.count() == sum(r["arrived"] for r in rows.values()) - used
    assert rows[3]["refits"] == 1 and rows[4]["refits"] == 0


def test_vacuum_bounds_storage_and_keeps_what_is_asked_for(spark, booted):
    """Twelve batches with refits and compactions: what is stored stops growing."""
    booted.config = config(vacuum_every=1, vacuum_margin=2, warehouse_limit=6, compact_every=3)
    sizes, folders = [], []
    arriving = lambda b: batch(spark, *(FAR if b % 5 == 2 else []), PEAR, ZINC)
    for batch_id in range(2, 14):
        booted.process(arriving(batch_id), batch_id)
        stored = [stored_bytes(spark, f"{booted.store.path}/{t}") for t in ("state", "models")]
        sizes.append(sum(stored))
        folders.append(len(folder_names(spark, f"{booted.store.path}/models")))
    assert max(sizes[6:]) <= 1.3 * max(sizes[:6]) and max(folders) <= 6
    force = booted.store.in_force(spark, 14)
    assert force.version >= 2 and force.generation > 7
    # a restart behind any batch of the margin still finds what it needs
    for back in (14, 13, 12):
        other = TopicStore(spark, booted.store.path)
        then = other.in_force(spark, back)
        assert other.state(spark, then, back - 1, 6).count() > 0
        assert other.model(then.level1).centres
    again = TopicMaintainer(spark, booted.store.path, booted.config)
    before = snapshot(booted, spark, 13)[0]
    again.process(arriving(13), 13)
    assert len(snapshot(again, spark, 13)[0]) == len(before)


def test_lines_in_force_read_back():
    force = InForce(4, 3, "a", {0: "b", 1: None}, {1: 4})
    assert InForce.read(force.line()) == force and InForce.read(InForce().line()) == InForce()
