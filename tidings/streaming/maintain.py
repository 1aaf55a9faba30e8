"""Routing a stream of documents into a topic hierarchy that refits itself.

Each micro-batch is routed with one narrow plan per level, appended to the state, counted
with one aggregation, and only then - when enough novel documents have gathered - followed
by a fit. Fits run MLlib over all retained documents and so belong into ``foreachBatch``,
not into a per-key stateful operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.functions import text
from tidings.operators import retention
from tidings.operators.clusters import route
from tidings.operators.features import fit_features
from tidings.operators.fits import (
    ADAPTIVE,
    LEVEL1,
    LevelParams,
    assign,
    assign_level2,
    fit_hierarchy,
    fit_space,
    label_params,
    layout_partitions,
)
from tidings.operators.labels import label_groups
from tidings.plans.jobs import line_words
from tidings.session import remove, staged
from tidings.streaming.store import InForce, TopicStore


@dataclass(frozen=True)
class StreamConfig:
    """The defaults of the stream. Thresholds are squared distances."""

    level1: LevelParams = ADAPTIVE[0]
    level2: LevelParams = ADAPTIVE[1]
    threshold1: float = 0.5
    threshold2: float = 0.3
    bootstrap: int = 500
    global_limit: int = 100
    local_limit: int = 100
    warehouse_limit: int = 1000
    compact_every: int = 50
    vacuum_every: int = 20
    vacuum_margin: int = 5
    partitions: int | None = None
    stop_words: Sequence[str] = text.DEFAULT_STOP_WORDS


_COMPACTED = ("compact", None, None, False)


class TopicMaintainer:
    """Processes batches of documents with a ``words`` column."""

    def __init__(
        self, spark: SparkSession, path: str, config: StreamConfig = StreamConfig()
    ) -> None:
        self.store = TopicStore(spark, path)
        self.config = config
        self._next: tuple[int, InForce] | None = None
        # documents that the last fit to be tried could not divide, while none has since
        self._undivided = 0

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Route one batch, refit what has to be refitted, publish the outcome.

        With a ``key`` column, documents keep it: ``doc_id`` is its hash, rows of one key are
        one document, and a batch that runs again, in whatever partitions, gives each key the
        same place. Rows without a key, or with NULL, get one from their position.
        """
        spark = batch.sparkSession
        seq = F.monotonically_increasing_id()
        place = F.concat_ws("-", F.lit(str(batch_id)), seq.cast("string"))
        key = F.coalesce(F.col("key"), place) if "key" in batch.columns else place
        docs = batch.select(
            "words", seq.alias("seq"), F.lit(batch_id).cast("bigint").alias("batch_id"), key.alias("key")
        )
        if "key" in batch.columns:
            # keys alone tell whether any comes twice; mostly none does, and no words move
            repeated = docs.groupBy("key").count().where("count > 1")
            if not repeated.isEmpty():
                rows = F.struct("seq", "words", "batch_id")
                docs = docs.groupBy("key").agg(F.min_by(rows, F.struct("words", "seq")).alias("row"))
                docs = docs.select("key", "row.*")
        docs = docs.withColumn("doc_id", F.xxhash64("key"))
        # after a finished batch the outcome is known; otherwise the registry tells
        expected, self._next = self._next, None
        if expected and expected[0] == batch_id:
            force = expected[1]
        else:
            force = self.store.in_force(spark, batch_id)
        step = self._collect if force.version is None else self._maintain
        self._next = (batch_id + 1, step(docs, force, batch_id))
        if batch_id and batch_id % self.config.vacuum_every == 0:
            self.store.vacuum(spark, batch_id, self.config.vacuum_margin)

    # -- before the first model ------------------------------------------------------

    def _collect(self, docs: DataFrame, force: InForce, batch_id: int) -> InForce:
        spark = docs.sparkSession
        boot = (
            docs.withColumn("slot", F.lit("boot"))
            .withColumn("cluster", F.lit(None).cast("int"))
            .withColumn("model_version", F.lit(None).cast("bigint"))
        )
        self.store.write_state(boot, force.generation, batch_id)
        held = self.store.rows(spark, force, batch_id)
        counted = held.groupBy((F.col("written") == batch_id).alias("fresh")).count()
        counts = {r["fresh"]: r["count"] for r in counted.collect()}
        documents, arrived = sum(counts.values()), counts.get(True, 0)
        changed = None
        if documents >= self.config.bootstrap + self._undivided:
            changed = self._refit_all(spark, held, ("boot",), batch_id)
            if not changed:
                self._undivided = documents
        self.store.note(spark, batch_id, arrived, 0, 0, int(changed is not None))
        if not changed:
            return force
        force, rows = changed
        self.store.commit(spark, batch_id, rows, force)
        return force

    # -- with a model ----------------------------------------------------------------

    def _maintain(self, docs: DataFrame, force: InForce, batch_id: int) -> InForce:
        spark = docs.sparkSession
        config = self.config
        self.store.forget_models(force)
        arrived = self._route(docs, force, batch_id)

        used = [0, 0]
        rows: list[tuple] = []
        counts = self._counts(spark, force, batch_id)
        novel = counts.get(("global", None), 0)
        if novel >= config.global_limit + self._undivided:
            changed = self._refit_all(
                spark, self._state(spark, force, batch_id), ("global", "warehouse"), batch_id
            )
            if changed:
                used[0] = novel
                force, fitted = changed
                rows += fitted
                counts = self._counts(spark, force, batch_id)
            else:  # try again once as many documents as the limit have come in
                self._undivided = novel

        for node in sorted(force.nodes):
            if counts.get(("local", node), 0) >= config.local_limit:
                used[1] += counts["local", node]
                force, fitted = self._refit_node(spark, force, node, batch_id)
                rows += fitted

        if not rows and batch_id - force.generation >= config.compact_every:
            self.store.write_state(
                self._state(spark, force, batch_id), batch_id, batch_id
            )
            rows.append(_COMPACTED)
            force = replace(force, generation=batch_id)
        refits = len({(kind, node) for kind, node, *_ in rows if kind == "local" or node == LEVEL1})
        self.store.note(spark, batch_id, arrived, *used, refits)
        self.store.commit(spark, batch_id, rows, force)
        return force

    def _state(self, spark: SparkSession, force: InForce, batch_id: int) -> DataFrame:
        return self.store.state(spark, force, batch_id, self.config.warehouse_limit)

    def _counts(self, spark: SparkSession, force: InForce, batch_id: int) -> dict:
        """Documents per container. Only slot and cluster are read."""
        containers = retention.merge_slots(
            self.store.rows(spark, force, batch_id), "global", "local"
        )
        found = retention.slot_counts(containers).collect()  # a row per container
        counts: dict = {}
        for row in found:
            key = (row["slot"], row["cluster"] if row["slot"] == "local" else None)
            counts[key] = counts.get(key, 0) + row["documents"]
        return counts

    def _route(self, docs: DataFrame, force: InForce, batch_id: int) -> int:
        """Write the documents of a batch under their slots, and say how many came."""
        config = self.config
        placed = assign(docs, self.store.model(force.level1)).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        try:
            fits = F.coalesce(F.col("distance") <= config.threshold1, F.lit(False))
            nodes = {n: self.store.model(p) for n, p in force.nodes.items()}
            inside = assign_level2(placed.where(fits), nodes)
            outside = (
                placed.where(~fits)
                .withColumn("subcluster", F.lit(None).cast("int"))
                .withColumn("subdistance", F.lit(None).cast("double"))
            )
            routed = route(
                retention.append(inside, outside), config.threshold1, config.threshold2
            ).withColumn("model_version", F.lit(force.version).cast("bigint"))
            arrived = placed.count()
            # what the batch itself pushes out of a warehouse need not be written
            state = self._newest(routed, arrived)
            # each branch reads all of a partition it takes part in: few files for a small batch,
            # more for a large one, so that no task has to read a large partition once a branch
            files = max(1, placed.rdd.getNumPartitions(), layout_partitions(arrived))
            self.store.write_state(state.coalesce(files), force.generation, batch_id)
            return arrived
        finally:
            placed.unpersist()

    def _newest(self, rows: DataFrame, most: int) -> DataFrame:
        """``rows`` without what is too old for its warehouse; there are at most ``most``."""
        limit = self.config.warehouse_limit
        if most <= limit:
            return rows
        held = rows.where(F.col("slot") == "warehouse")
        kept = retention.keep_newest(held, ["cluster"], limit)
        return retention.append(rows.where(F.col("slot") != "warehouse"), kept)

    # -- refits ----------------------------------------------------------------------

    def _refit_all(
        self, spark: SparkSession, state: DataFrame, trained: Sequence[str], batch_id: int
    ) -> tuple[InForce, list[tuple]] | None:
        """Fit the hierarchy on the slots ``trained`` and start a generation.

        Other documents than those of the global container get their cluster under the new
        model and stay. The state, a ranking of all that is stored, is evaluated once, into a
        table that is deleted afterwards. Without anything to divide the old model stays: None.
        """
        with staged(state, "refit") as state:
            return self._fitted(
                spark,
                retention.merge_slots(state, *trained),
                retention.merge_slots(state, "boot", "local", "warehouse"),
                batch_id,
            )

    def _fitted(
        self, spark: SparkSession, training: DataFrame, retained: DataFrame, batch_id: int
    ) -> tuple[InForce, list[tuple]] | None:
        config = self.config
        path = self.store.model_path(batch_id)
        fitted = fit_hierarchy(
            training.select("doc_id", "words"),
            f"{self.store.path}/{path}",
            (config.level1, config.level2),
            partitions=config.partitions,
        )
        if fitted.level1.pipeline is None:
            return None
        self._undivided = 0
        again = (
            assign(retained, fitted.level1)
            .withColumn(
                "slot", F.when(F.col("slot") == "local", "local").otherwise("warehouse")
            )
            .withColumn("model_version", F.lit(batch_id).cast("bigint"))
        )
        snapshot = self._newest(again, retained.count())
        self.store.write_state(snapshot, batch_id, batch_id)
        # the models and labels are kept, their documents are in the snapshot
        remove(spark, f"{self.store.path}/{path}/assigned")

        nodes = {
            node: None if model.pipeline is None else f"{path}/secondLevel/node={node}"
            for node, model in fitted.level2.items()
        }
        force = InForce(batch_id, batch_id, f"{path}/firstLevel", nodes)
        self.store.remember(force.level1, fitted.level1)
        for node, model in fitted.level2.items():
            self.store.remember(nodes[node], model)
        rows = [("global", LEVEL1, force.level1, False)]
        rows += [("global", node, p, p is None) for node, p in nodes.items()]
        return force, rows

    def _refit_node(
        self, spark: SparkSession, force: InForce, node: int, batch_id: int
    ) -> tuple[InForce, list[tuple]]:
        """Refit level 2 of one cluster on its container and warehouse, empty the container."""
        members = retention.merge_slots(
            self._state(spark, force, batch_id), "local", "warehouse"
        ).where(F.col("cluster") == node)
        with staged(members, "refit") as training:
            return self._fitted_node(spark, force, node, training, batch_id)

    def _fitted_node(
        self, spark: SparkSession, force: InForce, node: int, training: DataFrame, batch_id: int
    ) -> tuple[InForce, list[tuple]]:
        config = self.config
        path = self.store.model_path(batch_id, node)
        space = fit_features(training, config.level2.vocab_size, config.level2.min_df)
        model = fit_space(training, space, config.level2, partitions=config.partitions)
        model.save(f"{self.store.path}/{path}/model")

        inside = assign(training, model, "subcluster", "subdistance")
        labels = label_params(config.level2)
        label_groups(
            inside,
            ["cluster", "subcluster"],
            labels.length,
            labels.vocab_size,
            labels.min_df,
        ).select(
            "cluster", "subcluster", "documents", F.col("label").alias("SubTopic")
        ).write.mode("overwrite").parquet(f"{self.store.path}/{path}/topics")

        leaf = model.pipeline is None
        saved = None if leaf else f"{path}/model"
        self.store.remember(saved, model)
        return (
            force.after_local(node, saved, batch_id),
            [("local", node, saved, leaf)],
        )


def maintain_topics(
    lines: DataFrame,
    path: str,
    config: StreamConfig = StreamConfig(),
    checkpoint: str | None = None,
    interval: str | None = "1 second",
    available_now: bool = False,
    key: Column | None = None,
) -> StreamingQuery:
    """Start the stream on tagged lines (``value``); ``path`` holds state and models.

    ``key`` names a document by its line, so that it can be told apart and followed. A restart with the same checkpoint resumes behind the last finished batch.
    """
    spark = lines.sparkSession
    maintainer = TopicMaintainer(spark, path, config)
    found = line_words(lines, stop_words=config.stop_words)
    words = found.select("words") if key is None else found.select("words", key.alias("key"))
    writer = words.writeStream.foreachBatch(maintainer.process).option(
        "checkpointLocation", checkpoint or f"{path.rstrip('/')}/checkpoint"
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
