"""What a topic stream keeps between batches: documents by slot, and models.

Everything lives in tables below one path that all executors reach.

``state/gen=<g>/batch=<b>`` holds the documents written by batch ``b`` in generation ``g``.
A batch writes its folder as a whole, so running it again replaces what it wrote. A
generation starts with a snapshot of the documents still in use; older ones are no longer
read, which bounds the scan.

``registry`` lists models and snapshots as they came. ``force/batch=<b>`` holds all that is in
force behind batch ``b``, in one line, and is written last: what a batch sees is decided by
the newest such line of an earlier batch, hence a batch that failed half-way, or was
finished but not acknowledged, does the same work again on the same input. Reading it takes
the names of a folder and one line, however long the stream has run.

``ledger`` counts what each batch brought and what refits used up.

``vacuum`` deletes generations, models and lines that no batch can ask for any more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators.fits import LEVEL1, LevelModel
from tidings.operators.retention import append, keep_newest
from tidings.session import folder_names, remove

STATE_SCHEMA = (
    "doc_id BIGINT, key STRING, words ARRAY<STRING>, batch_id BIGINT, seq BIGINT, slot STRING, "
    "cluster INT, model_version BIGINT, written BIGINT"
)
REGISTRY_SCHEMA = (
    "batch_id BIGINT, kind STRING, node INT, path STRING, leaf BOOLEAN, "
    "committed_at TIMESTAMP"
)
LEDGER_SCHEMA = (
    "batch_id BIGINT, arrived BIGINT, global_used BIGINT, local_used BIGINT, refits INT"
)
FIRST_GENERATION = -1


@dataclass(frozen=True)
class InForce:
    """Models and generation that a batch works with."""

    generation: int = FIRST_GENERATION
    version: int | None = None
    level1: str | None = None
    nodes: dict[int, str | None] = field(default_factory=dict)
    refitted: dict[int, int] = field(default_factory=dict)

    def after_local(self, node: int, path: str | None, batch_id: int) -> "InForce":
        return replace(
            self,
            nodes={**self.nodes, node: path},
            refitted={**self.refitted, node: batch_id},
        )

    def line(self) -> str:
        """Everything as one line of text."""
        return json.dumps(
            [self.generation, self.version, self.level1,
             sorted(self.nodes.items()), sorted(self.refitted.items())]
        )

    @classmethod
    def read(cls, line: str) -> "InForce":
        generation, version, level1, nodes, refitted = json.loads(line)
        return cls(generation, version, level1, dict(nodes), dict(refitted))


class TopicStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._models: dict[str, LevelModel] = {}
        for folder, schema in (
            ("registry/start", REGISTRY_SCHEMA),
            (f"state/gen={FIRST_GENERATION}/start", STATE_SCHEMA),
        ):
            empty = spark.createDataFrame([], schema)
            empty.write.mode("ignore").parquet(f"{self.path}/{folder}")

    # -- registry --------------------------------------------------------------------

    def registry(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.path}/registry", REGISTRY_SCHEMA)

    def in_force(self, spark: SparkSession, batch_id: int) -> InForce:
        """What batches before ``batch_id`` left behind: the newest line of one of them."""
        known = [b for b in self._batches(spark, "force") if b < batch_id]
        if not known:
            return InForce()
        return InForce.read(spark.read.text(f"{self.path}/force/batch={max(known)}").first()[0])

    def _batches(self, spark: SparkSession, table: str) -> list[int]:
        names = folder_names(spark, f"{self.path}/{table}")
        return [int(n.split("=")[1]) for n in names if n.startswith("batch=")]

    def commit(
        self, spark: SparkSession, batch_id: int, rows: list[tuple], force: InForce
    ) -> None:
        """Publish ``(kind, node, path, leaf)`` rows of a batch and, last, what is in force.

        A batch that changed nothing leaves the line of an earlier one in force.
        """
        if not rows:
            return
        listed = _few(spark, [(batch_id, *row, None) for row in rows], REGISTRY_SCHEMA)
        listed.withColumn("committed_at", F.current_timestamp()).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/registry/batch={batch_id}")
        _few(spark, [(force.line(),)], "value STRING").write.mode("overwrite").text(
            f"{self.path}/force/batch={batch_id}"
        )

    # -- ledger ----------------------------------------------------------------------

    def note(self, spark: SparkSession, batch_id: int, *counts: int) -> None:
        """Enter a batch; running it again replaces the entry."""
        _few(spark, [(batch_id, *counts)], LEDGER_SCHEMA).write.mode("overwrite").parquet(
            f"{self.path}/ledger/batch={batch_id}"
        )

    def ledger(self, spark: SparkSession) -> DataFrame:
        """``arrived`` documents of each batch, those that its refits used up, and refits."""
        return _read(spark, f"{self.path}/ledger", LEDGER_SCHEMA)

    # -- vacuum ----------------------------------------------------------------------

    def vacuum(self, spark: SparkSession, batch_id: int, margin: int) -> list[str]:
        """Delete what no batch from ``batch_id - margin`` on can ask for, and say what.

        Those batches see the line in force before them and all later ones. Generations
        older than theirs, models that none of these lines names, and older lines go. What
        is listed in ``ledger`` and ``registry`` is a few bytes a batch and stays.
        """
        known = sorted(self._batches(spark, "force"))
        before = [b for b in known if b < batch_id - margin]
        if not before:
            return []
        kept = [b for b in known if b >= before[-1]]
        lines = [
            InForce.read(spark.read.text(f"{self.path}/force/batch={b}").first()[0]) for b in kept
        ]
        used = {self.model_path(f.version) for f in lines if f.version is not None}
        used |= {self.model_path(b, n) for f in lines for n, b in f.refitted.items()}
        oldest = min(f.generation for f in lines)
        gone = [f"force/batch={b}" for b in before[:-1]]
        for name in folder_names(spark, f"{self.path}/state"):
            if name.startswith("gen=") and int(name[4:]) < oldest:
                gone.append(f"state/{name}")
        for name in folder_names(spark, f"{self.path}/models"):
            made = int(name.split("=")[1].split("-")[0])
            # a batch behind the last line may be at work on its models
            if f"models/{name}" not in used and made <= kept[-1]:
                gone.append(f"models/{name}")
        for path in gone:
            remove(spark, f"{self.path}/{path}")
        return gone

    # -- models ----------------------------------------------------------------------

    def model_path(self, batch_id: int, node: int | None = None) -> str:
        """Where batch ``batch_id`` puts the hierarchy, or one refitted node."""
        name = f"models/batch={batch_id}"
        return name if node is None else f"{name}-node={node}"

    def model(self, path: str | None) -> LevelModel:
        """A saved model, loaded once; no path stands for a leaf."""
        if path is None:
            return LevelModel(None)
        if path not in self._models:
            self._models[path] = LevelModel.load(f"{self.path}/{path}")
        return self._models[path]

    def remember(self, path: str | None, model: LevelModel) -> None:
        """Keep a model that was just saved, so that it need not be loaded."""
        if path is not None:
            self._models[path] = model

    def forget_models(self, force: InForce) -> None:
        """Drop cached models that are no longer in force."""
        used = {force.level1, *force.nodes.values()}
        self._models = {p: m for p, m in self._models.items() if p in used}

    # -- state -----------------------------------------------------------------------

    def write_state(self, rows: DataFrame, generation: int, batch_id: int) -> None:
        names = [part.split()[0] for part in STATE_SCHEMA.split(", ")]
        rows.withColumn("written", F.lit(batch_id).cast("bigint")).select(
            *names
        ).write.mode("overwrite").parquet(
            f"{self.path}/state/gen={generation}/batch={batch_id}"
        )

    def rows(self, spark: SparkSession, force: InForce, batch_id: int) -> DataFrame:
        """Documents of the generation up to ``batch_id``, without used-up containers."""
        rows = _read(spark, f"{self.path}/state/gen={force.generation}", STATE_SCHEMA)
        alive = F.col("written") <= batch_id
        for node, when in force.refitted.items():
            consumed = (
                (F.col("slot") == "local")
                & F.col("cluster").eqNullSafe(node)
                & (F.col("written") <= when)
            )
            alive = alive & ~consumed
        return rows.where(alive)

    def state(
        self, spark: SparkSession, force: InForce, batch_id: int, warehouse_limit: int
    ) -> DataFrame:
        """The same with only the newest documents of each warehouse."""
        rows = self.rows(spark, force, batch_id)
        kept = keep_newest(
            rows.where(F.col("slot") == "warehouse"), ["cluster"], warehouse_limit
        )
        return append(rows.where(F.col("slot") != "warehouse"), kept)

    # -- topics ----------------------------------------------------------------------

    def topics(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """Labels of the hierarchy in force: level-2 labels of refitted nodes replaced."""
        force = self.in_force(spark, batch_id if batch_id is not None else 2**62)
        if force.version is None:
            return spark.createDataFrame(
                [], "cluster INT, MainTopic STRING, subcluster INT, documents BIGINT, SubTopic STRING"
            )
        base = spark.read.parquet(f"{self.path}/{self.model_path(force.version)}/topics")
        columns = ["cluster", "MainTopic", "subcluster", "documents", "SubTopic"]
        result = base.where(~F.col("cluster").isin(list(force.refitted))).select(*columns)
        names = base.select("cluster", "MainTopic").distinct()
        for node, when in force.refitted.items():
            sub = spark.read.parquet(f"{self.path}/{self.model_path(when, node)}/topics")
            result = result.unionByName(sub.join(names, "cluster").select(*columns))
        return result


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows as literals in one partition, with no Python worker behind them."""
    columns = [part.split() for part in schema.split(", ")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns)])
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
