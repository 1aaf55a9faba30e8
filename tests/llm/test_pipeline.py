"""Queries against SQL, and the stages of the pipeline on what each is given."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidings.llm import leaks, toxicity
from tidings.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), connection.sql(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    order = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(ours), order(theirs), check_dtype=False)


def test_all_operators_are_registered():
    from __spark_entry__ import queries

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(queries())


def test_pipeline(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [
        (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, None, None, None, None),
        (9004, "only line of its own here", "en", "s", 3),
    ]
    docs = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in made.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {9001, 9002, 9003, 9004} <= ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == documents.columns
        seen.append(made)
        docs = made
    toxic, lines, near, clean, encoded = seen
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert leaks.find_leaks(clean, items).count() == 0
    assert encoded.count() == clean.count() and encoded.where("n_tokens IS NULL").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("toxic = 0").join(documents, "doc_id").count()
    left = labels.where("toxic = 0").join(toxic, "doc_id").count()
    # this folder has fewer than LEAST toxic labels: nothing is learned, so nothing goes
    assert left == known and toxic.count() == documents.count() + 4
    texts = [x for r in lines.select("text").collect() for x in (r[0] or "").lower().split("\n")]
    normal = [" ".join(t.split()) for t in texts if t.split()]
    assert len(normal) == len(set(normal))
    assert labels.where("toxic = 1").count() < toxicity.LEAST


def test_stages_keep_columns_of_any_name(spark):
    """Columns that the stages use themselves, rows without an id, and repeated ids."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    extra = documents.limit(3).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    docs = documents.unionByName(extra).unionByName(documents.limit(2)).selectExpr(
        "*", "'a' as score", "2 as predicted", "'b' as n_lines", "3L as n_dropped", "'c' as component_id"
    )
    for name, stage in corpus_pipeline.STAGES[:2]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns
        own = made.select("score", "predicted", "n_lines", "n_dropped", "component_id").distinct()
        assert [tuple(r) for r in own.collect()] == [("a", 2, "b", 3, "c")]
