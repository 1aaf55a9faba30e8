"""Headline queries at one scale; prints one JSON line.

Seconds per query are the median of three runs on a warm session, every result consumed
in full. ``stream_replay`` replays all documents in five batches through a topic stream
whose first batch fits the hierarchy.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

from tidings.operators.fits import FIXED
from tidings.plans import catalog
from tidings.session import build_session, work_dir
from tidings.sources.replay import slices
from tidings.streaming.maintain import StreamConfig, TopicMaintainer

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BATCHES = 5
#: Reported beside the headline, once each and not in its sum.
MORE = ("article_scan", "inspect_words", "topic_tables")
HEADLINE = (
    "cluster_labels", "doc_term_tfidf", "nearest_centroid", "kmeans_level1",
    "lda_level1", "clean_text", "tokens", "topic_pairs", "preprocess_articles",
    "route_docs", "retain_newest", "replay_slices",
)


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def replay_stream(spark) -> dict[str, float]:
    docs = catalog.words(spark, SF_DIR)
    size = -(-docs.count() // BATCHES)
    sliced = slices(docs, "doc_id", size=size).cache()
    sliced.count()
    # distances are not normalised: a threshold near the median keeps both outcomes
    config = StreamConfig(
        level1=FIXED[0], level2=FIXED[1], threshold1=50.0, threshold2=50.0,
        bootstrap=size, global_limit=2 * size, local_limit=size,
    )
    maintainer = TopicMaintainer(spark, work_dir(spark, "bench"), config)
    timings = []
    for batch_id in range(BATCHES):
        start = time.perf_counter()
        maintainer.process(sliced.where(f"slice = {batch_id}"), batch_id)
        timings.append(time.perf_counter() - start)
    # the interval of the reference: 50 documents, on a stream that is under way
    start = time.perf_counter()
    maintainer.process(sliced.where(f"slice = {BATCHES - 1}").limit(50), BATCHES)
    small = time.perf_counter() - start
    registry = maintainer.store.registry(spark)
    refits = {r["batch_id"] for r in registry.where("kind <> 'compact'").collect()}
    plain = [t for i, t in enumerate(timings) if i not in refits]
    return {
        "stream_replay": sum(timings),
        "stream_refit_batch": max(t for i, t in enumerate(timings) if i in refits),
        "stream_plain_batch": statistics.median(plain) if plain else 0.0,
        "stream_50_documents": small,
        "stream_docs_per_sec": BATCHES * size / sum(timings),
    }


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            consume(catalog.QUERIES[name](spark, SF_DIR))
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    more = {}
    for name in MORE:
        start = time.perf_counter()
        consume(catalog.QUERIES[name](spark, SF_DIR))
        more[name] = round(time.perf_counter() - start, 3)
    stream = replay_stream(spark)
    seconds["stream_replay"] = round(stream.pop("stream_replay"), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "more": more,
                "stream": {k: round(v, 3) for k, v in stream.items()},
                "runs": RUNS,
                "cpus": CPUS,
                "machine": platform.machine(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
