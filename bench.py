"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tiers_by_source", "count_matches_builtin", "count_matches_arrow", "count_matches_large_lists",
    "lexicon_details", "lexicon_term_hits", "lexical_negatives", "training_set",
    "insert_if_absent", "transition", "fold_transitions", "status_summary", "stage_counts",
    "rss_items", "playlist_entries", "enqueue_feed_episodes", "route_ingest", "backfill_metadata",
    "merge_attributes", "first_seen", "cap_per_source", "cap_groups",
    "classify_by_source", "classify_by_source_table", "label_by_source",
    "quota_per_class", "stratified_sample", "stratified_split",
    "classification_report", "roc_auc_skewed", "tier_precision", "threshold_sweep",
    "value_profile", "feature_vectors", "classifier_weights", "scored_tiers",
    "drain_clicks", "dedup_stream", "distinct_url_stream",
    "lexicon_term_hits_by_join", "lexical_negatives_flat", "holdout_report", "text_embeddings",
    "count_phrases", "count_phrases_by_join", "top_of_large_classes", "hashed_embeddings", "drain_by_status",
    "labelled_queue", "scored_queue", "routed_queue", "enqueue_searched_episodes", "evaluated_tiers",
)


def session(cpus: str, shared: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_ONLY")
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = session(os.environ.get("BENCH_CPUS", "8"), shared.name)
    from cribble import catalog
    from cribble.sources.tables import clear_materialized

    registered = catalog.queries()
    times: dict[str, float] = {}
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    # Start-up of text scans and of Python workers is no query's own time.
    registered["count_matches_arrow"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        clear_materialized(spark)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
