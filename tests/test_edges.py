"""Inputs that the registered queries do not hold: caps, restarts, nulls, large positions."""

import json
import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cribble.functions import media
from cribble.operators.evaluate import roc_auc
from cribble.operators.features import attach_embeddings
from cribble.operators.queue import apply_conversions, new_items
from cribble.operators.ranking import number_rows
from cribble.plans.stages import discover_feed_episodes
from cribble.schemas import QUEUE
from cribble.settings import Caps, Settings
from cribble.sources import dumps
from cribble.sources.tables import clear_materialized, materialize, read_lexicons, scratch_path
from cribble.streaming.dedup import dedup_ingest
from cribble.streaming.drain import drain, read_drained

NOW = datetime(2026, 1, 1)


def test_readers_cut_nothing_by_default(spark):
    page = json.dumps({"entries": [{"url": f"https://www.tiktok.com/{i}"} for i in range(80)]})
    found = json.dumps({"items": [{"id": {"videoId": f"v{i}", "channelId": f"c{i}"}, "snippet": {
        "title": "t", "channelId": "c", "resourceId": {"videoId": f"v{i}"}}} for i in range(50)]})
    df = spark.createDataFrame([(0, page, found)], "source_pos int, json string, found string")
    assert dumps.playlist_entries(df).count() == 80 and dumps.playlist_entries(df, n=50).count() == 50
    for read in (dumps.video_search_results, dumps.channel_search_results, dumps.upload_results):
        assert read(df, "found").count() == 50


def test_feed_listed_twice_keeps_its_episodes(spark):
    rows = [("f", s, i, term, [{"href": f"http://a/{i}"}]) for s, term in ((4, "x"), (9, "y")) for i in range(3)]
    items = spark.createDataFrame(rows, "feed_url string, source_pos long, item_pos long, search_term string, enclosures array<struct<href:string>>")
    queue = spark.createDataFrame([], QUEUE)
    got = discover_feed_episodes(queue, items, NOW, Settings(caps=Caps(episodes_per_feed=3)), searched=True).collect()
    assert sorted((r.id, r.url) for r in got) == [(i + 1, f"http://a/{i}") for i in range(3)]
    assert {r.source_metadata["search_term"] for r in got} == {"x"}


def test_positions_of_any_size(spark):
    rows = [("late", 3_000_000_000, 0), ("second", 0, 5_000_000_000), ("first", 0, 1), ("third", 1, 0)]
    found = spark.createDataFrame(rows, "url string, source_pos long, item_pos long").select(
        "*", F.lit("youtube").alias("platform"), F.create_map(F.lit("a"), F.lit("b")).alias("source_metadata"))
    got = new_items(spark.createDataFrame([], QUEUE), found, NOW).orderBy("id").collect()
    assert [(r.id, r.url, r.status) for r in got] == [(1, "first", "DISCOVERED"), (2, "second", "DISCOVERED"), (3, "third", "DISCOVERED"), (4, "late", "DISCOVERED")]


def test_loaded_items_enter_as_downloaded(spark):
    found = spark.createDataFrame([("u", 0, 0, "p.wav", 12.9)], "url string, source_pos long, item_pos long, audio_path string, duration_seconds double").select(
        "*", F.lit("adi17").alias("platform"), F.create_map(F.lit("a"), F.lit("b")).alias("source_metadata"))
    row = new_items(spark.createDataFrame([], QUEUE), found, NOW).first()
    assert (row.status, row.audio_path, row.duration_seconds) == ("DOWNLOADED", "p.wav", 12)
    queue = new_items(spark.createDataFrame([], QUEUE), found, NOW)
    new = apply_conversions(queue, spark.createDataFrame([(1, "p.flac")], "id long, audio_path string")).first()
    assert new.audio_path == "p.flac" and new.asDict() | {"audio_path": "p.wav"} == row.asDict()


def test_numbers_are_dense(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b")).repartition(5)
    got = number_rows(df, ["a", "b"], "n").collect()
    assert [r.n for r in sorted(got)] == list(range(5000))
    assert number_rows(df.limit(0), ["a", "b"], "n").count() == 0


def _urls(spark, path, *urls):
    spark.createDataFrame([(u, 0, i) for i, u in enumerate(urls)], "url string, source_pos long, item_pos long").write.parquet(str(path))
    return "url string, source_pos long, item_pos long"


def test_streams_keep_what_older_checkpoints_wrote(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(_urls(spark, tmp_path / "a", "u1", "u2"))
    _urls(spark, tmp_path / "b", "u3", "u2")
    for name in ("a", "b"):
        dedup_ingest(spark, str(tmp_path / name), schema, str(tmp_path / "store"), str(tmp_path / f"ck-{name}"))
        dedup_ingest(spark, str(tmp_path / name), schema, str(tmp_path / "store"), str(tmp_path / f"ck-{name}"))
        drain(spark, str(tmp_path / name), schema, lambda b: b.select("url"), str(tmp_path / "out"), str(tmp_path / f"dk-{name}"))
    assert sorted(r.url for r in read_drained(spark, str(tmp_path / "store")).collect()) == ["u1", "u2", "u3"]
    assert sorted(r.url for r in read_drained(spark, str(tmp_path / "out")).collect()) == ["u1", "u2", "u2", "u3"]


def test_scores_without_a_rank_are_left_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 1), (math.nan, 0)], "score double, label int")
    row = roc_auc(df).first()
    assert (row.auc, row.positives, row.negatives, row.unscored) == (1.0, 1, 1, 2)


@pytest.mark.parametrize("duration", [None, math.nan])
def test_missing_duration(spark, duration):
    df = spark.createDataFrame([(1, "podcast", duration)], "id long, p string, d double")
    row = df.select(media.duration_gate("p", "d").alias("g"), media.chunk_plan("id", "d").alias("c")).first()
    assert row.g.status == "ERROR_DOWNLOAD" and row.g.error_msg == "No duration" and row.g.duration_seconds is None
    assert row.c is None


def test_lexicon_file_of_a_standard_writer(spark, tmp_path):
    import csv

    path = tmp_path / "terms.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([["lexicon", "term"], ["lb", 'say "hi", you'], ["lb", ""], ["lb", " x "]])
    assert sorted(r.term for r in read_lexicons(spark, str(path)).collect()) == ["", " x ", 'say "hi", you']


def test_scratch_is_shared_and_removed(spark, monkeypatch):
    import os

    kept = materialize(spark.range(3), "edge")
    path = kept.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and clear_materialized(spark) >= 1 and not os.path.exists(path)

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Cluster, "x")


def test_text_stays_out_of_the_embedding_join(spark):
    items = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, embedding array<double>")
    joined = attach_embeddings(items.hint("merge"), vectors, 1).select("id", "embedding")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    deals = [x for x in plan.splitlines() if "Exchange hashpartitioning(id" in x]
    below = plan[plan.index(deals[0]):plan.index(deals[1])]
    assert re.search(r"Generate explode\(.*\), \[id#\d+L\], false, \[_blank#\d+\]", below), below
    assert {r.id: r.embedding for r in joined.collect()} == {1: [1.0], 2: [0.0], 3: [0.0]}
