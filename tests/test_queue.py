from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cribble.operators import backfill, discover, ingest, queue as q, reports
from cribble.schemas import QUEUE

T0, T1 = datetime(2026, 1, 1), datetime(2026, 2, 2)


def item(id, url=None, platform="youtube", status="DISCOVERED", at=T0, error=None, path=None, duration=None,
         reason=None, meta=None):
    return (id, url or f"http://u/{id}", platform, status, at, at, error, path, duration, reason, meta)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), QUEUE)


def by_id(df):
    return {r.id: r for r in df.collect()}


def candidates(spark, *rows):
    return spark.createDataFrame(
        [(u, "podcast", {"feed_url": f}, s, i) for u, f, s, i in rows],
        "url string, platform string, source_metadata map<string,string>, source_pos long, item_pos long")


def test_fetch_is_oldest_first(spark):
    df = table(spark, item(1, at=T1), item(3, at=T0), item(2, at=T0), item(4, status="SCREENED"), item(5, platform="tiktok"))
    assert [r.id for r in q.fetch(df, "DISCOVERED").collect()] == [2, 3, 5, 1]
    assert [r.id for r in q.fetch(df, "DISCOVERED", "youtube", 2).collect()] == [2, 3]
    assert [r.id for r in q.next_batch(df, "DISCOVERED", "tiktok", 9).collect()] == [5]


def test_stored_empty_metadata_counts_as_stored(spark):
    df = table(spark, item(1, status="SCREENED"), item(2, status="SCREENED", meta={}), item(3, status="SCREENED", meta={"a": "b"}),
               item(4, platform="podcast"), item(5, platform="podcast_rss", meta={}))
    assert [r.id for r in q.with_metadata(df).collect()] == [2, 3]
    assert [r.id for r in q.with_metadata(df, limit=1).collect()] == [2]
    assert [r.id for r in q.needs_backfill(df).collect()] == [4]


def test_insert_if_absent(spark):
    df = table(spark, item(7, "http://old"))
    new = candidates(spark, ("http://b", "f2", 1, 0), ("http://a", "f1", 0, 5), ("http://old", "f", 0, 0),
                     ("http://b", "f0", 0, 9), ("http://b", "f9", 2, 0))
    grown = by_id(q.insert_if_absent(df, new, T1))
    assert sorted(grown) == [7, 8, 9]
    assert (grown[8].url, grown[8].status, grown[8].source_metadata) == ("http://a", "DISCOVERED", {"feed_url": "f1"})
    assert (grown[9].url, grown[9].source_metadata, grown[9].discovered_at) == ("http://b", {"feed_url": "f0"}, T1)
    again = q.insert_if_absent(q.insert_if_absent(df, new, T1), new, T1)
    assert again.count() == 3
    flags = q.flag_inserted(df, new).where("inserted").collect()
    assert sorted((r.url, r.source_pos, r.item_pos) for r in flags) == [("http://a", 0, 5), ("http://b", 0, 9)]
    assert tuple(discover.discovered_report(df, new).first()) == (3, 2)


def test_insert_into_an_empty_queue(spark):
    grown = q.insert_if_absent(table(spark), candidates(spark, ("http://a", "f", 0, 0)), T1).collect()
    assert [r.id for r in grown] == [1]
    assert q.insert_if_absent(table(spark), candidates(spark), T1).count() == 0


def test_transition_clears_the_message_and_keeps_rows(spark):
    df = table(spark, item(1, error="old"), item(2, error="keep"), item(3))
    updates = spark.createDataFrame([(1, "SCREENED", None), (3, "ERROR_SCREEN", "boom"), (99, "X", "x")],
                                    "id long, status string, error_msg string")
    out = by_id(q.transition(df, updates, T1))
    assert sorted(out) == [1, 2, 3]
    assert (out[1].status, out[1].error_msg, out[1].last_update_at) == ("SCREENED", None, T1)
    assert (out[2].status, out[2].error_msg, out[2].last_update_at) == ("DISCOVERED", "keep", T0)
    assert out[3].error_msg == "boom"
    assert by_id(q.transition(df, updates.select("id", "status"), T1))[3].error_msg is None


def test_two_updates_for_one_id_fail(spark):
    updates = spark.createDataFrame([(1, "A"), (1, "B")], "id long, status string")
    with pytest.raises(PySparkException, match="more than one update for id 1"):
        q.transition(table(spark, item(1)), updates, T1).collect()


def test_mark_downloaded_and_rejected_and_metadata(spark):
    df = table(spark, item(1, error="old"), item(2, error="old"), item(3, error="old"))
    done = by_id(q.mark_downloaded(df, spark.createDataFrame([(1, "p.mp3", 12.9)], "id long, audio_path string, duration_seconds double"), T1))
    assert (done[1].status, done[1].audio_path, done[1].duration_seconds, done[1].error_msg) == ("DOWNLOADED", "p.mp3", 12, None)
    kind = QUEUE["rejection_reason"].dataType
    reason = df.where("id = 2").select("id", F.from_json(F.lit('{"model_probability": 0.25}'), kind).alias("rejection_reason"))
    rejected = by_id(q.mark_rejected(df, reason, T1))
    assert (rejected[2].status, rejected[2].error_msg, rejected[2].rejection_reason.model_probability) == ("REJECTED", "old", 0.25)
    meta = df.where("id = 3").select("id", F.create_map(F.lit("k"), F.lit("v")).alias("source_metadata"))
    changed = by_id(q.set_metadata(df, meta, T1))
    assert (changed[3].status, changed[3].source_metadata, changed[3].last_update_at) == ("DISCOVERED", {"k": "v"}, T1)
    assert changed[1].last_update_at == T0


def test_resets(spark):
    df = table(spark, item(1, status="REJECTED", error="e"), item(2, status="WEAK_POSITIVE"), item(3, status="SCREENED_NO_LABEL"),
               item(4, platform="podcast", status="DOWNLOADED", path="p", duration=3, error="e"),
               item(5, platform="podcast", status="WEAK_NEGATIVE"), item(6, status="DOWNLOADED", path="p"))
    rescored = by_id(q.reset_for_rescoring(df))
    assert [rescored[i].status for i in range(1, 7)] == ["SCREENED", "SCREENED", "SCREENED_NO_LABEL", "DOWNLOADED", "SCREENED", "DOWNLOADED"]
    assert rescored[1].error_msg == "e" and rescored[1].last_update_at == T0
    weak = by_id(q.reset_weak_labels(df))
    assert [weak[i].status for i in (2, 3, 5)] == ["SCREENED", "SCREENED", "WEAK_NEGATIVE"]
    downs = by_id(q.reset_downloads(df, T1))
    assert (downs[4].status, downs[4].audio_path, downs[4].duration_seconds, downs[4].error_msg, downs[4].last_update_at) == (
        "DISCOVERED", None, None, None, T1)
    assert downs[6].status == "DOWNLOADED"
    twice = q.reset_downloads(q.reset_downloads(df, T1), T1)
    assert by_id(twice) == downs


def test_retry_takes_lowest_ids(spark):
    df = table(spark, *[item(i, status="ERROR_DOWNLOAD", error="e", meta={} if i % 2 else None) for i in (9, 3, 4, 5, 1)])
    assert q.count_retryable(df).first().n == 4
    out = by_id(q.retry_errors(df, T1, limit=2))
    assert sorted(i for i, r in out.items() if r.status == "DISCOVERED") == [1, 3]
    assert sum(r.status == "DISCOVERED" for r in by_id(q.retry_errors(df, T1)).values()) == 4
    assert q.retry_errors(df.where("id = 4"), T1, limit=2).first().status == "ERROR_DOWNLOAD"


def test_fold_transitions(spark):
    log = spark.createDataFrame([(1, T0, 1, "A"), (1, T1, 1, "B"), (1, T1, 2, None), (2, T0, 1, "C")],
                                "id long, ts timestamp, seq int, status string")
    assert {r.id: r.status for r in q.fold_transitions(log).collect()} == {1: None, 2: "C"}


def test_status_summary_hides_statuses_outside_the_domain(spark):
    df = table(spark, item(1), item(2, status="SKIPPED_LENGTH"), item(3, status="SCREENED", platform=""),
               item(4, status="SCREENED", platform=None))
    rows = reports.status_summary(df).orderBy("pos").collect()
    assert [r.status for r in rows][-1] == "TOTAL" and rows[-1].n == 3 and len(rows) == 12
    assert {r.status: r.n for r in rows}["WEAK_POSITIVE"] == 0
    assert [tuple(r) for r in reports.platform_summary(df).collect()] == [("UNKNOWN", 2), ("youtube", 1)]


def test_stage_counts(spark):
    df = table(spark, item(1), item(2, meta={}), item(3, status="SCREENED"), item(4, platform="tiktok"))
    assert [tuple(r) for r in reports.stage_counts(df).collect()] == [("TOTAL", 3, 1), ("DISCOVERED", 2, 1), ("SCREENED", 1, 0)]


def probes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, ok boolean, audio_path string, duration double, error string")


def test_route_first_rule_wins(spark):
    df = table(
        spark, item(1, "https://x.buzzsprout.com/shorts/1"), item(2, "https://y/shorts/2"), item(3, platform="instagram"),
        item(4), item(5), item(6, platform="podcast"), item(7), item(8, "https://y/shorts/8", platform="tiktok"), item(9),
        item(10, platform=None))
    p = probes(spark, (1, True, "a", 50.0, None), (2, True, "a", 50.0, None), (4, False, None, None, "no net"), (5, True, "a", 5.0, None),
               (6, True, "a", 1201.0, None), (7, True, "p7", 6.0, None), (8, True, "p8", 1300.0, None))
    out = by_id(ingest.route_ingest(df.select("id", "url", "platform"), p))
    assert {i: (r.status, r.error_msg) for i, r in out.items()} == {
        1: ("REJECTED", "host-blocked (buzzsprout)"), 2: ("REJECTED", "youtube_short_skipped"),
        3: ("UNSUPPORTED_PLATFORM", "Unsupported platform: instagram"), 4: ("ERROR_DOWNLOAD", "no net"), 5: ("SKIPPED_LENGTH", None),
        6: ("ERROR_DOWNLOAD", "Podcast too long (1201.0s > 1200s)"), 7: ("DOWNLOADED", None), 8: ("DOWNLOADED", None),
        10: ("UNSUPPORTED_PLATFORM", "Unsupported platform: None")}
    assert (out[7].audio_path, out[7].duration_seconds, out[8].duration_seconds) == ("p7", 6, 1200)
    assert out[1].reject_stage == "gate" and out[5].audio_path is None
    applied = by_id(ingest.apply_routing(df, ingest.route_ingest(df.select("id", "url", "platform"), p), T1))
    assert len(applied) == 10 and applied[9].status == "DISCOVERED" and applied[7].audio_path == "p7"


def test_caps_and_first_seen(spark):
    rows = spark.createDataFrame([("a", 0, i, f"u{i % 3}") for i in range(6)] + [("b", 1, 0, "u0")],
                                 "source string, source_pos long, item_pos long, url string")
    assert discover.cap_per_source(rows, 2).count() == 3
    assert {(r.url, r.item_pos) for r in discover.first_seen(rows).collect()} == {("u0", 0), ("u1", 1), ("u2", 2)}
    kept = discover.cap_groups(rows, 1, "source").select("source").distinct().collect()
    assert [r.source for r in kept] == ["a"]


def test_merge_attributes_last_wins(spark):
    rows = spark.createDataFrame(
        [("v", "t1", None, 0, 0), ("v", "t2", None, 1, 0), ("v", None, "u1", 2, 0), ("w", None, "u1", 2, 1)],
        "url string, hashtag string, user string, source_pos long, item_pos long")
    out = {r.url: r for r in discover.merge_attributes(rows).collect()}
    assert out["v"].source_metadata == {"hashtag": "t2", "user": "u1"} and out["v"].source_pos == 0
    assert out["w"].source_metadata == {"user": "u1"}


def test_backfill_last_feed_wins(spark):
    entries = spark.createDataFrame([("http://u/1", {"feed_url": "a"}, 0, 0), ("http://u/1", {"feed_url": "b"}, 1, 0), ("http://u/3", {}, 0, 1)],
                                    "url string, meta map<string,string>, source_pos long, item_pos long")
    df = table(spark, item(1, platform="podcast"), item(2, platform="podcast"), item(3, platform="podcast_rss"),
               item(4, "http://u/1", platform="podcast", meta={}), item(5, "http://u/1"))
    filled = backfill.backfill_metadata(df, backfill.url_metadata(entries))
    assert {r.id: (r.matched, r.source_metadata) for r in filled.collect()} == {
        1: (True, {"feed_url": "b"}), 2: (False, None), 3: (False, None)}
    assert tuple(backfill.backfill_report(filled).first()) == (1, 2)
    after = q.set_metadata(df, filled.where("matched").select("id", "source_metadata"), T1)
    assert by_id(after)[1].source_metadata == {"feed_url": "b"}
