from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.lexicon import Lexicons
from cribble.operators.features import embed_text, fit_embedder
from cribble.plans import stages
from cribble.schemas import QUEUE, TRANSCRIPT
from cribble.sources.source_lists import read_source_lists

NOW = datetime(2026, 5, 5)
OLD = datetime(2026, 1, 1)
LEX = Lexicons.from_lists({
    "lb": ["hello", "friend"], "msa": ["formal"], "egy": ["nile"], "gulf": ["pearl"], "sy": ["barada"], "strong_lb_hits": ["hello"]})


@pytest.fixture(scope="module")
def world(spark):
    """240 items in every status with transcripts for most of them."""
    statuses = ["SCREENED", "WEAK_POSITIVE", "WEAK_NEGATIVE", "REJECTED", "SCREENED", "DISCOVERED"]
    rows, docs = [], []
    for i in range(240):
        status = statuses[i % 6]
        meta = [None, {}, {"channel_id": "good"}, {"channel_id": "bad"}, {"channel_id": "other"}][i % 5]
        rows.append((i, f"http://u/{i}", "youtube", status, OLD, OLD, "old", f"a/{i}.wav", 60, None, meta))
        positive = status == "WEAK_POSITIVE" or i % 7 == 0
        text = ("hello friend " if positive else "formal nile ") + ("pearl " if i % 11 == 0 else "") + f"w{i % 4}"
        if i % 10 != 9:
            docs.append((i, f"http://u/{i}", "youtube", [("c", "ar", 0.9 if i % 8 else 0.2, text, [])]))
    return (spark.createDataFrame(rows, QUEUE).cache(), spark.createDataFrame(docs, TRANSCRIPT).cache())


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_label_screened(spark, world):
    queue, transcripts = world
    trusted = read_source_lists(spark, S.SourceLists(trusted_positive_channels=("good",), trusted_negative_channels=("bad",)))
    before, after = by_id(queue), by_id(stages.label_screened(queue, trusted, transcripts, LEX, NOW))
    assert sorted(before) == sorted(after)
    for i, old in before.items():
        new = after[i]
        if old.status != "SCREENED":
            assert new == old
            continue
        meta = old.source_metadata
        if meta is not None:
            expected = {"good": "WEAK_POSITIVE", "bad": "WEAK_NEGATIVE"}.get(meta.get("channel_id"), "SCREENED_NO_LABEL")
        else:
            negative = i % 10 != 9 and i % 8 != 0 and i % 7 != 0
            expected = "WEAK_NEGATIVE" if negative else "SCREENED"
        assert new.status == expected, i
        changed = expected != "SCREENED"
        assert (new.error_msg, new.last_update_at) == ((None, NOW) if changed else ("old", OLD))
    again = by_id(stages.label_screened(stages.label_screened(queue, trusted, transcripts, LEX, NOW), trusted, transcripts, LEX, NOW))
    assert again == after


def test_unlabelled_items_can_stay_for_the_lexical_pass(spark, world):
    queue, transcripts = world
    trusted = read_source_lists(spark, S.SourceLists(trusted_positive_channels=("good",)))
    kept = stages.label_screened(queue, trusted, transcripts, LEX, NOW, unlabelled_status="SCREENED")
    assert kept.where("status = 'SCREENED_NO_LABEL'").count() == 0
    assert by_id(kept)[4].status == "WEAK_NEGATIVE"


def test_train_then_score(spark, world):
    queue, transcripts = world
    texts = transcripts.select(F.col("screening_samples")[0]["text"].alias("text"))
    embedder = fit_embedder(texts, 8)
    embed = lambda df: embed_text(df, embedder)
    model, report, auc = stages.train(queue, transcripts, LEX, embed)
    assert auc.first().auc > 0.9
    assert {r["class"] for r in report.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    scored = by_id(stages.score_items(queue, transcripts, LEX, embed, model, NOW))
    before = by_id(queue)
    assert sorted(scored) == sorted(before)
    for i, old in before.items():
        new = scored[i]
        if old.status != "SCREENED":
            assert new == old
        elif i % 10 == 9:
            assert (new.status, new.error_msg, new.rejection_reason) == ("ERROR_SCORING", "Missing transcript", None)
        else:
            assert new.status in ("POTENTIAL_LB", "BORDERLINE_LB", "REJECTED") and new.last_update_at == NOW
            assert (new.error_msg == "old") == (new.status == "REJECTED")
            assert (new.rejection_reason is not None) == (new.status == "REJECTED")
            if new.rejection_reason:
                assert new.rejection_reason.model_probability < 0.5
                assert new.rejection_reason.diagnostics.lexicon_details.msa == 1
    holes = lambda df: embed(df).withColumn("embedding", F.when(F.col("id") != 0, F.col("embedding")))
    broken = by_id(stages.score_items(queue, transcripts, LEX, holes, model, NOW))
    assert (broken[0].status, broken[0].error_msg) == ("ERROR_SCORING", "Missing features")
    assert {i for i in broken if broken[i] != scored[i]} == {0}
    few = by_id(stages.score_items(queue, transcripts, LEX, embed, model, NOW, limit=20))
    changed = [i for i in few if few[i].status != before[i].status]
    assert changed == sorted(i for i, r in before.items() if r.status == "SCREENED")[:20]


def test_sample_then_evaluate(spark, world):
    queue, _ = world
    strata = {"WEAK_POSITIVE": 10, "REJECTED": 10}
    sample = stages.annotation_sample(queue, strata=strata).collect()
    assert sorted(r.source_status for r in sample) == ["REJECTED"] * 10 + ["WEAK_POSITIVE"] * 10
    notes = spark.createDataFrame(
        [(r.id, "lebanese" if r.source_status == "WEAK_POSITIVE" else "not_lebanese", "t", k) for k, r in enumerate(sample)]
        + [(sample[0].id, "skip", "u", 99)], "item_id long, ground_truth string, timestamp string, seq int")
    predictions = queue.select("id", "status", F.when(F.col("status") == "REJECTED", 0.1).otherwise(0.8).alias("probability"))
    out = stages.evaluate_tiers(predictions, notes)
    assert sum(r.n for r in out["truth_distribution"].collect()) == 19
    assert {r.status: r.precision for r in out["tier_precision"].collect()} == {"WEAK_POSITIVE": 1.0, "REJECTED": 0.0}
    assert {r.threshold: r.f1 for r in out["threshold_sweep"].collect()}[0.75] == 1.0


def test_searched_feeds_cap_entries_before_the_enclosure_test(spark):
    enc = "array<struct<url:string,href:string,type:string>>"
    rows = [("f", "term", 0, i, [] if i == 0 else [("u", f"http://e/{i}.pdf", "t")]) for i in range(4)]
    items = spark.createDataFrame(rows, f"feed_url string, search_term string, source_pos long, item_pos long, enclosures {enc}").withColumn(
        "links", F.array().cast("array<struct<href:string>>"))
    limits = S.Settings(caps=S.Caps(episodes_per_feed=3))
    empty = spark.createDataFrame([], QUEUE)
    out = stages.discover_feed_episodes(empty, items, NOW, limits, searched=True).orderBy("id").collect()
    assert [(r.id, r.url, r.platform) for r in out] == [(1, "http://e/1.pdf", "podcast_rss"), (2, "http://e/2.pdf", "podcast_rss")]
    assert out[0].source_metadata == {"feed_url": "f", "search_term": "term"}
