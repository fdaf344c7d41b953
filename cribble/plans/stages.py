"""The stages a run goes through, each one lazy plan from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.lexicon import Lexicons
from cribble.functions.meta import channel_feed_meta, episode_meta, search_meta
from cribble.functions.text import transcript_text
from cribble.functions.urls import pick_audio_url, pick_first_enclosure, video_url
from cribble.operators.discover import POSITION, cap_per_source, merge_attributes
from cribble.operators.evaluate import (
    join_truth,
    probability_profile,
    threshold_sweep,
    tier_precision,
    truth_distribution,
)
from cribble.operators.features import add_features, score_texts
from cribble.operators.files import usable_audio
from cribble.operators.labels import (
    attach_transcripts,
    classify_by_source,
    lexical_negative,
    require_rows,
    training_set,
)
from cribble.operators.model import Classifier, apply_scores, evaluate, train_classifier
from cribble.operators.once import compute_once
from cribble.operators.queue import fetch, insert_if_absent
from cribble.operators.ranking import broadcast_if_small
from cribble.sources.tables import materialize
from cribble.operators.sampling import (
    latest_annotation,
    shuffle_sample,
    stratified_sample,
    stratified_split,
)

Embed = Callable[[DataFrame], DataFrame]


def _stamp(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def discover_feed_episodes(
    queue: DataFrame, items: DataFrame, now, settings: S.Settings = S.Settings(),
    searched: bool = False,
) -> DataFrame:
    """Queue with the episodes of parsed feeds.

    Feeds found by search take the first enclosure of their first entries
    (``search_term`` column), from the first place that lists the feed;
    configured feeds take the first audio URL.
    """
    if searched:
        first = items.groupBy("feed_url").agg(F.min("source_pos").alias("_first"))
        items = items.join(first, "feed_url").where(F.col("source_pos") == F.col("_first")).drop("_first")
        capped = cap_per_source(items, settings.caps.episodes_per_feed, "feed_url")
        url = pick_first_enclosure("enclosures")
        meta, platform = episode_meta("feed_url", "search_term"), "podcast_rss"
    else:
        capped, url = items, pick_audio_url("enclosures", "links")
        meta, platform = episode_meta("feed_url"), "podcast"
    candidates = compute_once(capped, "url", url).select(
        "url", F.lit(platform).alias("platform"), meta.alias("source_metadata"),
        "source_pos", "item_pos",
    ).where(F.col("url").isNotNull())
    return insert_if_absent(queue, candidates, now)


def _in_turn(*parts: DataFrame) -> DataFrame:
    """All parts, the places of each before those of the next."""
    placed = [p.withColumn("source_pos", F.struct(F.lit(i).alias("part"), F.col("source_pos").cast("long").alias("pos")))
              for i, p in enumerate(parts)]
    whole = placed[0]
    for p in placed[1:]:
        whole = whole.unionByName(p)
    return whole


def discover_videos(
    queue: DataFrame, searched: DataFrame, uploads: DataFrame, channel_feeds: DataFrame, now,
) -> DataFrame:
    """Queue with videos found by search, in channels' uploads and in channels' feeds.

    ``searched(video_id, channel, query, source_pos, item_pos)``,
    ``uploads(video_id, channel, source_pos, item_pos)``, ``channel_feeds(url,
    channel_id, source_pos, item_pos)``; places count in this order.
    """
    none = F.lit(None).cast("string")
    candidates = _in_turn(
        searched.select(video_url("video_id").alias("url"), search_meta("channel", "query").alias("source_metadata"), *POSITION),
        uploads.select(video_url("video_id").alias("url"), search_meta("channel", none).alias("source_metadata"), *POSITION),
        channel_feeds.select("url", channel_feed_meta("channel_id").alias("source_metadata"), *POSITION),
    ).withColumn("platform", F.lit("youtube"))
    return insert_if_absent(queue, candidates, now)


def discover_clips(queue: DataFrame, by_tag: DataFrame, by_user: DataFrame, now) -> DataFrame:
    """Queue with short clips listed under tags and users: ``(url, tag | user, source_pos, item_pos)``.

    A clip found in several places keeps its last tag and its last user.
    """
    none = F.lit(None).cast("string")
    found = _in_turn(
        by_tag.select("url", F.col("tag").alias("hashtag"), none.alias("user"), *POSITION),
        by_user.select("url", none.alias("hashtag"), "user", *POSITION),
    )
    return insert_if_absent(queue, merge_attributes(found).withColumn("platform", F.lit("tiktok")), now)


def label_screened(
    queue: DataFrame, trusted: DataFrame, transcripts: DataFrame, lexicons: Lexicons, now,
    settings: S.Settings = S.Settings(), unlabelled_status: str = S.SCREENED_NO_LABEL,
) -> DataFrame:
    """Metadata labels first, lexical negatives over what is still SCREENED.

    Only SCREENED rows take part; the rest pass by untouched. They carry their
    columns along, so nothing is joined back to the queue.
    """
    rest = queue.where(~F.col("status").eqNullSafe(S.SCREENED))
    waiting = queue.where(F.col("status") == S.SCREENED)
    labelled = classify_by_source(waiting, trusted, out="_label").withColumn(
        "_by_source",
        F.when(F.col("source_metadata").isNotNull(),
               F.coalesce("_label", F.lit(unlabelled_status))),
    )
    settled = F.coalesce(F.col("_by_source") != S.SCREENED, F.lit(False))
    samples = transcripts.select("id", "screening_samples")
    # Settled rows are past scoring: without samples they cost the scorer nothing.
    joined = labelled.join(samples, "id", "left").withColumn(
        "screening_samples", F.when(~settled, F.col("screening_samples"))
    )
    judged = lexical_negative(joined, lexicons, settings.weights, settings.thresholds)
    status = F.when(settled, F.col("_by_source")).when(
        F.col("outcome") == S.WEAK_NEGATIVE, F.col("outcome")
    )
    done = judged.withColumns({
        "status": F.coalesce(status, F.lit(S.SCREENED)),
        "error_msg": F.when(status.isNull(), F.col("error_msg")),
        "last_update_at": F.when(status.isNull(), F.col("last_update_at")).otherwise(_stamp(now)),
    })
    return rest.unionByName(done.select(*queue.columns))


def featurize(
    items: DataFrame, transcripts: DataFrame, lexicons: Lexicons, embed: Embed,
    on_missing: str = "drop", settings: S.Settings = S.Settings(),
) -> DataFrame:
    """Items with text, diagnostics and features."""
    texts = transcripts.select("id", transcript_text("screening_samples").alias("text"))
    joined = attach_transcripts(items, texts, on_missing)
    return add_features(score_texts(joined, lexicons, "text", settings.weights), embed)


def score_items(
    queue: DataFrame, transcripts: DataFrame, lexicons: Lexicons, embed: Embed,
    model: Classifier, now, settings: S.Settings = S.Settings(),
    limit: int | None = None,
) -> DataFrame:
    """Queue with all SCREENED items (or the oldest ``limit``) scored into tiers.

    Scored rows carry their queue columns, so they are not joined back.
    """
    if limit is None:
        waiting = queue.where(F.col("status") == S.SCREENED)
        rest = queue.where(~F.col("status").eqNullSafe(S.SCREENED))
    else:
        waiting = fetch(queue, S.SCREENED, limit=limit)
        rest = queue.join(broadcast_if_small(waiting.select("id")), "id", "left_anti")
    ready = featurize(waiting, transcripts, lexicons, embed, "skip", settings)
    scored = apply_scores(ready, model, now, settings.thresholds)
    return rest.unionByName(scored.select(*queue.columns))


def train(
    queue: DataFrame, transcripts: DataFrame, lexicons: Lexicons, embed: Embed,
    settings: S.Settings = S.Settings(), include_rejected: bool = True,
):
    """``(model, report, auc)`` from the weak labels with a stratified hold-out.

    The feature rows are written to the shared folder for the passes of the
    split, the training and the two reports; ``clear_materialized`` removes them.
    """
    labelled = [S.WEAK_POSITIVE, S.WEAK_NEGATIVE, S.REJECTED]
    items = queue.where(F.col("status").isin(*labelled)).select("id", "status")
    ready = featurize(items, transcripts, lexicons, embed, "drop", settings)
    rows = training_set(ready, settings.thresholds, include_rejected, check_size=False)
    kept = materialize(rows.select("id", "label", "features"), "training")
    require_rows(kept, settings.thresholds.min_training_rows)
    split = stratified_split(kept, fraction=settings.thresholds.holdout_fraction)
    model = train_classifier(split.where(~F.col("holdout")))
    report, auc = evaluate(split.where("holdout"), model)
    return model, report, auc


def annotation_sample(
    queue: DataFrame, listing: DataFrame | None = None, strata=S.SAMPLE_STRATA,
    seed: int = S.SEED,
) -> DataFrame:
    """Shuffled stratified sample of items whose audio can be played."""
    ready = usable_audio(queue, listing).select("id", "url", "platform", "audio_path", "status")
    picked = stratified_sample(ready, strata, seed)
    return shuffle_sample(picked, seed).withColumnRenamed("status", "source_status")


def evaluate_tiers(predictions: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """All ground-truth tables of ``predictions(id, status, probability)``."""
    truth = latest_annotation(annotations).where(F.col("ground_truth") != S.SKIP_TRUTH)
    joined = join_truth(predictions, truth)
    return {
        "truth_distribution": truth_distribution(joined),
        "tier_precision": tier_precision(joined),
        "threshold_sweep": threshold_sweep(joined),
        "probability_profile": probability_profile(joined),
    }
