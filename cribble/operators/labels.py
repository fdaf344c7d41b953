"""Weak labels from source metadata and from lexical evidence, and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.lexicon import Lexicons, lexicon_score
from cribble.functions.meta import json_field
from cribble.functions.text import language_gate, transcript_text
from cribble.functions.urls import normalize_feed
from cribble.operators.once import compute_once
from cribble.operators.ranking import broadcast_if_small

KIND_FIELDS = (("channel", "channel_id"), ("feed", "feed_url"), ("user", "user"))


def classify_by_source(
    items: DataFrame, trusted: DataFrame, meta: str = "source_metadata", out: str = "label"
) -> DataFrame:
    """Label items by channel, then feed, then user; no match falls through to the next key.

    ``trusted(kind, value, polarity)`` is reduced to one polarity per value
    (positive wins), so rows never multiply. Null where nothing matches.
    """
    value = F.when(F.col("kind") == "feed", normalize_feed("value")).otherwise(F.col("value"))
    dim = (
        trusted.select("kind", value.alias("value"), (F.col("polarity") == "positive").alias("p"))
        .where(F.col("value") != "")
        .groupBy("kind", "value").agg(F.bool_or("p").alias("p"))
    )
    dim = broadcast_if_small(dim)
    keyed = items
    for kind, field_name in KIND_FIELDS:
        key = json_field(meta, field_name)
        if kind == "feed":
            key = F.nullif(normalize_feed(key), F.lit(""))
        # Rows without the key match nothing; spread them in case this join shuffles.
        key = F.coalesce(key, F.concat(F.lit("\0"), F.spark_partition_id().cast("string")))
        side = dim.where(F.col("kind") == kind).select(
            F.col("value").alias(f"_v_{kind}"), F.col("p").alias(f"_p_{kind}")
        )
        keyed = keyed.withColumn(f"_k_{kind}", key).join(
            side, F.col(f"_k_{kind}") == F.col(f"_v_{kind}"), "left"
        )
    positive = F.coalesce(*[F.col(f"_p_{kind}") for kind, _ in KIND_FIELDS])
    label = F.when(positive, S.WEAK_POSITIVE).when(~positive, S.WEAK_NEGATIVE)
    return keyed.select(*items.columns, label.alias(out))


def label_by_source(
    queue: DataFrame, trusted: DataFrame, unlabelled_status: str = S.SCREENED_NO_LABEL
) -> DataFrame:
    """``updates(id, status)`` for screened items with metadata.

    Unmatched items leave SCREENED too, so later passes do not see them; give
    ``unlabelled_status="SCREENED"`` to keep them in.
    """
    picked = queue.where(
        (F.col("status") == S.SCREENED) & F.col("source_metadata").isNotNull()
    ).select("id", "source_metadata")
    return classify_by_source(picked, trusted).select(
        "id", F.coalesce("label", F.lit(unlabelled_status)).alias("status")
    )


def attach_transcripts(
    items: DataFrame, transcripts: DataFrame, on_missing: str = "skip", key: str = "id"
) -> DataFrame:
    """Join transcripts by id.

    ``drop`` keeps only items that have one. ``skip`` keeps all and sets
    ``missing``. ``error`` also fills ``status`` and ``error_msg`` of the missing.
    """
    if on_missing == "drop":
        return items.join(transcripts, key)
    joined = items.join(transcripts.withColumn("_found", F.lit(True)), key, "left")
    missing = F.col("_found").isNull()
    out = joined.withColumn("missing", missing)
    if on_missing == "error":
        values = {
            "status": F.when(missing, S.ERROR_SCORING).otherwise(
                F.col("status") if "status" in items.columns else F.lit(None)),
            "error_msg": F.when(missing, S.MISSING_TRANSCRIPT_MESSAGE).otherwise(
                F.col("error_msg") if "error_msg" in items.columns else F.lit(None)),
        }
        out = out.withColumns(values)
    elif on_missing != "skip":
        raise ValueError(f"unknown policy {on_missing!r}")
    return out.drop("_found")


def join_samples(
    samples: DataFrame, key: str = "id", order: str = "sample_idx", text: str = "text"
) -> DataFrame:
    """Transcript text per item from one row per sample, in sample order.

    One item's samples end up in one row because the joined text is one value;
    transcripts hold a handful of samples. Nested transcripts need no shuffle:
    use ``functions.text.transcript_text`` on the array instead.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))
    )
    return samples.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text")
    )


def language_means(
    samples: DataFrame, language: str, key: str = "id",
    language_col: str = "language", probability: str = "language_probability",
) -> DataFrame:
    """Mean probability of each item's samples in ``language``; null when it has none."""
    return samples.groupBy(key).agg(
        F.avg(
            F.when(F.col(language_col) == language, F.coalesce(probability, F.lit(0.0)))
        ).alias("confidence")
    )


def lexical_negative(
    items: DataFrame,
    lexicons: Lexicons,
    weights: S.LexiconWeights = S.LexiconWeights(),
    thresholds: S.Thresholds = S.Thresholds(),
    samples: str = "screening_samples",
    plan: str = "auto",
) -> DataFrame:
    """Add ``outcome``: WEAK_NEGATIVE or the first reason that rules it out.

    In order: ``no_transcript``, ``not_language``, ``score_not_negative``,
    ``no_signal``. Only texts that pass the language gate reach the scorer.
    """
    passed = language_gate(samples, thresholds.language, thresholds.min_language_probability)
    gated = items.withColumn("_pass", passed["passed"])
    text = F.when(F.col("_pass"), transcript_text(samples)).otherwise(F.lit(""))
    return _lexical_outcome(
        compute_once(gated, "_d", lexicon_score(text, lexicons, weights, plan)),
        F.col(samples).isNull(), F.col("_pass"),
    ).drop("_pass", "_d")


def lexical_negative_flat(
    items: DataFrame,
    lexicons: Lexicons,
    confidence: str = "confidence",
    text: str = "text",
    weights: S.LexiconWeights = S.LexiconWeights(),
    thresholds: S.Thresholds = S.Thresholds(),
    plan: str = "auto",
) -> DataFrame:
    """The same from an already joined text and mean language probability."""
    ok = F.coalesce(F.col(confidence) >= thresholds.min_language_probability, F.lit(False))
    shown = F.when(ok, F.col(text)).otherwise(F.lit(""))
    return _lexical_outcome(
        compute_once(items, "_d", lexicon_score(shown, lexicons, weights, plan)),
        F.col(text).isNull(), ok,
    ).drop("_d")


def _lexical_outcome(scored: DataFrame, missing: Column, passed: Column) -> DataFrame:
    d = F.col("_d")
    other = d["msa"] + d["egy"] + d["gulf"] + d["sy"]
    return scored.withColumn(
        "outcome",
        F.when(missing, "no_transcript")
        .when(~passed, "not_language")
        .when(d["raw_score"] >= 0, "score_not_negative")
        .when(other == 0, "no_signal")
        .otherwise(S.WEAK_NEGATIVE),
    )


def tier(
    probability: Column | str,
    potential: float = S.Thresholds.potential,
    borderline: float = S.Thresholds.borderline,
) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return (
        F.when(p >= potential, S.POTENTIAL).when(p >= borderline, S.BORDERLINE)
        .otherwise(S.REJECTED)
    )


def verified_positive(
    scored: DataFrame, k: int = S.Thresholds.min_strong_hits,
    hits: str = "diagnostics.lexicon_details.strong_lb_hits",
) -> DataFrame:
    return scored.where(F.col(hits) >= k)


def training_set(
    scored: DataFrame,
    thresholds: S.Thresholds = S.Thresholds(),
    include_rejected: bool = True,
    check_size: bool = True,
    hits: str = "diagnostics.lexicon_details.strong_lb_hits",
) -> DataFrame:
    """Items with ``label``: verified weak positives 1, weak negatives (and rejects) 0.

    ``scored`` has a transcript behind every row (inner join). One filter over
    one scan; raises when fewer than ``min_training_rows`` remain.
    """
    negatives = [S.WEAK_NEGATIVE] + ([S.REJECTED] if include_rejected else [])
    positive = (F.col("status") == S.WEAK_POSITIVE) & (
        F.col(hits) >= thresholds.min_strong_hits
    )
    rows = scored.where(positive | F.col("status").isin(*negatives)).withColumn(
        "label", (F.col("status") == S.WEAK_POSITIVE).cast("int")
    )
    if check_size:
        require_rows(rows, thresholds.min_training_rows)
    return rows


def require_rows(rows: DataFrame, need: int) -> None:
    """Fail on fewer than ``need`` rows; stops reading once there are enough."""
    if rows.limit(need).count() < need:
        raise ValueError("Not enough labeled data to train model.")
