"""Configured source lists as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cribble.schemas import TRUSTED_SOURCE
from cribble.settings import SourceLists


def read_source_lists(
    spark: SparkSession, lists: SourceLists, fall_back: bool = True
) -> DataFrame:
    """``trusted_sources(kind, value, polarity)``.

    Each positive list that is empty falls back to its platform list;
    negative lists never do.
    """
    def positive(trusted: tuple[str, ...], platform: tuple[str, ...]) -> tuple[str, ...]:
        return trusted or (platform if fall_back else ())

    parts = [
        ("channel", "positive", positive(lists.trusted_positive_channels, lists.channels)),
        ("feed", "positive", positive(lists.trusted_positive_feeds, lists.feeds)),
        ("user", "positive", positive(lists.trusted_positive_users, lists.users)),
        ("channel", "negative", lists.trusted_negative_channels),
        ("feed", "negative", lists.trusted_negative_feeds),
        ("user", "negative", lists.trusted_negative_users),
    ]
    rows = [(kind, value, polarity) for kind, polarity, values in parts for value in values]
    return spark.createDataFrame(rows, TRUSTED_SOURCE).distinct()


def used_fall_back(lists: SourceLists) -> dict[str, bool]:
    """Which kinds take their positives from the platform lists."""
    return {
        "channel": not lists.trusted_positive_channels,
        "feed": not lists.trusted_positive_feeds,
        "user": not lists.trusted_positive_users,
    }
