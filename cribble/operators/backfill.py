"""Filling in metadata that items were stored without."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble import settings as S


def url_metadata(entries: DataFrame, url: str = "url", meta: str = "meta") -> DataFrame:
    """One metadata map per URL; of several feeds listing it the last one wins."""
    return entries.where(F.col(url).isNotNull()).groupBy(url).agg(
        F.max_by(meta, F.struct("source_pos", "item_pos")).alias(meta)
    )


def backfill_metadata(
    queue: DataFrame, url_meta: DataFrame, platforms: Sequence[str] = S.PODCAST_PLATFORMS,
    meta: str = "meta",
) -> DataFrame:
    """Items of the platforms that lack metadata, with ``matched`` and the new ``source_metadata``.

    Feed the matched rows to ``queue.set_metadata``.
    """
    todo = queue.where(
        F.col("platform").isin(*platforms) & F.col("source_metadata").isNull()
    ).select("id", "url")
    usable = url_meta.where(F.size(F.map_keys(meta)) > 0).select(
        "url", F.col(meta).alias("source_metadata")
    )
    return todo.join(usable, "url", "left").select(
        "id", "url", F.col("source_metadata").isNotNull().alias("matched"), "source_metadata"
    )


def backfill_report(filled: DataFrame) -> DataFrame:
    return filled.agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")
    )
