"""From fetched listings to candidates: de-duplication, caps and merging.

Order matters here (first seen wins, last tag wins), so every row carries
``source_pos`` (rank of its source) and ``item_pos`` (rank within it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.meta import compact_map
from cribble.functions.urls import normalize_tag, platform_tag, useless_platform_tag, useless_token
from cribble.operators.queue import flag_inserted
from cribble.operators.ranking import broadcast_if_small, top_per_group

POSITION = ("source_pos", "item_pos")


def first_seen(
    rows: DataFrame, key: str = "url", position: Sequence[str] = POSITION
) -> DataFrame:
    """One row per key, the earliest. Map-side combine keeps a hot key cheap."""
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("r"))
        .select(key, "r.*").select(*rows.columns)
    )


def cap_per_source(
    rows: DataFrame, n: int, source: str = "source", position: str = "item_pos"
) -> DataFrame:
    """First ``n`` entries of each source, counted before any later filter."""
    return top_per_group(rows, [source], [F.col(position)], n, rank="_rank").drop("_rank")


def cap_groups(
    rows: DataFrame, n: int = S.Caps.max_feeds, group: str = "feed_url",
    position: Sequence[str] = POSITION,
) -> DataFrame:
    """Rows of the first ``n`` distinct groups by first appearance, over all sources."""
    kept = (
        rows.where(F.col(group).isNotNull() & (F.col(group).cast("string") != ""))
        .groupBy(group).agg(F.min(F.struct(*position)).alias("_first"))
        .orderBy("_first", group).limit(n).select(group)
    )
    return rows.join(broadcast_if_small(kept), group, "left_semi")


def union_discovery(*parts: DataFrame) -> DataFrame:
    """Concatenate discovery results in the given order, then keep the first of each URL."""
    ranked = [
        p.select("*", F.lit(i).alias("_part")) for i, p in enumerate(parts)
    ]
    whole = ranked[0]
    for p in ranked[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return first_seen(whole, "url", ("_part", *POSITION)).drop("_part")


def merge_attributes(rows: DataFrame, url: str = "url") -> DataFrame:
    """One row per URL with ``source_metadata`` of its last hashtag and last user.

    Keeps the first position of the URL. Rows carry ``hashtag`` or ``user``.
    """
    position = F.struct(*POSITION)

    def last(column: str) -> Column:
        return F.max_by(F.when(F.col(column).isNotNull(), F.col(column)),
                        F.when(F.col(column).isNotNull(), position))

    return rows.groupBy(url).agg(
        last("hashtag").alias("_tag"), last("user").alias("_user"),
        F.min(position).alias("_first"),
    ).select(
        url,
        compact_map(hashtag="_tag", user="_user").alias("source_metadata"),
        F.col("_first.source_pos").alias("source_pos"),
        F.col("_first.item_pos").alias("item_pos"),
    )


def only_new(found: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Found rows whose key does not exist yet, one per key value."""
    return found.join(existing.select(key), key, "left_anti")


def merge_sorted_distinct(*lists: DataFrame) -> DataFrame:
    """Union of one-column lists, distinct and sorted."""
    whole = lists[0]
    for other in lists[1:]:
        whole = whole.union(other)
    return whole.distinct().orderBy(whole.columns[0])


def clean_tokens(
    raw: DataFrame, column: str = "token", min_len: int = 4,
    stopwords: Sequence[str] = S.TIKTOK_STOPWORDS, keep_blanks: bool = False,
) -> DataFrame:
    """Normalised seed tokens without the useless ones, distinct."""
    return (
        raw.select(normalize_tag(column, keep_blanks).alias(column))
        .where(~useless_token(column, min_len, stopwords))
        .distinct()
    )


def discovered_report(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """``discovered`` distinct URLs in the batch and how many of them are ``inserted``."""
    flagged = flag_inserted(queue, candidates)
    # One row per URL first: a distinct count would expand the rows.
    per_url = flagged.groupBy("url").agg(F.max("inserted").alias("inserted"))
    return per_url.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if("inserted").alias("inserted")
    )


def grow_source_list(
    existing: DataFrame, seeds: DataFrame, platform: str, taken: DataFrame | None = None, token: str = "token",
) -> DataFrame:
    """A platform's list of tags, users or pages with new seeds, sorted and distinct.

    What is listed already is only normalized; seeds have to be useful by the platform's rules as
    well. Entries of ``taken`` (a list that goes before, as hashtags before users) are left out.
    """
    tag = platform_tag(F.coalesce(token, F.lit("")), platform).alias(token)
    old, new = existing.select(tag), seeds.select(tag)
    whole = merge_sorted_distinct(old, new.where(~useless_platform_tag(token, platform)))
    return whole if taken is None else only_new(whole, taken, token).orderBy(token)
