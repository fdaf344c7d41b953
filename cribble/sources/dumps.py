"""JSON responses of search and listing services held in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.operators.once import compute_once


def _entries(df: DataFrame, json: str, schema: str, field: str, n: int | None) -> DataFrame:
    """Explode ``field`` of the parsed JSON; a malformed document gives no rows."""
    parsed = F.from_json(F.col(json), schema)[field]
    cut = F.slice(parsed, 1, n) if n is not None else parsed
    keys = [c for c in df.columns if c != json]
    # Exploding infers a size filter, which would parse each document again.
    once = compute_once(df, "_entries", cut)
    return once.select(*keys, F.posexplode("_entries").alias("item_pos", "e")).withColumn(
        "item_pos", F.col("item_pos").cast("long")
    )


def playlist_entries(
    pages: DataFrame, json: str = "json", host: str = "tiktok.com",
    n: int | None = None,
) -> DataFrame:
    """``url`` of the playlist entries (the first ``n`` if given) whose URL contains ``host``."""
    schema = "entries array<struct<url:string>>"
    rows = _entries(pages, json, schema, "entries", n)
    return rows.where(F.coalesce(F.contains("e.url", F.lit(host)), F.lit(False))).select(
        "*", F.col("e.url").alias("url")
    ).drop("e")


def directory_results(
    responses: DataFrame, json: str = "json", n: int | None = None
) -> DataFrame:
    """Podcast-directory results: ``feed_url, collection, publisher`` per response row."""
    schema = "results array<struct<feedUrl:string,collectionName:string,artistName:string>>"
    rows = _entries(responses, json, schema, "results", n)
    return rows.select(
        "*", F.col("e.feedUrl").alias("feed_url"),
        F.col("e.collectionName").alias("collection"), F.col("e.artistName").alias("publisher"),
    ).drop("e").where(F.coalesce(F.col("feed_url") != "", F.lit(False)))


def feed_search_results(responses: DataFrame, json: str = "json") -> DataFrame:
    """Feed-search results: ``url, title, language`` per response row."""
    schema = "feeds array<struct<url:string,title:string,language:string>>"
    rows = _entries(responses, json, schema, "feeds", None)
    return rows.select("*", "e.url", "e.title", "e.language").drop("e")


def video_search_results(
    responses: DataFrame, json: str = "json", n: int | None = None
) -> DataFrame:
    """Video-search results: ``video_id, title, channel`` per response row."""
    schema = (
        "items array<struct<id:struct<videoId:string,channelId:string>,"
        "snippet:struct<title:string,channelId:string>>>"
    )
    rows = _entries(responses, json, schema, "items", n)
    return rows.select(
        "*", F.col("e.id.videoId").alias("video_id"), F.col("e.snippet.title").alias("title"),
        F.col("e.snippet.channelId").alias("channel"),
    ).drop("e")


def channel_search_results(
    responses: DataFrame, json: str = "json", n: int | None = None
) -> DataFrame:
    """Channel-search results: ``channel_id, title`` per response row."""
    schema = "items array<struct<id:struct<channelId:string>,snippet:struct<title:string>>>"
    rows = _entries(responses, json, schema, "items", n)
    return rows.select(
        "*", F.col("e.id.channelId").alias("channel_id"), F.col("e.snippet.title").alias("title")
    ).drop("e")


def upload_results(
    responses: DataFrame, json: str = "json", n: int | None = None
) -> DataFrame:
    """Uploads-playlist results: ``video_id, title`` per response row (which knows its channel)."""
    schema = (
        "items array<struct<snippet:struct<title:string,resourceId:struct<videoId:string>>>>"
    )
    rows = _entries(responses, json, schema, "items", n)
    return rows.select(
        "*", F.col("e.snippet.resourceId.videoId").alias("video_id"),
        F.col("e.snippet.title").alias("title"),
    ).drop("e")
