"""RSS and Atom documents held in a column, to one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble.operators.once import compute_once

_LINK = "struct<_href:string,_rel:string,_type:string,_VALUE:string>"
_ENC = "struct<_url:string,_type:string>"

_ITEM = (
    "struct<title:string,pubDate:string,`dc:date`:string,guid:string,`_rdf:about`:string,link:string,"
    f"enclosure:array<{_ENC}>,`atom:link`:array<{_LINK}>>"
)
_ENTRY = f"struct<id:string,title:string,published:string,link:array<{_LINK}>>"
# Items stand in the channel (RSS 2.0) or beside it (RSS 1.0); Atom has entries.
RSS_SCHEMA = (
    "channel struct<title:string,language:string,country:string,author:string,"
    f"`itunes:author`:string,`itunes:country`:string,item:array<{_ITEM}>>, "
    f"item array<{_ITEM}>, entry array<{_ENTRY}>, _corrupt_record string"
)
_OUT = (
    "struct<title:string,published:string,guid:string,"
    "enclosures:array<struct<url:string,href:string,type:string>>,links:array<struct<href:string>>>"
)
ATOM_SCHEMA = (
    "title string, author struct<name:string>,"
    "entry array<struct<id:string,title:string,published:string,"
    f"link:array<{_LINK}>>>, _corrupt_record string"
)


def _parse(feeds: DataFrame, xml: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = compute_once(feeds, "_f", F.from_xml(F.col(xml), schema, options))
    return parsed.where(F.col("_f").isNotNull() & F.col("_f._corrupt_record").isNull())


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of ``feeds(feed_url, source_pos, <xml>)``; a feed that does not parse gives none.

    RSS 2.0, RSS 1.0 and Atom alike: an Atom entry's enclosures are its links
    with ``rel="enclosure"``.
    """
    none = F.array().cast(f"array<{_OUT}>")

    def enclosures(urls: Column) -> Column:
        return F.coalesce(urls, F.array().cast("array<struct<url:string,href:string,type:string>>"))

    def links(hrefs: Column) -> Column:
        return F.filter(F.coalesce(hrefs, F.array().cast("array<struct<href:string>>")), lambda x: x["href"].isNotNull())

    def of_item(i: Column) -> Column:
        return F.struct(
            i["title"].alias("title"), F.coalesce(i["pubDate"], i["dc:date"]).alias("published"),
            F.coalesce(i["guid"], i["_rdf:about"]).alias("guid"),
            enclosures(F.transform(i["enclosure"], lambda e: F.struct(
                e["_url"].alias("url"), e["_url"].alias("href"), e["_type"].alias("type")))).alias("enclosures"),
            links(F.concat(
                F.array(F.struct(i["link"].alias("href"))),
                links(F.transform(i["atom:link"], lambda x: F.struct(x["_href"].alias("href")))))).alias("links"))

    def of_entry(e: Column) -> Column:
        attached = F.filter(e["link"], lambda x: x["_rel"] == "enclosure")
        others = F.filter(e["link"], lambda x: ~x["_rel"].eqNullSafe(F.lit("enclosure")))
        return F.struct(
            e["title"].alias("title"), e["published"].alias("published"), e["id"].alias("guid"),
            enclosures(F.transform(attached, lambda x: F.struct(
                x["_href"].alias("url"), x["_href"].alias("href"), x["_type"].alias("type")))).alias("enclosures"),
            links(F.transform(others, lambda x: F.struct(x["_href"].alias("href")))).alias("links"))

    items = F.concat(
        F.coalesce(F.transform("_f.channel.item", of_item), none),
        F.coalesce(F.transform("_f.item", of_item), none),
        F.coalesce(F.transform("_f.entry", of_entry), none))
    return _parse(feeds, xml, RSS_SCHEMA).select(
        "feed_url", "source_pos", F.posexplode(items).alias("item_pos", "i")
    ).select(
        "feed_url", F.col("source_pos").cast("long").alias("source_pos"),
        F.col("item_pos").cast("long").alias("item_pos"), "i.*",
    )


def rss_feed_meta(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed-level fields of each feed that parses."""
    c = F.col("_f.channel")
    return _parse(feeds, xml, RSS_SCHEMA).select(
        "feed_url", "source_pos", c["author"].alias("author"),
        c["itunes:author"].alias("itunes_author"), c["language"].alias("language"),
        c["itunes:country"].alias("itunes_country"), c["country"].alias("country"),
    )


def atom_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Channel-feed entries that have a link, as ``(channel_id, positions, url, title, published)``."""
    # A link without ``rel`` is an alternate one; an entry without any is left out.
    alternate = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.get(alternate, 0)["_href"]
    return _parse(feeds, xml, ATOM_SCHEMA).select(
        "channel_id", "source_pos", F.posexplode("_f.entry").alias("item_pos", "e")
    ).select(
        "channel_id", F.col("source_pos").cast("long").alias("source_pos"),
        F.col("item_pos").cast("long").alias("item_pos"),
        link.alias("url"), F.col("e.title").alias("title"),
        F.col("e.published").alias("published"),
    ).where(F.col("url").isNotNull())
