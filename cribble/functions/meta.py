"""Source-metadata expressions. Metadata is ``map<string,string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribble import settings as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_metadata(json: Column | str) -> Column:
    """Parse a JSON column; SQL NULL stays NULL, JSON ``null`` and ``{}`` give an empty map."""
    raw = _col(json)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(
        raw.isNotNull(), F.coalesce(F.from_json(raw, "map<string,string>"), empty)
    )


def meta_present(meta: Column | str) -> Column:
    """Stored at all; an empty object still counts."""
    return _col(meta).isNotNull()


def meta_usable(meta: Column | str) -> Column:
    """Holds at least one key."""
    return F.coalesce(F.size(F.map_keys(_col(meta))) > 0, F.lit(False))


def json_field(meta: Column | str, key: str) -> Column:
    """Value of one key, null when the map or the key is missing or the value is ''."""
    return F.nullif(F.try_element_at(_col(meta), F.lit(key)), F.lit(""))


def first_non_empty(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns])


def compact_map(**entries: Column | str) -> Column:
    """Map of the given entries without the null ones."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), _col(v))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def feed_meta(
    feed_url: Column | str,
    author: Column | str,
    itunes_author: Column | str,
    language: Column | str,
    itunes_country: Column | str,
    country: Column | str,
) -> Column:
    return compact_map(
        feed_url=feed_url,
        feed_author=first_non_empty(author, itunes_author),
        feed_language=first_non_empty(language),
        feed_country=first_non_empty(itunes_country, country),
    )


def video_meta(
    channel_id: Column | str,
    uploader_id: Column | str,
    uploader: Column | str,
    channel: Column | str,
    location: Column | str,
    channel_country: Column | str,
) -> Column:
    """Null unless a channel id or an uploader is known."""
    chan = first_non_empty(channel_id, uploader_id)
    who = first_non_empty(uploader, channel)
    return F.when(
        chan.isNotNull() | who.isNotNull(),
        compact_map(
            channel_id=chan,
            uploader=who,
            channel=first_non_empty(channel),
            channel_country=first_non_empty(location, channel_country),
        ),
    )


def contrastive_role(code: Column | str, roles: dict[str, str] = S.CONTRASTIVE_ROLES) -> Column:
    """Role of a class code, null for codes outside the map."""
    pairs = [F.lit(x) for kv in roles.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(code))


def contrastive_meta(
    item_id: Column | str, code: Column | str, roles: dict[str, str] = S.CONTRASTIVE_ROLES
) -> Column:
    return F.create_map(
        F.lit("source"), F.lit("adi17"),
        F.lit("adi17_id"), _col(item_id),
        F.lit("adi17_dialect"), _col(code),
        F.lit("contrastive_role"), contrastive_role(code, roles),
    )


def search_meta(channel: Column | str, query: Column | str) -> Column:
    return F.create_map(F.lit("channel_id"), _col(channel), F.lit("query"), _col(query))


def channel_feed_meta(channel_id: Column | str) -> Column:
    """Channel-feed items carry no query, so only the channel is stored."""
    return F.create_map(F.lit("channel_id"), _col(channel_id))


def episode_meta(feed_url: Column | str, search_term: Column | str | None = None) -> Column:
    pairs = [F.lit("feed_url"), _col(feed_url)]
    if search_term is not None:
        pairs += [F.lit("search_term"), _col(search_term)]
    return F.create_map(*pairs)
