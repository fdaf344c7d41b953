"""URL, tag and token expressions. Column in, Column out, all inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribble import settings as S

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_authority(url: Column | str) -> Column:
    """Authority part as written, '' when there is none."""
    return F.coalesce(F.regexp_extract(_col(url), _AUTHORITY, 1), F.lit(""))


def url_path(url: Column | str) -> Column:
    """Path part without query, fragment or the ``;params`` of its last segment."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?", "")
    return F.regexp_replace(path, r";[^/]*$", "")


def normalize_feed(url: Column | str) -> Column:
    """Lower-cased scheme, host and path without trailing slashes; null gives ''."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^([^:/]+://[^/]*/.*?);[^/]*$", "$1")
    return F.coalesce(F.lower(F.regexp_replace(bare, r"/+$", "")), F.lit(""))


def site_root(url: Column | str) -> Column:
    scheme = F.lower(F.regexp_extract(_col(url), _SCHEME, 1))
    return F.concat(scheme, F.lit("://"), url_authority(url))


def host_blocked(url: Column | str, host: str = S.BLOCKED_HOST) -> Column:
    return F.contains(F.lower(url_authority(url)), F.lit(host))


def is_short(url: Column | str) -> Column:
    return F.coalesce(F.contains(_col(url), F.lit("/shorts/")), F.lit(False))


def is_audio_url(
    url: Column | str, extensions: Sequence[str] = S.AUDIO_URL_EXTENSIONS
) -> Column:
    """True when the lower-cased URL *ends* in an audio extension; a query string spoils it."""
    low = F.lower(_col(url))
    hit = F.lit(False)
    for ext in extensions:
        hit = hit | F.endswith(low, F.lit(ext))
    return F.coalesce(hit, F.lit(False))


def pick_audio_url(
    enclosures: Column | str, links: Column | str, enclosure_href: bool = False
) -> Column:
    """First audio enclosure, else first audio link, else null.

    ``enclosure_href`` also reads ``href`` of enclosures that have no ``url``.
    """
    def enclosure_url(e: Column) -> Column:
        if not enclosure_href:
            return e["url"]
        return F.coalesce(F.nullif(e["url"], F.lit("")), e["href"])

    def first_audio(urls: Column) -> Column:
        return F.get(F.filter(urls, lambda u: is_audio_url(u)), 0)

    return F.coalesce(
        first_audio(F.transform(_col(enclosures), enclosure_url)),
        first_audio(F.transform(_col(links), lambda x: x["href"])),
    )


def pick_first_enclosure(enclosures: Column | str) -> Column:
    """Href of the very first enclosure whatever its type; '' and missing give null."""
    return F.nullif(F.get(_col(enclosures), 0)["href"], F.lit(""))


def relevant_feed(
    language: Column | str,
    title: Column | str,
    language_parts: Sequence[str] = S.RELEVANT_LANGUAGE_PARTS,
    title_parts: Sequence[str] = S.RELEVANT_TITLE_PARTS,
) -> Column:
    lang = F.lower(F.coalesce(_col(language), F.lit("")))
    name = F.lower(F.coalesce(_col(title), F.lit("")))
    hit = F.lit(False)
    for part in language_parts:
        hit = hit | F.contains(lang, F.lit(part))
    for part in title_parts:
        hit = hit | F.contains(name, F.lit(part))
    return hit


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_tag(tag: Column | str, keep_blanks: bool = False) -> Column:
    """Lower-case and drop ``#`` and ``@``; also every blank unless ``keep_blanks``."""
    low = F.lower(_col(tag))
    if keep_blanks:
        return _strip(F.translate(low, "#@", ""))
    return F.translate(_strip(low), " #@", "")


def useless_token(
    token: Column | str,
    min_len: int = 4,
    stopwords: Sequence[str] = S.TIKTOK_STOPWORDS,
) -> Column:
    t = F.coalesce(_col(token), F.lit(""))
    return (
        (F.char_length(t) < min_len) | F.rlike(t, F.lit(r"^\p{Nd}+$")) | t.isin(*stopwords)
    )


def platform_tag(token: Column | str, platform: str) -> Column:
    """A token as a tag of one platform (``settings.TAG_RULES``)."""
    return normalize_tag(token, keep_blanks=S.TAG_RULES[platform][2])


def useless_platform_tag(tag: Column | str, platform: str) -> Column:
    """Whether a normalized tag is too short, a number or a stopword by its platform's rules."""
    min_len, stopwords, _ = S.TAG_RULES[platform]
    return useless_token(tag, min_len, stopwords)


def stable_name(
    url: Column | str, extensions: Sequence[str] = S.AUDIO_NAME_EXTENSIONS
) -> Column:
    """File name from the SHA-1 of the URL plus its extension when that is a known one."""
    name = F.regexp_extract(F.regexp_replace(url_path(url), r"/+$", ""), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    ext = F.when(ext.isin(*extensions), ext).otherwise(F.lit(".mp3"))
    return F.concat(F.lit("podcast_"), F.sha1(_col(url)), ext)


def url_basename(url: Column | str, default: str = "tiktok") -> Column:
    """``host_lastpart`` with dots turned to underscores and defaults for missing parts; null for null."""
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    last = F.coalesce(
        F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.lit(default)
    )
    host = F.regexp_replace(F.lower(url_authority(url)), r"^.*@|:\d*$", "")
    host = F.coalesce(F.nullif(host, F.lit("")), F.lit(default))
    name = F.concat(F.translate(host, ".", "_"), F.lit("_"), F.translate(last, ".", "_"))
    return F.when(_col(url).isNotNull(), name)


def video_url(video_id: Column | str) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), _col(video_id))


def feed_url(channel_id: Column | str) -> Column:
    return F.concat(
        F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), _col(channel_id)
    )


def tag_url(tag: Column | str) -> Column:
    return F.concat(F.lit("https://www.tiktok.com/tag/"), _col(tag))


def user_url(user: Column | str) -> Column:
    return F.concat(F.lit("https://www.tiktok.com/@"), _col(user))


def dataset_url(item_id: Column | str, repo: str) -> Column:
    return F.concat(F.lit(f"https://huggingface.co/datasets/{repo}/"), _col(item_id))
