"""URL, tag, metadata and media expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.registry import (
    QUEUE_SQL,
    Tables,
    derive,
    derive_sql,
    query,
    queue,
)
from cribble.functions import media, meta, text, urls
from cribble.operators.files import by_extension

# Page URLs, made to hit the rules: some move to a blocked host, become Shorts
# or get a file name with an extension.
PAGE_E = {
    "page_id": "page_id",
    "url": (
        "CASE page_id % 7 WHEN 0 THEN replace(url, 'example', 'BuzzSprout') "
        "WHEN 1 THEN replace(url, '.com/', '.com/shorts/') "
        "WHEN 2 THEN url || '/ep' || page_id || '.MP3' WHEN 3 THEN url || '/buzzsprout.com/x.m4a' "
        "WHEN 4 THEN NULL WHEN 5 THEN url || '/a.ogg/' ELSE url END"
    ),
}
PAGE_SQL = f"p AS ({derive_sql('pages', PAGE_E)})"
HOST = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)'"
PATH = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')"


def pages(t: Tables) -> DataFrame:
    return derive(t.pages, PAGE_E)


@query("P4", f"""WITH {PAGE_SQL} SELECT page_id, coalesce(contains(lower(regexp_extract(url, {HOST}, 1)),
'buzzsprout.com'), false) AS blocked FROM p""")
def host_blocked(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.host_blocked("url").alias("blocked"))


@query("P5", f"WITH {PAGE_SQL} SELECT page_id, coalesce(contains(url, '/shorts/'), false) AS short FROM p")
def is_short(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.is_short("url").alias("short"))


@query("P6", f"""WITH {PAGE_SQL} SELECT page_id, coalesce(lower(url) LIKE '%.mp3' OR lower(url) LIKE '%.m4a'
OR lower(url) LIKE '%.wav' OR lower(url) LIKE '%.ogg', false) AS audio FROM p""")
def is_audio_url(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.is_audio_url("url").alias("audio"))


# One entry per order: up to three enclosures and two links from its columns.
ENTRY_E = {
    "id": "o_orderkey",
    "u1": "CASE WHEN o_custkey % 4 > 0 THEN 'http://e/' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.jpg' ELSE '.mp3?k' END END",
    "h1": "CASE WHEN o_custkey % 5 > 0 THEN 'http://h/' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.ogg' ELSE '.png' END END",
    "u2": "CASE WHEN o_custkey % 2 = 0 THEN 'http://f/' || o_orderkey || '.wav' END",
    "l1": "'http://l/' || o_orderkey || CASE o_custkey % 7 WHEN 0 THEN '.m4a' ELSE '.html' END",
    "n_enc": "o_orderkey % 3",
}
ENTRY_SQL = f"e AS ({derive_sql('orders', ENTRY_E)})"


def entries(t: Tables) -> DataFrame:
    e = derive(t.orders, ENTRY_E)
    none = F.lit(None).cast("string")
    first = F.struct(F.col("u1").alias("url"), F.col("h1").alias("href"))
    second = F.struct(F.col("u2").alias("url"), none.alias("href"))
    return e.select(
        "id",
        F.slice(F.array(first, second), 1, F.col("n_enc").cast("int")).alias("enclosures"),
        F.array(F.struct(F.col("l1").alias("href"))).alias("links"),
    )


def _audio(c: str) -> str:
    return f"regexp_matches(lower(coalesce({c}, '')), '\\.(mp3|m4a|wav|ogg)$')"


@query("P7", f"""WITH {ENTRY_SQL} SELECT id,
CASE WHEN n_enc > 0 AND {_audio('u1')} THEN u1 WHEN n_enc > 1 AND {_audio('u2')} THEN u2
WHEN {_audio('l1')} THEN l1 END AS by_url,
CASE WHEN n_enc > 0 AND {_audio('coalesce(u1, h1)')} THEN coalesce(u1, h1)
WHEN n_enc > 1 AND {_audio('u2')} THEN u2 WHEN {_audio('l1')} THEN l1 END AS by_href FROM e""")
def pick_audio_url(t: Tables) -> DataFrame:
    return entries(t).select(
        "id", urls.pick_audio_url("enclosures", "links").alias("by_url"),
        urls.pick_audio_url("enclosures", "links", enclosure_href=True).alias("by_href"),
    )


@query("P8", f"WITH {ENTRY_SQL} SELECT id, h1 AS url FROM e WHERE n_enc > 0 AND h1 IS NOT NULL")
def pick_first_enclosure(t: Tables) -> DataFrame:
    picked = entries(t).select("id", urls.pick_first_enclosure("enclosures").alias("url"))
    return picked.where(F.col("url").isNotNull())


@query("P9", """SELECT doc_id, contains(lower(coalesce(lang, '')), 'r')
OR contains(lower(coalesce(text, '')), 'eaux') OR contains(lower(coalesce(text, '')), 'ê') AS relevant
FROM documents""")
def relevant_feed(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", urls.relevant_feed("lang", "text", ["r"], ["eaux", "ê"]).alias("relevant")
    )


TOKEN_E = {
    "id": "p_partkey",
    "token": (
        "CASE p_partkey % 5 WHEN 0 THEN ' #' || p_name || ' ' WHEN 1 THEN '@' || p_size "
        "WHEN 2 THEN upper(p_brand) WHEN 3 THEN ' Vi Deo#' ELSE CAST(p_partkey AS STRING) END"
    ),
}
TOKEN_SQL = f"k AS ({derive_sql('part', TOKEN_E)})"


@query("P10, F10", f"""WITH {TOKEN_SQL}, n AS (SELECT id,
translate(lower(trim(token)), ' #@', '') AS tag, trim(translate(lower(token), '#@', '')) AS reel_tag FROM k)
SELECT *, length(tag) < 4 OR regexp_matches(tag, '^[0-9]+$') OR tag IN ('video', 'fun') AS useless FROM n""")
def normalize_tags(t: Tables) -> DataFrame:
    k = derive(t.part, TOKEN_E)
    tag = urls.normalize_tag("token")
    return k.select(
        "id", tag.alias("tag"), urls.normalize_tag("token", keep_blanks=True).alias("reel_tag"),
        urls.useless_token(tag, 4, ["video", "fun"]).alias("useless"),
    )


@query("F6", f"""WITH {PAGE_SQL} SELECT page_id, coalesce(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''),
'/+$', '')), '') AS feed FROM p""")
def normalize_feed(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.normalize_feed("url").alias("feed"))


@query("F7", f"WITH {PAGE_SQL} SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS root FROM p")
def site_root(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.site_root("url").alias("root"))


@query("F8", f"""WITH {PAGE_SQL}, x AS (SELECT page_id, url, lower(regexp_extract(regexp_extract(
regexp_replace({PATH}, '/+$', ''), '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS ext FROM p)
SELECT page_id, 'podcast_' || sha1(url) || CASE WHEN ext IN ('.mp3', '.m4a', '.wav', '.aac', '.ogg')
THEN ext ELSE '.mp3' END AS name FROM x""")
def stable_name(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.stable_name("url").alias("name"))


@query("F9", f"""WITH {PAGE_SQL} SELECT page_id, replace(lower(regexp_extract(url, {HOST}, 1)), '.', '_') || '_' ||
replace(coalesce(nullif(regexp_extract(regexp_replace({PATH}, '/+$', ''), '([^/]*)$', 1), ''), 'tiktok'), '.', '_')
AS name FROM p""")
def url_basename(t: Tables) -> DataFrame:
    return pages(t).select("page_id", urls.url_basename("url").alias("name"))


@query("F15", """SELECT p_partkey AS id, 'https://www.youtube.com/watch?v=' || p_partkey AS video,
'https://www.youtube.com/feeds/videos.xml?channel_id=' || p_name AS feed,
'https://www.tiktok.com/tag/' || p_name AS tag, 'https://www.tiktok.com/@' || p_name AS usr,
'https://huggingface.co/datasets/some/corpus/' || p_partkey AS item FROM part""")
def source_urls(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        F.col("p_partkey").alias("id"), urls.video_url(key).alias("video"),
        urls.feed_url("p_name").alias("feed"), urls.tag_url("p_name").alias("tag"),
        urls.user_url("p_name").alias("usr"), urls.dataset_url(key, "some/corpus").alias("item"),
    )


# --- Metadata --------------------------------------------------------------

@query("F21, P2, P3", f"""WITH {QUEUE_SQL} SELECT id, meta_kind <> 'null' AS present,
meta_kind = 'full' AND (meta_channel IS NOT NULL OR meta_feed IS NOT NULL OR meta_user IS NOT NULL) AS usable,
CASE WHEN meta_kind = 'full' THEN meta_channel END AS channel_id FROM q""")
def metadata_states(t: Tables) -> DataFrame:
    m = "source_metadata"
    return queue(t).select(
        "id", meta.meta_present(m).alias("present"), meta.meta_usable(m).alias("usable"),
        meta.json_field(m, "channel_id").alias("channel_id"),
    )


@query("F21", """SELECT event_id, props IS NOT NULL AND event_id % 4 <> 0 AS present,
event_id % 4 > 1 AS usable, CASE WHEN event_id % 4 > 1 THEN json_extract_string(props, '$.k') END AS k
FROM events""")
def metadata_from_json(t: Tables) -> DataFrame:
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE props END")
    parsed = t.events.select("event_id", meta.parse_metadata(raw).alias("m"))
    return parsed.select(
        "event_id", meta.meta_present("m").alias("present"), meta.meta_usable("m").alias("usable"),
        meta.json_field("m", "k").alias("k"),
    )


FEED_META_E = {
    "id": "c_custkey",
    "feed_url": "'http://feed/' || c_custkey",
    "author": "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END",
    "itunes_author": "CASE WHEN c_custkey % 2 = 0 THEN 'it ' || c_name END",
    "language": "CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END",
    "itunes_country": "CASE WHEN c_custkey % 5 = 0 THEN 'n' || c_nationkey END",
    "country": "CASE WHEN c_custkey % 7 > 2 THEN 'm' || c_nationkey END",
}
FEED_META_SQL = f"c AS ({derive_sql('customer', FEED_META_E)})"


def feed_fields(t: Tables) -> DataFrame:
    return derive(t.customer, FEED_META_E)


@query("F16", f"""WITH {FEED_META_SQL}, x AS (SELECT id, feed_url,
coalesce(nullif(author, ''), nullif(itunes_author, '')) AS feed_author, nullif(language, '') AS feed_language,
coalesce(nullif(itunes_country, ''), nullif(country, '')) AS feed_country FROM c)
SELECT *, CAST(1 + CASE WHEN feed_author IS NULL THEN 0 ELSE 1 END + CASE WHEN feed_language IS NULL THEN 0 ELSE 1 END
+ CASE WHEN feed_country IS NULL THEN 0 ELSE 1 END AS INT) AS n_keys FROM x""")
def feed_meta(t: Tables) -> DataFrame:
    m = feed_fields(t).select("id", meta.feed_meta(
        "feed_url", "author", "itunes_author", "language", "itunes_country", "country").alias("m"))
    keys = ("feed_url", "feed_author", "feed_language", "feed_country")
    return m.select("id", *[meta.json_field("m", k).alias(k) for k in keys],
                    F.size(F.map_keys("m")).alias("n_keys"))


@query("F16", f"""WITH {FEED_META_SQL}, x AS (SELECT id, coalesce(nullif(author, ''), nullif(itunes_country, ''))
AS channel_id, nullif(itunes_author, '') AS uploader, nullif(language, '') AS channel,
nullif(country, '') AS channel_country FROM c), y AS (SELECT id, channel_id, coalesce(uploader, channel) AS uploader,
channel, channel_country FROM x)
SELECT id, channel_id, uploader, CASE WHEN keep THEN channel END AS channel,
CASE WHEN keep THEN channel_country END AS channel_country, keep AS known
FROM (SELECT *, channel_id IS NOT NULL OR uploader IS NOT NULL AS keep FROM y)""")
def video_meta(t: Tables) -> DataFrame:
    m = feed_fields(t).select("id", meta.video_meta(
        "author", "itunes_country", "itunes_author", "language", F.lit(None).cast("string"), "country",
    ).alias("m"))
    keys = ("channel_id", "uploader", "channel", "channel_country")
    return m.select("id", *[meta.json_field("m", k).alias(k) for k in keys],
                    F.col("m").isNotNull().alias("known"))


@query("F17, F18", """SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN 'egyptian' WHEN 1 THEN 'msa'
WHEN 2 THEN 'gulf' WHEN 3 THEN 'gulf' WHEN 4 THEN 'gulf' WHEN 5 THEN 'gulf' WHEN 6 THEN 'gulf'
WHEN 7 THEN 'lebanese' END AS contrastive_role, p_name AS channel_id, 'q' || p_size AS query,
p_brand AS feed_url FROM part""")
def contrastive_meta(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in
                      ("EGY", "MSA", "KSA", "KWT", "UAE", "QAT", "OMA", "LEB", "XXX")])
    key = F.col("p_partkey").cast("string")
    m = t.part.select(
        F.col("p_partkey").alias("id"),
        meta.contrastive_meta(key, F.get(codes, F.col("p_size") % 9)).alias("c"),
        meta.search_meta("p_name", F.concat(F.lit("q"), F.col("p_size").cast("string"))).alias("s"),
        meta.episode_meta("p_brand", "p_type").alias("e"),
    )
    return m.select(
        "id", meta.json_field("c", "contrastive_role").alias("contrastive_role"),
        meta.json_field("s", "channel_id").alias("channel_id"),
        meta.json_field("s", "query").alias("query"), meta.json_field("e", "feed_url").alias("feed_url"),
    )


# --- Media -----------------------------------------------------------------

PROBE_E = {
    "id": "o_orderkey",
    "platform": "CASE o_custkey % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'podcast_rss' WHEN 2 THEN 'tiktok' ELSE 'podcast' END",
    "duration": (
        "CASE o_orderkey % 6 WHEN 0 THEN 5e0 WHEN 1 THEN 6e0 WHEN 2 THEN 1200e0 WHEN 3 THEN 1200.5e0 "
        "WHEN 4 THEN 1201.5e0 ELSE CAST(floor(o_totalprice / 100) AS DOUBLE) END"
    ),
}
PROBE_SQL = f"o AS ({derive_sql('orders', PROBE_E)})"


def probes(t: Tables) -> DataFrame:
    return derive(t.orders, PROBE_E)


GATE_SQL = """g AS (SELECT *, platform IN ('podcast', 'podcast_rss') AND duration > 1200 AS too_long,
CASE WHEN platform = 'youtube' AND duration > 1200 THEN 1200e0
WHEN platform = 'tiktok' AND duration > 1201 THEN 1200e0 ELSE duration END AS cut FROM o)"""


@query("P11", f"""WITH {PROBE_SQL}, {GATE_SQL} SELECT id, CASE WHEN too_long THEN 'ERROR_DOWNLOAD' WHEN cut < 6
THEN 'SKIPPED_LENGTH' ELSE 'DOWNLOADED' END AS status,
CASE WHEN too_long THEN 'Podcast too long (' || printf('%.1f', duration) || 's > 1200s)' END AS error_msg,
CASE WHEN NOT too_long AND cut >= 6 THEN cut END AS duration_seconds FROM g""")
def duration_gate(t: Tables) -> DataFrame:
    return probes(t).select("id", media.duration_gate("platform", "duration").alias("g")).select(
        "id", "g.*"
    )


@query("F12", f"""WITH {PROBE_SQL}, k AS (SELECT unnest([0, 1, 2]) AS idx)
SELECT id, duration, idx, CASE WHEN duration < 20 THEN 0 ELSE CAST('0x' || substr(md5(id || ':' || idx || ':42'), 1, 8) AS BIGINT)
% (CAST(floor(duration - 20) AS BIGINT) + 1) END AS start FROM o CROSS JOIN k WHERE duration >= 20 OR idx = 0""")
def chunk_plan(t: Tables) -> DataFrame:
    planned = probes(t).select(
        "id", "duration", F.explode(media.chunk_plan("id", "duration")).alias("c")
    )
    return planned.select("id", "duration", "c.idx", "c.start")


@query("F13", f"""WITH {PROBE_SQL} SELECT id, CASE WHEN duration - 500 > 0 THEN round(greatest(0e0, least(duration - 500 - 60,
(duration - 500) * 0.3e0)), 6) END AS start FROM o""")
def clip_start(t: Tables) -> DataFrame:
    return probes(t).select("id", F.round(media.clip_start(F.col("duration") - 500), 6).alias("start"))


@query("F14", r"""WITH x AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  '
ELSE text END AS t FROM documents), y AS (SELECT doc_id, t, regexp_replace(substr(t, 1, 600), '^\s+|\s+$', '', 'g')
AS c FROM x) SELECT doc_id, CASE WHEN t IS NULL THEN '(no transcript available)' WHEN c = ''
THEN '(empty transcript)' ELSE c END AS excerpt FROM y""")
def excerpts(t: Tables) -> DataFrame:
    shown = F.expr("CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE text END")
    return t.documents.select("doc_id", text.excerpt(shown).alias("excerpt"))


@query("P18", f"WITH {QUEUE_SQL} SELECT id, audio_path FROM q WHERE lower(audio_path) LIKE '%.wav'")
def wav_worklist(t: Tables) -> DataFrame:
    return by_extension(queue(t)).select("id", "audio_path")


@query("F19", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN lower(audio_path) LIKE '%.wav' AND id % 5 > 0 AND id % 7 > 0
THEN left(audio_path, length(audio_path) - 4) || '.flac' ELSE audio_path END AS audio_path FROM q""")
def swap_extension(t: Tables) -> DataFrame:
    return queue(t).select("id", media.swap_extension(
        "audio_path", F.col("id") % 5 > 0, F.col("id") % 7 > 0).alias("audio_path"))


@query("F20", """WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: exp(CAST(e AS DOUBLE))) AS v FROM embeddings)
SELECT vec_id, 'C' || lpad(CAST(list_position(v, list_max(v)) - 1 AS VARCHAR), 2, '0') AS top,
round(list_max(v) / list_sum(v), 6) AS top_score FROM x""")
def top_class(t: Tables) -> DataFrame:
    """Every component of the vector is the logit of a class."""
    entries = F.transform("embedding", lambda e, i: F.struct(
        F.concat(F.lit("c"), F.lpad(i.cast("string"), 2, "0")).alias("key"), e.cast("double").alias("value")))
    best = t.embeddings.select("vec_id", text.top_class(text.softmax(F.map_from_entries(entries))).alias("b"))
    return best.select("vec_id", "b.top", F.round("b.top_score", 6).alias("top_score"))
