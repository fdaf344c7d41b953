"""Feeds, listings and search responses to candidates, and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.queueing import BASE_SQL, base, candidates
from cribble.catalog.registry import QUEUE_SQL, Tables, now, query, queue
from cribble.catalog.urls import GATE_SQL
from cribble.operators import backfill, discover, ingest
from cribble.plans.stages import discover_clips, discover_feed_episodes, discover_videos
from cribble.sources import dumps, feeds

# Feeds: ten parts each, every seventh feed cut short so that it does not parse.
FEED_WIDTH = 10


def feed_documents(t: Tables) -> DataFrame:
    item = F.concat(
        F.lit("<item><title>"), F.col("p_name"), F.lit("</title><guid>g"), F.col("p_partkey").cast("string"),
        F.lit("</guid><pubDate>d"), F.col("p_size").cast("string"), F.lit("</pubDate>"),
        F.when(F.col("p_partkey") % 3 > 0, F.concat(
            F.lit('<enclosure url="http://a.example.org/'), F.col("p_size").cast("string"), F.lit("/"),
            (F.col("p_partkey") % 50).cast("string"),
            F.when(F.col("p_partkey") % 2 == 0, ".mp3").otherwise(".pdf"), F.lit('" type="t"/>'),
        )).otherwise(F.lit("")),
        F.lit("<link>http://l.example.org/"), F.col("p_partkey").cast("string"),
        F.when(F.col("p_partkey") % 5 == 0, ".M4A").otherwise(".html"), F.lit("</link></item>"),
    )
    parts = t.part.select(F.floor(F.col("p_partkey") / FEED_WIDTH).alias("f"), "p_partkey", item.alias("x"))
    body = parts.groupBy("f").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("p_partkey", "x"))), lambda s: s["x"]), "").alias("b")
    )
    return body.select(
        F.concat(F.lit("http://feed/"), F.col("f").cast("string")).alias("feed_url"),
        F.col("f").alias("source_pos"),
        F.concat(
            F.lit('<rss version="2.0"><channel><title>t</title><language>ar</language><author>w'),
            F.col("f").cast("string"), F.lit("</author>"), F.col("b"),
            F.when(F.col("f") % 7 == 6, "</chan").otherwise("</channel></rss>"),
        ).alias("xml"),
    )


FEED_SQL = """fi AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS source_pos, p_partkey % 10 AS item_pos,
'http://feed/' || CAST(floor(p_partkey / 10) AS BIGINT) AS feed_url, p_name AS title, 'd' || p_size AS published,
'g' || p_partkey AS guid, CASE WHEN p_partkey % 3 > 0 THEN 'http://a.example.org/' || p_size || '/' || (p_partkey % 50)
|| CASE WHEN p_partkey % 2 = 0 THEN '.mp3' ELSE '.pdf' END END AS enc, 'http://l.example.org/' || p_partkey ||
CASE WHEN p_partkey % 5 = 0 THEN '.M4A' ELSE '.html' END AS link FROM part WHERE CAST(floor(p_partkey / 10) AS BIGINT) % 7 <> 6),
au AS (SELECT *, CASE WHEN enc LIKE '%.mp3' THEN enc WHEN link LIKE '%.M4A' THEN link END AS audio FROM fi)"""


@query("S4", f"WITH {FEED_SQL} SELECT feed_url, source_pos, item_pos, title, published, guid, enc, link FROM fi")
def rss_items(t: Tables) -> DataFrame:
    return feeds.rss_items(feed_documents(t)).select(
        "feed_url", "source_pos", "item_pos", "title", "published", "guid",
        F.get("enclosures", 0)["href"].alias("enc"), F.get("links", 0)["href"].alias("link"),
    )


@query("S4", """SELECT p_partkey AS source_pos, 'UC' || p_partkey AS channel_id, CAST(0 AS BIGINT) AS item_pos,
'http://v/' || p_size AS url, p_name AS title FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0""")
def atom_items(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    docs = t.part.select(
        F.concat(F.lit("UC"), key).alias("channel_id"), F.col("p_partkey").alias("source_pos"),
        F.concat(
            F.lit("<feed><title>c</title><entry><id>"), key, F.lit("</id><title>"), F.col("p_name"), F.lit("</title>"),
            F.when(F.col("p_partkey") % 4 > 0, F.concat(
                F.lit('<link rel="alternate" href="http://v/'), F.col("p_size").cast("string"), F.lit('"/>')
            )).otherwise(F.lit("")),
            F.when(F.col("p_partkey") % 5 > 0, "</entry></feed>").otherwise("</en"),
        ).alias("xml"),
    )
    return feeds.atom_items(docs).select("channel_id", "source_pos", "item_pos", "url", "title")


@query("S4, P7", """WITH x AS (SELECT p_partkey, p_partkey % 3 AS kind, 'http://a/' || p_partkey || '.mp3' AS audio FROM part)
SELECT 'http://feed/' || p_partkey AS feed_url, 'g' || p_partkey AS guid, CASE WHEN kind < 2 THEN audio END AS enc,
'http://l/' || p_partkey AS link, CASE WHEN kind < 2 THEN audio END AS audio FROM x""")
def other_feed_items(t: Tables) -> DataFrame:
    """Atom feeds with enclosures, and feeds whose items stand beside the channel."""
    from cribble.functions.urls import pick_audio_url

    key = F.col("p_partkey").cast("string")
    audio = F.concat(F.lit("http://a/"), key, F.lit(".mp3"))
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry><id>g'), key, F.lit('</id><link href="http://l/'), key,
        F.lit('"/><link rel="enclosure" type="audio/mpeg" href="'), audio, F.lit('"/></entry></feed>'))
    outer = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel><item rdf:about="g'), key,
        F.lit('"><link>http://l/'), key, F.lit("</link>"),
        F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('<enclosure url="'), audio, F.lit('" type="t"/>'))).otherwise(F.lit("")),
        F.lit("</item></rdf:RDF>"))
    docs = t.part.select(
        F.concat(F.lit("http://feed/"), key).alias("feed_url"), F.col("p_partkey").alias("source_pos"),
        F.when(F.col("p_partkey") % 3 == 0, atom).otherwise(outer).alias("xml"))
    return feeds.rss_items(docs).select(
        "feed_url", "guid", F.get("enclosures", 0)["href"].alias("enc"), F.get("links", 0)["href"].alias("link"),
        pick_audio_url("enclosures", "links").alias("audio"))


# Listings: one JSON page per order, its lines as entries.
def listing_pages(t: Tables) -> DataFrame:
    entry = F.struct(F.col("l_linenumber").alias("o"), F.struct(F.concat(
        F.when(F.col("l_suppkey") % 3 > 0, "https://www.tiktok.com/@u/video/").otherwise("https://other.example.org/"),
        F.col("l_partkey").cast("string"),
    ).alias("url")).alias("e"))
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    body = F.to_json(F.struct(F.transform("es", lambda s: s["e"]).alias("entries")))
    return grouped.select(
        F.col("l_orderkey").alias("source_pos"),
        F.when(F.col("l_orderkey") % 9 == 8, F.lit("{broken")).otherwise(body).alias("json"),
    )


LISTING_SQL = """li AS (SELECT l_orderkey AS source_pos, row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_linenumber, u) - 1 AS item_pos, u AS url FROM (SELECT *,
CASE WHEN l_suppkey % 3 > 0 THEN 'https://www.tiktok.com/@u/video/' ELSE 'https://other.example.org/' END || l_partkey AS u
FROM lineitem WHERE l_orderkey % 9 <> 8)), pe AS (SELECT * FROM li WHERE item_pos < 3 AND contains(url, 'tiktok.com'))"""


@query("S5, W4", f"WITH {LISTING_SQL} SELECT source_pos, CAST(item_pos AS BIGINT) AS item_pos, url FROM pe")
def playlist_entries(t: Tables) -> DataFrame:
    return dumps.playlist_entries(listing_pages(t), n=3).select("source_pos", "item_pos", "url")


@query("S5", f"WITH {LISTING_SQL} SELECT source_pos, CAST(item_pos AS BIGINT) AS item_pos, url FROM li WHERE contains(url, 'tiktok.com')")
def playlist_all(t: Tables) -> DataFrame:
    return dumps.playlist_entries(listing_pages(t)).select("source_pos", "item_pos", "url")


def _json_rows(t: Tables, body, key: str = "c_custkey") -> DataFrame:
    return t.customer.select(F.col(key).alias("source_pos"), F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("query"), F.to_json(body).alias("json"))


@query("S6", """SELECT c_custkey AS source_pos, 'q' || c_nationkey AS query, CAST(0 AS BIGINT) AS item_pos,
'http://f/' || c_custkey AS feed_url, c_name AS collection, c_mktsegment AS publisher FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT c_custkey, 'q' || c_nationkey, 1, 'http://shared/' || c_nationkey, NULL, NULL FROM customer""")
def directory_results(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    one = F.struct(
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("http://f/"), F.col("c_custkey").cast("string"))).alias("feedUrl"),
        F.col("c_name").alias("collectionName"), F.col("c_mktsegment").alias("artistName"))
    two = F.struct(
        F.concat(F.lit("http://shared/"), F.col("c_nationkey").cast("string")).alias("feedUrl"),
        none.alias("collectionName"), none.alias("artistName"))
    return dumps.directory_results(_json_rows(t, F.struct(F.array(one, two).alias("results"))))


@query("S6, F18", """SELECT c_custkey AS source_pos, 'q' || c_nationkey AS query, 'https://www.youtube.com/watch?v=v' || c_custkey AS url,
'ch' || c_nationkey AS channel, c_name AS title FROM customer""")
def video_search_results(t: Tables) -> DataFrame:
    from cribble.functions.urls import video_url

    key = F.col("c_custkey").cast("string")
    item = F.struct(
        F.struct(F.concat(F.lit("v"), key).alias("videoId")).alias("id"),
        F.struct(F.col("c_name").alias("title"), F.concat(F.lit("ch"), F.col("c_nationkey").cast("string")).alias("channelId")).alias("snippet"))
    rows = dumps.video_search_results(_json_rows(t, F.struct(F.array(item).alias("items"))))
    return rows.select("source_pos", "query", video_url("video_id").alias("url"), "channel", "title")


@query("S6", """SELECT c_custkey AS source_pos, 'v' || c_custkey AS video_id, c_name AS title FROM customer""")
def upload_results(t: Tables) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    item = F.struct(F.struct(
        F.col("c_name").alias("title"),
        F.struct(F.concat(F.lit("v"), key).alias("videoId")).alias("resourceId")).alias("snippet"))
    rows = dumps.upload_results(_json_rows(t, F.struct(F.array(item).alias("items"))))
    return rows.select("source_pos", "video_id", "title")


@query("S6, J8", """WITH f AS (SELECT 'UC' || c_nationkey || '_' || (c_custkey % 11) AS channel_id, c_custkey FROM customer)
SELECT DISTINCT channel_id FROM f WHERE channel_id NOT IN (SELECT 'UC' || n_nationkey || '_3' FROM nation)""")
def new_channels(t: Tables) -> DataFrame:
    cid = F.concat(F.lit("UC"), F.col("c_nationkey").cast("string"), F.lit("_"), (F.col("c_custkey") % 11).cast("string"))
    item = F.struct(F.struct(cid.alias("channelId")).alias("id"), F.struct(F.col("c_name").alias("title")).alias("snippet"))
    found = dumps.channel_search_results(_json_rows(t, F.struct(F.array(item).alias("items"))))
    existing = t.nation.selectExpr("'UC' || n_nationkey || '_3' AS channel_id")
    return discover.only_new(found.select("channel_id").distinct(), existing, "channel_id")


@query("S6, P9, U3", """SELECT DISTINCT 'http://f/' || c_nationkey || '/' || (c_custkey % 40) AS url FROM customer
WHERE c_mktsegment LIKE '%AU%' OR lower(c_name) LIKE '%7%' UNION SELECT 'http://known/' || n_nationkey FROM nation""")
def relevant_feed_list(t: Tables) -> DataFrame:
    from cribble.functions.urls import relevant_feed

    one = F.struct(
        F.concat(F.lit("http://f/"), F.col("c_nationkey").cast("string"), F.lit("/"), (F.col("c_custkey") % 40).cast("string")).alias("url"),
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("language"))
    found = dumps.feed_search_results(_json_rows(t, F.struct(F.array(one).alias("feeds"))))
    kept = found.where(relevant_feed("language", "title", ["au"], ["7"])).select("url")
    return discover.merge_sorted_distinct(kept, t.nation.selectExpr("'http://known/' || n_nationkey AS url"))


def _new_only(t: Tables, after: DataFrame) -> DataFrame:
    return after.join(t.orders.selectExpr("o_orderkey AS id"), "id", "left_anti")


@query("S6, U1, J1, F18", f"""WITH {QUEUE_SQL}, c AS (SELECT 0 AS part, c_custkey AS sp, c_custkey % 3 AS ip, 'https://www.youtube.com/watch?v=' || (c_custkey % 500) AS url,
'ch' || c_nationkey AS channel_id, 'q' || c_nationkey AS query FROM customer
UNION ALL SELECT 1, s_suppkey, 0, 'https://www.youtube.com/watch?v=' || (s_suppkey * 3), 'up' || s_nationkey, NULL FROM supplier
UNION ALL SELECT 2, p_partkey, 0, 'http://v/' || p_size, 'UC' || p_brand, NULL FROM part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, sp, ip) AS rn FROM c) WHERE rn = 1 AND url NOT IN (SELECT url FROM q))
SELECT (SELECT max(id) FROM q) + row_number() OVER (ORDER BY part, sp, ip, url) AS id, url, 'youtube' AS platform, channel_id, query FROM f""")
def video_discovery(t: Tables) -> DataFrame:
    searched = t.customer.selectExpr(
        "CAST(c_custkey % 500 AS STRING) AS video_id", "'ch' || c_nationkey AS channel", "'q' || c_nationkey AS query",
        "c_custkey AS source_pos", "c_custkey % 3 AS item_pos")
    uploads = t.supplier.selectExpr("CAST(s_suppkey * 3 AS STRING) AS video_id", "'up' || s_nationkey AS channel", "s_suppkey AS source_pos", "0L AS item_pos")
    channel_feeds = t.part.selectExpr("'http://v/' || p_size AS url", "'UC' || p_brand AS channel_id", "p_partkey AS source_pos", "0L AS item_pos")
    return _new_only(t, discover_videos(queue(t), searched, uploads, channel_feeds, now())).select(
        "id", "url", "platform", F.col("source_metadata")["channel_id"].alias("channel_id"), F.col("source_metadata")["query"].alias("query"))


@query("U4, J1", f"""WITH {QUEUE_SQL}, c AS (SELECT 'https://www.tiktok.com/' || (user_id % 97) AS url, event_id % 2 AS part, user_id AS sp, event_id AS ip,
event_type AS tag, 'u' || user_id AS usr FROM events),
g AS (SELECT url, min(part * 1000000000000000 + sp * 1000000000 + ip) AS o, arg_max(tag, sp * 1000000000 + ip) FILTER (WHERE part = 0) AS hashtag,
arg_max(usr, sp * 1000000000 + ip) FILTER (WHERE part = 1) AS user_name FROM c GROUP BY url)
SELECT (SELECT max(id) FROM q) + row_number() OVER (ORDER BY o) AS id, url, hashtag, user_name FROM g""")
def clip_discovery(t: Tables) -> DataFrame:
    place = ["'https://www.tiktok.com/' || (user_id % 97) AS url", "user_id AS source_pos", "event_id AS item_pos"]
    by_tag = t.events.where("event_id % 2 = 0").selectExpr(*place, "event_type AS tag")
    by_user = t.events.where("event_id % 2 = 1").selectExpr(*place, "'u' || user_id AS user")
    return _new_only(t, discover_clips(queue(t), by_tag, by_user, now())).select(
        "id", "url", F.col("source_metadata")["hashtag"].alias("hashtag"), F.col("source_metadata")["user"].alias("user_name"))


# --- De-duplication and caps ----------------------------------------------

@query("W1", f"""WITH {BASE_SQL} SELECT url, CAST(source_pos AS BIGINT) AS source_pos, item_pos, tag FROM ranked WHERE rn = 1""")
def first_seen(t: Tables) -> DataFrame:
    return discover.first_seen(candidates(t).select("url", "source_pos", "item_pos", "tag"))


@query("W4", """SELECT c_nationkey AS source, c_custkey AS item_pos FROM (SELECT *, row_number() OVER (
PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 20""")
def cap_per_source(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("c_nationkey AS source", "c_custkey AS item_pos")
    return discover.cap_per_source(rows, 20)


@query("W5", """WITH r AS (SELECT o_custkey AS feed, o_orderkey % 10 AS source_pos, o_orderkey AS item_pos FROM orders),
g AS (SELECT feed FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY source_pos, item_pos) AS rn FROM r)
WHERE rn = 1 ORDER BY source_pos, item_pos LIMIT 200)
SELECT feed, source_pos, item_pos FROM r WHERE feed IN (SELECT feed FROM g)""")
def cap_groups(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_custkey AS feed", "o_orderkey % 10 AS source_pos", "o_orderkey AS item_pos")
    return discover.cap_groups(rows, 200, "feed")


@query("U1", """WITH u AS (SELECT 'http://x/' || (c_custkey % 700) AS url, 0 AS part, c_custkey AS p, 'k' || c_custkey AS via FROM customer
UNION ALL SELECT 'http://x/' || p_partkey, 1, p_partkey, 'c' || p_partkey FROM part)
SELECT url, via FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, p) AS rn FROM u) WHERE rn = 1""")
def union_discovery(t: Tables) -> DataFrame:
    by_query = t.customer.selectExpr("'http://x/' || (c_custkey % 700) AS url", "0L AS source_pos", "c_custkey AS item_pos", "'k' || c_custkey AS via")
    by_channel = t.part.selectExpr("'http://x/' || p_partkey AS url", "0L AS source_pos", "p_partkey AS item_pos", "'c' || p_partkey AS via")
    return discover.union_discovery(by_query, by_channel).select("url", "via")


@query("U4", """WITH r AS (SELECT 'http://v/' || l_partkey AS url, CASE WHEN l_suppkey % 2 = 0 THEN 'tag' || l_suppkey END AS hashtag,
CASE WHEN l_suppkey % 2 = 1 THEN 'usr' || l_suppkey END AS usr, l_suppkey AS sp, l_orderkey * 10 + l_linenumber AS ip FROM lineitem)
SELECT url, arg_max(hashtag, sp * 10000000000 + ip) FILTER (WHERE hashtag IS NOT NULL) AS hashtag,
arg_max(usr, sp * 10000000000 + ip) FILTER (WHERE usr IS NOT NULL) AS usr, min(sp) AS source_pos FROM r GROUP BY 1""")
def merge_attributes(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr(
        "'http://v/' || l_partkey AS url", "CASE WHEN l_suppkey % 2 = 0 THEN 'tag' || l_suppkey END AS hashtag",
        "CASE WHEN l_suppkey % 2 = 1 THEN 'usr' || l_suppkey END AS user",
        "l_suppkey AS source_pos", "l_orderkey * 10 + l_linenumber AS item_pos")
    m = discover.merge_attributes(rows)
    return m.select(
        "url", F.try_element_at("source_metadata", F.lit("hashtag")).alias("hashtag"),
        F.try_element_at("source_metadata", F.lit("user")).alias("usr"), "source_pos")


@query("J8, U5, F10, P10", """WITH tags AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS token FROM part),
users AS (SELECT DISTINCT replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || p_size END), ' ', '') AS token FROM part)
SELECT token FROM users WHERE token NOT IN (SELECT token FROM tags) AND length(token) >= 4""")
def users_not_tags(t: Tables) -> DataFrame:
    tags = discover.clean_tokens(t.part.selectExpr("'#' || p_name AS token"))
    users = discover.clean_tokens(t.part.selectExpr(
        "'@' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || p_size END AS token"))
    return discover.only_new(users, tags, "token")


@query("A17", f"""WITH {BASE_SQL} SELECT count(DISTINCT url) AS discovered,
count(*) FILTER (WHERE rn = 1 AND url NOT IN (SELECT url FROM base)) AS inserted FROM ranked""")
def discovered_report(t: Tables) -> DataFrame:
    return discover.discovered_report(base(t), candidates(t))


@query("S4, P7, W1, J1", f"""WITH {FEED_SQL}, r AS (SELECT audio, feed_url, row_number() OVER (PARTITION BY audio ORDER BY
source_pos, item_pos) AS rn, source_pos, item_pos FROM au WHERE audio IS NOT NULL)
SELECT row_number() OVER (ORDER BY source_pos, item_pos) AS id, audio AS url, 'podcast' AS platform, feed_url FROM r WHERE rn = 1""")
def enqueue_feed_episodes(t: Tables) -> DataFrame:
    empty = queue(t).where("false")
    grown = discover_feed_episodes(empty, feeds.rss_items(feed_documents(t)), now())
    return grown.select("id", "url", "platform",
                        F.try_element_at("source_metadata", F.lit("feed_url")).alias("feed_url"))


# --- Routing and backfill --------------------------------------------------

ROUTE_SQL = f"""{QUEUE_SQL}, o AS (SELECT id, url, platform, id % 10 > 0 AS ok, CAST(CASE id % 6 WHEN 0 THEN 5e0 WHEN 1 THEN 6e0
WHEN 2 THEN 1200e0 WHEN 3 THEN 1200.5e0 WHEN 4 THEN 1201.5e0 ELSE duration_seconds END AS DOUBLE) AS duration FROM q),
{GATE_SQL}, r AS (SELECT *, CASE WHEN contains(lower(url), '//media.buzzsprout.com') THEN 1
WHEN platform = 'youtube' AND contains(url, '/shorts/') THEN 2
WHEN coalesce(platform NOT IN ('youtube', 'podcast', 'podcast_rss', 'tiktok'), true) THEN 3
WHEN NOT ok THEN 4 ELSE 5 END AS r FROM g)"""


@query("P12", f"""WITH {ROUTE_SQL}, s AS (SELECT *, CASE WHEN r < 3 THEN 'REJECTED' WHEN r = 3 THEN 'UNSUPPORTED_PLATFORM'
WHEN r = 4 OR too_long THEN 'ERROR_DOWNLOAD' WHEN cut < 6 THEN 'SKIPPED_LENGTH' ELSE 'DOWNLOADED' END AS status FROM r)
SELECT id, status, CASE WHEN r = 1 THEN 'host-blocked (buzzsprout)' WHEN r = 2 THEN 'youtube_short_skipped'
WHEN r = 3 THEN 'Unsupported platform: ' || coalesce(platform, 'None') WHEN r = 4 THEN 'probe ' || id
WHEN too_long THEN 'Podcast too long (' || printf('%.1f', duration) || 's > 1200s)' END AS error_msg,
CASE WHEN status = 'DOWNLOADED' THEN 'dl/' || id END AS audio_path,
CASE WHEN status = 'DOWNLOADED' THEN CAST(floor(cut) AS INT) END AS duration_seconds,
CASE WHEN r < 3 THEN 'gate' END AS reject_stage FROM s""")
def route_ingest(t: Tables) -> DataFrame:
    q = queue(t)
    probes = q.selectExpr(
        "id", "id % 10 > 0 AS ok", "'dl/' || id AS audio_path",
        "CAST(CASE id % 6 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 1200 WHEN 3 THEN 1200.5 WHEN 4 THEN 1201.5 "
        "ELSE duration_seconds END AS DOUBLE) AS duration",
        "'probe ' || id AS error")
    return ingest.route_ingest(q.select("id", "url", "platform"), probes)


BACKFILL_SQL = f"""{FEED_SQL}, um AS (SELECT audio AS url, arg_max(feed_url, source_pos * 100 + item_pos) AS feed_url FROM au
WHERE audio IS NOT NULL GROUP BY 1), pq AS (SELECT p_partkey AS id, 'http://a.example.org/' || p_size || '/' || (p_partkey % 50) || '.mp3' AS url
FROM part), bf AS (SELECT id, pq.url, um.url IS NOT NULL AS matched, um.feed_url FROM pq LEFT JOIN um ON pq.url = um.url)"""


def backfilled(t: Tables) -> DataFrame:
    from cribble.functions.meta import episode_meta
    from cribble.functions.urls import pick_audio_url

    entries = feeds.rss_items(feed_documents(t)).select(
        pick_audio_url("enclosures", "links", enclosure_href=True).alias("url"),
        episode_meta("feed_url").alias("meta"), "source_pos", "item_pos")
    q = t.part.selectExpr(
        "p_partkey AS id", "'http://a.example.org/' || p_size || '/' || (p_partkey % 50) || '.mp3' AS url",
        "'podcast' AS platform", "CAST(NULL AS map<string,string>) AS source_metadata")
    return backfill.backfill_metadata(q, backfill.url_metadata(entries))


@query("J4", f"WITH {BACKFILL_SQL} SELECT id, url, matched, feed_url FROM bf")
def backfill_metadata(t: Tables) -> DataFrame:
    return backfilled(t).select(
        "id", "url", "matched", F.try_element_at("source_metadata", F.lit("feed_url")).alias("feed_url"))


@query("J4, A7", f"WITH {BACKFILL_SQL} SELECT count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS unmatched FROM bf")
def backfill_report(t: Tables) -> DataFrame:
    return backfill.backfill_report(backfilled(t))
