"""Selection, insertion, transitions and count reports over the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.catalog.registry import NOW, QUEUE_SQL, Tables, as_text, now, query, queue
from cribble.operators import queue as ops
from cribble.operators import reports

STAMP = f"'{NOW}'"


@query("P1", f"""WITH {QUEUE_SQL} SELECT id, url, CAST(discovered_at AS STRING) AS discovered_at FROM q
WHERE status = 'DISCOVERED'""")
def fetch_by_status(t: Tables) -> DataFrame:
    return ops.fetch(queue(t), "DISCOVERED").select("id", "url", *as_text("discovered_at"))


@query("T1, P1", f"""WITH {QUEUE_SQL} SELECT id, CAST(discovered_at AS STRING) AS discovered_at FROM q
WHERE status = 'DISCOVERED' AND platform = 'youtube' ORDER BY q.discovered_at, id LIMIT 600""")
def next_batch(t: Tables) -> DataFrame:
    return ops.next_batch(queue(t), "DISCOVERED", "youtube", 600).select(
        "id", *as_text("discovered_at"))


@query("P2", f"WITH {QUEUE_SQL} SELECT id FROM q WHERE status = 'SCREENED' AND meta_kind <> 'null'")
def screened_with_metadata(t: Tables) -> DataFrame:
    return ops.with_metadata(queue(t)).select("id")


@query("P3", f"""WITH {QUEUE_SQL} SELECT id, platform FROM q WHERE platform IN ('podcast', 'podcast_rss')
AND meta_kind = 'null'""")
def needs_backfill(t: Tables) -> DataFrame:
    return ops.needs_backfill(queue(t)).select("id", "platform")


@query("T2", f"WITH {QUEUE_SQL} SELECT id, status, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS n FROM q")
def numbered_items(t: Tables) -> DataFrame:
    from cribble.operators.ranking import number_rows

    return number_rows(queue(t).select("id", "status"), "id", "n")


# Candidates: pages three times over (two sources and a re-listing), beside
# a queue that already holds the .com pages.
BASE_SQL = """base AS (SELECT page_id AS id, url FROM pages WHERE contains(url, '.com/')),
cand AS (SELECT url, page_id % 5 AS source_pos, page_id AS item_pos, 'a' || page_id AS tag FROM pages
UNION ALL SELECT url, page_id % 7 + 5 AS source_pos, page_id + 1 AS item_pos, 'b' || page_id AS tag FROM pages
UNION ALL SELECT url, page_id % 5 AS source_pos, page_id + 1000000 AS item_pos, 'c' || page_id AS tag FROM pages
UNION ALL SELECT 'http://hot.example.org/' AS url, 20 AS source_pos, page_id AS item_pos, 'h' || page_id AS tag FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_pos, item_pos) AS rn FROM cand)"""


def base(t: Tables) -> DataFrame:
    return t.pages.where("contains(url, '.com/')").selectExpr("page_id AS id", "url")


def candidates(t: Tables) -> DataFrame:
    p = t.pages
    first = p.selectExpr("url", "page_id % 5 AS source_pos", "page_id AS item_pos", "'a' || page_id AS tag")
    second = p.selectExpr("url", "page_id % 7 + 5 AS source_pos", "page_id + 1 AS item_pos", "'b' || page_id AS tag")
    third = p.selectExpr("url", "page_id % 5 AS source_pos", "page_id + 1000000 AS item_pos", "'c' || page_id AS tag")
    hot = p.selectExpr("'http://hot.example.org/' AS url", "20 AS source_pos", "page_id AS item_pos", "'h' || page_id AS tag")
    return first.unionByName(second).unionByName(third).unionByName(hot).withColumns({
        "platform": F.lit("podcast"),
        "source_metadata": F.create_map(F.lit("hashtag"), F.col("tag")),
    })


@query("J1", f"""WITH {BASE_SQL} SELECT id + (SELECT max(id) FROM base) AS id, url, hashtag, status, discovered_at FROM (
SELECT row_number() OVER (ORDER BY source_pos, item_pos) AS id, url, tag AS hashtag, 'DISCOVERED' AS status,
{STAMP} AS discovered_at FROM ranked WHERE rn = 1 AND url NOT IN (SELECT url FROM base))
UNION ALL SELECT id, url, NULL, NULL, NULL FROM base""")
def insert_if_absent(t: Tables) -> DataFrame:
    grown = ops.insert_if_absent(base(t), candidates(t), now())
    return grown.select(
        "id", "url", F.try_element_at("source_metadata", F.lit("hashtag")).alias("hashtag"),
        "status", *as_text("discovered_at"),
    )


@query("J1", f"""WITH {BASE_SQL} SELECT url, CAST(source_pos AS BIGINT) AS source_pos, item_pos,
rn = 1 AND url NOT IN (SELECT url FROM base) AS inserted FROM ranked""")
def inserted_flags(t: Tables) -> DataFrame:
    return ops.flag_inserted(base(t), candidates(t)).select("url", "source_pos", "item_pos", "inserted")


# --- Transitions -----------------------------------------------------------

@query("X1", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN status = 'DOWNLOADED' THEN CASE WHEN audio_path IS NULL THEN 'ERROR_SCREEN'
ELSE 'SCREENED' END ELSE status END AS status,
CASE WHEN status = 'DOWNLOADED' THEN CASE WHEN audio_path IS NULL THEN 'no audio' END ELSE error_msg END AS error_msg,
CASE WHEN status = 'DOWNLOADED' THEN {STAMP} ELSE CAST(last_update_at AS STRING) END AS last_update_at FROM q""")
def transition(t: Tables) -> DataFrame:
    q = queue(t)
    updates = q.where("status = 'DOWNLOADED'").selectExpr(
        "id", "CASE WHEN audio_path IS NULL THEN 'ERROR_SCREEN' ELSE 'SCREENED' END AS status",
        "CASE WHEN audio_path IS NULL THEN 'no audio' END AS error_msg")
    stray = q.selectExpr("-1 - id AS id", "'X' AS status", "'x' AS error_msg")
    return ops.transition(q, updates.unionByName(stray), now()).select(
        "id", "status", "error_msg", *as_text("last_update_at"))


@query("X2", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN status = 'DISCOVERED' THEN 'DOWNLOADED' ELSE status END AS status,
CASE WHEN status = 'DISCOVERED' THEN 'new/' || id ELSE audio_path END AS audio_path,
CASE WHEN status = 'DISCOVERED' THEN duration_seconds + 1 ELSE duration_seconds END AS duration_seconds,
CASE WHEN status = 'DISCOVERED' THEN NULL ELSE error_msg END AS error_msg FROM q""")
def mark_downloaded(t: Tables) -> DataFrame:
    q = queue(t)
    updates = q.where("status = 'DISCOVERED'").selectExpr(
        "id", "'new/' || id AS audio_path", "duration_seconds + 1 AS duration_seconds")
    return ops.mark_downloaded(q, updates, now()).select(
        "id", "status", "audio_path", "duration_seconds", "error_msg")


@query("X3", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN status = 'SCREENED' THEN 'REJECTED' ELSE status END AS status, error_msg,
CASE WHEN status = 'SCREENED' THEN CAST(duration_seconds % 64 AS DOUBLE) / 128e0 END AS model_probability FROM q""")
def mark_rejected(t: Tables) -> DataFrame:
    q = queue(t)
    reason = F.struct(
        (F.col("duration_seconds") % 64 / 128).alias("model_probability"),
        F.lit(None).cast(q.schema["rejection_reason"].dataType["diagnostics"].dataType).alias("diagnostics"),
    )
    updates = q.where("status = 'SCREENED'").select("id", reason.alias("rejection_reason"))
    return ops.mark_rejected(q, updates, now()).select(
        "id", "status", "error_msg", F.col("rejection_reason.model_probability").alias("model_probability"))


@query("X4", f"""WITH {QUEUE_SQL} SELECT id, status, CASE WHEN meta_kind = 'null' THEN 'n' || id
WHEN meta_kind = 'full' THEN meta_channel END AS channel_id FROM q""")
def set_metadata(t: Tables) -> DataFrame:
    q = queue(t)
    updates = q.where("source_metadata IS NULL").select("id", F.create_map(
        F.lit("channel_id"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("source_metadata"))
    return ops.set_metadata(q, updates, now()).select(
        "id", "status", F.try_element_at("source_metadata", F.lit("channel_id")).alias("channel_id"))


@query("X5", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN status IN ('REJECTED', 'BORDERLINE_LB', 'POTENTIAL_LB',
'WEAK_POSITIVE', 'WEAK_NEGATIVE') THEN 'SCREENED' ELSE status END AS status,
CAST(last_update_at AS STRING) AS last_update_at FROM q""")
def reset_for_rescoring(t: Tables) -> DataFrame:
    return ops.reset_for_rescoring(queue(t)).select("id", "status", *as_text("last_update_at"))


@query("X6", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN platform = 'youtube' AND status IN ('WEAK_POSITIVE',
'WEAK_NEGATIVE', 'SCREENED_NO_LABEL') THEN 'SCREENED' ELSE status END AS status FROM q""")
def reset_weak_labels(t: Tables) -> DataFrame:
    return ops.reset_weak_labels(queue(t)).select("id", "status")


DOWN = "(platform IN ('podcast', 'podcast_rss') AND status = 'DOWNLOADED')"


@query("X7", f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN {DOWN} THEN 'DISCOVERED' ELSE status END AS status,
CASE WHEN {DOWN} THEN NULL ELSE audio_path END AS audio_path,
CASE WHEN {DOWN} THEN NULL ELSE duration_seconds END AS duration_seconds,
CASE WHEN {DOWN} THEN NULL ELSE error_msg END AS error_msg,
CASE WHEN {DOWN} THEN {STAMP} ELSE CAST(last_update_at AS STRING) END AS last_update_at FROM q""")
def reset_downloads(t: Tables) -> DataFrame:
    return ops.reset_downloads(queue(t), now()).select(
        "id", "status", "audio_path", "duration_seconds", "error_msg", *as_text("last_update_at"))


RETRY = "platform = 'youtube' AND status = 'ERROR_DOWNLOAD' AND meta_kind <> 'null'"


@query("X8", f"""WITH {QUEUE_SQL}, hit AS (SELECT id FROM q WHERE {RETRY} ORDER BY id LIMIT 50)
SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN 'DISCOVERED' ELSE status END AS status,
CASE WHEN id IN (SELECT id FROM hit) THEN NULL ELSE audio_path END AS audio_path FROM q""")
def retry_errors(t: Tables) -> DataFrame:
    return ops.retry_errors(queue(t), now(), limit=50).select("id", "status", "audio_path")


@query("X8", f"WITH {QUEUE_SQL} SELECT count(*) AS n FROM q WHERE {RETRY}")
def count_retryable(t: Tables) -> DataFrame:
    return ops.count_retryable(queue(t))


@query("X9", """SELECT user_id, event_type AS status, event_id, value FROM (SELECT *, row_number() OVER (
PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def fold_transitions(t: Tables) -> DataFrame:
    log = t.events.selectExpr("user_id", "ts", "event_id", "event_type AS status", "value")
    return ops.fold_transitions(log, "user_id", "ts", "event_id").drop("ts")


# --- Reports ---------------------------------------------------------------

DOMAIN_SQL = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{s}' AS status" for i, s in enumerate(S.SUMMARY_STATUSES)
)
IN_DOMAIN = "(" + ", ".join(f"'{s}'" for s in S.SUMMARY_STATUSES) + ")"


@query("A1", f"""WITH {QUEUE_SQL}, dom AS ({DOMAIN_SQL}), c AS (SELECT status, count(*) AS n FROM q GROUP BY 1)
SELECT CAST(pos AS INT) AS pos, dom.status, coalesce(n, 0) AS n FROM dom LEFT JOIN c ON dom.status = c.status
UNION ALL SELECT 11, 'TOTAL', count(*) FROM q WHERE status IN {IN_DOMAIN}""")
def status_summary(t: Tables) -> DataFrame:
    return reports.status_summary(queue(t))


@query("A2", f"""WITH {QUEUE_SQL} SELECT coalesce(nullif(platform, ''), 'UNKNOWN') AS platform, count(*) AS n
FROM q WHERE status IN {IN_DOMAIN} GROUP BY 1""")
def platform_summary(t: Tables) -> DataFrame:
    return reports.platform_summary(queue(t))


@query("A3, T2", f"""WITH {QUEUE_SQL}, y AS (SELECT status, meta_kind <> 'null' AS m FROM q WHERE platform = 'youtube')
SELECT status, count(*) AS n, count(*) FILTER (WHERE m) AS n_with_metadata FROM y GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (WHERE m) FROM y""")
def stage_counts(t: Tables) -> DataFrame:
    return reports.stage_counts(queue(t))


@query("A6", "SELECT p_type AS dialect, count(*) AS n FROM part GROUP BY 1")
def counts_by_class(t: Tables) -> DataFrame:
    return reports.counts_by_class(t.part.withColumnRenamed("p_type", "dialect"))


@query("A6", f"""WITH {QUEUE_SQL} SELECT meta_channel AS dialect, count(*) AS n FROM q WHERE platform = 'adi17'
AND meta_kind = 'full' AND meta_channel IS NOT NULL GROUP BY 1""")
def existing_by_class(t: Tables) -> DataFrame:
    return reports.existing_by_class(queue(t), key="channel_id")


@query("A14", f"""WITH {QUEUE_SQL} SELECT status, platform, count(*) AS n,
CAST(grouping(status) * 2 + grouping(platform) AS INT) AS level FROM q GROUP BY CUBE (status, platform)""")
def status_by_platform(t: Tables) -> DataFrame:
    return reports.status_by_platform(queue(t))
