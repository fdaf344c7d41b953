"""File listings, and the sources and sinks that write to the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.labelling import SAMPLE_SQL, TRUTH
from cribble.catalog.registry import (
    QUEUE_SQL,
    SAMPLES_SQL,
    Tables,
    as_text,
    now,
    query,
    queue,
    transcripts,
)
from cribble.functions.urls import stable_name
from cribble.operators import files, reports
from cribble.operators import queue as queue_ops
from cribble.operators.queue import apply_conversions
from cribble.plans.stages import annotation_sample
from cribble.sources.annotations import read_annotations, write_annotations, write_sample
from cribble.sources.tables import read_contrastive, read_queue, scratch_path, write_queue
from cribble.sources.transcripts import flatten_samples, read_transcripts, write_transcripts
from cribble.streaming.dedup import dedup_ingest, distinct_urls
from cribble.streaming.drain import drain, drain_status, read_claimed, read_drained

LIST_SQL = "ls AS (SELECT 'raw/' || l_orderkey || CASE l_linenumber % 2 WHEN 0 THEN '.wav' ELSE '.FLAC' END AS path FROM lineitem GROUP BY 1)"


def listing(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "'raw/' || l_orderkey || CASE l_linenumber % 2 WHEN 0 THEN '.wav' ELSE '.FLAC' END AS path").distinct()


@query("J9", f"WITH {QUEUE_SQL}, {LIST_SQL} SELECT path FROM ls WHERE path NOT IN (SELECT audio_path FROM q WHERE audio_path IS NOT NULL)")
def orphan_files(t: Tables) -> DataFrame:
    return files.orphan_files(listing(t), queue(t))


@query("P13", f"WITH {QUEUE_SQL}, {LIST_SQL} SELECT id, audio_path FROM q WHERE audio_path IN (SELECT path FROM ls)")
def usable_audio(t: Tables) -> DataFrame:
    return files.usable_audio(queue(t), listing(t)).select("id", "audio_path")


@query("J9, F8", f"""WITH {QUEUE_SQL}, nm AS (SELECT id, status, 'podcast_' || sha1(url) || CASE WHEN url LIKE '%.mp3' THEN '.mp3'
WHEN lower(url) LIKE '%.ogg' AND NOT contains(url, '?') THEN '.ogg' WHEN contains(url, '.M4A?') THEN '.m4a' ELSE '.mp3' END AS name FROM q)
SELECT 'd/' || name AS path, id, status FROM nm WHERE status = 'ERROR_DOWNLOAD' UNION ALL
SELECT 'd/x' || p_partkey, NULL, NULL FROM part""")
def orphan_owners(t: Tables) -> DataFrame:
    q = queue(t)
    left = q.where("status = 'ERROR_DOWNLOAD'").select(F.concat(F.lit("d/"), stable_name("url")).alias("path"))
    listed = left.unionByName(t.part.selectExpr("'d/x' || p_partkey AS path"))
    return files.orphan_owners(files.orphan_files(listed, q), q).select("path", "id", "status")


CONV_SQL = f"""{QUEUE_SQL}, w AS (SELECT id, audio_path, CASE WHEN id % 13 = 0 OR duration_seconds < 200 THEN 'missing' WHEN id % 5 = 0 THEN 'encode_fail'
WHEN id % 7 = 0 THEN 'verify_fail' ELSE 'ok' END AS outcome FROM q WHERE lower(audio_path) LIKE '%.wav')"""


def converted(t: Tables) -> DataFrame:
    q = queue(t)
    results = q.where("duration_seconds >= 200").selectExpr(
        "id", "id % 13 <> 0 AS found", "id % 5 <> 0 AS encoded", "id % 7 <> 0 AS verified")
    return files.conversion_outcomes(files.by_extension(q).select("id", "audio_path"), results)


@query("F19, P18", f"""WITH {CONV_SQL} SELECT id, outcome, CASE WHEN outcome = 'ok' THEN left(audio_path, length(audio_path) - 4) || '.flac'
ELSE audio_path END AS audio_path FROM w""")
def conversion_outcomes(t: Tables) -> DataFrame:
    return converted(t).select("id", "outcome", "audio_path")


@query("P18, X4", f"""WITH {CONV_SQL} SELECT q.id, q.status, CASE WHEN w.outcome = 'ok' THEN left(q.audio_path, length(q.audio_path) - 4) || '.flac'
ELSE q.audio_path END AS audio_path, CAST(q.last_update_at AS STRING) AS last_update_at FROM q LEFT JOIN w ON q.id = w.id""")
def conversions_applied(t: Tables) -> DataFrame:
    done = converted(t).where("outcome = 'ok'").select("id", "audio_path")
    return apply_conversions(queue(t), done).select("id", "status", "audio_path", *as_text("last_update_at"))


@query("A7", f"WITH {CONV_SQL} SELECT " + ", ".join(
    f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("ok", "missing", "encode_fail", "verify_fail")) + ", count(*) AS total FROM w")
def conversion_report(t: Tables) -> DataFrame:
    return reports.outcome_report(converted(t), ("ok", "missing", "encode_fail", "verify_fail"))


# --- Sources and sinks -----------------------------------------------------

@query("S1", f"""WITH {QUEUE_SQL} SELECT id, url, status, CAST(discovered_at AS STRING) AS discovered_at, audio_path, duration_seconds
FROM q WHERE status = 'SCREENED'""")
def queue_written_and_read(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "queue")
    write_queue(queue(t), path)
    back = read_queue(t.spark, path).where(F.col("status") == "SCREENED")
    return back.select("id", "url", "status", *as_text("discovered_at"), "audio_path", "duration_seconds")


@query("S2, S3", f"WITH {SAMPLES_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY sample_idx) - 1 AS INT) AS sample_idx, language, language_probability, text FROM s")
def transcripts_written_and_read(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "transcripts")
    write_transcripts(transcripts(t), path)
    return flatten_samples(read_transcripts(t.spark, path, multi_line=False)).select(
        "id", "sample_idx", "language", "language_probability", "text")


@query("S7", "SELECT lang AS dialect, count(*) AS n FROM documents GROUP BY 1")
def contrastive_classes(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "contrastive")
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("dialect"),
        F.struct(F.encode("text", "UTF-8").alias("bytes")).alias("audio"))
    paths = []
    for part in (0, 1):
        paths.append(f"{folder}/{part}")
        rows.where(F.col("id").cast("long") % 2 == part).write.parquet(paths[-1])
    return reports.counts_by_class(read_contrastive(t.spark, paths))


@query("S8", f"SELECT event_id AS item_id, {TRUTH} AS ground_truth, CASE WHEN event_id % 2 = 0 THEN 'a \"b\", ' || event_type ELSE event_type END AS notes FROM events")
def annotations_written_and_read(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "annotations")
    rows = t.events.selectExpr(
        "event_id AS item_id", "'SCREENED' AS source_status", "'youtube' AS platform", "CAST(NULL AS STRING) AS audio_path",
        f"{TRUTH} AS ground_truth", "CASE WHEN event_id % 2 = 0 THEN 'a \"b\", ' || event_type ELSE event_type END AS notes",
        "CAST(ts AS STRING) AS timestamp")
    write_annotations(rows, path)
    return read_annotations(t.spark, path).select("item_id", "ground_truth", "notes")


@query("S10", f"WITH {SAMPLE_SQL} SELECT id, source_status, pos FROM smp")
def sample_written_once(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sample")
    write_sample(annotation_sample(queue(t)), path)
    again = write_sample(annotation_sample(queue(t), seed=7), path)
    return again.select("id", "source_status", "pos")


# --- Streams ---------------------------------------------------------------

def _drop_files(rows: DataFrame, path: str, n: int) -> None:
    rows.repartition(n, "user_id").write.parquet(path)


@query("Z1", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
def drain_clicks(t: Tables) -> DataFrame:
    home = scratch_path(t.spark, "drain")
    rows = t.events.withColumn("status", F.col("event_type"))
    _drop_files(rows, f"{home}/in", 7)
    drain(t.spark, f"{home}/in", rows.schema, lambda b: b.select("event_id", "event_type", "value"),
          f"{home}/out", f"{home}/ck", files_per_batch=3, status="click")
    return read_drained(t.spark, f"{home}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("Z1, X5", f"""WITH {QUEUE_SQL} SELECT id, CAST(1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS times FROM q WHERE status = 'SCREENED'""")
def drain_by_status(t: Tables) -> DataFrame:
    """Items are drained, half of them put back for rescoring, and drained again; a third call finds none."""
    out = f"{scratch_path(t.spark, 'by-status')}/out"
    items = queue(t)
    take = lambda b: b.select("id")
    drain_status(items, "SCREENED", take, out, per_batch=max(1, items.where("status = 'SCREENED'").count() // 2))
    tier = F.when(F.col("id") % 2 == 0, "REJECTED").otherwise("WEAK_POSITIVE")
    scored = queue_ops.transition(items, items.where("status = 'SCREENED'").select("id", tier.alias("status")), now())
    # Of those rejected, only the drained ones bear the new stamp and come back to be scored.
    back = queue_ops.reset_for_rescoring(scored.where((F.col("last_update_at") == now()) | (F.col("status") != "REJECTED")), ["REJECTED"])
    drain_status(back, "SCREENED", take, out)
    drain_status(back, "SCREENED", take, out)
    return read_claimed(t.spark, out).groupBy("id").agg(F.count(F.lit(1)).alias("times"))


@query("Z2", "SELECT 'u' || user_id || '/' || event_type AS url, count(*) AS copies FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def dedup_stream(t: Tables) -> DataFrame:
    home = scratch_path(t.spark, "dedup")
    rows = t.events.selectExpr(
        "'u' || user_id || '/' || event_type AS url", "user_id AS source_pos", "event_id AS item_pos", "event_id AS user_id")
    _drop_files(rows, f"{home}/in", 6)
    dedup_ingest(t.spark, f"{home}/in", rows.schema, f"{home}/out", f"{home}/ck", files_per_batch=2)
    return t.spark.read.parquet(f"{home}/out").groupBy("url").agg(F.count(F.lit(1)).alias("copies"))


@query("Z2", "SELECT 'u' || user_id || '/' || event_type AS url, count(*) AS copies FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def distinct_url_stream(t: Tables) -> DataFrame:
    home = scratch_path(t.spark, "distinct")
    rows = t.events.selectExpr("'u' || user_id || '/' || event_type AS url", "event_id AS user_id")
    _drop_files(rows, f"{home}/in", 6)
    waiting = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
    run = distinct_urls(waiting).select("url").writeStream.format("parquet").option("path", f"{home}/out").option(
        "checkpointLocation", f"{home}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(f"{home}/out").groupBy("url").agg(F.count(F.lit(1)).alias("copies"))
