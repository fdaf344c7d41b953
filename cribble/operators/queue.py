"""The item table: selection, insertion and state changes.

Each change is a function from a queue DataFrame to a new one. Write the
result to a new path; never over the files being read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.operators.ranking import number_rows
from cribble.schemas import QUEUE
from cribble.sources.tables import materialize


# --- Selection -------------------------------------------------------------

def fetch(
    queue: DataFrame, status: str, platform: str | None = None, limit: int | None = None
) -> DataFrame:
    """Items in one status, oldest first; ``id`` breaks ties. A limit becomes a top-n."""
    picked = queue.where(F.col("status") == status)
    if platform is not None:
        picked = picked.where(F.col("platform") == platform)
    picked = picked.orderBy("discovered_at", "id")
    return picked if limit is None else picked.limit(limit)


def next_batch(queue: DataFrame, status: str, platform: str, n: int) -> DataFrame:
    return fetch(queue, status, platform, n)


def with_metadata(
    queue: DataFrame, status: str = S.SCREENED, limit: int | None = None
) -> DataFrame:
    """Items whose metadata is stored at all; an empty object counts as stored."""
    picked = queue.where(
        (F.col("status") == status) & F.col("source_metadata").isNotNull()
    ).orderBy("id")
    return picked if limit is None else picked.limit(limit)


def needs_backfill(
    queue: DataFrame, platforms: Sequence[str] = S.PODCAST_PLATFORMS, limit: int | None = None
) -> DataFrame:
    picked = queue.where(
        F.col("platform").isin(*platforms) & F.col("source_metadata").isNull()
    ).orderBy("id")
    return picked if limit is None else picked.limit(limit)


# --- Insertion -------------------------------------------------------------

NEW_ITEM_VALUES = ("platform", "source_metadata", "audio_path", "duration_seconds")


def _first_per_url(candidates: DataFrame) -> DataFrame:
    """Keep each URL's earliest candidate; partial aggregation absorbs hot URLs."""
    rest = [c for c in candidates.columns if c != "url"]
    return (
        candidates.groupBy("url")
        .agg(F.min_by(F.struct(*rest), F.struct("source_pos", "item_pos")).alias("c"))
        .select("url", "c.*")
    )


def flag_inserted(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with ``inserted``: first of their URL in the batch and not queued yet."""
    firsts = _first_per_url(candidates).select("url", "source_pos", "item_pos")
    new = firsts.join(queue.select("url"), "url", "left_anti").select(
        "url", "source_pos", "item_pos", F.lit(True).alias("inserted")
    )
    return candidates.join(new, ["url", "source_pos", "item_pos"], "left").withColumn(
        "inserted", F.coalesce("inserted", F.lit(False))
    )


def new_items(queue: DataFrame, candidates: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows to append for the candidates that are not queued.

    Candidates carry ``url, platform, source_metadata, source_pos, item_pos``.
    Ids continue the queue's in discovery order. With ``audio_path`` and
    ``duration_seconds`` they enter as DOWNLOADED, else as DISCOVERED.
    """
    stamp = now if isinstance(now, Column) else F.lit(now)
    fresh = _first_per_url(candidates).join(queue.select("url"), "url", "left_anti")
    # Parsing, de-duplication and the anti-join run once; numbering then reads
    # only the new rows.
    placed = materialize(
        fresh.select(
            "url", "source_pos", "item_pos", *[c for c in NEW_ITEM_VALUES if c in fresh.columns]
        ),
        "new-items",
    )
    last_id = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    numbered = number_rows(placed, ["source_pos", "item_pos", "url"], "_n")
    loaded = "audio_path" in placed.columns
    values = {
        "id": F.col("_n") + F.lit(last_id + 1),
        "url": F.col("url"),
        "platform": F.col("platform"),
        "status": F.lit(S.DOWNLOADED if loaded else S.DISCOVERED),
        "discovered_at": stamp,
        "last_update_at": stamp,
        "source_metadata": F.col("source_metadata"),
    }
    if loaded:
        # Durations are cut to whole seconds.
        values |= {"audio_path": F.col("audio_path"), "duration_seconds": F.col("duration_seconds")}
    return numbered.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in QUEUE.fields]
    )


def insert_if_absent(
    queue: DataFrame, candidates: DataFrame, now: datetime | Column
) -> DataFrame:
    return queue.unionByName(new_items(queue, candidates, now), allowMissingColumns=True)


# --- State changes ---------------------------------------------------------

def _once_per_id(updates: DataFrame) -> DataFrame:
    """Updates keyed by ``id``; a second update for one id fails the query.

    The check sits on the shuffle that the join by id needs anyway.
    """
    rest = [c for c in updates.columns if c != "id"]
    folded = updates.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("u")
    )
    once = F.when(F.col("_n") == 1, F.col("u")).otherwise(
        F.raise_error(F.concat(F.lit("more than one update for id "), F.col("id")))
    )
    return folded.select("id", once.alias("u"))


def _apply(queue: DataFrame, updates: DataFrame, values: dict[str, Column]) -> DataFrame:
    joined = queue.join(_once_per_id(updates), "id", "left")
    hit = F.col("u").isNotNull()
    return joined.select(*[
        F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in queue.columns
    ])


def transition(queue: DataFrame, updates: DataFrame, now: datetime | Column) -> DataFrame:
    """Set status and ``error_msg`` from ``updates(id, status[, error_msg])``.

    The message is cleared where the update gives none. Unknown ids are ignored.
    """
    stamp = now if isinstance(now, Column) else F.lit(now)
    if "error_msg" not in updates.columns:
        updates = updates.withColumn("error_msg", F.lit(None).cast("string"))
    return _apply(queue, updates, {
        "status": F.col("u.status"), "error_msg": F.col("u.error_msg"), "last_update_at": stamp,
    })


def mark_downloaded(queue: DataFrame, updates: DataFrame, now: datetime | Column) -> DataFrame:
    """Store path and duration from ``updates(id, audio_path, duration_seconds)``."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    return _apply(queue, updates, {
        "status": F.lit(S.DOWNLOADED),
        "audio_path": F.col("u.audio_path"),
        "duration_seconds": F.col("u.duration_seconds").cast("int"),
        "error_msg": F.lit(None).cast("string"),
        "last_update_at": stamp,
    })


def apply_conversions(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Store the new path from ``updates(id, audio_path)``; nothing else changes."""
    return _apply(queue, updates, {"audio_path": F.col("u.audio_path")})


def mark_rejected(queue: DataFrame, updates: DataFrame, now: datetime | Column) -> DataFrame:
    """Reject with a structured reason from ``updates(id, rejection_reason)``; keeps ``error_msg``."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    return _apply(queue, updates, {
        "status": F.lit(S.REJECTED),
        "rejection_reason": F.col("u.rejection_reason"),
        "last_update_at": stamp,
    })


def set_metadata(queue: DataFrame, updates: DataFrame, now: datetime | Column) -> DataFrame:
    """Replace metadata from ``updates(id, source_metadata)``; the status stays."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    return _apply(queue, updates, {
        "source_metadata": F.col("u.source_metadata"), "last_update_at": stamp,
    })


def _where(queue: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    return queue.select(*[
        F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in values else F.col(f.name)
        for f in queue.schema.fields
    ])


def reset_for_rescoring(
    queue: DataFrame, statuses: Sequence[str] = S.RESCORE_STATUSES
) -> DataFrame:
    """Back to SCREENED without a reason; the timestamp stays."""
    return _where(queue, F.col("status").isin(*statuses), {
        "status": F.lit(S.SCREENED), "rejection_reason": F.lit(None),
    })


def reset_weak_labels(
    queue: DataFrame, platform: str = "youtube",
    statuses: Sequence[str] = S.LABEL_RESET_STATUSES,
) -> DataFrame:
    hit = (F.col("platform") == platform) & F.col("status").isin(*statuses)
    return _where(queue, hit, {"status": F.lit(S.SCREENED)})


def _back_to_discovered(queue: DataFrame, hit: Column, now: datetime | Column) -> DataFrame:
    stamp = now if isinstance(now, Column) else F.lit(now)
    return _where(queue, hit, {
        "status": F.lit(S.DISCOVERED),
        "audio_path": F.lit(None),
        "duration_seconds": F.lit(None),
        "error_msg": F.lit(None),
        "last_update_at": stamp,
    })


def reset_downloads(
    queue: DataFrame, now: datetime | Column, platforms: Sequence[str] = S.PODCAST_PLATFORMS
) -> DataFrame:
    hit = F.col("platform").isin(*platforms) & (F.col("status") == S.DOWNLOADED)
    return _back_to_discovered(queue, hit, now)


def _retryable(platform: str) -> Column:
    return (
        (F.col("platform") == platform)
        & (F.col("status") == S.ERROR_DOWNLOAD)
        & F.col("source_metadata").isNotNull()
    )


def count_retryable(queue: DataFrame, platform: str = "youtube") -> DataFrame:
    """The dry run of ``retry_errors``."""
    return queue.agg(F.count_if(_retryable(platform)).alias("n"))


def retry_errors(
    queue: DataFrame, now: datetime | Column, platform: str = "youtube", limit: int | None = None
) -> DataFrame:
    """Send failed downloads that have metadata back to DISCOVERED, lowest ids first.

    The n-th lowest id is found by a top-n, after which the update is a plain filter.
    """
    hit = _retryable(platform)
    if limit is not None:
        last = (
            queue.where(hit).select("id").orderBy("id").limit(limit)
            .agg(F.max("id").alias("m")).first().m
        )
        hit = hit & (F.col("id") <= F.lit(last)) if last is not None else F.lit(False)
    return _back_to_discovered(queue, hit, now)


def fold_transitions(
    log: DataFrame, id_col: str = "id", ts_col: str = "ts", seq_col: str = "seq"
) -> DataFrame:
    """Current state per id from a transition log: the latest row by (time, sequence).

    ``max_by`` combines map-side, so an id with very many transitions is no hot spot.
    """
    rest = [c for c in log.columns if c != id_col]
    return (
        log.groupBy(id_col)
        .agg(F.max_by(F.struct(*rest), F.struct(ts_col, seq_col)).alias("last"))
        .select(id_col, "last.*")
    )
