"""Routing of discovered items by URL rules and probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.media import duration_gate
from cribble.functions.urls import host_blocked, is_short


def route_ingest(
    items: DataFrame,
    probes: DataFrame,
    limits: S.AudioLimits = S.AudioLimits(),
    blocked_host: str = S.BLOCKED_HOST,
) -> DataFrame:
    """Outcome per item: ``id, status, error_msg, audio_path, duration_seconds, reject_stage``.

    ``probes(id, ok, audio_path, duration, error)`` holds what fetching gave.
    The first rule that applies wins: blocked host, Shorts, unknown platform,
    failed probe, length, else downloaded. Items without a probe are left out,
    unless a rule that needs none decides them.
    """
    joined = items.join(probes, "id", "left")
    p = F.col("platform")
    gate = duration_gate(p, F.col("duration"), limits)
    by_url = F.when(host_blocked("url", blocked_host), 1).when(
        (p == "youtube") & is_short("url"), 2
    ).when(~F.coalesce(p.isin(*S.DOWNLOAD_PLATFORMS), F.lit(False)), 3)
    rule = F.coalesce(
        by_url,
        F.when(F.col("ok") & F.col("duration").isNotNull(), 5).when(F.col("ok").isNotNull(), 4),
    )
    routed = joined.withColumn("_rule", rule).where(F.col("_rule").isNotNull())
    r = F.col("_rule")

    def pick(blocked, short, platform, failed, length) -> Column:
        return (
            F.when(r == 1, blocked).when(r == 2, short).when(r == 3, platform)
            .when(r == 4, failed).otherwise(length)
        )

    none = F.lit(None).cast("string")
    status = pick(
        F.lit(S.REJECTED), F.lit(S.REJECTED), F.lit(S.UNSUPPORTED_PLATFORM),
        F.lit(S.ERROR_DOWNLOAD), gate["status"],
    )
    kept = (r == 5) & (gate["status"] == S.DOWNLOADED)
    return routed.select(
        "id",
        status.alias("status"),
        pick(
            F.lit(S.BLOCKED_HOST_MESSAGE), F.lit(S.SHORTS_MESSAGE),
            F.concat(F.lit("Unsupported platform: "), F.coalesce(p, F.lit("None"))),
            F.col("error"), gate["error_msg"],
        ).alias("error_msg"),
        F.when(kept, F.col("audio_path")).otherwise(none).alias("audio_path"),
        F.when(kept, gate["duration_seconds"].cast("int")).alias("duration_seconds"),
        F.when(status == S.REJECTED, "gate").alias("reject_stage"),
    )


def apply_routing(queue: DataFrame, routed: DataFrame, now) -> DataFrame:
    """Write the outcomes into the queue in one join."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    got = routed.select(
        "id", F.struct("status", "error_msg", "audio_path", "duration_seconds").alias("u")
    )
    joined = queue.join(got, "id", "left")
    hit = F.col("u").isNotNull()
    done = hit & (F.col("u.status") == S.DOWNLOADED)
    values = {
        "status": F.when(hit, F.col("u.status")).otherwise(F.col("status")),
        "error_msg": F.when(hit, F.col("u.error_msg")).otherwise(F.col("error_msg")),
        "audio_path": F.when(done, F.col("u.audio_path")).otherwise(F.col("audio_path")),
        "duration_seconds": F.when(done, F.col("u.duration_seconds")).otherwise(
            F.col("duration_seconds")
        ),
        "last_update_at": F.when(hit, stamp).otherwise(F.col("last_update_at")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in queue.columns])
