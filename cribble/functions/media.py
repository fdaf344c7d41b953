"""Duration, chunk and conversion expressions over probe results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribble import settings as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capped_duration(
    platform: Column | str, duration: Column | str, limits: S.AudioLimits = S.AudioLimits()
) -> Column:
    """Duration after trimming: video is cut at the cap, short clips only above cap + 1."""
    d, p, cap = _col(duration), _col(platform), F.lit(float(limits.max_seconds))
    return (
        F.when((p == "youtube") & (d > cap), cap)
        .when((p == "tiktok") & (d > cap + 1), cap)
        .otherwise(d)
    )


def duration_gate(
    platform: Column | str, duration: Column | str, limits: S.AudioLimits = S.AudioLimits()
) -> Column:
    """``struct(status, error_msg, duration_seconds)`` decided by length alone.

    A length that is null or NaN is none: the item ends as ERROR_DOWNLOAD.
    """
    p, d = _col(platform), F.nullif(_col(duration).cast("double"), F.lit(float("nan")))
    too_long = p.isin(*S.PODCAST_PLATFORMS) & (d > limits.max_seconds)
    too_short = capped_duration(p, d, limits) < limits.min_seconds
    message = F.format_string(
        f"Podcast too long (%.1fs > {limits.max_seconds}s)", d
    )
    status = (
        F.when(d.isNull() | too_long, S.ERROR_DOWNLOAD)
        .when(too_short, S.SKIPPED_LENGTH)
        .otherwise(S.DOWNLOADED)
    )
    return F.struct(
        status.alias("status"),
        F.when(d.isNull(), S.NO_DURATION_MESSAGE).when(too_long, message).alias("error_msg"),
        F.when(status == S.DOWNLOADED, capped_duration(p, d, limits)).alias("duration_seconds"),
    )


def chunk_plan(
    item_id: Column | str,
    duration: Column | str,
    limits: S.AudioLimits = S.AudioLimits(),
    seed: int = S.SEED,
) -> Column:
    """Array of ``struct(idx, start)``: hash-chosen integer starts that leave room for a chunk.

    Null where the duration is null or NaN.
    """
    d, i = F.nullif(_col(duration).cast("double"), F.lit(float("nan"))), _col(item_id)
    room = F.floor(d - limits.chunk_seconds).cast("long") + 1

    def start(k: Column) -> Column:
        digest = F.md5(F.concat_ws(":", i.cast("string"), k.cast("string"), F.lit(str(seed))))
        return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % room

    picks = F.transform(
        F.sequence(F.lit(0), F.lit(limits.chunk_count - 1)),
        lambda k: F.struct(k.alias("idx"), start(k).alias("start")),
    )
    whole = F.array(F.struct(F.lit(0).alias("idx"), F.lit(0).cast("long").alias("start")))
    return F.when(d < limits.chunk_seconds, whole).when(d.isNotNull(), picks)


def clip_start(total: Column | str, clip_seconds: int = S.AudioLimits.clip_seconds) -> Column:
    """Start at 30 % unless that leaves too little; null when the length is unknown."""
    t = _col(total)
    return F.when(t > 0, F.greatest(F.lit(0.0), F.least(t - clip_seconds, t * 0.3)))


def has_extension(path: Column | str, extension: str) -> Column:
    return F.coalesce(F.endswith(F.lower(_col(path)), F.lit(extension)), F.lit(False))


def swap_extension(
    path: Column | str,
    encoded: Column | str,
    verified: Column | str,
    old: str = ".wav",
    new: str = ".flac",
) -> Column:
    """New path when the file was encoded and verified, else the old one."""
    p = _col(path)
    done = has_extension(p, old) & F.coalesce(_col(encoded) & _col(verified), F.lit(False))
    return F.when(done, F.concat(F.left(p, F.char_length(p) - len(old)), F.lit(new))).otherwise(p)
