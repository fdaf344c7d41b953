"""Work lists over file listings and conversion results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.functions.media import has_extension, swap_extension
from cribble.functions.urls import stable_name


def usable_audio(queue: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Items with an audio path, and with a listing only those whose file exists."""
    kept = queue.where(F.col("audio_path").isNotNull())
    if listing is None:
        return kept
    return kept.join(listing.select(F.col("path").alias("audio_path")), "audio_path", "left_semi")


def by_extension(queue: DataFrame, extension: str = ".wav") -> DataFrame:
    return queue.where(has_extension("audio_path", extension))


def orphan_files(listing: DataFrame, queue: DataFrame) -> DataFrame:
    """Files that no item refers to."""
    used = queue.where(F.col("audio_path").isNotNull()).select(F.col("audio_path").alias("path"))
    return listing.join(used, "path", "left_anti")


def orphan_owners(orphans: DataFrame, queue: DataFrame) -> DataFrame:
    """Orphans with the item they were fetched for, told by the URL hash in the file name.

    Such a file was downloaded and then not kept. ``id`` is null for other orphans.
    """
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    fetched = queue.select(stable_name("url").alias("_name"), "id", "status", "error_msg")
    return orphans.withColumn("_name", name).join(fetched, "_name", "left").drop("_name")


def conversion_outcomes(worklist: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``outcome`` and the new ``audio_path`` from ``results(id, found, encoded, verified)``."""
    joined = worklist.join(results, "id", "left")
    outcome = (
        F.when(~F.coalesce("found", F.lit(False)), "missing")
        .when(~F.coalesce("encoded", F.lit(False)), "encode_fail")
        .when(~F.coalesce("verified", F.lit(False)), "verify_fail")
        .otherwise("ok")
    )
    ok = outcome == "ok"
    return joined.withColumn("outcome", outcome).withColumn(
        "audio_path", swap_extension("audio_path", ok, ok)
    ).drop("found", "encoded", "verified")
