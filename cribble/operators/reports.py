"""Count reports over the queue and over stage outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble import settings as S

TOTAL = "TOTAL"


def status_summary(
    queue: DataFrame, domain: Sequence[str] = S.SUMMARY_STATUSES, status: str = "status"
) -> DataFrame:
    """``(status, n)`` over a fixed domain in its order, zeros shown, then TOTAL.

    Statuses outside the domain are in neither the rows nor the total.
    """
    one_row = queue.agg(
        *[F.count_if(F.col(status) == s).alias(f"_{i}") for i, s in enumerate(domain)],
        F.count_if(F.col(status).isin(*domain)).alias("_total"),
    )
    entries = [
        F.struct(F.lit(i).alias("pos"), F.lit(s).alias(status), F.col(f"_{i}").alias("n"))
        for i, s in enumerate(domain)
    ] + [F.struct(F.lit(len(domain)).alias("pos"), F.lit(TOTAL).alias(status),
                  F.col("_total").alias("n"))]
    return one_row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def platform_summary(
    queue: DataFrame, domain: Sequence[str] = S.SUMMARY_STATUSES
) -> DataFrame:
    """Items per platform whose status is in the domain; no platform counts as UNKNOWN."""
    name = F.coalesce(F.nullif(F.col("platform"), F.lit("")), F.lit("UNKNOWN"))
    return (
        queue.where(F.col("status").isin(*domain))
        .groupBy(name.alias("platform")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy("platform")
    )


def stage_counts(queue: DataFrame, platform: str = "youtube") -> DataFrame:
    """Per status and in total: all items and those with metadata, in one pass."""
    picked = queue.where(F.col("platform") == platform).select("status", "source_metadata")
    by_status = picked.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source_metadata").isNotNull()).alias("n_with_metadata"),
    )
    # The total is summed from the few status rows, not by a second pass.
    return by_status.rollup("status").agg(
        F.sum("n").alias("n"), F.sum("n_with_metadata").alias("n_with_metadata"),
        F.grouping("status").alias("_all"),
    ).select(
        F.when(F.col("_all") == 1, TOTAL).otherwise(F.col("status")).alias("status"),
        "n", "n_with_metadata",
    ).orderBy(F.desc("n"), "status")


def counts_by_class(
    rows: DataFrame, class_col: str = "dialect"
) -> DataFrame:
    return rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))


def existing_by_class(
    queue: DataFrame, platform: str = "adi17", key: str = "adi17_dialect",
    class_col: str = "dialect",
) -> DataFrame:
    """Queued contrastive items per class code, read from the metadata."""
    code = F.try_element_at("source_metadata", F.lit(key))
    return (
        queue.where((F.col("platform") == platform) & F.coalesce(code != "", F.lit(False)))
        .groupBy(code.alias(class_col)).agg(F.count(F.lit(1)).alias("n"))
    )


def outcome_report(
    rows: DataFrame, outcomes: Sequence[str], column: str = "outcome"
) -> DataFrame:
    """One row with a counter per outcome and the total."""
    return rows.agg(
        *[F.count_if(F.col(column) == x).alias(x) for x in outcomes],
        F.count(F.lit(1)).alias("total"),
    )


def status_by_platform(queue: DataFrame) -> DataFrame:
    """Counts per status and platform with sub-totals of both and the grand total."""
    counts = queue.groupBy("status", "platform").agg(F.count(F.lit(1)).alias("n"))
    # The cube expands rows fourfold, so it runs on the counts.
    return counts.cube("status", "platform").agg(
        F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level")
    )
