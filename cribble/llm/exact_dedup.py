"""Exact copies of transcripts: one stays of each text.

Everything here is a Spark expression; no Python runs in tasks. Texts are read
once, to be hashed; what is shuffled is ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribble.llm.shared import NULL_ID, id_or_null, settle

#: A digest is frequent when more than this share of all rows has it. At most one in so many
#: digests can be, which bounds what is broadcast.
FREQUENT_SHARE = 0.001


def _place() -> Column:
    return F.struct("id", "row")


def frequent_digests(digests: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """``digest, group_size, keep``: every digest of more than ``share`` of the rows, counted exactly.

    ``digests``: ``id, row, digest``, settled. Misra-Gries counters (Spark's
    ``freqItems``, one map of ``1 / share`` counters a task, merged) name a superset
    of the frequent digests without a shuffle of rows. A second pass verifies
    them: it counts the candidates' rows and finds their last, combined in the map tasks.
    """
    found = digests.stat.freqItems(["digest"], share)
    candidates = found.select(F.explode("digest_freqItems").alias("digest"))
    # 1 / share counters at most.
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(_place()).alias("keep"))
    return counted.where(F.col("group_size") > share * digests.count())


def exact_copies(
    transcripts: DataFrame, normalize: Callable[[Column], Column] | None = None,
    share: float = FREQUENT_SHARE,
) -> DataFrame:
    """Say of each transcript which row of its text stays: the one with the largest id.

    ``transcripts``: ``id, text`` as ``join_samples`` gives them, ``id`` a bigint; other
    columns are ignored. Texts are equal when their SHA-256 is, after ``normalize``
    (by default nothing is changed). Copies of frequent texts meet their verified
    winner in the map task by a broadcast of at most ``1 / share`` rows; all other digests are
    shuffled, so that no task meets more than that share of the rows under one key.

    Returns one row per input row: ``id, keep_id, group_size, kept, text_sha256``.
    A null text counts as empty. A null id comes before all others and is given back as null.
    Of rows that repeat both id and text just one stays. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = transcripts.select(
        F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id"),
        F.sha2(normalize(text) if normalize else text, 256).alias("digest"),
    ).withColumn("row", F.monotonically_increasing_id())
    # Written once, so that a row keeps its number when a later task is run again.
    digests = settle(hashed, "digests")
    winners = settle(frequent_digests(digests, share), "frequent")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where(F.col("keep").isNull()).withColumns({
        "group_size": F.count(F.lit(1)).over(same), "keep": F.max(_place()).over(same)})
    return marked.where(F.col("keep").isNotNull()).unionByName(rest).select(
        id_or_null("id").alias("id"), id_or_null("keep.id").alias("keep_id"), "group_size",
        (_place() == F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))
