"""Quotas, exact stratified samples and splits, and annotation bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.operators.ranking import (
    broadcast_if_small,
    hash_key,
    lowest_share,
    number_rows,
    top_per_group,
)


def quota_per_class(
    rows: DataFrame,
    existing: DataFrame,
    present_urls: DataFrame,
    targets: Mapping[str, str] = S.CONTRASTIVE_ROLES,
    quota: int = S.CONTRASTIVE_QUOTA,
    class_col: str = "dialect",
) -> DataFrame:
    """Add ``outcome`` to corpus rows: which fill up each class, and why the rest do not.

    ``rows(url, <class>, ok, file_pos, row_pos)``; ``existing(<class>, n)``.
    In order: ``not_target``, ``quota_full`` (after the row that filled it),
    ``failed``, ``already_present`` (counts once, in ``existing``), ``added``.
    A URL repeated in the rows counts at its first usable row.
    """
    position = F.struct("file_pos", "row_pos")
    target = F.col(class_col).isin(*targets)
    usable = rows.where(target & F.col("ok"))
    firsts = usable.groupBy("url").agg(
        F.min_by(F.struct(class_col, "file_pos", "row_pos"), position).alias("r")
    ).select("url", "r.*").join(present_urls.select("url"), "url", "left_anti")
    # Both tables have one row per class; classes are the keys of ``targets``.
    have = existing.where(F.col(class_col).isin(*targets)).select(
        F.col(class_col).alias("_class"), F.col("n").alias("_have")
    )
    ranked = top_per_group(
        firsts.select(class_col, "file_pos", "row_pos"), [class_col],
        [F.col("file_pos"), F.col("row_pos")], quota,
    )
    # At most quota rows per class: the rows themselves are joined without a shuffle.
    added = broadcast_if_small(
        ranked.join(broadcast_if_small(have), F.col(class_col) == F.col("_class"), "left")
        .withColumn("_room", F.lit(quota) - F.coalesce("_have", F.lit(0)))
        .where(F.col("rank") <= F.col("_room"))
        .select(
            F.col(class_col).alias("_c"), F.col("file_pos").alias("_f"), F.col("row_pos").alias("_r"),
            (F.col("rank") == F.col("_room")).alias("_last"),
        ),
    )
    nowhere = F.lit(-1).cast("long")
    cuts = broadcast_if_small(
        added.where("_last").select(
            F.col("_c").alias("_full"), F.struct(
                F.col("_f").cast("long").alias("f"), F.col("_r").cast("long").alias("r")).alias("_cut"))
        .unionByName(have.where(F.col("_have") >= quota).select(
            F.col("_class").alias("_full"),
            F.struct(nowhere.alias("f"), nowhere.alias("r")).alias("_cut")))
    )
    here = F.struct(F.col("file_pos").cast("long"), F.col("row_pos").cast("long"))
    marked = rows.join(cuts, F.col(class_col) == F.col("_full"), "left").join(
        added,
        (F.col(class_col) == F.col("_c")) & (F.col("file_pos") == F.col("_f"))
        & (F.col("row_pos") == F.col("_r")), "left",
    )
    outcome = (
        F.when(~F.coalesce(target, F.lit(False)), "not_target")
        .when(here > F.col("_cut"), "quota_full")
        .when(~F.coalesce("ok", F.lit(False)), "failed")
        .when(F.col("_c").isNull(), "already_present")
        .otherwise("added")
    )
    return marked.select(*rows.columns, outcome.alias("outcome"))


def stratified_sample(
    queue: DataFrame,
    strata: Mapping[str, int] = S.SAMPLE_STRATA,
    seed: int = S.SEED,
    status_col: str = "status",
    id_col: str = "id",
) -> DataFrame:
    """Exactly n items per status (all of a smaller stratum), reproducibly at random.

    The order within a stratum is ``md5(id:seed)``. Only ``max(n)`` rows per
    stratum leave a map task.
    """
    wanted = F.create_map(*[F.lit(x) for kv in strata.items() for x in kv])
    picked = queue.where(F.col(status_col).isin(*strata)).withColumn(
        "_key", hash_key(F.col(id_col).cast("string"), seed=seed)
    )
    ranked = top_per_group(
        picked, [status_col], [F.col("_key"), F.col(id_col)], max(strata.values()), rank="_rank"
    )
    return ranked.where(F.col("_rank") <= F.try_element_at(wanted, F.col(status_col))).drop(
        "_key", "_rank"
    )


def strata_shortfall(
    queue: DataFrame, strata: Mapping[str, int] = S.SAMPLE_STRATA, status_col: str = "status"
) -> DataFrame:
    """``(stratum, wanted, available, short)`` with a row for empty strata too."""
    dim = queue.sparkSession.createDataFrame(
        list(strata.items()), f"{status_col} string, wanted long"
    )
    counts = queue.where(F.col(status_col).isin(*strata)).groupBy(status_col).agg(
        F.count(F.lit(1)).alias("available")
    )
    available = F.coalesce("available", F.lit(0))
    return dim.join(counts, status_col, "left").select(
        status_col, "wanted", available.alias("available"),
        (available < F.col("wanted")).alias("short"),
    )


def shuffle_sample(sample: DataFrame, seed: int = S.SEED, id_col: str = "id") -> DataFrame:
    """Add ``pos``, an order that interleaves the strata.

    A permutation of any size: rows are dealt out by ranges of a hash of their id, sorted there, and
    numbered by the sizes of the ranges before. Costly rows should be materialized: they are read twice.
    """
    key = hash_key(F.col(id_col).cast("string"), seed=seed + 1)
    return number_rows(sample, [key, F.col(id_col)], "pos").withColumn("pos", F.col("pos").cast("int"))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    fraction: float = S.Thresholds.holdout_fraction,
    seed: int = S.SEED,
    id_col: str = "id",
    flag: str = "holdout",
) -> DataFrame:
    """Flag exactly ``round(n * fraction)`` rows of each class as held out."""
    keyed = df.withColumn("_key", hash_key(F.col(id_col).cast("string"), seed=seed))
    return lowest_share(
        keyed, label, "_key", id_col, F.round(F.col("n") * F.lit(fraction)), flag
    ).drop("_key")


def latest_annotation(
    annotations: DataFrame, key: str = "item_id", ts: str = "timestamp", seq: str = "seq"
) -> DataFrame:
    """The newest annotation of each item; a later one replaces an earlier one.

    Files hold no ``seq``; without it equal times are told apart by the other columns.
    """
    rest = [c for c in annotations.columns if c != key]
    order = [ts, seq] if seq in rest else [ts, *[c for c in rest if c != ts]]
    return (
        annotations.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("a"))
        .select(key, "a.*")
    )


def unlabelled(
    sample: DataFrame, annotations: DataFrame, id_col: str = "id",
    skip: str = S.SKIP_TRUTH,
) -> DataFrame:
    """Sample rows still to do: not annotated, or only skipped; in sample order."""
    done = annotations.where(F.col("ground_truth") != skip).select(
        F.col("item_id").alias(id_col)
    )
    return sample.join(done, id_col, "left_anti").orderBy("pos")
