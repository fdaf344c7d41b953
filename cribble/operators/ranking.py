"""Exact ranks, cuts and running totals without one task per group.

A plain ``row_number() over (partition by g order by o)`` sorts each group in
one task. Groups here (a status, a class, a label) may hold a third of all
rows, so every operator that ranks goes through one of these instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribble.sources.tables import materialize

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BROADCAST_ROWS = 20_000
SALTS = 32
# Spark limits a ranking window in its map tasks only up to this rank
# (spark.sql.optimizer.windowGroupLimitThreshold's default).
LIMITED_RANK = 1_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting it; a larger one is returned unhinted.

    At most ``max_rows + 1`` rows reach the driver. The small case becomes a
    local relation, so the work behind it runs once.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def top_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``k`` rows of each group with their rank; rows that tie in ``order`` come in any order.

    For small ``k`` map tasks keep ``k`` rows per group (window group limit), ``salts`` tasks
    per group keep ``k`` each of those, and one task merges ``salts * k``.
    The result does not depend on the salt. From ``LIMITED_RANK`` on that would bring whole groups
    to ``salts`` tasks; there the rows are dealt out by ranges of (groups, order), which
    split a group of any size, and ranked by the sizes of the ranges before.
    """
    if k > LIMITED_RANK:
        return _top_by_ranges(df, groups, order, k, rank)
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    last = Window.partitionBy(*groups).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)
    )


def _top_by_ranges(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str
) -> DataFrame:
    # The rows' hash splits runs of equal order, which no range could.
    numbered = number_rows(df, [*groups, *order, F.xxhash64(*df.columns)], "_n")
    first = numbered.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.min("_n").alias("_first"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    place = (F.col("_n") - F.col("_first") + 1).cast("int")
    return numbered.join(broadcast_if_small(first), on).where(place <= k).select(*df.columns, place.alias(rank))


def hash_key(*columns: Column | str, seed: int) -> Column:
    """``md5('a:b:seed')``: a reproducible random order that any SQL engine can recompute."""
    return F.md5(F.concat_ws(":", *columns, F.lit(str(seed))))


def lowest_share(
    df: DataFrame,
    group: str,
    key: str,
    tie: str,
    wanted: Column,
    flag: str,
    prefix: int = 4,
) -> DataFrame:
    """Flag exactly ``wanted`` rows per group, those lowest by the hex ``key``, then ``tie``.

    ``wanted`` is an expression over ``n``, the group's row count. The rows are
    never sorted by group: a histogram on the first ``prefix`` hex digits finds
    the bucket holding the last wanted row, only that bucket (1/65,536 of the
    group) is ranked, and the cut is then a comparison. Group and key columns
    are read twice more, nothing else is.
    """
    bucket = F.substring(F.col(key), 1, prefix)
    slim = df.select(group, key, tie).withColumn("_bucket", bucket)
    running = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    histogram = (
        slim.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(running))
        .withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
        .withColumn("_wanted", wanted.cast("long"))
    )
    edge = broadcast_if_small(
        histogram.where(
            (F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_rows") < F.col("_wanted"))
        ).select(
            F.col(group).alias("_group"),
            F.col("_bucket").alias("_edge"),
            (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_left"),
        )
    )
    inside = Window.partitionBy(group).orderBy(key, tie)
    cuts = broadcast_if_small(
        slim.join(
            edge, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_edge"))
        )
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_rank") == F.col("_left"))
        .select(F.col(group).alias("_group"), F.struct(key, tie).alias("_cut"))
    )
    return (
        df.join(cuts, F.col(group).eqNullSafe(F.col("_group")), "left")
        .withColumn(flag, F.coalesce(F.struct(key, tie) <= F.col("_cut"), F.lit(False)))
        .drop("_group", "_cut")
    )


def _local_sums(groups: Sequence[str], sums: Sequence[str]):
    """Running totals within one sorted partition, before each row of its group, and the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, carry = TaskContext.get().partitionId(), None, [0] * len(sums)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for g in groups:
                code = batch.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            ends = [tuple(batch.column(g)[i].as_py() for g in groups) for i in (0, n - 1)]
            new[0] = ends[0] != last
            last, starts, segment = ends[1], np.flatnonzero(new), np.cumsum(new) - 1
            columns = list(batch.columns)
            for k, c in enumerate(sums):
                value = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                before = total - value
                base = before[starts]
                local = np.where(segment < 0, before + carry[k], before - (base[np.maximum(segment, 0)] if len(base) else 0))
                carry[k] = total[-1] - base[-1] if len(base) else carry[k] + total[-1]
                columns.append(pa.array(local))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(n, here, np.int32))], names=[*batch.schema.names, *[f"_{c}_local" for c in sums], "_range"])

    return run


def running_sums(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<sum>_before`` and ``<sum>_total`` per group in order of ``key``.

    One shuffle deals the rows out by ranges of (groups, key), so that a group may hold any share
    of them; each task adds up its range in order and writes it. The ranges' sums (one row per group and
    range) then give the offsets. Give it rows already aggregated by ``(groups, key)`` so
    that ties are one row, and materialized where they are costly: they are read twice.
    """
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*groups, key]
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in sums}
    typed = df.withColumns({c: F.col(c).cast("bigint" if whole[c] else "double") for c in sums})
    schema = T.StructType([
        *typed.schema.fields, *[T.StructField(f"_{c}_local", T.LongType() if whole[c] else T.DoubleType()) for c in sums],
        T.StructField("_range", T.IntegerType())])
    ranges = materialize(
        typed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_local_sums(groups, sums), schema), "sums")
    totals = ranges.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    over_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = over_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(f"_{c}").over(over_group).alias(f"{c}_total") for c in sums],
    )
    on = F.col("_range") == F.col("_r")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ranges.join(broadcast_if_small(offsets), on).select(
        *df.columns,
        *[(F.col(f"_{c}_offset") + F.col(f"_{c}_local")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def number_rows(df: DataFrame, order: Column | str | Sequence[Column | str], out: str) -> DataFrame:
    """Dense 0-based row numbers in the order of the given column or columns, without one global sort task.

    The rows are dealt out by ranges of the order and written with their place in
    their range; the ranges' sizes (one row per range) then give the offsets.
    Give it materialized rows where they are costly: they are read twice.
    """
    order = [order] if isinstance(order, (str, Column)) else order
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranges = materialize(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_range", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND((1 << 33) - 1)),
        "numbered",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per range, which is at most one per shuffle partition.
    return ranges.join(F.broadcast(offsets), "_range").withColumn(
        out, F.col("_offset") + F.col("_place")).drop("_range", "_place", "_offset")


def exact_median(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group: the mean of the two middle values, found by running counts."""
    counted = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "counts",
    )
    ranked = running_sums(counted, value, ["n"], groups)
    low = F.floor((F.col("n_total") - 1) / 2)
    high = F.floor(F.col("n_total") / 2)
    upto = F.col("n_before") + F.col("n")

    def holds(position: Column) -> Column:
        return (F.col("n_before") <= position) & (position < upto)

    return ranked.groupBy(*groups).agg(
        (
            (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2
        ).alias(out)
    )
