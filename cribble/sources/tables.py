"""Parquet tables and where intermediate tables go."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.schemas import CONTRASTIVE, LEXICON, QUEUE


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The item table. Files written before a column existed read as null."""
    return spark.read.schema(QUEUE).parquet(path)


def write_queue(queue: DataFrame, path: str) -> None:
    """One directory per status, so that reading one status skips the others' files.

    Refuses an existing path: a state is written beside its predecessor, never over it.
    """
    # Rebalancing keeps files of even size: a large status is split, small ones are merged.
    queue.hint("rebalance", "status").write.mode("errorifexists").partitionBy("status").parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table for work that is heavy per row.

    An input of fewer splits than there are cores is spread over all of them;
    it is small by that very fact. A larger one is left as it is scanned.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_contrastive(
    spark: SparkSession, paths: str | Sequence[str], with_audio: bool = False
) -> DataFrame:
    """Labelled corpus rows ``id, dialect, has_audio``; ``audio.bytes`` only on request.

    ``has_audio`` is a length test, so on its own it still reads the bytes;
    columns that are not selected afterwards are pruned from the scan.
    """
    if isinstance(paths, str):
        paths = [paths]
    rows = spark.read.schema(CONTRASTIVE).parquet(*paths)
    has_audio = F.coalesce(F.octet_length("audio.bytes") > 0, F.lit(False))
    return rows.select("id", "dialect", has_audio.alias("has_audio"),
                       *(["audio"] if with_audio else []))


def read_lexicons(spark: SparkSession, path: str) -> DataFrame:
    """``(lexicon, term)`` rows; duplicates are significant and blanks are kept."""
    if path.endswith(".parquet"):
        return spark.read.schema(LEXICON).parquet(path)
    return spark.read.schema(LEXICON).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).withColumn("term", F.coalesce("term", F.lit("")))  # an empty field reads as null


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the session names in ``spark.checkpoint.dir``.

    A local folder is used only where that is unset and the master is local, as in
    tests; on a cluster each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cribble-")
    return f"{base.rstrip('/')}/cribble/{name}-{uuid4().hex}"


_materialized: list[str] = []


def clear_materialized(spark: SparkSession) -> int:
    """Remove what ``materialize`` wrote in this process; results built on it end with it."""
    n = len(_materialized)
    while _materialized:
        path = spark._jvm.org.apache.hadoop.fs.Path(_materialized.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results that several passes need: what is behind them runs once, and
    a lost executor costs a re-read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _materialized.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
