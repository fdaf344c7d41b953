"""What several corpus operators share: row identity, settled tables, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.sources.tables import scratch_path

#: Stands for a null id inside operators; it sorts before every other id.
NULL_ID = -(2**63)

#: Words are runs of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    It cuts the lineage, survives lost executors, and gives the planner the
    table's true size. ``clear_scratch`` removes what was written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove every settled table of this process; results built on them end with it."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def id_or_null(column: str = "id") -> Column:
    """The id to give back for an internal one."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def keyed(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, text`` alone, without nulls: a null id is ``NULL_ID``, a null text is empty."""
    return df.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
