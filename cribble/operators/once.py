"""Keeping a costly expression from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters may read.

    Catalyst pushes a filter through a projection by copying the expression
    into the filter, which would score or parse every row twice. It does not
    push one through a generator; filters on other columns still pass.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
