"""Registered queries: each operator run over the driver's tables, with its SQL oracle."""

from cribble.catalog import (  # noqa: F401  (importing registers the queries)
    discovery,
    evaluation,
    files,
    labelling,
    lexical,
    learning,
    queueing,
    stages,
    urls,
)
from cribble.catalog.registry import coverage, oracle_sql, queries

__all__ = ["coverage", "oracle_sql", "queries"]
