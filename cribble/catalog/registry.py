"""Where queries register, and the stand-in tables they share.

Stand-ins are derived from the driver's tables by expressions that mean the
same in Spark SQL and in the oracle's dialect, so both sides start equal and
only the operator under test differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.functions.meta import compact_map
from cribble.schemas import QUEUE
from cribble.sources.tables import read_spread

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}
_coverage: dict[str, str] = {}

NOW = "2026-01-01 00:00:00"


class Tables:
    """``t.orders`` is the parquet table of that name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """``documents`` for queries that are heavy per text."""
        return read_spread(self.spark, f"{self.folder}/documents.parquet")


def query(covers: str, sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        _queries[name] = lambda spark, folder: fn(Tables(spark, folder))
        _coverage[name] = covers
        if sql is not None:
            _oracle[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def coverage() -> dict[str, str]:
    return dict(_coverage)


def derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def derive_sql(table: str, exprs: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {table}"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


STATUS_CYCLE = (
    "DISCOVERED", "DOWNLOADED", "SCREENED", "WEAK_POSITIVE", "WEAK_NEGATIVE", "POTENTIAL_LB",
    "BORDERLINE_LB", "REJECTED", "ERROR_DOWNLOAD", "SCREENED", "ERROR_SCORING",
    "SKIPPED_LENGTH", "UNSUPPORTED_PLATFORM", "SCREENED_NO_LABEL",
)

# orders as the item table.
QUEUE_E = {
    "id": "o_orderkey",
    "url": (
        "'https://' || CASE o_custkey % 6 WHEN 0 THEN 'www.youtube.com/watch?v=' "
        "WHEN 1 THEN 'www.youtube.com/shorts/' WHEN 2 THEN 'Media.BUZZSPROUT.com/' "
        "ELSE 'cdn.example.org/a/' END || o_orderkey || CASE o_orderkey % 4 "
        "WHEN 0 THEN '.mp3' WHEN 1 THEN '.M4A?x=1' WHEN 2 THEN '.OGG' ELSE '' END"
    ),
    "platform": (
        "CASE o_custkey % 8 WHEN 0 THEN 'youtube' WHEN 1 THEN 'youtube' WHEN 2 THEN 'youtube' "
        "WHEN 3 THEN 'podcast' WHEN 4 THEN 'podcast_rss' WHEN 5 THEN 'tiktok' "
        "WHEN 6 THEN 'adi17' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '' END END"
    ),
    "status": (
        "CASE (o_orderkey + o_custkey) % 14 "
        + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUS_CYCLE))
        + " END"
    ),
    "discovered_at": "o_orderdate",
    "last_update_at": "o_orderdate",
    "error_msg": "CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey END",
    "audio_path": (
        "CASE WHEN o_orderkey % 4 <> 0 THEN 'raw/' || o_orderkey || CASE o_orderkey % 3 "
        "WHEN 0 THEN '.wav' WHEN 1 THEN '.FLAC' ELSE '.WAV' END END"
    ),
    "duration_seconds": "CAST(floor(o_totalprice / 200) AS INT)",
    "meta_kind": "CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' ELSE 'full' END",
    "meta_channel": "CASE WHEN o_custkey % 3 = 0 THEN 'ch' || (o_custkey % 40) END",
    "meta_feed": (
        "CASE WHEN o_custkey % 2 = 0 THEN 'HTTPS://Feeds.Example.com/f' || (o_custkey % 30) "
        "|| '/?x=' || o_orderkey END"
    ),
    "meta_user": "CASE WHEN o_custkey % 5 <> 0 THEN 'u' || (o_custkey % 20) END",
}
QUEUE_SQL = f"q AS ({derive_sql('orders', QUEUE_E)})"


def queue(t: Tables) -> DataFrame:
    """The item table in its full schema."""
    full = compact_map(channel_id="meta_channel", feed_url="meta_feed", user="meta_user")
    empty = F.map_filter(full, lambda k, v: F.lit(False))
    meta = F.when(F.col("meta_kind") == "full", full).when(F.col("meta_kind") == "empty", empty)
    flat = derive(t.orders, QUEUE_E).withColumn("source_metadata", meta)
    return flat.select(*[
        (F.col(f.name) if f.name in flat.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in QUEUE.fields
    ])


# conversations as transcript samples. Probabilities are multiples of 1/64, so
# means are exact whatever the order of addition.
SAMPLES_E = {
    "id": "conv_id",
    "sample_idx": "turn",
    "language": "role",
    "language_probability": (
        "CASE WHEN (conv_id + turn) % 11 <> 0 "
        "THEN CAST((conv_id * 7 + turn * 13) % 33 + 32 AS DOUBLE) / 64e0 END"
    ),
    "text": "CASE WHEN (conv_id + turn) % 17 <> 0 THEN text END",
}
SAMPLES_SQL = f"s AS ({derive_sql('conversations', SAMPLES_E)})"


def samples(t: Tables) -> DataFrame:
    return derive(t.conversations, SAMPLES_E)


def transcripts(t: Tables) -> DataFrame:
    """Nested transcripts from the samples."""
    from cribble.sources.transcripts import nest_samples

    return nest_samples(samples(t))


# labels joined to documents as annotated predictions.
JUDGED_E = {
    "id": "d.doc_id",
    "status": (
        "CASE d.doc_id % 5 WHEN 0 THEN 'WEAK_POSITIVE' WHEN 1 THEN 'POTENTIAL_LB' "
        "WHEN 2 THEN 'BORDERLINE_LB' WHEN 3 THEN 'REJECTED' ELSE 'WEAK_NEGATIVE' END"
    ),
    "ground_truth": (
        "CASE WHEN l.doc_id % 13 = 0 THEN 'unclear' WHEN l.quality = 1 AND l.toxic = 0 "
        "THEN CASE WHEN l.doc_id % 3 = 0 THEN 'mostly_lebanese' ELSE 'lebanese' END "
        "ELSE 'not_lebanese' END"
    ),
    "probability": "CAST((d.n_chars * 37 + d.doc_id * 11) % 257 AS DOUBLE) / 256e0",
    "strong_lb_hits": "CAST(d.n_chars % 7 AS INT)",
    "label": "l.quality",
    "prediction": "CASE WHEN (d.n_chars * 37 + d.doc_id * 11) % 257 >= 128 THEN 1 ELSE 0 END",
}
JUDGED_SQL = (
    f"j AS ({derive_sql('documents d JOIN labels l ON d.doc_id = l.doc_id', JUDGED_E)})"
)


def judged(t: Tables) -> DataFrame:
    joined = t.documents.alias("d").join(t.labels.alias("l"), F.expr("d.doc_id = l.doc_id"))
    return derive(joined, JUDGED_E)


def as_text(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]
