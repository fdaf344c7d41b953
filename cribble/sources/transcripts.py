"""Transcripts as nested JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.schemas import TRANSCRIPT


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transcript documents; the id comes from the content, not from the file name.

    One document per file needs ``multi_line``; for line-delimited files switch
    it off so that files can be split.
    """
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=multi_line)


def flatten_samples(transcripts: DataFrame) -> DataFrame:
    """One row per sample with its position."""
    return transcripts.select(
        "id", "url", "platform", F.posexplode("screening_samples").alias("sample_idx", "s")
    ).select("id", "url", "platform", "sample_idx", "s.*")


def nest_samples(samples: DataFrame) -> DataFrame:
    """Back to one document per item, samples in order."""
    fields = ["chunk_path", "language", "language_probability", "text", "segments"]
    have = [f for f in fields if f in samples.columns]
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", *have)))
    nested = F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in have]))
    keys = [k for k in ("id", "url", "platform") if k in samples.columns]
    return samples.groupBy(*keys).agg(nested.alias("screening_samples"))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Line-delimited UTF-8 JSON documents."""
    transcripts.write.mode("errorifexists").option("encoding", "UTF-8").json(path)
