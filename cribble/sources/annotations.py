"""Annotation samples and annotation files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cribble.schemas import ANNOTATION


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header. Fields may hold quotes and line breaks."""
    return spark.read.schema(ANNOTATION).csv(
        path, header=True, multiLine=True, escape='"', encoding="UTF-8"
    )


def write_annotations(annotations: DataFrame, path: str) -> None:
    annotations.select(*ANNOTATION.names).write.mode("errorifexists").csv(
        path, header=True, escape='"', quoteAll=False, encoding="UTF-8"
    )


def write_sample(sample: DataFrame, path: str) -> DataFrame:
    """Persist the sample once. When it is there already, the stored one is used."""
    spark = sample.sparkSession
    sample.write.mode("ignore").json(path)
    return read_sample(spark, path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "id long, url string, platform string, audio_path string, source_status string, pos int"
    )
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no sample at {path}") from e
