"""From raw documents to a mix: five stages, each on all that the one before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; extra columns are left behind. Rows
are told apart by id and text, so rows that share an id, null ids among them,
are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.llm.contamination import find_contamination
from cribble.llm.line_dedup import drop_shared_lines
from cribble.llm.mixing import mix_sources
from cribble.llm.quality import quality_verdicts
from cribble.llm.queries import MIX_WEIGHTS
from cribble.llm.set_join import similar_components
from cribble.llm.shared import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What counts as a near copy in the third stage.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def _transcripts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", *more)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or come from a source that fails them, go."""
    rejected = quality_verdicts(_transcripts(docs, "source")).where(~F.col("kept")).select(
        "id", F.col("source").alias("from"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (_text_hash() == F.col("text_hash"))
    return docs.select(*COLUMNS).join(rejected, same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last of them; ``n_chars`` follows the text.

    A text that was null becomes empty; no document goes.
    """
    left = drop_shared_lines(_transcripts(docs, "lang", "source"), carry=("lang", "source"))
    return left.select(F.col("id").alias("doc_id"), "text", "carried.lang", "carried.source",
                       F.length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays, and once only.

    Linked are those whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more; the narrower contract of op7 holds for that query alone. Documents without words link with nothing, so all of them stay.
    """
    found = settle(similar_components(_transcripts(docs), SIMILAR_PERCENT, SHINGLE_WORDS), "near_duplicates")
    stays = found.where("representative").groupBy("id", "text_hash").agg(
        F.max("n_shingles").alias("_n"), F.count(F.lit(1)).alias("_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (_text_hash() == F.col("text_hash"))
    kept = docs.select(*COLUMNS).join(stays, same)
    single = kept.where("_copies = 1 OR _n = 0").select(*COLUMNS)
    repeated = found.where("representative AND n_shingles > 0").groupBy("id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return single
    return single.unionByName(
        kept.where("_copies > 1 AND _n > 0").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are passages of ``benchmark`` go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(_transcripts(docs), benchmark).where("contaminated").select("id", "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (_text_hash() == F.col("text_hash"))
    return docs.select(*COLUMNS).join(found, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each (repeats counted)."""
    mixed = mix_sources(_transcripts(docs, F.array("source").alias("sources")), MIX_WEIGHTS)
    return mixed.where("taken > 0").select(
        F.col("id").alias("doc_id"), F.get("sources", F.lit(0)).alias("source"), "size",
        F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing),
]

# The components of the third stage have no plain SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is settled in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
