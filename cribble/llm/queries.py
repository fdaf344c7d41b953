"""The numbered queries: each maps the driver's tables to an operator and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble.llm import oracles
from cribble.llm.contamination import find_contamination
from cribble.llm.exact_dedup import exact_copies
from cribble.llm.hard_negatives import mine_hard_negatives
from cribble.llm.language import fit_language_tagger, tag_language
from cribble.llm.line_dedup import drop_shared_lines
from cribble.llm.mixing import mix_sources
from cribble.llm.phrase_dedup import remove_repeated_phrases
from cribble.llm.prefix_trie import end_digests, placed, prefix_trie
from cribble.llm.quality import quality_verdicts
from cribble.llm.set_join import similar_components
from cribble.llm.shared import NULL_ID, settle
from cribble.llm.suffix_dedup import remove_repeated_bytes
from cribble.llm.url_filter import url_verdicts
from cribble.llm.warc import read_archives, write_archives

URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)

MIX_WEIGHTS = [5.0, 2.0, 1.0]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """``documents`` as transcripts."""
    return _read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", *more)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_shared_lines(_texts(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_texts(spark, folder, "source")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _texts(spark, folder, "lang")
    held_out = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2
    net = fit_language_tagger(documents.where(~held_out).select("text", F.col("lang").alias("language")))
    return tag_language(documents, net).select(
        F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"), F.col("language_probability").alias("score"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("body"))
    return read_archives(write_archives(pages)).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    found = find_contamination(_texts(spark, folder), _read(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(_texts(spark, folder, F.array("source").alias("sources")), MIX_WEIGHTS)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", F.get("source_sizes", F.lit(0)).alias("source_size"),
        F.get("targets", F.lit(0)).alias("target"), "taken")


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(_texts(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_bytes(_texts(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_phrase_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_phrases(_texts(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select(F.col("page_id").alias("id"), "url")
    return url_verdicts(pages, URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = _read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), "embedding")
    return mine_hard_negatives(items, F.col("id") % 50 == 0)


def _rebuilt(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``conversations`` as transcripts: first the opening of another one, then their own turns.

    Returns samples and ids. A null id opens like no other and keeps all its turns.
    """
    turns = _read(spark, folder, "conversations").select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "turn",
        *[F.coalesce(c, F.lit("")).alias(new) for c, new in (("role", "language"), ("text", "text"))])
    h = F.when(F.col("id") == NULL_ID, F.lit(0)).otherwise(F.crc32(F.col("id").cast("string")) % 6)
    own = placed(turns, ["turn", "language", "text"]).select("id", F.col("pos").alias("sample_idx"), "language", "text")
    ids = settle(turns.select("id").distinct(), "ids")
    # At most five turns of a conversation are anyone's opening, and at most 199 ids share one.
    opening = own.where((F.col("id") % 100 == 0) & (F.col("sample_idx") < 5)).withColumnRenamed("id", "base")
    opened = ids.withColumn("base", F.col("id") - F.col("id") % 100).join(opening, "base").where(F.col("sample_idx") < h)
    samples = own.where(F.col("sample_idx") >= h).unionByName(opened.drop("base"))
    null_again = F.when(F.col("id") != NULL_ID, F.col("id"))
    return samples.withColumn("id", null_again), ids.withColumn("id", null_again)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    trie = prefix_trie(*_rebuilt(spark, folder))
    digests = end_digests(trie.ends).withColumnsRenamed({"depth": "_depth", "node": "_node"})
    same = (F.col("depth") == F.col("_depth")) & F.col("id").eqNullSafe(F.col("_node"))
    return trie.nodes.join(digests, same, "left").select(
        F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), F.col("n_transcripts").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(_texts(spark, folder)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_quality_rules, op3_language_id, op4_warc, op5_decontamination,
             op6_mixing, op7_jaccard_join, op8_suffix_dedup, op9_phrase_dedup, op10_url_filters,
             op11_hard_negatives, op12_prefix_trie, op13_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
