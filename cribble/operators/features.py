"""Feature vectors: lexical numbers followed by an embedding."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.lexicon import Lexicons, final_score
from cribble.operators.once import compute_once

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A task remembers the places of so many words.
KNOWN_TOKENS = 200_000

LEXICAL_FEATURES = ("lb", "msa", "strong_lb_hits", "msa_ratio_core")


def score_texts(
    df: DataFrame, lexicons: Lexicons, text: str = "text",
    weights: S.LexiconWeights = S.LexiconWeights(), plan: str = "auto",
) -> DataFrame:
    """Add ``diagnostics``, the full lexical score of the text."""
    return compute_once(df, "diagnostics", final_score(text, lexicons, weights, plan))


def attach_embeddings(
    items: DataFrame, embeddings: DataFrame, dim: int, key: str = "id",
    vector: str = "embedding", text: str | None = "text",
) -> DataFrame:
    """Join vectors by id; a blank text or a missing vector gives zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    if text is not None:
        # Looked at before the join: a text that nothing else reads stays out of the shuffle.
        blank = F.coalesce(F.rlike(F.col(text), F.lit(r"^\s*$")), F.lit(True))
        items = compute_once(items, "_blank", blank)
    joined = items.join(
        embeddings.select(key, F.col(vector).cast("array<double>").alias("_v")), key, "left"
    )
    value = F.coalesce("_v", zeros)
    if text is not None:
        value = F.when(F.col("_blank"), zeros).otherwise(value)
    return joined.withColumn("embedding", value).drop("_v", "_blank")


def fit_embedder(df: DataFrame, dim: int = 384, text: str = "text") -> PipelineModel:
    """A Spark-side text embedding: hashed term weights, L2-normalised, zeros for blank text."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]).fit(df.withColumn(text, F.coalesce(text, F.lit(""))))


def embed_text(df: DataFrame, embedder: PipelineModel, text: str = "text") -> DataFrame:
    filled = df.withColumn("_keep", F.col(text)).withColumn(text, F.coalesce(text, F.lit("")))
    return (
        embedder.transform(filled)
        .withColumn("embedding", vector_to_array("_unit"))
        .withColumn(text, F.col("_keep"))
        .drop("_tokens", "_tf", "_idf", "_unit", "_keep")
    )


def _hashed(dim: int):
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, int]] = {}

        def place(token: str) -> tuple[int, int]:
            if token not in places:
                if len(places) >= KNOWN_TOKENS:
                    places.clear()
                digest = hashlib.md5(token.encode()).hexdigest()
                places[token] = int(digest[:8], 16) % dim, 1 if digest[8] < "8" else -1
            return places[token]

        for texts in batches:
            rows = []
            for tokens in texts:
                at = np.array([place(t) for t in tokens if t], dtype=np.int64).reshape(-1, 2)
                vector = np.bincount(at[:, 0], weights=at[:, 1], minlength=dim)
                length = np.sqrt(vector @ vector)
                rows.append(vector / length if length else None if len(at) else vector)
            yield pd.Series(rows, dtype=object)

    return embed


def hash_embed(df: DataFrame, dim: int = 384, text: str = "text", cancelled: float = 0.0) -> DataFrame:
    """Add ``embedding``: a signed hashing of the text's words that any engine can recompute.

    Words are runs of letters and digits, lower-cased. The first eight hex digits of a word's MD5, modulo ``dim``,
    give its component, the ninth its sign (plus below 8). The vector is L2-normalised; a text
    without words gives zeros, one whose words cancel out ``cancelled`` in every component. Nothing is fitted,
    so a text's vector never changes.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    found = compute_once(df, "embedding", _hashed(dim)(words))
    return found.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(cancelled), dim)))


def feature_array(diagnostics: Column | str = "diagnostics", embedding: Column | str = "embedding") -> Column:
    """The lexical five in fixed order, then the embedding."""
    d = F.col(diagnostics) if isinstance(diagnostics, str) else diagnostics
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    lex = d["lexicon_details"]
    return F.concat(
        F.array(
            *[lex[name].cast("double") for name in LEXICAL_FEATURES],
            d["final_score"].cast("double"),
        ),
        e.cast("array<double>"),
    )


def add_features(
    scored: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add ``features`` (a vector, null without an embedding).

    ``embed`` may add the ``embedding`` column first.
    """
    ready = embed(scored) if embed is not None else scored
    return ready.withColumn(
        "features", F.when(F.col("embedding").isNotNull(), array_to_vector(feature_array()))
    )
