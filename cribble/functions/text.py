"""Transcript and score-map expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribble import settings as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def transcript_text(samples: Column | str) -> Column:
    """Sample texts in array order joined by one blank; a missing text keeps its empty slot."""
    return F.array_join(
        F.transform(_col(samples), lambda s: F.coalesce(s["text"], F.lit(""))), " "
    )


def language_confidence(samples: Column | str, language: str) -> Column:
    """Mean probability over the samples in ``language``; null when there are none."""
    probs = F.transform(
        F.filter(_col(samples), lambda s: s["language"] == language),
        lambda s: F.coalesce(s["language_probability"], F.lit(0.0)),
    )
    return F.when(
        F.size(probs) > 0,
        F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p) / F.size(probs),
    )


def language_gate(
    samples: Column | str,
    language: str = S.Thresholds.language,
    min_probability: float = S.Thresholds.min_language_probability,
) -> Column:
    """``struct(passed, probability)``: tested unrounded, reported to three places."""
    mean = language_confidence(samples, language)
    return F.struct(
        F.coalesce(mean >= min_probability, F.lit(False)).alias("passed"),
        F.coalesce(F.round(mean, 3), F.lit(0.0)).alias("probability"),
    )


def excerpt(text: Column | str, max_chars: int = 600) -> Column:
    """Cut, then strip; placeholders for a missing and for an empty transcript."""
    t = _col(text)
    cut = F.regexp_replace(F.substring(t, 1, max_chars), r"^\s+|\s+$", "")
    return (
        F.when(t.isNull(), S.NO_TRANSCRIPT_EXCERPT)
        .when(cut == "", S.EMPTY_TRANSCRIPT_EXCERPT)
        .otherwise(cut)
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def softmax(logits: Column | str) -> Column:
    """Softmax over a ``map<string,double>`` of logits, keys upper-cased."""
    def shares(m: Column, exps: Column, total: Column) -> Column:
        return F.map_from_arrays(
            F.transform(F.map_keys(m), lambda k: F.upper(k)), F.transform(exps, lambda v: v / total)
        )

    def over(m: Column, top: Column) -> Column:
        exps = F.transform(F.map_values(m), lambda v: F.exp(v - top))
        return _once(exps, lambda e: _once(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda total: shares(m, e, total)))

    return _once(_col(logits), lambda m: _once(F.array_max(F.map_values(m)), lambda top: over(m, top)))


def top_class(scores: Column | str) -> Column:
    """``struct(top, top_score)`` of a score map; the alphabetically first label wins a tie."""
    entries = F.array_sort(
        F.map_entries(_col(scores)),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )
    return _once(
        F.get(entries, 0), lambda b: F.struct(b["key"].alias("top"), b["value"].alias("top_score"))
    )
