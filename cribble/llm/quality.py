"""Quality rules on transcripts, and verdicts on the sources they come from.

Everything here is a Spark expression; no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import WORD_GAP, settle
from cribble.operators.ranking import broadcast_if_small

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SOURCE_LIMIT = 0.5
RULES = ("short", "repetitive", "symbols", "duplicate_lines", "word_length")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more.

    Windows are first sorted as 33 bits of hash above 31 of position; the few
    that share their bits with a neighbour are then compared as text.
    """
    def packed(hashes: Column) -> Column:
        def one(i: Column) -> Column:
            h = F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])
            return F.coalesce(F.shiftleft(h, 31).bitwiseOR(i.cast("bigint")), F.lit(0).cast("bigint"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(hashes) - width), one))

    def alike(rows: Column, key) -> Column:
        return F.filter(rows, lambda e, k: key(e).eqNullSafe(key(F.get(rows, k - 1)))
                        | key(e).eqNullSafe(key(F.get(rows, k + 1))))

    def exact(maybe: Column) -> Column:
        texts = F.transform(maybe, lambda e: F.struct(
            F.concat_ws(" ", F.slice(words, e.bitwiseAND(2**31 - 1).cast("int") + 1, width)).alias("w"),
            e.bitwiseAND(2**31 - 1).alias("i")))
        return _let(F.sort_array(texts), lambda rows: alike(rows, lambda e: e["w"]))

    def covered(rows: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(rows, lambda e: e["i"])), start,
            lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"),
                                    (i + width).alias("end")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = _let(_let(hashes, packed), lambda rows: alike(rows, lambda e: F.shiftright(e, 31)))
    return F.when(F.size(words) > width, covered(_let(found, exact))).otherwise(F.lit(0).cast("bigint"))


def measures(transcripts: DataFrame) -> DataFrame:
    """``id, source`` and the counts that the rules read, one row per input row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = transcripts.select("id", "source", text.alias("text"))
    rows = rows.withColumn("w", F.explode(F.array(words_of(F.col("text")))))  # evaluated once
    return rows.select(
        "id", "source", F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 10 > n,
        "duplicate_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20),
    }


def source_rates(measured: DataFrame) -> DataFrame:
    """``source, rule, n, fails, rate``: each source's failure rate per rule, shrunk.

    The prior of a rule is the beta distribution with the mean and variance of
    the rates found among sources (method of moments), worth 1 to 1,000 texts.
    """
    counts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(name) for name, c in _failures().items()],
    )
    pairs = ", ".join(f"'{name}', {name}" for name in RULES)
    by_rule = counts.selectExpr("source", "n", f"stack({len(RULES)}, {pairs}) AS (rule, fails)")
    spread = by_rule.groupBy("rule").agg(
        F.avg(F.col("fails") / F.col("n")).alias("m"),
        F.coalesce(F.var_samp(F.col("fails") / F.col("n")), F.lit(0.0)).alias("v"))
    size = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    prior = spread.select("rule", "m", size.alias("s"))
    rate = (F.col("fails") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    # One row per rule, so the prior side is a handful of rows whatever the corpus.
    return by_rule.join(F.broadcast(prior), "rule").select("source", "rule", "n", "fails", rate.alias("rate"))


def quality_verdicts(transcripts: DataFrame, source_limit: float = SOURCE_LIMIT) -> DataFrame:
    """Judge each transcript by its own text, then by the source it came from.

    ``transcripts``: ``id, text, source`` (the channel, feed or user); other
    columns are ignored. A text fails by itself when it has fewer than ten words
    or when over a fifth of its words lie in repeated five-word windows. A
    source fails when its shrunk rate of failures exceeds ``source_limit`` for
    any rule; its texts then go as well.

    Returns one row per input row: ``id, source, text_hash, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, source_failed, kept``
    (``text_hash`` tells rows with the same id apart). A null or empty text has no words and fails. A null source is no source: its texts
    are judged by themselves. Repeated rows are judged one by one.
    """
    measured = settle(measures(transcripts), "quality")
    failing = broadcast_if_small(source_rates(measured).where(F.col("rate") > source_limit)
                                 .select("source", F.lit(True).alias("source_failed")).distinct())
    rules = _failures()
    base = rules["short"] | rules["repetitive"]
    # Failing sources are counted before they are broadcast; beyond that limit the counts
    # (no texts) are joined by shuffle, where AQE splits a hot source.
    return measured.join(failing, "source", "left").select(
        "id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.coalesce("source_failed", F.lit(False)).alias("source_failed"),
        (~base & ~F.coalesce("source_failed", F.lit(False))).alias("kept"),
    )
