"""Keeping or blocking items by their URL: rules first, a character model for the rest.

Everything here is a Spark expression; no Python runs in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import settle

#: Longest context of the character models.
ORDER = 5
#: Below order 0 every Unicode code point is as likely as any other.
CODE_POINTS = 1_114_112
#: A gram that makes up at least one in so many characters is scored by a broadcast
#: table, which therefore has at most so many rows; the others are joined by shuffle.
HEAVY = 10_000
#: Log-ratios are whole micro-nats: sums are exact and do not depend on order.
MICRO = 1_000_000
#: Calibration bins of a hundredth of a nat per character.
BINS_PER_NAT = 100


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null.

    A rule is a host and a path prefix in one string; it fits its host and all
    subdomains when the path starts with its path. Rules are configuration:
    they travel in the plan.
    """
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"),
                                         F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = F.array_max(F.array(*fits))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _grams(url: str) -> str:
    """SQL for every character of a URL with the ``ORDER`` characters before it (line feeds before the start)."""
    symbols = f"split(concat(repeat('\\n', {ORDER}), translate({url}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '')"
    gram = ", ".join(f"get(s, i + {k})" for k in range(ORDER + 1))
    # ``sequence`` counts down where its end is below its start, hence the guard.
    grams = f"if(size(s) <= {ORDER}, array(), transform(sequence(0, size(s) - {ORDER + 1}), i -> concat({gram})))"
    return f"transform(array({symbols}), s -> {grams})[0]"


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, n, na, nr``: each different gram of the URLs, and how often it is in all, accepted and rejected ones.

    ``rows``: ``url, accepted`` (null where the URL teaches nothing). Counts
    are over all rows and combine before shuffling.
    """
    each = rows.select("accepted", F.explode(F.expr(_grams("coalesce(url, '')"))).alias("gram"))
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("na"),
                                    F.count_if(~F.col("accepted")).alias("nr"))


def language_model(counts: DataFrame) -> DataFrame:
    """``gram, n, ratio``: the log-ratio of a gram's last character after the others, in micro-nats.

    ``counts`` as from ``gram_counts``. Each class has a Markov model of
    variable order: it starts from the longest context of at most ``ORDER``
    characters that the class has seen, and mixes it with the shorter ones down
    to the even distribution (Witten-Bell): a context seen m times with t
    different followers gives the next shorter context the share t / (m + t).
    Contexts are the observed strings themselves, over any characters, in
    tables that grow with the URLs and are joined by their text.
    """
    def counted(k: int) -> DataFrame:
        """Counts of the last ``k`` characters and the one that follows, and of their context."""
        level = counts if k == ORDER else counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(
            F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        level = level.withColumn("ctx", F.substring("gram", 1, k))
        contexts = level.groupBy("ctx").agg(
            F.sum("na").alias("ma"), F.count_if(F.col("na") > 0).alias("ta"),
            F.sum("nr").alias("mr"), F.count_if(F.col("nr") > 0).alias("tr"))
        return level.join(contexts, "ctx")

    def mix(shorter: str, n: str, m: str, t: str) -> str:
        return f"if({m} = 0, {shorter}, ({n} + {t} * {shorter}) / ({m} + {t}))"

    even = f"(1D / {CODE_POINTS})"
    model = counted(0).selectExpr("gram", f"{mix(even, 'na', 'ma', 'ta')} AS pa", f"{mix(even, 'nr', 'mr', 'tr')} AS pr")
    for k in range(1, ORDER + 1):
        shorter = model.withColumnRenamed("gram", "short")
        model = counted(k).withColumn("short", F.expr("substring(gram, 2)")).join(shorter, "short").selectExpr(
            "gram", *(["n"] if k == ORDER else []), f"{mix('pa', 'na', 'ma', 'ta')} AS pa", f"{mix('pr', 'nr', 'mr', 'tr')} AS pr")
    return model.selectExpr("gram", "n", f"cast(round((ln(pa) - ln(pr)) * {MICRO}) AS bigint) AS ratio")


def _score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``score``: the log-likelihood difference per character in micro-nats, 0 without characters.

    ``rows`` are settled and have a key ``row``. Grams that nearly every URL has
    meet a table of at most ``HEAVY`` rows where they are; the rest, none of them
    frequent, are summed by gram and row and looked up by shuffle.
    """
    least = model.agg(F.ceil(F.sum("n") / HEAVY).alias("least")).scalar()
    heavy = model.where(F.col("n") >= least).select("gram", "ratio")
    light = model.where(F.col("n") < least).select("gram", "ratio")
    each = rows.select("row", F.explode(F.expr(_grams("coalesce(url, '')"))).alias("gram"))
    near = each.join(F.broadcast(heavy), "gram").groupBy("row").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    rest = each.join(F.broadcast(heavy.select("gram")), "gram", "left_anti").join(light, "gram")
    far = rest.groupBy("row").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    sums = near.unionByName(far).groupBy("row").agg(F.expr("sum(sum) div sum(n)").alias("score"))
    return rows.join(sums, "row", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("bigint")))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut`` (micro-nats): the place that tells the classes apart best.

    The histogram of scores has a fixed width, so what is ordered is a few
    thousand bins. The cut has the largest share of accepted URLs at or above
    it plus the share of rejected ones below, and lies halfway across the gap
    that no score falls into; the middle one of equally good places is taken.
    0 where a class is missing.
    """
    bins = scored.groupBy(F.expr(f"floor(score / {MICRO // BINS_PER_NAT}D)").alias("bin")).agg(
        F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    listed = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "good", "bad"))).alias("b"),
                      F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # The running counts of the bins below each bin.
    edges = listed.selectExpr("good", "bad", "posexplode(b) AS (k, x)", "b").selectExpr(
        "good", "bad", "x.bin AS bin", "coalesce(get(b, k - 1).bin + 1, x.bin) AS low",
        "aggregate(slice(b, 1, k), 0L, (a, y) -> a + y.good) AS good_below",
        "aggregate(slice(b, 1, k), 0L, (a, y) -> a + y.bad) AS bad_below",
    ).where("good > 0 AND bad > 0").selectExpr("bin", "low", "(good - good_below) / good + bad_below / bad AS gain", "good", "bad")
    best = edges.agg(F.max("gain").alias("g"), F.max("good").alias("good"), F.max("bad").alias("bad"),
                     F.collect_list(F.struct("bin", "low", "gain")).alias("e"))
    tops = "sort_array(transform(filter(e, x -> x.gain = g), x -> named_struct('bin', x.bin, 'twice', x.bin + x.low)))"
    return best.selectExpr(
        f"if(coalesce(good, 0L) = 0 OR coalesce(bad, 0L) = 0, 0L, cast({tops}[cast((size({tops}) - 1) div 2 AS int)].twice * {MICRO // BINS_PER_NAT // 2} AS bigint)) AS cut")


def url_verdicts(queue: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Allow or block each item of the queue by its URL.

    ``queue``: ``id, url``; other columns are ignored. ``rules``: pairs of
    ``allow`` or ``block`` and a rule such as ``example.org/es/``; the longest
    that fits decides. Where none fits, two character models of variable order decide, trained on
    half of the URLs that rules accepted and rejected; the other half sets the
    cut on the log-likelihood difference per character.

    Returns one row per input row: ``id, host, path, rule, verdict, score,
    cut`` (the last two in micro-nats per character). A null URL, or one
    without ``://``, has no host and no path, so only the models judge it; an
    empty one scores 0. Repeated rows get the same verdict. Without accepted or
    without rejected URLs the cut is 0. URLs of any length are read whole.
    """
    rows = queue.select("id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # Every table that is read twice is settled; the keys of the rows stay what they are.
    rows = settle(rows.withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules))
                  .withColumn("row", F.monotonically_increasing_id()), "url_rows")
    teaches = F.expr("instr('13579bdf', right(md5(url), 1)) = 0")
    accepted = F.col("_m.verdict") == "allow"
    counts = settle(gram_counts(rows.select("url", F.when(teaches, accepted).alias("accepted"))), "url_grams")
    model = settle(language_model(counts), "url_model")
    scored = settle(_score(rows, model), "url_scores")
    cut = settle(threshold(scored.where(F.col("_m").isNotNull() & ~teaches).select("score", accepted.alias("accepted"))), "url_cut")
    scored = scored.withColumn("cut", cut.scalar())
    by_model = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return scored.select("id", "host", "path", F.col("_m.rule").alias("rule"),
                         F.coalesce("_m.verdict", by_model).alias("verdict"), "score", "cut")
