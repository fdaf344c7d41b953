"""Metrics of predictions against annotations, each from one aggregation of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.operators.ranking import exact_median, running_sums
from cribble.sources.tables import materialize


def join_truth(
    predictions: DataFrame, annotations: DataFrame, id_col: str = "id"
) -> DataFrame:
    """Predictions of annotated items with their ground truth."""
    truth = annotations.select(F.col("item_id").alias(id_col), "ground_truth")
    return predictions.join(truth, id_col)


def is_positive(
    truth: Column | str, positive: Sequence[str] = S.POSITIVE_TRUTH
) -> Column:
    t = F.col(truth) if isinstance(truth, str) else truth
    return t.isin(*positive)


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    Everything after the confusion counts works on (classes squared) rows.
    """
    confusion = df.groupBy(
        F.col(label).cast("string").alias("t"), F.col(prediction).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = confusion.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("class"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
        )).alias("c")
    ).select("c.*")
    per_class = cells.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hit").alias("hit"),
    )
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    scored = per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        _f1(precision, recall).alias("f1"), "support", "hit",
    )
    total = F.sum("support")
    accuracy = F.sum("hit") / total
    metrics = ("precision", "recall", "f1")
    summary = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"),
                     *[accuracy.alias(m) for m in metrics], total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"),
                     *[F.avg(m).alias(m) for m in metrics], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in metrics],
                     total.alias("support")),
        ).alias("s")
    ).select(F.explode("s").alias("s")).select("s.*")
    return scored.drop("hit").unionByName(summary)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve (ties count half); null when a class is missing.

    Rows whose score is null or NaN have no rank; they are left out and counted in ``unscored``.

    Per-score counts, then running sums over equi-depth score buckets: no
    task sees all scores.
    """
    value = F.nullif(F.col(score).cast("double"), F.lit(float("nan")))
    counts = materialize(df.groupBy(value.alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ), "scores")
    unscored = counts.where("s IS NULL").agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("unscored"))
    ranked = running_sums(counts.where("s IS NOT NULL"), "s", ["pos", "neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    auc = ranked.agg(
        (won / F.nullif(F.sum("pos") * F.sum("neg").cast("double"), F.lit(0.0))).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )
    # Two single rows side by side.
    return auc.withColumn("unscored", unscored.scalar())


def tier_precision(
    df: DataFrame,
    tier: str = "status",
    truth: str = "ground_truth",
    labels: Sequence[str] = S.TRUTH_LABELS[:4],
    positive: Sequence[str] = S.POSITIVE_TRUTH,
    count_unclear: bool = True,
    z: float = 1.96,
) -> DataFrame:
    """Per tier: n, count per label, precision and its Wald interval clamped to [0, 1].

    ``count_unclear=False`` leaves unclear items out of n.
    """
    rows = df.where(F.col(truth).isin(*labels))
    if not count_unclear:
        rows = rows.where(F.col(truth) != S.UNCLEAR_TRUTH)
    agg = rows.groupBy(tier).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(truth) == x).alias(x) for x in labels],
        F.count_if(is_positive(truth, positive)).alias("_hit"),
    )
    p = F.col("_hit") / F.col("n")
    half = z * F.sqrt(p * (1 - p) / F.col("n"))
    return agg.select(
        tier, "n", *labels, p.alias("precision"),
        F.greatest(F.lit(0.0), p - half).alias("ci_low"),
        F.least(F.lit(1.0), p + half).alias("ci_high"),
    )


def _sweep(df: DataFrame, value: str, cuts: Sequence[float], positive: Column) -> DataFrame:
    """Counts at each cut ``value >= cut`` from one pass.

    Rows are reduced to (number of cuts reached, truth) before anything is
    expanded, so the rows themselves are never multiplied by the cuts.
    """
    ordered = sorted(cuts)
    reached = sum(((F.col(value) >= c).cast("int") for c in ordered), F.lit(0))
    table = df.where(F.col(value).isNotNull()).groupBy(
        reached.alias("reached"), positive.alias("pos")
    ).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("threshold")) for i, c in enumerate(ordered)
    ])
    wide = table.withColumn("step", F.explode(steps))
    up = F.col("reached") > F.col("step.i")
    zero = F.lit(0).cast("long")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(zero))

    return wide.groupBy(F.col("step.threshold").alias("threshold")).agg(
        total(up & F.col("pos")).alias("tp"),
        total(up & ~F.col("pos")).alias("fp"),
        total(~up & F.col("pos")).alias("fn"),
        total(~up & ~F.col("pos")).alias("tn"),
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90),
    score: str = "probability",
    truth: str = "ground_truth",
    positive: Sequence[str] = S.POSITIVE_TRUTH,
    exclude: Sequence[str] = (S.UNCLEAR_TRUTH, S.SKIP_TRUTH),
) -> DataFrame:
    """Precision, recall, F1 and accuracy at each threshold; unclear items left out."""
    rows = df.where(~F.col(truth).isin(*exclude)) if exclude else df
    return add_rates(_sweep(rows, score, thresholds, is_positive(truth, positive)))


def tier_at_threshold(
    df: DataFrame,
    threshold: float = 0.75,
    tier: str = "status",
    score: str = "probability",
    truth: str = "ground_truth",
    positive: Sequence[str] = S.POSITIVE_TRUTH,
    exclude: Sequence[str] = (S.UNCLEAR_TRUTH, S.SKIP_TRUTH),
) -> DataFrame:
    """Per tier: n, rows predicted positive at the threshold, truly positive ones, hits, precision.

    A null score predicts nothing; precision is 0 where nothing is predicted.
    """
    rows = df.where(~F.col(truth).isin(*exclude)) if exclude else df
    predicted = F.coalesce(F.col(score) >= threshold, F.lit(False))
    hit = is_positive(truth, positive)
    counts = rows.groupBy(tier).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(predicted).alias("predicted"), F.count_if(hit).alias("positive"),
        F.count_if(predicted & hit).alias("tp"), F.count_if(predicted & ~hit).alias("fp"))
    return counts.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))


def add_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        "*", precision.alias("precision"), recall.alias("recall"),
        _f1(precision, recall).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def marker_sweep(
    df: DataFrame,
    cuts: Sequence[int] = (0, 1, 2, 3, 4, 5),
    hits: str = "strong_lb_hits",
    truth: str = "ground_truth",
    positive: Sequence[str] = S.POSITIVE_TRUTH,
) -> DataFrame:
    """Items kept, annotated and precise for each minimum of strong hits.

    Items without a ground truth count as kept only.
    """
    annotated = F.col(truth).isNotNull()
    state = F.when(~annotated, 0).when(is_positive(truth, positive), 2).otherwise(1)
    ordered = sorted(cuts)
    reached = sum(((F.col(hits) >= c).cast("int") for c in ordered), F.lit(0))
    table = df.groupBy(reached.alias("reached"), state.alias("state")).agg(
        F.count(F.lit(1)).alias("n")
    )
    steps = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("min_hits")) for i, c in enumerate(ordered)
    ])
    wide = table.withColumn("step", F.explode(steps))
    up = F.col("reached") > F.col("step.i")
    zero = F.lit(0).cast("long")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(zero))

    out = wide.groupBy(F.col("step.min_hits").alias("min_hits")).agg(
        total(up).alias("kept"),
        total(up & (F.col("state") > 0)).alias("annotated"),
        total(up & (F.col("state") == 2)).alias("positive"),
    )
    return out.select("*", _ratio(F.col("positive"), F.col("annotated")).alias("precision"))


def probability_profile(
    df: DataFrame, score: str = "probability", truth: str = "ground_truth"
) -> DataFrame:
    """n, mean, exact median, min and max of the score per truth label."""
    base = df.groupBy(truth).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    return base.join(exact_median(df, [truth], score, "median"), truth, "left")


def truth_distribution(df: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Count and share per label."""
    counts = df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    # One row per label, so the unpartitioned window is over a handful of rows.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )
