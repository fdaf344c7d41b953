"""Metrics over judged documents and, at scale, over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.registry import JUDGED_SQL, Tables, judged, query
from cribble.operators import evaluate as ev

POS = "ground_truth IN ('lebanese', 'mostly_lebanese')"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: F.round(f.name, 6) for f in df.schema if f.dataType.typeName() == "double"
    })


@query("A8, M4", f"""WITH {JUDGED_SQL}, k AS (SELECT c.class, count(*) FILTER (WHERE label = c.class) AS support,
count(*) FILTER (WHERE prediction = c.class) AS predicted, count(*) FILTER (WHERE label = c.class AND prediction = c.class) AS hit
FROM j CROSS JOIN (SELECT 0 AS class UNION ALL SELECT 1) c GROUP BY 1),
p AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0e0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0e0 END AS re FROM k),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0e0 END AS f1 FROM p)
SELECT CAST(class AS STRING) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(t: Tables) -> DataFrame:
    return rounded(ev.classification_report(judged(t)))


AUC = """SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) AS auc,
p AS positives, n AS negatives, CAST(0 AS BIGINT) AS unscored FROM (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r,
count(*) FILTER (WHERE label = 1) OVER () AS p, count(*) FILTER (WHERE label = 0) OVER () AS n FROM x) GROUP BY p, n"""


@query("A9", f"WITH {JUDGED_SQL}, x AS (SELECT label, probability AS s FROM j) {AUC}")
def roc_auc(t: Tables) -> DataFrame:
    return rounded(ev.roc_auc(judged(t), score="probability"))


@query("A9", f"""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
CASE WHEN l_linenumber % 3 = 0 THEN 0.5e0 ELSE l_extendedprice END AS s FROM lineitem) {AUC}""")
def roc_auc_skewed(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr(
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
        "CASE WHEN l_linenumber % 3 = 0 THEN 0.5e0 ELSE l_extendedprice END AS score")
    return rounded(ev.roc_auc(rows))


def _tier_sql(where: str) -> str:
    return f"""WITH {JUDGED_SQL}, a AS (SELECT status, count(*) AS n, count(*) FILTER (WHERE ground_truth = 'lebanese') AS lebanese,
count(*) FILTER (WHERE ground_truth = 'mostly_lebanese') AS mostly_lebanese, count(*) FILTER (WHERE ground_truth = 'not_lebanese') AS not_lebanese,
count(*) FILTER (WHERE ground_truth = 'unclear') AS unclear, count(*) FILTER (WHERE {POS}) / count(*) AS p FROM j {where} GROUP BY 1)
SELECT status, n, lebanese, mostly_lebanese, not_lebanese, unclear, round(p, 6) AS precision,
round(greatest(0e0, p - 1.96e0 * sqrt(p * (1 - p) / n)), 6) AS ci_low, round(least(1e0, p + 1.96e0 * sqrt(p * (1 - p) / n)), 6) AS ci_high FROM a"""


@query("A10", _tier_sql(""))
def tier_precision(t: Tables) -> DataFrame:
    return rounded(ev.tier_precision(judged(t)))


@query("A10", _tier_sql("WHERE ground_truth <> 'unclear'"))
def tier_precision_clear(t: Tables) -> DataFrame:
    return rounded(ev.tier_precision(judged(t), count_unclear=False))


@query("A10, A11", f"""WITH {JUDGED_SQL}, a AS (SELECT status, count(*) AS n, count(*) FILTER (WHERE probability >= 0.75e0) AS predicted,
count(*) FILTER (WHERE {POS}) AS positive, count(*) FILTER (WHERE probability >= 0.75e0 AND {POS}) AS tp,
count(*) FILTER (WHERE probability >= 0.75e0 AND NOT {POS}) AS fp FROM j WHERE ground_truth <> 'unclear' GROUP BY 1)
SELECT *, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END, 6) AS precision FROM a""")
def tier_at_threshold(t: Tables) -> DataFrame:
    return rounded(ev.tier_at_threshold(judged(t)))


@query("A11", f"""WITH {JUDGED_SQL}, th AS (SELECT unnest([0.50e0, 0.60e0, 0.70e0, 0.75e0, 0.80e0, 0.85e0, 0.90e0]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE probability >= threshold AND {POS}) AS tp,
count(*) FILTER (WHERE probability >= threshold AND NOT {POS}) AS fp, count(*) FILTER (WHERE probability < threshold AND {POS}) AS fn,
count(*) FILTER (WHERE probability < threshold AND NOT {POS}) AS tn FROM j CROSS JOIN th WHERE ground_truth <> 'unclear' GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS re FROM c)
SELECT threshold, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall,
round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0e0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM r""")
def threshold_sweep(t: Tables) -> DataFrame:
    return rounded(ev.threshold_sweep(judged(t)))


@query("A12", f"""WITH {JUDGED_SQL} SELECT ground_truth, count(*) AS n, round(avg(probability), 6) AS mean, min(probability) AS min,
max(probability) AS max, round(median(probability), 6) AS median FROM j GROUP BY 1""")
def probability_profile(t: Tables) -> DataFrame:
    return ev.probability_profile(judged(t)).withColumns({
        "mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("A12", """SELECT l_returnflag AS ground_truth, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, min(l_extendedprice) AS min,
max(l_extendedprice) AS max, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1""")
def value_profile(t: Tables) -> DataFrame:
    return rounded(ev.probability_profile(t.lineitem, "l_extendedprice", "l_returnflag")).withColumnRenamed(
        "l_returnflag", "ground_truth").withColumn("mean", F.round("mean", 3))


@query("A13", f"WITH {JUDGED_SQL} SELECT ground_truth, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY 1")
def truth_distribution(t: Tables) -> DataFrame:
    return rounded(ev.truth_distribution(judged(t)))


@query("A15", """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (
SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, count(*) AS n FROM orders GROUP BY 1)""")
def class_weights(t: Tables) -> DataFrame:
    return rounded(ev.class_weights(t.orders.selectExpr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label")))


@query("A16", f"""WITH {JUDGED_SQL}, m AS (SELECT strong_lb_hits, CASE WHEN id % 4 > 0 THEN ground_truth END AS g FROM j),
th AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS min_hits),
c AS (SELECT min_hits, count(*) FILTER (WHERE strong_lb_hits >= min_hits) AS kept, count(*) FILTER (WHERE strong_lb_hits >= min_hits AND g IS NOT NULL) AS annotated,
count(*) FILTER (WHERE strong_lb_hits >= min_hits AND g IN ('lebanese', 'mostly_lebanese')) AS positive FROM m CROSS JOIN th GROUP BY 1)
SELECT *, round(CASE WHEN annotated > 0 THEN positive / annotated ELSE 0e0 END, 6) AS precision FROM c""")
def marker_sweep(t: Tables) -> DataFrame:
    rows = judged(t).withColumn("ground_truth", F.when(F.col("id") % 4 > 0, F.col("ground_truth")))
    return rounded(ev.marker_sweep(rows))
