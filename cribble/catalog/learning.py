"""Features, training and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.labelling import labelled_documents
from cribble.catalog.lexical import LEX, SCORED_DOCS, scored_sql
from cribble.catalog.registry import Tables, query
from cribble.operators import model as ml
from cribble.operators.features import (
    add_features,
    attach_embeddings,
    embed_text,
    feature_array,
    fit_embedder,
    hash_embed,
    score_texts,
)
from cribble.operators.labels import training_set
from cribble.operators.sampling import stratified_split
from cribble.sources.tables import materialize, scratch_path

DIM = 64


@query("J5", """SELECT d.doc_id AS id, CAST(i AS INT) AS i, round(CASE WHEN d.doc_id % 6 = 0 OR e.vec_id IS NULL THEN 0e0
ELSE CAST(e.embedding[i + 1] AS DOUBLE) END, 6) AS v FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id,
(SELECT unnest(range(64)) AS i)""")
def attached_embeddings(t: Tables) -> DataFrame:
    """Every component is compared, one row each."""
    items = t.texts.selectExpr("doc_id AS id", "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text")
    joined = attach_embeddings(items, t.embeddings.withColumnRenamed("vec_id", "id"), DIM)
    return joined.select("id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 6))


def featured(t: Tables, items: DataFrame) -> DataFrame:
    vectors = t.embeddings.withColumnRenamed("vec_id", "id")
    return add_features(items, lambda d: attach_embeddings(d, vectors, DIM))


@query("F11", f"""{SCORED_DOCS} SELECT s.doc_id AS id, CAST(i AS INT) AS i, CASE i WHEN 0 THEN CAST(lb AS DOUBLE) WHEN 1 THEN CAST(msa AS DOUBLE)
WHEN 2 THEN CAST(strong_lb_hits AS DOUBLE) WHEN 3 THEN msa_ratio_core WHEN 4 THEN round(lexicon_score, 6)
ELSE round(coalesce(CAST(e.embedding[i - 4] AS DOUBLE), 0e0), 6) END AS f
FROM scored s LEFT JOIN embeddings e ON s.doc_id = e.vec_id, (SELECT unnest(range(69)) AS i)""")
def feature_vectors(t: Tables) -> DataFrame:
    scored = score_texts(t.texts.selectExpr("doc_id AS id", "text"), LEX)
    vec = attach_embeddings(scored, t.embeddings.withColumnRenamed("vec_id", "id"), DIM).select(
        "id", feature_array().alias("f"))
    return vec.select("id", F.posexplode("f").alias("i", "f")).withColumn("f", F.round("f", 6))


@query("M3", """SELECT doc_id AS id, CAST(64 AS INT) AS dim, CASE WHEN doc_id % 6 = 0 THEN 0e0 ELSE 1e0 END AS norm FROM documents""")
def text_embeddings(t: Tables) -> DataFrame:
    items = t.texts.selectExpr("doc_id AS id", "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text")
    vectors = embed_text(items, fit_embedder(items, DIM))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("id", F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"))


STEPS = 12

# Rows of features with the label and the split of ``split_rows``, features as in ``feature_vectors``.
FEATURES_SQL = """coalesce(e.embedding, list_transform(range(64), lambda i: 0::FLOAT))"""
ROW_SQL = f"""list_concat([CAST(lb AS DOUBLE), CAST(msa AS DOUBLE), CAST(strong_lb_hits AS DOUBLE), msa_ratio_core, lexicon_score],
list_transform({FEATURES_SQL}, lambda x: CAST(x AS DOUBLE)))"""
SPLIT_SQL = f"""WITH RECURSIVE {scored_sql("documents", "doc_id").strip()},
labelled AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS label, {ROW_SQL} AS x
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN scored s ON s.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE l.quality = 0 OR l.toxic = 1 OR strong_lb_hits >= 1),
split AS MATERIALIZED (SELECT id, label, x, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42'), id)
<= round(count(*) OVER (PARTITION BY label) * 0.2e0) AS holdout FROM labelled)"""


def newton_sql(steps: int = STEPS) -> str:
    """CTEs up to ``model(w)``, the weights after so many Newton steps, the intercept last.

    Each step sums the gradient and the Hessian over all training rows and solves by elimination.
    """
    parts = ["""train AS MATERIALIZED (SELECT list_append(x, 1e0) AS x, label, count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY label)) AS weight
FROM split WHERE NOT holdout)""", "w0 AS MATERIALIZED (SELECT list_transform(range(70), lambda i: 0e0) AS w)"]
    for k in range(1, steps + 1):
        parts.append(f"""at{k} AS MATERIALIZED (SELECT x, weight * (p - label) AS g, weight * p * (1 - p) AS h FROM (
SELECT *, 1e0 / (1e0 + exp(-list_inner_product(x, w))) AS p FROM train, w{k - 1})),
g{k} AS (SELECT i, sum(g * x[i]) AS v FROM at{k}, (SELECT unnest(range(1, 71)) AS i) GROUP BY i),
h{k} AS (SELECT i, j, sum(h * x[i] * x[j]) AS v FROM at{k}, (SELECT unnest(range(1, 71)) AS i), (SELECT unnest(range(1, 71)) AS j) GROUP BY i, j),
rows{k} AS MATERIALIZED (SELECT h{k}.i, list_append(list(h{k}.v + CASE WHEN h{k}.i = j AND j < 70 THEN 1e0 ELSE 0e0 END ORDER BY j),
any_value(g{k}.v + CASE WHEN h{k}.i < 70 THEN w[h{k}.i] ELSE 0e0 END)) AS r FROM h{k} JOIN g{k} ON g{k}.i = h{k}.i, w{k - 1} GROUP BY h{k}.i),
e{k} AS (SELECT 0 AS k, list(r ORDER BY i) AS m FROM rows{k} UNION ALL
SELECT k + 1, list_transform(range(1, 71), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[i], lambda v: v / m[k + 1][k + 1])
ELSE list_transform(range(1, 72), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM e{k} WHERE k < 70),
w{k} AS MATERIALIZED (SELECT list_transform(range(1, 71), lambda i: w[i] - m[i][71]) AS w FROM e{k}, w{k - 1} WHERE k = 70)""")
    parts.append(f"model AS (SELECT w FROM w{steps})")
    return ",\n".join(parts)


MODEL_SQL = f"{SPLIT_SQL},\n{newton_sql()}"


@query("M3", r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents WHERE doc_id % 6 <> 0),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS v
FROM w WHERE w <> '' GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM h GROUP BY 1)
SELECT d.doc_id AS id, CAST(k.i AS INT) AS i, round(coalesce(CASE WHEN n > 0 THEN v / n END, 0e0), 6) AS v
FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS i) k LEFT JOIN h ON h.doc_id = d.doc_id AND h.i = k.i LEFT JOIN n ON n.doc_id = d.doc_id""")
def hashed_embeddings(t: Tables) -> DataFrame:
    """Every component is compared, one row each."""
    items = t.texts.selectExpr("doc_id AS id", "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text")
    return hash_embed(items, DIM).select("id", F.posexplode("embedding").alias("i", "v")).withColumn(
        "v", F.round(F.col("v") + 0.0, 6))


def split_rows(t: Tables) -> DataFrame:
    rows = training_set(featured(t, labelled_documents(t)), check_size=False)
    # The split reads ids and labels three times and training comes after: keep the rows.
    return stratified_split(materialize(rows.select("id", "label", "features"), "training"))


@query("M1, W8, U2", f"{MODEL_SQL} SELECT CAST(CASE WHEN i = 70 THEN -1 ELSE i - 1 END AS INT) AS feature, round(w[i], 6) AS weight "
       "FROM model, (SELECT unnest(range(1, 71)) AS i)")
def classifier_weights(t: Tables) -> DataFrame:
    model = ml.train_classifier(split_rows(t).where(~F.col("holdout")))
    # One row per feature, so this is as small as the vector.
    coefficients = [(i, w) for i, w in enumerate(model.coefficients)]
    return t.spark.createDataFrame(
        coefficients + [(-1, model.intercept)], "feature int, weight double").withColumn("weight", F.round("weight", 6))


HOLDOUT_SQL = f"""{MODEL_SQL},
j AS (SELECT label, p, CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM (
SELECT label, 1e0 / (1e0 + exp(-list_inner_product(list_append(x, 1e0), w))) AS p FROM split, model WHERE holdout)),
k AS (SELECT c.class, count(*) FILTER (WHERE label = c.class) AS support, count(*) FILTER (WHERE prediction = c.class) AS predicted,
count(*) FILTER (WHERE label = c.class AND prediction = c.class) AS hit FROM j CROSS JOIN (SELECT 0 AS class UNION ALL SELECT 1) c GROUP BY 1),
q AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0e0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0e0 END AS re FROM k),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0e0 END AS f1 FROM q),
r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM j),
a AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc, count(*) AS n FROM r)
SELECT CAST(class AS STRING) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'roc auc', round(auc, 6), round(auc, 6), round(auc, 6), n FROM a"""


@query("M4, A8, A9", HOLDOUT_SQL)
def holdout_report(t: Tables) -> DataFrame:
    split = split_rows(t)
    model = ml.train_classifier(split.where(~F.col("holdout")))
    report, auc = ml.evaluate(split.where("holdout"), model)
    whole = report.unionByName(auc.select(
        F.lit("roc auc").alias("class"), *[F.col("auc").alias(c) for c in ("precision", "recall", "f1")],
        (F.col("positives") + F.col("negatives")).alias("support")))
    return whole.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("M2, S11, P16", f"""{MODEL_SQL},
s AS (SELECT d.doc_id AS id, d.doc_id % 50 = 0 AS missing, lexicon_score,
1e0 / (1e0 + exp(-list_inner_product(list_append({ROW_SQL}, 1e0), w))) AS p
FROM documents d JOIN scored s ON s.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id, model)
SELECT id, CASE WHEN missing THEN 'ERROR_SCORING' WHEN p >= 0.75e0 THEN 'POTENTIAL_LB' WHEN p >= 0.50e0 THEN 'BORDERLINE_LB' ELSE 'REJECTED' END AS status,
CASE WHEN missing THEN 'Missing transcript' END AS error_msg, CASE WHEN NOT missing THEN round(p, 6) END AS model_probability,
CASE WHEN NOT missing AND p < 0.50e0 THEN 'model' END AS reject_stage, CASE WHEN NOT missing AND p < 0.50e0 THEN round(lexicon_score, 6) END AS final_score FROM s""")
def scored_tiers(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "model")
    ml.save_model(ml.train_classifier(split_rows(t).where(~F.col("holdout"))), path)
    items = t.texts.selectExpr("doc_id AS id", "CASE WHEN doc_id % 50 = 0 THEN NULL ELSE text END AS text")
    ready = featured(t, score_texts(items, LEX))
    return ml.score_and_tier(ready, ml.load_model(path)).select(
        "id", F.col("tier").alias("status"), F.col("tier_error").alias("error_msg"),
        F.round("model_probability", 6).alias("model_probability"), "reject_stage",
        F.round("reason.diagnostics.final_score", 6).alias("final_score"))
