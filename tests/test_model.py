import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cribble.operators import model as ml


def reference(x, y, c=1.0):
    """The optimum by plain gradient descent with line search on numpy arrays."""
    x = np.c_[x, np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    at = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return w @ np.logaddexp(0, np.where(y == 1, -z, z)) + b[:-1] @ b[:-1] / (2 * c)

    for _ in range(20_000):
        p = 1 / (1 + np.exp(-x @ at))
        g = x.T @ (w * (p - y)) + np.append(at[:-1], 0) / c
        step = 1.0
        while loss(at - step * g) > loss(at) - step / 2 * (g @ g) and step > 1e-14:
            step /= 2
        at = at - step * g
        if np.abs(g).max() < 1e-9:
            break
    return at


def frame(spark, x, y, parts=3):
    rows = [(int(b), [float(v) for v in a]) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "label int, f array<double>").repartition(parts).withColumn("features", array_to_vector("f"))


@pytest.mark.parametrize("c", [0.1, 1.0, 20.0])
def test_weights_minimize_the_objective(spark, c):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + rng.normal(size=240) > 0.8).astype(int)
    model = ml.train_classifier(frame(spark, x, y), c=c)
    assert np.allclose([*model.coefficients, model.intercept], reference(x, y, c), atol=1e-6)


def test_separable_rows_and_unlike_scales(spark):
    x = np.array([[i / 10, 1000.0 * (i % 3), 0.0] for i in range(60)])
    y = (np.arange(60) >= 30).astype(int)
    model = ml.train_classifier(frame(spark, x, y))
    assert np.isfinite([*model.coefficients, model.intercept]).all() and model.coefficients[2] == 0
    scored = ml.predict(frame(spark, x, y), model).select("label", "prediction").collect()
    assert sum(r.label != r.prediction for r in scored) <= 2


def test_sums_of_many_partitions_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(ml, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 2)), rng.integers(0, 2, 90)
    rows = frame(spark, x, y, parts=11).select(F.col("label").cast("double"), F.lit(1.0).alias("weight"), F.col("f").alias("features"))
    loss, gradient, hessian = ml._moments(rows, np.zeros(3), 1.0)
    ones = np.c_[x, np.ones(90)]
    assert np.isclose(loss, 90 * np.log(2)) and np.allclose(gradient, ones.T @ (0.5 - y))
    assert np.allclose(hessian, ones.T @ ones / 4 + np.diag([1, 1, 0]))


def test_rows_without_label_or_features_are_left_out(spark):
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 1, 0, 1])
    df = frame(spark, x, y).select("label", "features")
    holes = df.unionByName(df.selectExpr("CAST(NULL AS INT) AS label", "features")).unionByName(
        df.selectExpr("label", "features").withColumn("features", F.when(F.lit(False), F.col("features"))))
    whole, left = ml.train_classifier(df), ml.train_classifier(holes)
    assert np.allclose(whole.coefficients, left.coefficients) and np.isclose(whole.intercept, left.intercept)


@pytest.mark.parametrize("labels", [[1, 1], [], [0, 2]])
def test_both_labels_have_to_occur(spark, labels):
    df = frame(spark, np.ones((len(labels), 1)), labels, 1) if labels else frame(spark, [[1.0]], [1], 1).limit(0)
    with pytest.raises(ValueError, match="labels 0 and 1"):
        ml.train_classifier(df)


def test_a_saved_model_is_replaced(spark, tmp_path):
    path = str(tmp_path / "m")
    for model in (ml.Classifier((1.0, -2.5), 0.5), ml.Classifier((3.0,), -1.0)):
        ml.save_model(model, path)
        assert ml.load_model(path) == model


def test_probabilities_at_the_margins(spark):
    df = frame(spark, [[0.0], [2000.0], [-2000.0], [1.0]], [0, 1, 0, 1], 1)
    got = {r.f[0]: (r.model_probability, r.prediction) for r in ml.predict(df, ml.Classifier((1.0,), 0.0)).collect()}
    assert got[0.0] == (0.5, 0) and got[2000.0] == (1.0, 1) and got[-2000.0] == (0.0, 0)
    assert got[1.0][0] == pytest.approx(1 / (1 + np.exp(-1)))


def test_words_that_cancel_out_score_as_zeros(spark):
    """As ``hash_embed`` documents and ``hashed_embeddings``' SQL has it: never a probability that is no number."""
    from cribble.catalog.lexical import LEX
    from cribble.catalog.stages import MODEL
    from cribble.operators.features import add_features, hash_embed, score_texts

    df = spark.createDataFrame([(1, "three five"), (2, "")], "id long, text string")
    rows = ml.score_and_tier(add_features(score_texts(df, LEX), lambda d: hash_embed(d, 8)), MODEL).orderBy("id").collect()
    assert list(rows[0].embedding) == [0.0] * 8
    assert [round(r.model_probability, 6) for r in rows] == [round(1 / (1 + np.exp(-MODEL.intercept)), 6)] * 2


def test_scored_queue_takes_words_that_cancel_out_as_its_sql_does(spark, tmp_path):
    """The SQL's length of 0 gives a score that is no number; texts without words score as zeros."""
    import duckdb

    from cribble import catalog

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    texts = "(VALUES (16, 'three five'), (30, ''), (44, NULL), (58, 'three five six')) t(doc_id, text)"
    con.execute(f"COPY (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, 'en' AS lang FROM {texts}) TO '{tmp_path}/documents.parquet'")
    con.execute(
        "COPY (SELECT CAST(doc_id AS BIGINT) AS o_orderkey, CAST(14 AS BIGINT) AS o_custkey, TIMESTAMP '2024-01-01' AS o_orderdate, "
        f"100e0 AS o_totalprice FROM {texts}) TO '{tmp_path}/orders.parquet'")
    for name in ("documents", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(catalog.oracle_sql()["scored_queue"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["scored_queue"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[0]: r[1] for r in got}[16] == "POTENTIAL_LB"
