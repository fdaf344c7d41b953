"""The language network: gradients, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from cribble.llm import language
from cribble.llm.language import Network, chunks_of, fit_language_tagger, gradients, symbols_of, tag_language, train
from cribble.llm.words import buffers

FOLDER = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network.fresh(["a", "b", "c"], 3, rng)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    w["wz"][:, language.PAD] = 60
    rows, length, text = chunks_of(*symbols_of(*buffers(pa.array(["ab cd é", "xyz", "q"]))), 5)
    codes, label = np.ascontiguousarray(rows.T), text % 3
    old = language._states
    try:
        loss, g = gradients(w, codes, length, label)
    finally:
        language._states = old
    for name in w:
        for at in [tuple(rng.integers(0, s) for s in w[name].shape) for _ in range(6)]:
            if name == "wz" and at[1] == language.PAD:
                continue
            values = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                values.append(gradients(moved, codes, length, label)[0])
            assert g[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-4)


def test_chunks_hold_every_symbol():
    texts = ["", "abc", "x" * 23, "1 2 3", "é" * 9]
    codes, bounds = symbols_of(*buffers(pa.array(texts)))
    assert np.diff(bounds).tolist() == [0, 3, 23, 1, 18]
    rows, length, text = chunks_of(codes, bounds, 10)
    assert np.bincount(text, length, minlength=5).tolist() == [0, 3, 23, 1, 18]
    assert (rows != language.PAD).sum(1).tolist() == length.tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id AS id", "text", "lang AS language", "doc_id % 4 = 2 AS held")
    net = fit_language_tagger(docs.where("NOT held"), rounds=250)
    assert net.languages == ["de", "en", "es", "fr"]
    held = docs.where("held AND language IS NOT NULL")
    rows = tag_language(held, net).withColumnRenamed("language", "found").join(held, "id").select("found", "language").collect()
    assert np.mean([r.found == r.language for r in rows]) > 0.97


@pytest.fixture(scope="module")
def small_net():
    return train(["the cat sat on the mat"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20, rounds=60)


def test_messy_rows(messy, empty, small_net):
    rows = tag_language(messy, small_net).collect()
    assert len(rows) == 11
    for r in rows:
        assert (r.language == "und" and r.language_probability == 0) if r.id in (None, 2, 3, 4) else r.language in ("de", "en")
        assert 0 <= r.language_probability <= 1
    assert tag_language(empty, small_net).count() == 0


def test_position_in_a_batch_does_not_matter(spark, small_net):
    texts = [(i, "die katze und der hund " * (i % 40 + 1)) for i in range(60)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    one = {r.id: r for r in tag_language(df.repartition(1), small_net).collect()}
    many = {r.id: r for r in tag_language(df.repartition(13), small_net).collect()}
    assert all(one[i].language == many[i].language for i in one)
    assert all(abs(one[i].language_probability - many[i].language_probability) < 1e-5 for i in one)


def test_nothing_learned(spark, messy):
    none = spark.createDataFrame([(None, "en"), ("abc", None), ("12", "en")], "text string, language string")
    assert {r.language for r in tag_language(messy, fit_language_tagger(none)).collect()} == {"und"}
    one = spark.createDataFrame([("abc", "en")], "text string, language string")
    assert {r.language for r in tag_language(messy, fit_language_tagger(one)).collect()} == {"und", "en"}


def test_the_sample_is_bounded_however_many_rows_share_a_text(spark, monkeypatch):
    from cribble.llm import language as L

    seen = {}
    monkeypatch.setattr(L, "train", lambda texts, languages, **more: seen.update(texts=texts, languages=languages))
    copies = spark.range(20_000).selectExpr("'immer der gleiche Satz' AS text", "IF(id % 2 = 0, 'de', 'xx') AS language")
    others = spark.range(3_000).selectExpr("'Satz Nummer ' || id AS text", "'de' AS language")
    L.fit_language_tagger(copies.unionByName(others), per_language=50)
    assert len(set(zip(seen["texts"], seen["languages"]))) == len(seen["texts"]) <= 4 * 50
    assert 25 <= seen["languages"].count("de") <= 100 and seen["languages"].count("xx") == 1
