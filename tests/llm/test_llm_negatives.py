import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribble.llm import hard_negatives as H
from cribble.llm.hard_negatives import mine_hard_negatives

SCHEMA = "id bigint, label string, embedding array<double>"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    seen = {}
    for id_, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        seen.setdefault((id_, label, tuple(vector)), [math.floor(256 * x) for x in vector])
    kept = [(id_, label, v) for (id_, label, _), v in seen.items()]
    order = lambda r: (-r[1], -math.inf if r[0] is None else r[0])
    out = []
    for a, label, v in kept:
        if a is None or not is_anchor(a):
            continue
        scored = [(i, sum(x * y for x, y in zip(v, w)), lab) for i, lab, w in kept if i != a]
        near = sorted((r for r in scored if r[2] == label), key=order)[:positives]
        far = sorted((r for r in scored if r[2] != label), key=order)
        for p, s, _ in near:
            hits = [r for r in far if low * s <= 100 * r[1] <= high * s][:negatives]
            out += [(a, p, k, r[0], s, r[1]) for k, r in enumerate(hits, 1)]
    return out


def mined(df, **more):
    rows = [tuple(r) for r in mine_hard_negatives(df, F.col("id") % 4 == 0, **more).collect()]
    return sorted(rows, key=str)


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    vectors = (centres[rng.integers(0, 6, n)] + rng.normal(scale=0.4, size=(n, dim))) / math.sqrt(dim)
    return [(i, f"l{rng.integers(0, labels)}", vectors[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_equals_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(H, "FIRST_ROWS", 8)
    rows = clustered(240, dim, dim)
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == sorted(brute(rows, lambda i: i % 4 == 0), key=str)
    assert mined(df, positives=2, negatives=1, low_percent=80, high_percent=100) == sorted(
        brute(rows, lambda i: i % 4 == 0, 2, 1, 80, 100), key=str)


def test_ties_hot_vectors_and_messy_rows(spark):
    same = [1.0, -0.5, 0.25]
    rows = [(i, "a" if i % 3 else "b", same) for i in range(60)]
    rows += [(100 + i, "c", [0.75, -0.375, 0.19]) for i in range(5)] + [(7, "a", same)] * 3
    rows += [(200, None, same), (204, "a", None), (208, "a", [1.0, None, 0.0]), (212, "b", [float("nan"), 0.0, 1.0]),
             (216, "b", [math.inf, 0.0, 0.0]), (220, "a", []), (224, "d", [0.0, 0.0, 0.0]), (None, "c", [0.7, -0.4, 0.2]),
             (228, "a", [-1.0, 0.5]), (104, "other", [0.74, -0.37, 0.2]), (232, "only", [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS anchor", "3 AS score").repartition(3)
    found = mined(df)
    assert found == sorted(brute(rows, lambda i: i % 4 == 0), key=str)
    assert any(r[3] is None for r in found)  # the row without id is a negative like any other


def test_vectors_too_long_take_no_part(spark):
    rows = [(0, "a", [1.0, 1.0]), (1, "a", [1.0, 0.5]), (2, "b", [0.8, 0.5]), (3, "b", [1e300, 1.0]), (4, "b", [1e10, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == sorted(brute(rows[:3], lambda i: i % 4 == 0), key=str)


def test_empty_and_single(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(4, "a", [1.0])], SCHEMA)) == []


def test_intervals_hold_every_score_and_narrow():
    rng = np.random.default_rng(5)
    signs = np.where(rng.random((H.LAYERS, 128)) < 0.5, -1.0, 1.0)
    numbers = rng.integers(-300, 300, (200, 100))
    codes, aligned, left = H.encode(numbers.astype(float), signs)
    norm = np.sqrt((numbers.astype(float) ** 2).sum(1))
    block = H.Block(np.arange(200), np.array(["x"] * 200), numbers, norm, codes, aligned, left)
    a = H.Anchors(np.arange(40), np.arange(40), np.array(["x"] * 40), numbers[:40], np.zeros((40, 1)), np.zeros((40, 1)), signs)
    pairs = H.Pairs(a, block, np.arange(40)[:, None], np.arange(200)[None])
    exact, width = numbers[:40] @ numbers.T, math.inf
    for _ in range(H.LAYERS):
        low, high = pairs.refine()
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < 0.8 * width
        width = (high - low).mean()


def test_runs_on_attached_embeddings_of_queue_items(spark):
    from cribble.operators.features import attach_embeddings

    items = spark.createDataFrame([(i, "ein Text", "WEAK_POSITIVE" if i % 2 else "WEAK_NEGATIVE") for i in range(24)],
                                  "id bigint, text string, label string")
    vectors = spark.createDataFrame([(i, [1.0, i / 24, 0.5]) for i in range(20)], "id bigint, embedding array<double>")
    joined = attach_embeddings(items, vectors, 3)
    rows = [(r.id, r.label, r.embedding) for r in joined.collect()]
    assert mined(joined) == sorted(brute(rows, lambda i: i % 4 == 0), key=str)


def test_blocks_grow_with_rows_and_cells_fill_the_cores():
    assert H._grid(0, 0, 8) == (8, 3) or H._grid(0, 0, 8)[0] >= 1
    assert H._grid(10 * H.BLOCK_ROWS, 1000, 8)[0] == 10
    blocks, parts = H._grid(100_000, 2_000, 400)
    assert blocks * parts >= 400
