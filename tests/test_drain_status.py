from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cribble.operators.features import hash_embed
from cribble.operators.queue import transition
from cribble.schemas import QUEUE
from cribble.streaming import drain as D

T0, T1 = datetime(2026, 1, 1), datetime(2026, 2, 1)


def items(spark, states):
    rows = [{"id": i, "url": f"u{i}", "status": s, "discovered_at": T0, "last_update_at": None if i == 3 else T0} for i, s in states.items()]
    return spark.createDataFrame(rows, QUEUE)


def taken(spark, out):
    return sorted((r.batch, r.id) for r in D.read_claimed(spark, out).collect())


def test_each_item_once_per_state(spark, tmp_path):
    out, step = str(tmp_path / "o"), lambda b: b.select("id")
    queue = items(spark, {1: "SCREENED", 2: "SCREENED", 3: "SCREENED", 4: "DISCOVERED"})
    assert D.drain_status(queue, "SCREENED", step, out, per_batch=2) == 2
    assert taken(spark, out) == [(0, 1), (0, 2), (1, 3)]
    assert D.drain_status(queue, "SCREENED", step, out) == 0
    back = transition(queue, spark.createDataFrame([(2, "SCREENED"), (3, "SCREENED"), (4, "SCREENED")], "id long, status string"), T1)
    assert D.drain_status(back, "SCREENED", step, out) == 1
    assert taken(spark, out)[3:] == [(2, 2), (2, 3), (2, 4)]


@pytest.mark.parametrize("at", ["rows", "claims"])
def test_a_batch_that_broke_off_is_run_anew(spark, tmp_path, monkeypatch, at):
    out, queue, fail = str(tmp_path / "o"), items(spark, {1: "SCREENED", 2: "SCREENED"}), [True]

    def step(batch):
        if fail[0] and at == "rows":
            raise RuntimeError("lost")
        return batch.select("id")

    if at == "claims":
        real = D.materialize

        def broken(df, name):  # claims are read off the batch after its rows are written
            kept = real(df, name)
            kept.select = lambda *c: (_ for _ in ()).throw(RuntimeError("lost")) if len(c) == 2 else type(kept).select(kept, *c)
            return kept

        monkeypatch.setattr(D, "materialize", broken)
    with pytest.raises(RuntimeError, match="lost"):
        D.drain_status(queue, "SCREENED", step, out)
    monkeypatch.undo()
    fail[0] = False
    assert D.drain_status(queue.where("id = 2"), "SCREENED", step, out) == 1
    assert taken(spark, out) == [(0, 2)]
    assert D.drain_status(queue, "SCREENED", step, out) == 1
    assert taken(spark, out) == [(0, 2), (1, 1)]


def test_steps_may_give_many_rows_or_none(spark, tmp_path):
    out = str(tmp_path / "o")
    queue = items(spark, {1: "SCREENED", 2: "SCREENED", 5: "SCREENED"})
    D.drain_status(queue, "SCREENED", lambda b: b.where("id > 1").select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x")), out)
    assert taken(spark, out) == [(0, 2), (0, 2), (0, 5), (0, 5)]
    assert D.drain_status(queue, "SCREENED", lambda b: b.select("id"), out) == 0


def test_large_batches_are_cut_by_number(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "o")
    monkeypatch.setattr(D, "MAX_TOP", 3)
    queue = items(spark, {i: "SCREENED" if i % 3 else "DISCOVERED" for i in range(1, 22)})
    assert D.drain_status(queue, "SCREENED", lambda b: b.select("id"), out, per_batch=5) == 3
    ids = [i for i in range(1, 22) if i % 3]
    assert taken(spark, out) == [(k // 5, i) for k, i in enumerate(ids)]


def test_only_claims_are_written_besides_rows(spark, tmp_path, monkeypatch):
    kept, real = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: kept.append(df.columns) or real(df, name))
    seen = []
    D.drain_status(items(spark, {1: "SCREENED", 2: "SCREENED"}), "SCREENED",
                   lambda b: seen.append(b.columns) or b.select("id", "url"), str(tmp_path / "o"), per_batch=1)
    assert kept == [["id", "last_update_at"]] * 3
    assert seen == [[f.name for f in QUEUE.fields]] * 2
    assert [r.url for r in D.read_claimed(spark, str(tmp_path / "o")).orderBy("id").collect()] == ["u1", "u2"]


def test_hashed_embedding(spark):
    import hashlib
    import math

    texts = ["Ein Wort ein", "", None, "...", "漢字 Éa éA a1", "x " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.text, list(r.embedding)) for r in hash_embed(df, 8).collect()}
    for i, words in enumerate([["ein", "wort", "ein"], [], [], [], ["漢字", "éa", "éa", "a1"], ["x"] * 1000]):
        v = [0.0] * 8
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += 1 if h[8] < "8" else -1
        n = math.sqrt(sum(x * x for x in v))
        assert got[i][0] == texts[i] and got[i][1] == pytest.approx([x / n if n else 0.0 for x in v])
