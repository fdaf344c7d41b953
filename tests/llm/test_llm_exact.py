import hashlib

import pytest
from pyspark.sql import functions as F

from cribble.llm.exact_dedup import exact_copies, frequent_digests

SCHEMA = "id bigint, text string"


def brute(rows, change=lambda t: t):
    groups = {}
    for id_, text in rows:
        groups.setdefault(change(text or ""), []).append(id_)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: float("-inf") if i is None else i)
        sha, stays = hashlib.sha256(text.encode()).hexdigest(), True
        for id_ in ids:
            out.append((id_, keep, len(ids), id_ == keep and stays, sha))
            stays = stays and id_ != keep
    return sorted(out, key=str)


def copies(df, **more):
    return sorted((tuple(r) for r in exact_copies(df, **more).collect()), key=str)


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_equals_brute_force(spark, share):
    rows = [(i, "heiss" if i % 3 == 0 else f"t{i % 40}" if i % 3 == 1 else f"einzeln {i}") for i in range(900)]
    assert copies(spark.createDataFrame(rows, SCHEMA).repartition(6), share=share) == brute(rows)


@pytest.mark.parametrize("share", [0.001, 0.3])
def test_messy_rows(spark, messy, share):
    rows = [(r.id, r.text) for r in messy.collect()]
    assert copies(messy, share=share) == brute(rows)
    again = rows * 3 + [(None, "x"), (None, "x"), (8, None), (8, "")]
    assert copies(spark.createDataFrame(again, SCHEMA).repartition(5), share=share) == brute(again)


def test_empty(empty):
    assert copies(empty) == []


def test_normalized_texts(spark):
    rows = [(1, "Ja "), (2, "ja"), (3, "nein")]
    got = copies(spark.createDataFrame(rows, SCHEMA), normalize=lambda t: F.lower(F.trim(t)))
    assert got == brute(rows, lambda t: t.strip().lower())


def test_frequent_digests_are_all_found_and_counted(spark):
    rows = [(i, i, "a" if i % 3 == 0 else "b" if i % 10 == 1 else f"x{i}") for i in range(6_000)]
    digests = spark.createDataFrame(rows, "id bigint, row bigint, digest string").repartition(9)
    found = {r.digest: (r.group_size, r.keep.id) for r in frequent_digests(digests, 0.05).collect()}
    assert found == {"a": (2_000, 5_997), "b": (400, 5_981)}


def test_no_python_in_the_plan(spark, messy):
    plan = exact_copies(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
