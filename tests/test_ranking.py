import random
import statistics

import pytest
from pyspark.sql import functions as F

from cribble.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group, one score and nearly one position."""
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"g{rng.randint(0, 9)}", 0.5 if hot else rng.random(), rng.randint(0, 1)))
    return rows, spark.createDataFrame(rows, "id long, g string, s double, y int").repartition(7).cache()


def test_top_per_group(skewed):
    rows, df = skewed
    got = {(r.g, r.id, r["rank"]) for r in R.top_per_group(df, ["g"], [F.desc("s"), F.col("id")], 5, salts=3).collect()}
    expected = set()
    for g in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:5]
        expected |= {(g, r[0], k + 1) for k, r in enumerate(best)}
    assert got == expected


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.333, 1.0])
def test_lowest_share(skewed, fraction):
    rows, df = skewed
    keyed = df.withColumn("k", R.hash_key(F.col("id").cast("string"), seed=42))
    out = R.lowest_share(keyed, "g", "k", "id", F.round(F.col("n") * fraction), "pick", prefix=1).collect()
    assert len(out) == len(rows)
    for g in {r[1] for r in rows}:
        mine = sorted((r.k, r.id, r.pick) for r in out if r.g == g)
        want = int(len(mine) * fraction + 0.5)
        assert [m[2] for m in mine] == [True] * want + [False] * (len(mine) - want)


def test_lowest_share_null_group_and_equal_keys(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", "same") for i in range(20)], "id long, g string, k string")
    out = R.lowest_share(df, "g", "k", "id", F.lit(3), "pick").where("pick").collect()
    assert sorted(r.id for r in out) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("buckets", [1, 5, 1000])
def test_running_sums(skewed, buckets):
    rows, df = skewed
    counts = df.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    out = R.running_sums(counts, "s", ["n"], ["g"], buckets=buckets).collect()
    for r in out:
        assert r.n_before == sum(1 for x in rows if x[1] == r.g and x[2] < r.s)
        assert r.n_total == sum(1 for x in rows if x[1] == r.g)
    assert sum(r.n for r in out) == len(rows)


def test_number_rows(spark):
    ids = random.Random(3).sample(range(10**12), 2000)
    out = R.number_rows(spark.createDataFrame([(i,) for i in ids], "p long"), "p", "n").collect()
    assert [r.p for r in sorted(out, key=lambda r: r.n)] == sorted(ids)
    assert sorted(r.n for r in out) == list(range(2000))
    assert R.number_rows(spark.createDataFrame([], "p long"), "p", "n").collect() == []


def test_exact_median(skewed):
    rows, df = skewed
    out = {r.g: r.m for r in R.exact_median(df, ["g"], "s", "m").collect()}
    for g in out:
        assert out[g] == statistics.median(r[2] for r in rows if r[1] == g)


def test_broadcast_if_small(spark):
    small = R.broadcast_if_small(spark.range(5), max_rows=5)
    large = R.broadcast_if_small(spark.range(6), max_rows=5)
    assert small.count() == 5 and large.count() == 6

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(small) and not hinted(large)


def test_every_row_survives_the_unhinted_path(spark, monkeypatch):
    """Results stay the same when nothing is small enough to broadcast."""
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g")).withColumn(
        "k", R.hash_key(F.col("id").cast("string"), seed=1))
    usual = {r.id for r in R.lowest_share(df, "g", "k", "id", F.lit(40), "p").where("p").collect()}
    monkeypatch.setattr(R, "broadcast_if_small", lambda d, max_rows=0: d)
    plain = {r.id for r in R.lowest_share(df, "g", "k", "id", F.lit(40), "p").where("p").collect()}
    assert usual == plain and len(plain) == 120


@pytest.mark.parametrize("order", ["v", ["v"], ["v", "w"]])
def test_rows_are_numbered_by_one_column_or_several(spark, order):
    from cribble.operators.ranking import number_rows

    rows = [(i * 7 % 50, i % 3) for i in range(50)]
    got = number_rows(spark.createDataFrame(rows, "v int, w int").repartition(5), order, "n").collect()
    assert sorted((r.n, r.v) for r in got) == [(i, i) for i in range(50)]


@pytest.mark.parametrize("limit", [2, 1_000])
@pytest.mark.parametrize("k", [3, 150, 10_000])
def test_top_of_any_k(skewed, monkeypatch, limit, k):
    monkeypatch.setattr(R, "LIMITED_RANK", limit)
    rows, df = skewed
    with_null = df.unionByName(df.where("id % 5 = 0").withColumn("g", F.lit(None).cast("string")))
    got = {(r.g, r.id, r["rank"]) for r in R.top_per_group(with_null, ["g"], [F.desc("s"), F.col("id")], k).collect()}
    expected = set()
    for g in {r[1] for r in rows} | {None}:
        mine = [r for r in rows if r[1] == g] if g else [r for r in rows if r[0] % 5 == 0]
        expected |= {(g, r[0], i + 1) for i, r in enumerate(sorted(mine, key=lambda r: (-r[2], r[0]))[:k])}
    assert got == expected


def test_ranges_split_a_group_that_ties(spark, monkeypatch):
    """A third of the rows in one class, all of one order; every task gets a small part of them."""
    monkeypatch.setattr(R, "LIMITED_RANK", 2)
    df = spark.range(60_000).selectExpr("id", "IF(id % 3 = 0, 'hot', 'g' || id % 50) AS g", "0 AS o").repartition(8)
    top = R.top_per_group(df, ["g"], [F.col("o")], 5_000)
    assert {r.g: r["count"] for r in top.groupBy("g").count().collect()}["hot"] == 5_000
    sizes = [r["count"] for r in R.number_rows(df, ["g", "o", F.xxhash64("id")], "n").groupBy(
        F.spark_partition_id()).count().collect()]
    assert max(sizes) < 20_000


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_running_sums_of_several_columns_over_batches(spark, skewed, monkeypatch, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows, df = skewed
        counts = df.withColumn("g", F.when(F.col("g") != "g3", F.col("g"))).groupBy("g", "s").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("y") / 2).alias("h"))
        got = R.running_sums(counts, "s", ["n", "h"], ["g"], buckets=parts).collect()
        assert len(got) == counts.count()
        for r in got:
            mine = [x for x in rows if (None if x[1] == "g3" else x[1]) == r.g]
            assert r.n_before == sum(x[2] < r.s for x in mine) and r.n_total == len(mine)
            assert r.h_before == sum(x[3] / 2 for x in mine if x[2] < r.s)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_sums_hold_no_bounds_in_the_plan(spark, skewed):
    _, df = skewed
    counts = df.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    plan = R.running_sums(counts, "s", ["n"], ["g"])._jdf.queryExecution().toString()
    assert "0.5" not in plan and len(plan) < 20_000
    assert R.running_sums(counts.limit(0), "s", ["n"]).count() == 0


def test_a_shuffle_is_a_permutation(spark):
    from cribble.operators.sampling import shuffle_sample

    rows = spark.range(3_000).withColumn("s", F.col("id") % 2)
    got = sorted((r.pos, r.id) for r in shuffle_sample(rows, 7).collect())
    assert [p for p, _ in got] == list(range(3_000)) and sorted(i for _, i in got) == list(range(3_000))
    assert got == sorted((r.pos, r.id) for r in shuffle_sample(rows.repartition(5), 7).collect())
    assert [i for _, i in got] != list(range(3_000))
