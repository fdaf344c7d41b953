import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from cribble.streaming import dedup
from cribble.streaming.dedup import dedup_ingest
from cribble.streaming.drain import read_drained

SCHEMA = StructType().add("url", StringType()).add("source_pos", LongType()).add("item_pos", LongType())


def put(spark, path, urls):
    rows = [(u, 0, i) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def ingest(spark, tmp_path, name="a", **more):
    dedup_ingest(spark, str(tmp_path / name), SCHEMA, str(tmp_path / "store"), str(tmp_path / f"ck-{name}"), **more)


def stored(spark, tmp_path):
    return sorted(r.url for r in read_drained(spark, str(tmp_path / "store")).collect())


def scans(spark, monkeypatch):
    """How often stored rows were read, by the filter on buckets that goes with it."""
    seen = []
    real = spark.read.__class__.parquet

    def parquet(self, *paths, **more):
        seen.extend(p for p in paths if p.endswith("/store"))
        return real(self, *paths, **more)

    monkeypatch.setattr(spark.read.__class__, "parquet", parquet)
    return seen


def test_new_urls_read_no_stored_rows(spark, tmp_path, monkeypatch):
    seen = scans(spark, monkeypatch)
    for k in range(4):
        put(spark, tmp_path / "a", [f"u{k}-{i}" for i in range(300)])
        ingest(spark, tmp_path)
    assert seen == []
    put(spark, tmp_path / "a", ["u0-5", "new"])
    ingest(spark, tmp_path)
    assert len(seen) == 1
    monkeypatch.undo()
    assert stored(spark, tmp_path) == sorted([f"u{k}-{i}" for k in range(4) for i in range(300)] + ["new"])


def test_a_full_filter_loses_nothing(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path / "a", [f"u{i}" for i in range(k * 40, k * 40 + 80)])
        ingest(spark, tmp_path, words=2, buckets=2)
    assert stored(spark, tmp_path) == sorted(f"u{i}" for i in range(160))


def test_the_filter_keeps_its_size_and_two_versions(spark, tmp_path):
    for k in range(5):
        put(spark, tmp_path / "a", [f"u{k}-{i}" for i in range(50)])
        ingest(spark, tmp_path, words=16, buckets=4)
    versions = sorted(os.listdir(tmp_path / "store" / "_filters"))
    assert versions == ["seq=3", "seq=4"]
    assert spark.read.parquet(str(tmp_path / "store" / "_filters" / "seq=4")).count() == 16


@pytest.mark.parametrize("broken", ["rows", "filter"])
def test_a_batch_that_broke_off_is_repeated_exactly(spark, tmp_path, monkeypatch, broken):
    put(spark, tmp_path / "a", ["u1", "u2"])
    ingest(spark, tmp_path)
    put(spark, tmp_path / "a", ["u2", "u3"])
    real = dedup._Filters.write

    def write(self, words):
        if broken == "rows":
            real(self, words)  # the filter is there, the rows are not
        raise RuntimeError("lost")

    monkeypatch.setattr(dedup._Filters, "write", write)
    with pytest.raises(Exception, match="lost"):
        ingest(spark, tmp_path)
    monkeypatch.undo()
    put(spark, tmp_path / "b", ["u3", "u1", "u4"])
    ingest(spark, tmp_path, "b")  # another stream, before the broken one is taken up again
    ingest(spark, tmp_path)
    assert stored(spark, tmp_path) == ["u1", "u2", "u3", "u4"]


def test_an_unfinished_version_is_passed_over(spark, tmp_path):
    put(spark, tmp_path / "a", ["u1", "u2"])
    ingest(spark, tmp_path)
    half = tmp_path / "store" / "_filters" / "seq=1" / "run=x" / "batch=0"
    half.mkdir(parents=True)
    spark.range(0).selectExpr("id AS word", "id AS bits").write.mode("overwrite").parquet(str(half))
    (half / "_SUCCESS").unlink()
    put(spark, tmp_path / "b", ["u2", "u5"])
    ingest(spark, tmp_path, "b")
    assert stored(spark, tmp_path) == ["u1", "u2", "u5"]


def test_words_and_buckets(spark):
    word, mask, bucket = dedup._spread(F.col("url"), 1000, 8)
    rows = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url")).select(word.alias("w"), mask.alias("m"), bucket.alias("b")).collect()
    assert {r.b for r in rows} == set(range(8)) and all(r.b == r.w * 8 // 1000 for r in rows)
    assert all(1 <= bin(r.m % 2**64).count("1") <= 4 for r in rows)
