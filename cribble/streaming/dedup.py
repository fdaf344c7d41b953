"""Insert only URLs never seen before, across restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cribble.operators.discover import first_seen
from cribble.streaming.drain import stream_id


def distinct_urls(stream: DataFrame, url: str = "url") -> DataFrame:
    """Exact de-duplication; the state holds every URL ever seen, so use the RocksDB store."""
    return stream.dropDuplicates([url])


def distinct_urls_within(
    stream: DataFrame, event_time: str, delay: str, url: str = "url"
) -> DataFrame:
    """Bounded state: a URL that comes back after ``delay`` is let in again."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([url])


#: The store's rows lie in so many folders by a hash of the URL.
BUCKETS = 64
#: Words of 64 bits in the filter over the stored URLs. Up to some four URLs a word it is sharp;
#: a fuller one only sends more batches to the rows.
WORDS = 1 << 22


def _spread(url: Column, words: int, buckets: int) -> tuple[Column, Column, Column]:
    """A URL's word in the filter, its four bits there, and its bucket (a range of words)."""
    word = F.pmod(F.xxhash64(url), F.lit(words).cast("bigint"))
    places = F.xxhash64(url, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        bit = F.shiftrightunsigned(places, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return word, mask, F.floor(word * buckets / words).cast("int")


class _Filters:
    """Versions of the filter beside the rows, ``seq=N/run=R/batch=B``; a version is whole once it has ``_SUCCESS``."""

    def __init__(self, spark: SparkSession, out: str, run: str, batch: int):
        self.spark, self.home, self.own = spark, f"{out}/_filters", f"run={run}/batch={batch}"
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(self.home)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = self.files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/seq=*/run=*/batch=*/_SUCCESS"))
        names = [x.getPath().getParent().toString() for x in (done or [])]
        self.whole = {int(n.split("/seq=")[1].split("/")[0]): n for n in names if not n.endswith(self.own)}
        self.newest = max(self.whole, default=-1)

    def read(self) -> DataFrame | None:
        """``word, bits`` of the newest whole version that another batch wrote."""
        if self.newest < 0:
            return None
        return self.spark.read.schema("word bigint, bits bigint").parquet(self.whole[self.newest])

    def write(self, words: DataFrame) -> None:
        words.write.mode("overwrite").parquet(f"{self.home}/seq={self.newest + 1}/{self.own}")
        for seq in self.whole:
            if seq < self.newest:  # the one before stays, should this batch be repeated
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/seq={seq}"), True)


def dedup_ingest(
    spark: SparkSession,
    path: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    files_per_batch: int = 100,
    buckets: int = BUCKETS,
    words: int = WORDS,
) -> None:
    """Append new URLs from candidate files to ``out`` until none are waiting.

    The table itself is the memory, so there is no state to outgrow an executor and
    each restart is exact, under a new checkpoint as well. Each batch keeps its first row per URL
    and asks a filter of fixed size (at most ``words`` rows of 16 bytes) which URLs may be stored. Only for
    those are rows read, the ``url`` column of their buckets alone; a batch of URLs that are all new reads
    none. The filter is written before the rows, so that it never lacks a stored
    URL whenever a batch breaks off. ``buckets`` and ``words`` stay as a store was begun with; one
    stream writes to a store at a time. Rows carry ``url, source_pos, item_pos``; read the store with ``read_drained``.
    """
    waiting = spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch
    ).parquet(path)
    word, mask, bucket = _spread(F.col("url"), words, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = stream_id(spark, checkpoint)
        fresh = first_seen(batch).withColumns({"_word": word, "_mask": mask, "bucket": bucket}).persist()
        try:
            filters = _Filters(spark, out, run, batch_id)
            known, new = filters.read(), fresh.select(F.col("_word").alias("word"), F.col("_mask").alias("bits"))
            grown = new if known is None else known.unionByName(new)
            filters.write(grown.groupBy("word").agg(F.bit_or("bits").alias("bits")))
            kept = fresh
            if known is not None:
                may_be = fresh.join(known, F.col("_word") == F.col("word")).where(
                    F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select("url", "bucket")
                touched = [r["bucket"] for r in may_be.select("bucket").distinct().collect()]  # at most ``buckets``
                if touched:
                    stored = spark.read.schema("url string, run string, batch long, bucket int").parquet(out).where(
                        F.col("bucket").isin(touched) & ((F.col("run") != run) | (F.col("batch") != batch_id)))
                    again = may_be.join(stored.select("url"), "url", "left_semi").select("url")
                    kept = fresh.join(again, "url", "left_anti")
            kept.drop("_word", "_mask").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{out}/run={run}/batch={batch_id}")
        finally:
            fresh.unpersist()

    query = (
        waiting.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
