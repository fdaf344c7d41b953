"""Work off what is waiting, in batches, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cribble.operators.queue import fetch
from cribble.operators.ranking import number_rows
from cribble.sources.tables import materialize


#: Batches up to this size are a top-n, which ends in one task; larger ones are cut off by number.
MAX_TOP = 100_000


def drain(
    spark: SparkSession,
    path: str,
    schema: StructType,
    step: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int = 5,
    status: str | None = None,
) -> None:
    """Run ``step`` over all files waiting in ``path`` and append its rows to ``out``.

    A later call takes up where this one stopped. A batch that is repeated
    after a failure overwrites its own directory, so no row appears twice. The
    directory bears the id of the stream, kept in its checkpoint, so a new
    checkpoint never overwrites what an older one wrote. Read the result with
    ``read_drained``.
    """
    waiting = spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch
    ).parquet(path)
    if status is not None:
        waiting = waiting.where(F.col("status") == status)

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/run={stream_id(spark, checkpoint)}/batch={batch_id}")

    query = (
        waiting.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _committed(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose claims are wholly written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/claims/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def drain_status(
    queue: DataFrame,
    status: str,
    step: Callable[[DataFrame], DataFrame],
    out: str,
    per_batch: int | None = None,
) -> int:
    """Run ``step`` over the items that are in ``status``, oldest first, until none are left; returns the batches run.

    ``out`` keeps a log of claims, ``(id, last_update_at)`` of every item taken. An item is taken once
    in one state: a later call passes it over until a transition has given it a new stamp and
    brought it back to ``status``, as resets and retries do; then it is taken again, once. A batch counts from
    when its claims are written, after its rows; one that broke off before is run anew under its number. Read the rows with
    ``read_claimed``. A step that needs few columns reads few, one that reads its batch
    several times should keep it. One caller drains into ``out`` at a time.
    """
    spark, runs = queue.sparkSession, 0
    key = (F.col("id") == F.col("_id")) & F.col("last_update_at").eqNullSafe(F.col("_at"))
    names = {"id": "_id", "last_update_at": "_at"}
    waiting = queue.where(F.col("status") == status)
    while True:
        done = _committed(spark, out)
        # Whom to claim is settled by ids and stamps alone; the items themselves are read by the step.
        open_ = waiting.select("id", "last_update_at", "discovered_at", "status")
        if done:
            claims = spark.read.schema("id bigint, last_update_at timestamp, batch bigint").parquet(f"{out}/claims")
            taken = claims.where(F.col("batch").isin(done)).select("id", "last_update_at").withColumnsRenamed(names)
            open_ = open_.join(taken, key, "left_anti")
        if per_batch is not None and per_batch <= MAX_TOP:
            open_ = fetch(open_, status, limit=per_batch)
        elif per_batch is not None:
            open_ = number_rows(open_, ["discovered_at", "id"], "_n").where(F.col("_n") < per_batch)
        claimed = materialize(open_.drop("discovered_at", "status", "_n"), "claimed")
        if claimed.isEmpty():
            return runs
        number = max(done, default=-1) + 1
        batch = waiting.join(claimed.withColumnsRenamed(names), key, "left_semi")
        step(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        claimed.select("id", "last_update_at").write.mode("overwrite").parquet(f"{out}/claims/batch={number}")
        runs += 1


def read_claimed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all batches that ``drain_status`` has completed, with their ``batch``."""
    return spark.read.parquet(f"{out}/rows").where(F.col("batch").isin(_committed(spark, out)))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream writes into its checkpoint before its first batch."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def read_drained(spark: SparkSession, out: str) -> DataFrame:
    """What ``drain`` or ``dedup_ingest`` wrote, without the columns that name its folders."""
    return spark.read.parquet(out).drop("run", "batch", "bucket")
