"""A table of vectors kept up by a stream of inserts and deletes, as numbered snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (id, v) after changes (seq, op, id, v): of each id the last change counts, 'delete' or an insert of v."""
    last = changes.withColumn("__r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq")))).where("__r = 1")
    return rows.join(last.select("id"), "id", "left_anti").select("id", "v").unionByName(last.where("op <> 'delete'").select("id", "v"))


def start_snapshots(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes the next snapshot from the last; a batch that runs again writes the same one."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/snapshot-{epoch - 1}") if epoch else spark.createDataFrame([], batch.select("id", "v").schema)
        apply_changes(before, batch).write.mode("overwrite").parquet(f"{folder}/snapshot-{epoch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/snapshot-{epoch}")


def slide(changes: DataFrame, window: int, chunk: int) -> DataFrame:
    """For arrivals (seq, id) in order: (step, id) of the rows alive after each full chunk.

    A row that came in chunk c is alive in the steps from c until it leaves the window, so each
    row is repeated at most window / chunk + 1 times and no state is kept.
    """
    came = F.floor(F.col("seq") / chunk)
    leaves = F.floor((F.col("seq") + window) / chunk) + 1
    steps = F.sequence(came.cast("long"), leaves.cast("long"))
    alive = changes.select("id", "seq", F.explode(steps).alias("step"))
    start = F.col("step") * chunk
    oldest = F.when(start >= window + chunk, start - window).otherwise(0)
    return alive.where((F.col("seq") < start + chunk) & (F.col("seq") >= oldest)).select("step", "id")
