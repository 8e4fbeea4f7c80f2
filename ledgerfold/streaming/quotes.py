"""Incremental opening and closing quotes with Structured Streaming.

Quote files are read as a stream.  Each micro-batch is reduced to one row per
event and written as its own delta, named by the batch number, so a batch
replayed after a failure overwrites itself.  Opening and closing are a min and
a max: deltas are merged when read, in any order, late quotes included, and a
batch never rewrites what earlier batches wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUOTE = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("snapshot_ts", T.TimestampType()),
                      T.StructField("quote_id", T.LongType()), T.StructField("prob_a", T.DoubleType())])
LINES = T.StructType([T.StructField("event_id", T.StringType()), *[
    T.StructField(f"{side}_{c}", t) for side in ("open", "close")
    for c, t in (("ts", T.TimestampType()), ("id", T.LongType()), ("prob", T.DoubleType()))]])


def quote_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream of landed quote files."""
    return spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def reduce_batch(batch: DataFrame) -> DataFrame:
    """One row per event: earliest and latest quote of the batch."""
    at = F.struct("snapshot_ts", "quote_id")
    q = F.struct(F.col("snapshot_ts").alias("ts"), F.col("quote_id").alias("id"), F.col("prob_a").alias("prob"))
    g = batch.groupBy("event_id").agg(F.min_by(q, at).alias("open"), F.max_by(q, at).alias("close"))
    return g.select("event_id", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("open", "close") for f in ("ts", "id", "prob")])


def merge_lines(deltas: DataFrame) -> DataFrame:
    """One row per event from any number of deltas."""
    o, c = F.struct("open_ts", "open_id", "open_prob"), F.struct("close_ts", "close_id", "close_prob")
    return deltas.groupBy("event_id").agg(F.min(o).alias("o"), F.max(c).alias("c")).select("event_id", "o.*", "c.*")


def read_lines(spark: SparkSession, target: str) -> DataFrame:
    """Current opening and closing quote of every event."""
    return merge_lines(spark.read.schema(LINES).option("recursiveFileLookup", True).parquet(target))


def compact(spark: SparkSession, target: str, into: str) -> None:
    """Write the merged state as one table; new deltas then start from it."""
    read_lines(spark, target).write.mode("overwrite").parquet(into)


def run_available(spark: SparkSession, landing: str, target: str, progress: str, files_per_batch: int = 1) -> None:
    """Process all landed files once and stop (for schedulers and tests)."""

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        reduce_batch(batch).write.mode("overwrite").parquet(f"{target}/batch_{batch_id:012d}")

    q = (quote_stream(spark, landing, files_per_batch).writeStream.foreachBatch(write_delta)
         .option("checkpointLocation", progress).trigger(availableNow=True).start())
    q.awaitTermination()
