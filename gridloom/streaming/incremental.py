"""Extensions beyond the batch operators: the same accumulators and logs as streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import metrics


def running_errors(boards: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """error_decomposition() of a stream of boards: counts add up, so update and complete modes both serve."""
    return metrics.error_decomposition(boards, pred, truth)


def windowed_tolerance(events: DataFrame, time: str, wrong: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tolerance shares by event-time window; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), *metrics.within(F.col(wrong))).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *[f"within_{t}" for t in metrics.TOLERANCES])


def sessions(events: DataFrame, time: str, key: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, closed after a gap."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def upsert_log(log: DataFrame, target: str, key: list[str], sequence: str, checkpoint: str) -> StreamingQuery:
    """Each batch of an append-only log, its last record of each key kept, over the table at target.

    A batch that runs again gives the same table: a record counts only if its sequence number isn't lower.
    """
    from gridloom.operators.merging import last_write
    from gridloom.sources.readers import tolerant
    from gridloom.sources.sinks import replace

    def apply(batch: DataFrame, _: int) -> None:
        old = tolerant(batch.sparkSession, target, None)
        rows = batch if old is None else old.unionByName(batch)
        replace(last_write(rows, key, sequence), target)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets(log: DataFrame, target: str, key: list[str], sequence: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """As upsert_log(), over a table in buckets by a hash of the key: a batch rewrites only the buckets that it touches.

    What a batch makes of its buckets is staged beside the target before any is written over. A batch that broke off
    while they were is finished from the stage when it runs again, so no bucket loses what only the table held. The
    number of buckets is the table's for good. read_buckets() reads it.
    """
    from gridloom.operators.merging import last_write
    from gridloom.sources.sinks import _fs

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # batches are numbered by their checkpoint

    def apply(batch: DataFrame, number: int) -> None:
        spark, stage = batch.sparkSession, f"{target}.stage/{name}-{number}"
        fs, staged = _fs(spark, stage)
        if not fs.exists(_fs(spark, f"{stage}/_SUCCESS")[1]):
            fresh = last_write(batch, key, sequence).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            if fs.exists(_fs(spark, target)[1]):
                touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
                old = spark.read.schema(fresh.schema).parquet(target).where(F.col("bucket").isin(*touched)) if touched else fresh.limit(0)
                fresh = last_write(old.unionByName(fresh), key, sequence)
            fresh.write.mode("overwrite").parquet(stage)
        made = spark.read.parquet(stage)
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        fs.delete(staged, True)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_buckets(spark: SparkSession, target: str) -> DataFrame:
    """The table that upsert_buckets() keeps."""
    return spark.read.parquet(target).drop("bucket")
