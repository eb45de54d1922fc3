"""Resumable micro-batches: each candidate is judged once, however often the job is stopped and restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintang.sources.readers import CANDIDATE


def candidate_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSONL files of the folder; a key that was seen before, in any batch, does not come again.

    Keys never expire, so there is no watermark; the state holds one small entry per key in RocksDB or memory.
    """
    rows = spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where("id IS NOT NULL AND candidate_idx IS NOT NULL").dropDuplicates(["id", "candidate_idx"])


def run_resumable(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> int:
    """Judge all that is available and stop; writes (.., status) partitioned by batch, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def status_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
