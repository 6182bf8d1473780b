"""Run states from a stream of events, with the same answer as ``operators.runs.current`` over all of them."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from ..storage import shared_dir


def run_states(events: DataFrame) -> DataFrame:
    """Stream of events (run_id, state, updated_at, error_code, sequence) to a row for each run that changed in a batch.

    One built-in aggregation, combined before its shuffle and kept in the state store: the same expression as in batch.
    """
    return runs.current(events)


def created_once(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests by payload digest, the first of each within the delay."""
    keyed = requests.withColumn("run_id", F.concat(F.lit("review-"), F.sha2(F.col("payload").cast("binary"), 256)))
    return keyed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["run_id"])


def to_table(stream: DataFrame, path: str, label: str = "stream"):
    """Start writing updates of run states as tables of changes, all that is there now; the last by sequence counts."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", f"{shared_dir(spark)}/{label}-checkpoint-{crc32(path.encode())}").trigger(availableNow=True).foreachBatch(keep).start()


def settled(spark, path: str) -> DataFrame:
    """The last row of each run in the tables that to_table wrote."""
    every = spark.read.parquet(f"{path}/batch=*")
    row = F.max_by(F.struct("state", "updated_at", "error_code", "sequence", "attempts"), F.struct("sequence", "attempts"))
    return every.groupBy("run_id").agg(row.alias("_r")).select("run_id", "_r.*")
