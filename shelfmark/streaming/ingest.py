"""Incremental ingestion: arriving batches of catalog rows are upserted into a versioned state table.

An extension: each micro-batch writes the next version of the state, named by its batch number, so a batch that is run again
after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.operators.state import last_by_key, upsert


def ingest(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Start a query that takes all Parquet files there are and stops; state/vN is the state after batch N."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = last_by_key(batch, keys, F.col("seen_at"))
        fresh = rows.drop("seen_at")
        stamped = F.lit(number).cast("timestamp")
        if number == 0:
            before = fresh.limit(0).withColumns({"first_seen_at": stamped, "last_seen_at": stamped})
        else:
            before = spark.read.parquet(f"{state}/v{number - 1}").drop("outcome")
        upsert(before, fresh, keys, stamped).write.mode("overwrite").parquet(f"{state}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream by event-time window; rows later than the watermark are left out."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
