"""Steps of running evaluations as a stream: an append-only log and live counts.

Runs report every step while they work; here the reports arrive as JSON files
(one step per line, with `run_id` and the time `ts`) and are consumed as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STEP_EVENT = (
    "run_id string, ts timestamp, seq long, type string, name string, ok boolean, latency_ms double, "
    "input_tokens long, output_tokens long"
)


def step_events(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Step reports with a watermark; a report delivered twice counts once."""
    events = spark.readStream.schema(STEP_EVENT).json(folder)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def step_counts(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Steps, failed tool calls, latency and tokens per window, type and tool."""
    return events.groupBy(F.window("ts", window), "type", "name").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def append_log(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write all waiting steps to a log table and stop; a restart continues where it ended."""
    return (
        events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
