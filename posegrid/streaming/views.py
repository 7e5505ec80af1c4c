"""Streams over observation files: the batch operators' twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracking import track_stream

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def observations(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select("event_id", F.col("user_id").alias("scene"), F.to_date("ts").alias("frame"), F.col("event_type").alias("label"), F.col("value").alias("conf"), k.alias("k"), "ts")


def tracks(spark: SparkSession, path: str) -> DataFrame:
    return track_stream(observations(spark, path))


def windows(rows: DataFrame, late: str = "10 minutes", wide: str = "1 hour") -> DataFrame:
    """Counts and sums by event time; a window closes when the watermark has passed it."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", wide).alias("w"), "label")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("conf"), 4).alias("total")).select(F.col("w.start").alias("start"), "label", "n", "total")


def compacted(rows: DataFrame, path: str, checkpoint: str, size: float = 0.1):
    """Background cells, appended per micro-batch as partial sums: count and sums add up on reading, so a rerun of a batch
    overwrites its own folder and nothing is counted twice."""

    def put(batch: DataFrame, number: int) -> None:
        cell = F.floor(F.col("conf") / size).cast("bigint")
        batch.groupBy("scene", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("conf").alias("total")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
