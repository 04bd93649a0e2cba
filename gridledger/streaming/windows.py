"""Windowed aggregates that run on streams and tables alike: hourly means, trailing audits, outage sessions, two sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridledger.functions import timecycle
from gridledger.operators import quality

LATENESS = "10 minutes"


def hourly(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Sum and count of each device, metric and phase by UTC hour. On a stream an hour appears once the watermark passes it."""
    timed = readings.withColumn("at", F.col("captured_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("device_id", "metric", "phase", F.window("at", "1 hour")).agg(F.sum("cents").alias("cents"), F.count("*").alias("n")).select("device_id", "metric", "phase", F.col("window.start").alias("hour"), "cents", "n")


def averages(readings: DataFrame, bucket: str = "hour", zone: str = timecycle.ZONE, lateness: str = LATENESS) -> DataFrame:
    """Mean of each device, metric and phase by local hour or day, one decimal; on a stream a bucket appears once it is over."""
    local = readings.withColumn("at", timecycle.to_local(F.col("captured_at"), zone).cast("timestamp")).withWatermark("at", lateness)
    mean = F.round(F.sum("cents").cast("decimal(30,4)") / F.count("*") / 100, 1).cast("double")
    sums = local.groupBy("device_id", "metric", "phase", F.window("at", f"1 {bucket}")).agg(mean.alias("mean"), F.count("*").alias("n"))
    return sums.select("device_id", "metric", "phase", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "mean", "n")


def trailing(claims: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Claims of each device and metric in every four-hour window that ends on the hour."""
    timed = claims.withColumn("at", F.col("captured_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("device_id", "metric", F.window("at", "4 hours", "1 hour")).agg(F.count("*").alias("frames"), F.max("cents").alias("greatest")).select("device_id", "metric", F.col("window.end").alias("window_end"), "frames", "greatest")


def trailing_audit(claims: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The audit of each device and metric in every four-hour window that ends on the hour: frames, misreads, accuracy and
    consensus register, as quality.consensus has them. On a stream a window appears once the watermark passes it.

    State is a count for each value of a window, to which late rows just add; the median comes from the counts of the
    window's few hours when it closes, and nothing older is held."""
    timed = claims.filter("cents is not null").withColumn("at", F.col("captured_at").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy("device_id", "metric", F.window("at", "4 hours", "1 hour"), F.col("cents").alias("value")).agg(F.count("*").alias("n"))
    listed = counts.groupBy("device_id", "metric", "window").agg(F.collect_list(F.struct("value", "n")).alias("counts"))
    return listed.select("device_id", "metric", F.col("window.end").cast("timestamp_ntz").alias("window_end"), quality.figures(F.col("counts")).alias("f")).select("device_id", "metric", "window_end", "f.*")


def outage_sessions(claims: DataFrame, minutes: int, lateness: str = LATENESS) -> DataFrame:
    """Spells of rows of a device without a gap of so many minutes."""
    timed = claims.withColumn("at", F.col("captured_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("device_id", F.session_window("at", f"{minutes} minutes")).agg(F.count("*").alias("n")).select("device_id", F.col("session_window.start").alias("from_at"), F.col("session_window.end").alias("to_at"), "n")


def two_sinks(judged: DataFrame, raw_path: str, accepted_path: str, checkpoint: str, raw_metrics: tuple[str, ...]) -> DataStreamWriter:
    """Writes the claims of the metrics that are staged raw and, beside them, the stored ones of all metrics.

    A batch that is run again replaces its own files. Without a checkpoint of its own a run starts from the beginning."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.filter(F.col("metric").isin(*raw_metrics)).write.mode("overwrite").parquet(f"{raw_path}/batch={number}")
            held.filter("outcome = 'store'").write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        finally:
            held.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
