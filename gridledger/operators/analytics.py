"""Fleet analytics: statistics, latest rows, phase averages, outages, change points, frame pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import timecycle


def metric_stats(readings: DataFrame) -> DataFrame:
    """Count, least and greatest value, first and last time of each device and metric."""
    return readings.groupBy("device_id", "metric").agg(F.count("*").alias("n"), F.min("cents").alias("least"), F.max("cents").alias("greatest"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def latest(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key by insertion (id)."""
    return readings.groupBy(*keys).agg(F.max_by(F.struct("id", "captured_at", "cents"), "id").alias("l")).select(*keys, "l.*")


def latest_rows(readings: DataFrame, n: int = 40) -> DataFrame:
    """The n latest rows of each device by id."""
    return readings.withColumn("place", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("id")))).filter(F.col("place") <= n)


def phase_averages(readings: DataFrame, bucket: str, start: Column, zone: str = timecycle.ZONE, bounds: str = "utc") -> DataFrame:
    """Mean of each device, metric and phase by local hour or day, one decimal. Means are over accepted changes, not time.

    bounds: whether the local start is compared with UTC times ("utc", as always reported) or local ones."""
    local = readings.filter("phase is not null").withColumn("local", timecycle.to_local(F.col("captured_at"), zone))
    since = local.filter(F.col("captured_at" if bounds == "utc" else "local") >= start)
    # sums of integers are exact, whatever the order of the rows
    mean = F.round(F.sum("cents").cast("decimal(30,4)") / F.count("*") / 100, 1).cast("double")
    return since.groupBy("device_id", "metric", "phase", F.date_trunc(bucket, F.col("local").cast("timestamp")).cast("timestamp_ntz").alias("bucket")).agg(mean.alias("mean"), F.count("*").alias("n"))


def outages(rows: DataFrame, minutes: int) -> DataFrame:
    """Gaps between a device's rows that are longer than so many minutes: from, to, and seconds."""
    before = F.lag("captured_at").over(Window.partitionBy("device_id").orderBy("captured_at"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gaps = rows.select("device_id", "captured_at").withColumn("from_at", before).filter("from_at is not null").withColumn("micros", micros(F.col("captured_at")) - micros(F.col("from_at")))
    return gaps.filter(F.col("micros") > minutes * 60_000_000).select("device_id", "from_at", F.col("captured_at").alias("to_at"), F.floor(F.col("micros") / 1_000_000).alias("seconds"))


def sessions(rows: DataFrame, minutes: int) -> DataFrame:
    """Spells without an outage: start, last row and number of rows. For streams and tables alike."""
    return rows.groupBy("device_id", F.session_window("captured_at", f"{minutes} minutes")).agg(F.min("captured_at").alias("from_at"), F.max("captured_at").alias("to_at"), F.count("*").alias("n")).drop("session_window")


def change_points(readings: DataFrame) -> DataFrame:
    """Rows whose value differs from the one before of the same device, metric and phase; the first one, too."""
    before = F.lag("cents").over(Window.partitionBy("device_id", "metric", "phase").orderBy("captured_at", "id"))
    return readings.withColumn("before", before).filter(~F.col("cents").eqNullSafe(F.col("before"))).drop("before")


def pages(frames: DataFrame, number: int, size: int = 48) -> DataFrame:
    """A page of each device's frames (device_id, src, captured_at, ...), newest first, with page: the number is clamped to the pages there are."""
    order = Window.partitionBy("device_id").orderBy(F.desc("captured_at"), "src")
    there = F.ceil(F.count("*").over(Window.partitionBy("device_id")) / size)
    placed = frames.withColumn("place", F.row_number().over(order)).withColumn("page", F.least(F.greatest(F.lit(1), F.lit(number)), there).cast("int"))
    return placed.filter((F.col("place") > (F.col("page") - 1) * size) & (F.col("place") <= F.col("page") * size)).drop("place")
