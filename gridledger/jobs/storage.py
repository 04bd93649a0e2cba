"""Writing and keeping tables: appends by date, retention, repair of the dates that fixes touch, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without: elsewhere executors share no folder."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_by_date(rows: DataFrame, path: str) -> None:
    """Append rows to a table partitioned by the UTC date of captured_at; one file a date and task."""
    rows.withColumn("dt", F.col("captured_at").cast("date")).repartition("dt", "device_id").write.mode("append").partitionBy("dt").parquet(path)


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Writes rows as a table in buckets of the keys, one file a bucket, sorted by them, and reads it. Tables with the same keys
    and number of buckets are joined on them where they lie, without an exchange."""
    rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def retained(rows: DataFrame, now: Column, days: int, column: str = "created_at") -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.filter(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def replace_dates(rows: DataFrame, path: str) -> None:
    """Overwrite the dates that rows hold, and only those: rows has dt and must not be read from path lazily."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def heal(path: str, fixes: DataFrame, spark: SparkSession) -> None:
    """Apply fixes (device_id, metric, id, new_cents, dt) to a table by date: only the dates of fixes are rewritten.

    Dates are overwritten one by one, so a run that is stopped there leaves some old; it can be run again. The copy in the
    shared folder stays until that is cleared."""
    from gridledger.operators.quality import apply_fixes

    touched = fixes.select("dt").distinct()
    rows = spark.read.parquet(path).join(F.broadcast(touched), "dt", "left_semi")  # dates are few, and they prune the scan
    step = scratch(spark, "healed")
    apply_fixes(rows, fixes).write.parquet(step)
    replace_dates(spark.read.parquet(step), path)


#: Fields of a register in a report, and the columns of an audit that they come from.
REPORTED = {"frames": "frames", "misreads": "misreads", "accuracy_pct": "accuracy", "consensus_register": "consensus_cents", "stored_register": "stored_cents", "status": "status", "fixes": "fixes"}


def report_json(status: DataFrame, checked: Column, hours: float) -> DataFrame:
    """The audit of each device as JSON: {"checked_utc", "window_hours", "metrics": {metric: {...}}}. status: statuses of an audit."""
    value = lambda c: (F.col(c) / 100.0 if c.endswith("_cents") else F.col(c))
    fields = F.struct(*(value(c).alias(name) for name, c in REPORTED.items()))
    entries = F.array_sort(F.collect_list(F.struct(F.col("metric").alias("key"), fields.alias("value"))))  # a row for each register, some four
    report = F.struct(checked.alias("checked_utc"), F.lit(float(hours)).alias("window_hours"), F.map_from_entries(entries).alias("metrics"))
    return status.groupBy("device_id").agg(F.to_json(report).alias("report"))


def report_fields(reports: DataFrame, metric: str) -> DataFrame:
    """device_id, checked_utc, window_hours, and the fields of a metric in its report, null where the report doesn't have it."""
    of = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    kinds = {"frames": "bigint", "misreads": "bigint", "status": "string", "fixes": "bigint"}
    fields = (of(f"metrics.{metric}.{name}", kinds.get(name, "double")).alias(name) for name in REPORTED)
    return reports.select("device_id", of("checked_utc", "string").alias("checked_utc"), of("window_hours", "double").alias("window_hours"), *fields)


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("name", "path", "length", "modificationTime")


def listed(spark: SparkSession, folder: str, after: str = "", first: int | None = None) -> DataFrame:
    """Frames of a folder whose names come after a mark, in the order of names, the first so many of them where asked:
    name, path, length, modificationTime; contents are not read."""
    rows = _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)).filter(F.col("name") > after).orderBy("name")
    return rows if first is None else rows.limit(first)


def listed_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """The same as a stream: each frame once, so many files a trigger; a new checkpoint starts from the beginning."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.jpg").option("maxFilesPerTrigger", files_a_trigger).load(folder))


#: Days that frames are kept, and the age in days from which the oldest shows that the clean-up is stuck.
FRAME_DAYS, FRAME_WARN = 2, 2.6


def frame_retention(frames: DataFrame, now: Column) -> DataFrame:
    """Per device: frames, those to keep, those to delete, the oldest one's age in days, and whether that is too old.

    frames: device_id, modified_at."""
    days = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("modified_at").cast("timestamp"))) / 86_400.0
    aged = frames.withColumn("days", days)
    per = aged.groupBy("device_id").agg(F.count("*").alias("frames"), F.count(F.when(F.col("days") <= FRAME_DAYS, 1)).alias("kept"), F.count(F.when(F.col("days") > FRAME_DAYS, 1)).alias("expired"), F.round(F.max("days"), 1).alias("oldest_days"))
    return per.withColumn("late", F.col("oldest_days") > FRAME_WARN)
