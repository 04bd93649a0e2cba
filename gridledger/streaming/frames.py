"""Frames to readings as one stream: files as they arrive, decoded, judged, and written to two sinks."""

from __future__ import annotations

import contextlib
import os
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridledger.functions import timecycle
from gridledger.operators import decode
from gridledger.streaming import guard_stream, windows

#: What a frame's file holds: the register on show and the fractions that its segments are lit.
CONTENT = "metric string, phase string, cells array<struct<ink:double,seg:array<double>>>"
_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes that could be read in the time that a frame's file takes to open.
OPEN_COST = 65_536


def _saver(folder: str, write: str):
    """Saves the frames of a task, each under another name first, so that a reader sees whole files only. A frame's file has the
    same name whichever task or attempt saves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, attempt = set(), uuid.uuid4().hex
        for batch in batches:
            for device, name, value in zip(*(batch.column(c).to_pylist() for c in ("device_id", "name", "value")), strict=True):
                device, name = ("__HIVE_DEFAULT_PARTITION__" if x is None else urllib.parse.quote(str(x), safe="") for x in (device, name))
                own = f"{folder}/device_id={device}"
                if own not in made:
                    os.makedirs(own, exist_ok=True)
                    made.add(own)
                with open(part := f"{own}/.{attempt}", "w", encoding="utf-8") as file:
                    file.write(f"{value}\n")
                os.replace(part, f"{own}/name={name}.part-{write}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return run


def write_frames(frames: DataFrame, folder: str) -> None:
    """A file for each frame, named after it, in its device's folder: frames has device_id, name, metric, phase, cells.

    Tasks save to a shared local folder themselves: Hadoop's local files take a process each for their permissions, and Spark's writer a
    folder each for their names. In any other store Spark writes them, in a folder named after each."""
    content = F.to_json(F.struct("metric", "phase", "cells"))
    rows = frames.select(content.alias("value"), "device_id", "name")
    spark = frames.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        os.makedirs(top := path.toUri().getPath(), exist_ok=True)  # also without frames
        rows.mapInArrow(_saver(top, uuid.uuid4().hex), "n bigint").write.format("noop").mode("overwrite").save()
    else:
        _by_spark(rows, folder)


def _by_spark(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").partitionBy("device_id", "name").text(folder)


@contextlib.contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What is listed and read herein are many small files: some hundreds go to a task instead of one or a few. A stream is to
    end herein, too, as it lists and reads by its session's settings of the moment."""
    settings = {
        "spark.sql.files.openCostInBytes": str(OPEN_COST),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(max(32, 4 * spark.sparkContext.defaultParallelism)),
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frame_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """device_id, id, captured_at, metric, phase, cells of the frames of a folder, each once; the mark of what has been read is
    the stream's checkpoint. The id is the name's last part, and the time its first."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*part-*").option("maxFilesPerTrigger", files_a_trigger).load(folder)
    part = lambda name, end: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]+?){end}", 1))
    held = F.from_json(F.col("content").cast("string"), CONTENT)
    named = files.select(part("device_id", "/").cast("bigint").alias("device_id"), part("name", "[/.]part-[^/]*$").alias("name"), held.alias("held"))
    number = F.conv(F.regexp_extract("name", r"_([0-9a-f]+)\.jpg$", 1), 16, 10).cast("bigint")
    return named.select("device_id", number.alias("id"), timecycle.name_time(F.col("name")).alias("captured_at"), "held.*")


def readings(frames: DataFrame) -> DataFrame:
    """Claims of the frames that can be read."""
    return decode.without_self_test(decode.decode(frames)).filter("reason = 'ok'").select(*guard_stream.COLUMNS)


def ingest(frames: DataFrame, raw_path: str, accepted_path: str, checkpoint: str, raw_metrics: tuple[str, ...]) -> DataStreamWriter:
    """From frames to both tables. A run that stops goes on from its checkpoint: no frame is read twice, and the
    guard's state is that of the last batch that was written."""
    return windows.two_sinks(guard_stream.guard_stream(readings(frames)), raw_path, accepted_path, checkpoint, raw_metrics)


def preview(frames: DataFrame, first: int) -> DataFrame:
    """A dry run over a table of frames: the first so many readings that would be stored, by device and time. Nothing is written,
    and no state is kept."""
    from gridledger.operators import guard

    return guard.accepted(guard.guard(readings(frames))).orderBy("device_id", "captured_at", "id").limit(first)
