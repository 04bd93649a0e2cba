"""Queries that run the streaming operators over claims, through a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import timecycle
from gridledger.jobs import observed, storage
from gridledger.queries import metering
from gridledger.operators import alerts, guard
from gridledger.operators.registry import REGISTRY
from gridledger.sources import adapters, tables
from gridledger.streaming import alert_stream, frames, guard_stream, windows


#: Metrics whose claims are staged before any judgement.
RAW = tuple(m for _, m, _, kind, *_ in REGISTRY if kind in ("cumulative", "md"))


def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = storage.scratch(spark, "claims")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream gives for what there is now."""
    out = storage.scratch(spark, "drained")
    query = stream.writeStream.format("parquet").option("checkpointLocation", storage.scratch(spark, "offsets")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.claims(spark, sf_dir).withColumn("captured_at", F.col("guard_at")).select("device_id", "id", "captured_at", "metric", "phase", "cents")


def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, guard_stream.guard_stream(_stream(spark, _claims(spark, sf_dir)))).drop("captured_at")


def window_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hourly(adapters.claims(spark, sf_dir))


def window_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing(adapters.claims(spark, sf_dir).filter("metric <> 'voltage'"))


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every four hours, by the hour, as a stream gives it."""
    rows = adapters.claims(spark, sf_dir).filter("metric <> 'voltage'").select("device_id", "captured_at", "metric", "cents")
    return _drained(spark, windows.trailing_audit(_stream(spark, rows)))


#: Minutes without a frame after which a device is silent, in these sparse tables.
SILENCE = 2880


def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that fall silent and come back, told by timers."""
    rows = adapters.claims(spark, sf_dir).select("device_id", F.col("captured_at").alias("at"), F.lit(None).cast("array<string>").alias("keys"))
    found = _drained(spark, alert_stream.alert_stream(_stream(spark, rows), SILENCE))
    return found.select("device_id", "event", F.col("at").cast("timestamp_ntz").alias("at"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statuses of each device, replayed: what the second changes."""
    times = (metering.CHECK_BEFORE, metering.CHECK)

    def status(at: str) -> DataFrame:
        known = metering._status(spark, sf_dir, at)
        keys = alerts.pushed(alerts.alerts(known, 600)).groupBy("device_id").agg(F.collect_set("key").alias("keys"))
        return known.select("device_id").join(keys, "device_id", "left").select("device_id", F.lit(at).cast("timestamp").alias("at"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))

    found = _drained(spark, alert_stream.alert_stream(_stream(spark, status(times[0]).unionByName(status(times[1])))))
    return found.filter(F.col("at") == F.lit(times[1]).cast("timestamp")).select("device_id", "key", "event")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each page: a register that rises, misreads now and then, and frames that can't be read."""
    cents = F.expr("CASE WHEN id % 3 = 0 THEN 60000 + 7 * id ELSE 20000 + 9 * id END + CASE WHEN id % 11 = 4 THEN 10000 WHEN id % 13 = 7 THEN -2000 ELSE 0 END")
    rows = adapters.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    at = F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id * 97)")
    wide = lambda text, fill: F.lpad(text, F.greatest(F.lit(6), F.length(text)), fill)  # noqa: E731  # six or more, none is cut off
    shown = F.split(wide(cents.cast("string"), F.lit(" ")), "")
    known = F.array(*map(F.lit, adapters.SEGMENTS))

    def cell(c):
        lit = F.transform(F.split(F.coalesce(F.get(known, c.try_cast("int")), F.lit("0000000")), ""), lambda b: F.when(b == "1", 0.6).otherwise(0.05))
        return F.struct(F.when(c == " ", 0.01).otherwise(0.3).alias("ink"), F.when(F.col("id") % 17 == 5, F.transform(lit, lambda _: F.lit(0.05))).otherwise(lit).alias("seg"))

    cells = F.transform(F.filter(shown, lambda c: c != ""), cell)
    return rows.select((F.col("id") % 5).alias("device_id"), "id", at.alias("captured_at"), F.when(F.col("id") % 3 == 0, "ep_cu_fd").otherwise("ip_cu_fd").alias("metric"), F.lit(None).cast("string").alias("phase"), cells.alias("cells")).withColumn(
        "name", timecycle.frame_name(F.col("captured_at"), F.lower(wide(F.hex("id"), F.lit("0"))))
    )


def frame_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as files, in two parts; the stream stops between them and goes on from its checkpoint."""
    folder, raw, kept, point = (storage.scratch(spark, x) for x in ("frames", "raw", "kept", "point"))
    rows = _frames(spark, sf_dir)
    half = F.lit(rows.agg(F.expr("percentile_approx(id, 0.5)")).first()[0])  # once: it may come out otherwise in another pass
    for part in (F.col("id") <= half, F.col("id") > half):
        frames.write_frames(rows.filter(part), folder)
        with frames.small_files(spark):
            frames.ingest(frames.frame_stream(spark, folder, 100_000), raw, kept, point, RAW).trigger(availableNow=True).start().awaitTermination()
    columns = ["device_id", "id", "metric", "cents"]
    stored = spark.read.parquet(kept).select(*columns, F.lit(True).alias("stored"))
    return spark.read.parquet(raw).select(*columns, "outcome").join(stored, columns, "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 readings that a run would store."""
    return frames.preview(_frames(spark, sf_dir), 30).drop("captured_at")


def guard_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each outcome, counted by the pass that writes them."""
    rows = _claims(spark, sf_dir)
    seen = observed.written(guard.guard(rows), storage.scratch(spark, "judged"))
    return spark.createDataFrame([(o, n) for o, n in seen.items() if o in guard.OUTCOMES and n], "outcome string, n bigint")


def database_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by way of a database: written to a table, and read back after a mark in ranges of id."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = adapters.claims(spark, sf_dir).select("device_id", "id", "metric", "cents")
    rows.write.option("createTableColumnTypes", "metric varchar(32)").jdbc(url, "readings", properties={"driver": DERBY})
    return tables.newer(spark, url, "readings", 100, 4, driver=DERBY).filter("metric = 'ep_cu_fd' and cents > 95000").select("device_id", "id", "cents")


#: The driver of the embedded database that Spark brings along.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def two_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = guard_stream.guard_stream(_stream(spark, _claims(spark, sf_dir)))
    raw, kept = storage.scratch(spark, "raw"), storage.scratch(spark, "kept")
    windows.two_sinks(judged, raw, kept, storage.scratch(spark, "offsets"), RAW).trigger(availableNow=True).start().awaitTermination()
    count = lambda path, name: spark.read.parquet(path).groupBy("device_id", "metric").agg(F.count("*").alias(name))
    return count(raw, "claims").join(count(kept, "stored"), ["device_id", "metric"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = storage.report_json(metering.consensus_status(spark, sf_dir), F.lit(metering.CHECK), 720)
    return storage.report_fields(reports, "ip_cu_fd")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.claims(spark, sf_dir).select("device_id", "id", "captured_at")
    return storage.retained(rows, F.lit(metering.CHECK).cast("timestamp_ntz"), 7, "captured_at")


def stream_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.claims(spark, sf_dir).select("device_id", "captured_at", "metric", "phase", "cents")
    return _drained(spark, windows.averages(_stream(spark, rows), "day"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.claims(spark, sf_dir).select("device_id", "captured_at")
    return _drained(spark, windows.outage_sessions(_stream(spark, rows), 1440)).select("device_id", F.col("from_at").cast("timestamp_ntz").alias("from_at"), "n")


def stream_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything once more from the beginning, after a first run: a new checkpoint is a reset, and outcomes stay."""
    source = _stream(spark, _claims(spark, sf_dir))
    runs = [guard.outcome_counts(_drained(spark, guard_stream.guard_stream(source))).withColumnRenamed("n", f"n{i}") for i in (1, 2)]
    return runs[0].join(runs[1], ["device_id", "outcome"], "full")


def readings_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended by date, and read with the table's own schema."""
    folder = storage.scratch(spark, "tables")
    rows = adapters.claims(spark, sf_dir).select("device_id", "id", "captured_at", "metric", "cents", F.lit("kWh").alias("unit"), "phase", "src")
    storage.append_by_date(rows, f"{folder}/readings")
    return tables.parquet(spark, folder, "readings").groupBy("device_id", F.col("captured_at").cast("date").alias("day")).agg(F.count("*").alias("n"), F.max("cents").alias("greatest"))


QUERIES = {f.__name__: f for f in (stream_guard, stream_audit, stream_silence, stream_alerts, frame_ingest, dry_run, guard_observed, database_readings, two_sinks, window_hourly, window_trailing, health_report, retention, stream_averages, stream_sessions, stream_again, readings_by_date)}

_C = metering._CLAIMS
#: The guard's SQL over the readings of frames.
_FRAMES = (
    """
WITH RECURSIVE pg AS (SELECT page_id AS id, page_id * 97 AS gs FROM pages WHERE page_id % 17 <> 5),
c AS (SELECT id % 5 AS device_id, id, CASE WHEN id % 3 = 0 THEN 'ep_cu_fd' ELSE 'ip_cu_fd' END AS metric, CAST(NULL AS VARCHAR) AS phase, gs, CAST(id AS VARCHAR) AS src,
             CAST(CASE WHEN id % 3 = 0 THEN 60000 + 7 * id ELSE 20000 + 9 * id END + CASE WHEN id % 11 = 4 THEN 10000 WHEN id % 13 = 7 THEN -2000 ELSE 0 END AS BIGINT) AS cents FROM pg)
"""
    + metering._GUARD.removeprefix(metering._CLAIMS)
)
ORACLE_SQL = {
    "stream_guard": metering.ORACLE_SQL["guard_outcomes"],
    "two_sinks": metering._GUARD + "SELECT device_id, metric, count(*) AS claims, count(*) FILTER (WHERE outcome = 'store') AS stored FROM j WHERE metric <> 'voltage' GROUP BY 1, 2",
    "window_hourly": _C + "SELECT device_id, metric, phase, date_trunc('hour', captured_at) AS hour, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM c GROUP BY 1, 2, 3, 4",
    "window_trailing": _C
    + "SELECT device_id, metric, date_trunc('hour', captured_at) + to_hours(k) AS window_end, count(*) AS frames, max(cents) AS greatest FROM en, range(1, 5) t(k) GROUP BY 1, 2, 3",
    "stream_audit": _C
    + """, wi AS (SELECT device_id, metric, date_trunc('hour', captured_at) + to_hours(k) AS window_end, cents FROM en, range(1, 5) t(k)),
md AS (SELECT *, median(cents) OVER (PARTITION BY device_id, metric, window_end) AS m FROM wi),
fo AS (SELECT *, cents - CAST(round_even((cents - m) / 10000.0::DOUBLE, 0) * 10000 AS BIGINT) AS folded FROM md)
SELECT device_id, metric, window_end, count(*) AS frames, count(*) FILTER (WHERE abs(cents - m) > 2000) AS misreads,
       round_even(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE abs(cents - m) > 2000)) / count(*), 1) AS accuracy, max(folded) AS consensus_cents
FROM fo WHERE window_end <= (SELECT max(captured_at) FROM en) - INTERVAL 10 MINUTE GROUP BY 1, 2, 3""",
    "stream_silence": _C
    + f""", w AS (SELECT device_id, captured_at AS seen, lead(captured_at) OVER (PARTITION BY device_id ORDER BY captured_at) AS next, max(captured_at) OVER () AS newest FROM c),
s AS (SELECT *, seen + to_seconds({60 * SILENCE + 30}) AS due FROM w)
SELECT device_id, 'new' AS event, due AS at FROM s WHERE CASE WHEN next IS NULL THEN due <= newest - INTERVAL 10 MINUTE ELSE next >= due END
UNION ALL SELECT device_id, 'recovered', next FROM s WHERE next >= due""",
    "stream_alerts": metering.ORACLE_SQL["alert_transitions"],
    "frame_ingest": _FRAMES + "SELECT device_id, id, metric, cents, outcome, outcome = 'store' AS stored FROM j",
    "dry_run": _FRAMES + "SELECT device_id, id, metric, phase, cents FROM j WHERE outcome = 'store' ORDER BY device_id, gs, id LIMIT 30",
    "guard_observed": "SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM (" + metering.ORACLE_SQL["guard_stats"] + ") GROUP BY 1",
    "database_readings": _C + "SELECT device_id, id, cents FROM c WHERE id > 100 AND metric = 'ep_cu_fd' AND cents > 95000",
    "health_report": metering._HEAL
    + f""", d AS (SELECT DISTINCT device_id FROM status)
SELECT device_id, '{metering.CHECK}' AS checked_utc, 720.0::DOUBLE AS window_hours, frames, misreads, accuracy AS accuracy_pct, consensus_cents / 100.0::DOUBLE AS consensus_register,
       stored_cents / 100.0::DOUBLE AS stored_register, status, fixes
FROM d LEFT JOIN (SELECT * FROM status WHERE metric = 'ip_cu_fd') USING (device_id)""",
    "stream_averages": _C
    + f""", l AS (SELECT *, captured_at + INTERVAL 330 MINUTE AS local FROM c),
b AS (SELECT device_id, metric, phase, CAST(date_trunc('day', local) AS TIMESTAMP) AS bucket, {metering._MEAN} FROM l GROUP BY 1, 2, 3, 4)
SELECT * FROM b WHERE bucket + INTERVAL 1 DAY <= (SELECT max(local) FROM l) - INTERVAL 10 MINUTE""",
    "stream_sessions": "SELECT device_id, from_at, n FROM (" + metering.ORACLE_SQL["outage_sessions"] + ") WHERE to_at + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_again": "SELECT device_id, outcome, n AS n1, n AS n2 FROM (" + metering.ORACLE_SQL["guard_stats"] + ")",
    "readings_by_date": _C + "SELECT device_id, CAST(captured_at AS DATE) AS day, count(*) AS n, max(cents) AS greatest FROM c GROUP BY 1, 2",
    "retention": _C + f"SELECT device_id, id, captured_at FROM c WHERE captured_at >= TIMESTAMP '{metering.CHECK}' - INTERVAL 7 DAY",
}
