"""Device health: a status board, alerts with texts, pushes and their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"ok": 0, "warn": 1, "bad": 2}
#: Seconds after which the worker and the monitor are stale, days of the oldest image.
WORKER_STALE, MONITOR_STALE, OLDEST_DAYS = 180, 600, 2.6
#: The billing registers and their names in alerts.
REGISTERS = {"ip_cu_fd": "import", "ep_cu_fd": "export"}
#: Texts of the alerts.
NO_FRAMES, GAP = "No camera frames on record.", "No camera frames for %s min — camera or worker may be down."
STALE, DISK = "Worker has not run in 3+ min (cron may be stuck).", "Disk space low: %s%% free."
POISON = "Billing register '%s' looks poisoned: stored %s vs OCR consensus %s — auto-heal couldn't fix it. Check the meter."
LAGGING = "Billing register '%s' may be stuck/lagging: stored %s vs OCR consensus %s."


def _rule(when: Column, key: str, level: str, text: Column) -> Column:
    return F.when(when, F.struct(F.lit(key).alias("key"), F.lit(level).alias("level"), text.alias("text")))


def alerts(status: DataFrame, gap_minutes: int) -> DataFrame:
    """A row per alert: device_id, key, level, text.

    status: device_id, frame_age and worker_age in seconds (null: never), free_percent, and registers: a map from metric
    to struct(status, stored_cents, consensus_cents) of the audit. Ages are compared in whole minutes, rounded."""
    minutes = F.round(F.col("frame_age") / 60, 0).cast("bigint")
    kwh = lambda c: F.format_string("%.2f", c / 100.0)
    rules = [
        _rule(F.col("frame_age").isNull(), "camera", "bad", F.lit(NO_FRAMES)),
        _rule(minutes > gap_minutes, "camera", "bad", F.format_string(GAP, minutes.cast("string"))),
        _rule(F.col("worker_age") > WORKER_STALE, "worker", "warn", F.lit(STALE)),
        _rule(F.col("free_percent") < 10, "disk", "bad", F.format_string(DISK, F.col("free_percent").cast("string"))),
    ]
    for metric, name in REGISTERS.items():
        r = F.try_element_at("registers", F.lit(metric))
        for state, level, text in (("poison_high", "bad", POISON), ("behind", "warn", LAGGING)):
            rules.append(_rule(r["status"] == state, f"ocr_{metric}", level, F.format_string(text, F.lit(name), kwh(r["stored_cents"]), kwh(r["consensus_cents"]))))
    return status.select("device_id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("a")).select("device_id", "a.*")


def pushed(found: DataFrame) -> DataFrame:
    """Alerts that are sent: of the camera, the disk, and registers that can't be healed."""
    return found.filter(F.col("key").isin("camera", "disk") | (F.col("key").startswith("ocr_") & (F.col("level") == "bad")))


def board(status: DataFrame) -> DataFrame:
    """Checks of each device, with a severity from 0 to 2: camera, worker, monitor, rows, disk, images, and each register."""
    check = lambda key, level: F.struct(F.lit(key).alias("key"), level.cast("int").alias("severity"))
    good = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(2)
    checks = F.array(
        check("camera", good(F.col("frame_age") < 300)),
        check("worker", good(F.col("worker_age") < WORKER_STALE)),
        check("monitor", good(F.col("monitor_age") < MONITOR_STALE)),
        check("rows", good(F.col("rows") > 0)),
        check("disk", F.when(F.col("free_percent") > 15, 0).when(F.col("free_percent") > 8, 1).otherwise(2)),
        check("images", F.when(F.col("oldest_days") > OLDEST_DAYS, 1).otherwise(0)),
        *(
            check(f"ocr_{m}", F.when(state == "poison_high", 2).when(state.isin("healed", "behind"), 1).otherwise(0))
            for m in REGISTERS
            for state in [F.try_element_at("registers", F.lit(m))["status"]]
        ),
    )
    return status.select("device_id", F.explode(checks).alias("c")).select("device_id", "c.*")


def worst(checks: DataFrame) -> DataFrame:
    """The worst severity of each device."""
    return checks.groupBy("device_id").agg(F.max("severity").alias("severity"))


def transitions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Notifications between two runs: device_id, key, event (new or recovered). Unchanged alerts give none."""
    keys = ["device_id", "key"]
    new = now.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("event", F.lit("new"))
    gone = before.select(*keys).distinct().join(now.select(*keys), keys, "left_anti").withColumn("event", F.lit("recovered"))
    return new.unionByName(gone)


def liveness(last_frame: Column, now: Column) -> Column:
    """struct(age in whole minutes, online: under five)."""
    age = F.round((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_frame.cast("timestamp"))) / 60, 0).cast("bigint")
    return F.struct(age.alias("age"), (age < 5).alias("online"))
