"""Consumption from cumulative registers: cycle usage, today, daily deltas, month on month, boundary snapshots.

Readings: device_id, metric, captured_at (UTC, no zone), cents, and id where rows can share a time. Every function
takes the whole fleet at once and groups by device first; aggregation comes before any window, so that windows run
over days or cycles, not readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import timecycle


def _order(readings: DataFrame) -> Column:
    """Time, then insertion where there are ids. Time alone keeps the aggregation on a hash table."""
    return F.struct("captured_at", "id") if "id" in readings.columns else F.col("captured_at")


def with_cycle(readings: DataFrame, devices: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """Adds local (wall time), cycle_start and cycle_end. devices: device_id, billing_day, and tz where zones differ;
    other devices have billing day 1 and the given zone."""
    own = F.col("tz") if "tz" in devices.columns else F.lit(None).cast("string")
    known = readings.join(devices.select("device_id", "billing_day", own.alias("own_zone")), "device_id", "left").withColumn("billing_day", F.coalesce("billing_day", F.lit(1)))
    at = F.coalesce("own_zone", F.lit(zone)) if "tz" in devices.columns else zone
    local = known.withColumn("local", timecycle.to_local(F.col("captured_at"), at)).drop("own_zone")
    start = local.withColumn("cycle_start", timecycle.cycle_start(F.col("local"), F.col("billing_day")))
    return start.withColumn("cycle_end", timecycle.cycle_end(F.col("cycle_start")))


def cycle_usage(readings: DataFrame, devices: DataFrame, baselines: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """A row per device, metric and cycle with readings: anchor (manual baseline, else the first reading in the cycle),
    is_manual, first and last reading, their times, the number of readings, and usage_cents = last - anchor."""
    rows = with_cycle(readings, devices, zone)
    order = _order(rows)
    per = rows.groupBy("device_id", "metric", "cycle_start", "cycle_end").agg(
        F.min_by("cents", order).alias("first_cents"), F.max_by("cents", order).alias("last_cents"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.count("*").alias("readings")
    )
    manual = baselines.select("device_id", "metric", "cycle_start", F.col("cents").alias("manual_cents"))
    anchored = per.join(manual, ["device_id", "metric", "cycle_start"], "left").withColumn("anchor_cents", F.coalesce("manual_cents", "first_cents"))
    return anchored.select(
        "device_id", "metric", "cycle_start", "cycle_end", "anchor_cents", F.col("manual_cents").isNotNull().alias("is_manual"),
        "first_cents", "last_cents", "first_at", "last_at", "readings", (F.col("last_cents") - F.col("anchor_cents")).alias("usage_cents"),
    )


def today_usage(readings: DataFrame, as_of: Column, zone: str = timecycle.ZONE) -> DataFrame:
    """Per device and metric: usage since local midnight. Anchor: the last reading before midnight, else the first of
    today. Without a reading today the usage is 0, with the last reading as value; devices without readings have no row."""
    rows = readings.withColumn("local", timecycle.to_local(F.col("captured_at"), zone)).filter(F.col("local") <= as_of)
    midnight = as_of.cast("date").cast("timestamp_ntz")
    order, today = _order(rows), F.col("local") >= midnight
    value = lambda f, when: f(F.when(when, F.col("cents")), F.when(when, order))
    per = rows.groupBy("device_id", "metric").agg(value(F.max_by, ~today).alias("before"), value(F.min_by, today).alias("first"), value(F.max_by, today).alias("last"))
    return per.select(
        "device_id", "metric",
        F.coalesce("last", "before").alias("last_cents"),
        F.when(F.col("last").isNull(), 0).otherwise(F.col("last") - F.coalesce("before", "first")).cast("bigint").alias("usage_cents"),
    )


def daily_last(readings: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """The last value of each local day: device_id, metric, day, cents."""
    rows = readings.withColumn("day", timecycle.to_local(F.col("captured_at"), zone).cast("date"))
    return rows.groupBy("device_id", "metric", "day").agg(F.max_by("cents", _order(rows)).alias("cents"))


def daily_deltas(readings: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """Each day's last value minus that of the day before it that has readings; the first day has no row."""
    before = F.lag("cents").over(Window.partitionBy("device_id", "metric").orderBy("day"))
    return daily_last(readings, zone).withColumn("delta_cents", F.col("cents") - before).filter("delta_cents is not null").select("device_id", "metric", "day", "delta_cents")


def last_days(deltas: DataFrame, n: int = 14) -> DataFrame:
    """The last n days of deltas of each device and metric."""
    place = F.row_number().over(Window.partitionBy("device_id", "metric").orderBy(F.desc("day")))
    return deltas.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def daily_net(deltas: DataFrame, imported: str, exported: str) -> DataFrame:
    """Import and export of each day that has either; a missing side is 0. Net is clamped at 0."""
    side = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("delta_cents"))), F.lit(0)).cast("bigint")
    days = deltas.filter(F.col("metric").isin(imported, exported)).groupBy("device_id", "day").agg(side(imported).alias("import_cents"), side(exported).alias("export_cents"))
    return days.withColumn("net_cents", F.greatest(F.lit(0), F.col("import_cents") - F.col("export_cents")).cast("bigint"))


def period_summary(net: DataFrame, start: Column, end: Column) -> DataFrame:
    """Totals of a period's days for each device: sums, net, days, mean import a day (one decimal of kWh), and the
    peak day (the earliest of equal ones)."""
    days = net.filter((F.col("day") >= start) & (F.col("day") <= end))
    per = days.groupBy("device_id").agg(
        F.sum("import_cents").alias("import_cents"), F.sum("export_cents").alias("export_cents"), F.count("*").alias("days"),
        F.max(F.struct("import_cents", F.negate(F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("earlier"), "day"))["day"].alias("peak_day"), F.max("import_cents").alias("peak_cents"),
    )
    return per.withColumn("net_cents", F.greatest(F.lit(0), F.col("import_cents") - F.col("export_cents")).cast("bigint")).withColumn(
        "mean_kwh", F.round((F.col("import_cents").cast("decimal(20,2)") / 100) / F.greatest(F.lit(1), F.col("days")), 1).cast("double")
    )


def cycle_totals(net: DataFrame, usage: DataFrame, start: str, imported: str, exported: str) -> DataFrame:
    """The period of one cycle: totals as billed (last less anchor, else what was measured), what was measured from its
    first day on, and pre_gap_cents, the import used before measuring began.

    net: daily_net; usage: cycle_usage rows of each device's open cycle; start: name of usage's column with the first day."""
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("usage_cents")))
    billed = usage.groupBy("device_id", F.col(start).alias("start")).agg(of(imported).alias("import_use"), of(exported).alias("export_use"))
    days = net.join(billed.select("device_id", "start"), "device_id").filter("day >= start")
    measured = days.groupBy("device_id").agg(F.sum("import_cents").alias("measured_import"), F.sum("export_cents").alias("measured_export"), F.count("*").alias("days"))
    joined = billed.join(measured, "device_id", "left").na.fill(0, ["measured_import", "measured_export", "days"])
    total = lambda side: F.coalesce(f"{side}_use", f"measured_{side}")
    return joined.select(
        "device_id", F.col("start").alias("cycle_start"), total("import").alias("import_cents"), total("export").alias("export_cents"), (total("import") - total("export")).alias("net_cents"),
        "measured_import", "measured_export", "days", (total("import") - F.col("measured_import")).alias("pre_gap_cents"),
    )


def month_on_month(readings: DataFrame, devices: DataFrame, baselines: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """Per device, metric and cycle: last minus anchor, where the anchor is the manual baseline, else the last value
    before the cycle, else the cycle's own last, which gives 0 (unlike cycle_usage, on purpose)."""
    rows = with_cycle(readings, devices, zone)
    per = rows.groupBy("device_id", "metric", "cycle_start").agg(F.max_by("cents", _order(rows)).alias("last_cents"))
    before = F.lag("last_cents").over(Window.partitionBy("device_id", "metric").orderBy("cycle_start"))
    manual = baselines.select("device_id", "metric", "cycle_start", F.col("cents").alias("manual_cents"))
    joined = per.withColumn("before", before).join(manual, ["device_id", "metric", "cycle_start"], "left")
    return joined.select("device_id", "metric", "cycle_start", (F.col("last_cents") - F.coalesce("manual_cents", "before", "last_cents")).alias("usage_cents"))


def cycle_calendar(readings: DataFrame, devices: DataFrame, billed: str, as_of: Column, zone: str = timecycle.ZONE) -> DataFrame:
    """All cycle starts of a device from its first billed reading to the cycle of as_of (local), with their ends."""
    first = with_cycle(readings.filter(F.col("metric") == billed), devices, zone).groupBy("device_id", "billing_day").agg(F.min("cycle_start").alias("first"))
    now = timecycle.cycle_start(as_of, F.col("billing_day"))
    cycles = first.filter(F.col("first") <= now).select("device_id", F.explode(timecycle.all_cycles(F.col("first"), now)).alias("cycle_start"))
    return cycles.withColumn("cycle_end", timecycle.cycle_end(F.col("cycle_start")))


def boundary_snapshots(readings: DataFrame, devices: DataFrame, calendar: DataFrame, zone: str = timecycle.ZONE) -> DataFrame:
    """The last reading strictly before each cycle of the calendar, per metric: device_id, metric, cycle_start, cents.

    No range join: the last value of each cycle is carried forward over cycles without readings."""
    rows = with_cycle(readings, devices, zone)
    ends = rows.groupBy("device_id", "metric", "cycle_start").agg(F.max_by("cents", _order(rows)).alias("cents"))
    metrics = ends.select("device_id", "metric").distinct()
    grid = calendar.select("device_id", "cycle_start").join(metrics, "device_id").join(ends, ["device_id", "metric", "cycle_start"], "full")
    before = Window.partitionBy("device_id", "metric").orderBy("cycle_start").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("before", F.last("cents", ignorenulls=True).over(before))
    return carried.filter("before is not null").join(calendar.select("device_id", "cycle_start"), ["device_id", "cycle_start"], "left_semi").select("device_id", "metric", "cycle_start", F.col("before").alias("cents"))


def series(readings: DataFrame, metric: str, zone: str = timecycle.ZONE) -> DataFrame:
    """The values of one metric with local times: device_id, local, kwh. Sort where it is shown."""
    return readings.filter(F.col("metric") == metric).select("device_id", timecycle.to_local(F.col("captured_at"), zone).alias("local"), (F.col("cents") / 100.0).alias("kwh"))


def net_projection(net_cents: Column, use_cents: Column, projected: Column) -> Column:
    """A projected net: the net's share of the use so far, of the projected use; the projection itself without use."""
    return F.when((use_cents > 0) & projected.isNotNull(), F.round(net_cents * (projected / use_cents), 1)).otherwise(projected)


def projection(usage: DataFrame, as_of: Column) -> DataFrame:
    """Projected usage of the cycle that as_of (local) is in: rate since the first reading, over the days that remain.

    usage: cycle_usage rows of that cycle. Null with fewer than two readings. Day of the cycle and its length come along."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    first, last = seconds(timecycle.to_local(F.col("first_at"))), seconds(as_of)
    days = F.greatest(F.lit(0.04), (last - first) / 86400.0)
    left = F.greatest(F.lit(0.0), (seconds(F.col("cycle_end")) - last) / 86400.0)
    use = F.col("usage_cents") / 100.0
    rate = F.greatest(F.lit(0.0), (F.col("last_cents") - F.col("first_cents")) / 100.0 / days)
    into = F.greatest(F.lit(0.04), (last - seconds(F.col("cycle_start"))) / 86400.0)
    return usage.select(
        "device_id", "metric", "cycle_start",
        F.when(F.col("readings") >= 2, F.round(use + rate * left, 1)).alias("projected_kwh"),
        F.ceil(into).cast("bigint").alias("day_of_cycle"),
        F.greatest(F.lit(1), F.datediff("cycle_end", "cycle_start")).cast("bigint").alias("cycle_days"),
    )
