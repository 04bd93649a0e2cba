"""Queries of the billing operators, over registers made of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import tariff, timecycle
from gridledger.jobs import monthly
from gridledger.operators import bills, consumption, validity
from gridledger.operators.registry import BILLING, EXPORT
from gridledger.sources import adapters, settings

#: Local time at which the reports are made.
NOW = "1998-06-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    readings, known = adapters.registers(spark, sf_dir), monthly.devices(spark, sf_dir)
    return readings, known, monthly.baselines(readings, known)


def cycle_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly.usage(spark, sf_dir)


def savings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.savings_rollup(bills.savings(bills.sides(monthly.usage(spark, sf_dir)), monthly.tariffs(spark, sf_dir)))


def bill_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = monthly.bill(spark, sf_dir)
    return bills.variance(estimates, bills.audited_actuals(monthly.entered(estimates))[0])


def last_closed_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = monthly.bill(spark, sf_dir)
    current = monthly.devices(spark, sf_dir).select("device_id", timecycle.cycle_start(_now(), F.col("billing_day")).alias("cycle_start"))
    return bills.last_closed(estimates, bills.audited_actuals(monthly.entered(estimates))[0], current)


def month_on_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.month_on_month(*_parts(spark, sf_dir))


def cycle_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, known, base = _parts(spark, sf_dir)
    past = readings.filter(timecycle.to_local(F.col("captured_at")) <= _now())
    usage = consumption.cycle_usage(past, known, base)
    open_ = known.select("device_id", timecycle.cycle_start(_now(), F.col("billing_day")).alias("cycle_start"))
    return consumption.projection(usage.join(open_, ["device_id", "cycle_start"], "left_semi"), _now())


def baseline_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, known, base = _parts(spark, sf_dir)
    calendar = consumption.cycle_calendar(readings, known, BILLING, _now())
    return bills.insert_absent(consumption.boundary_snapshots(readings, known, calendar), base, ["device_id", "metric", "cycle_start"])


def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, known, base = _parts(spark, sf_dir)
    old = base.groupBy("device_id", "cycle_start").agg(*(F.max(F.when(F.col("metric") == m, F.col("cents"))).alias(n) for m, n in ((BILLING, "import_cents"), (EXPORT, "export_cents"))))
    entry = base.filter("device_id % 6 = 0").select("device_id", "cycle_start", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).distinct()
    changes = entry.select("device_id", "cycle_start", "version", F.when(F.col("version") == 1, 12_345).cast("bigint").alias("import_cents"), F.when(F.col("version") == 2, F.col("device_id") * 10).alias("export_cents"))
    return bills.upsert(old, changes, ["device_id", "cycle_start"], ["import_cents", "export_cents"], "version")


def actual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.audited_actuals(monthly.entered(monthly.bill(spark, sf_dir)))[1].drop("version")


def cycle_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, known, _ = _parts(spark, sf_dir)
    return consumption.cycle_calendar(readings, known, BILLING, _now())


def daily_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.daily_deltas(adapters.registers(spark, sf_dir))


def daily_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.daily_net(consumption.daily_deltas(adapters.registers(spark, sf_dir)), BILLING, EXPORT)


def last14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.last_days(consumption.daily_deltas(adapters.registers(spark, sf_dir)), 14)


def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _now().cast("date")
    return consumption.period_summary(daily_net(spark, sf_dir), timecycle.period_start("30d", end, end), end)


def cycle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = adapters.registers(spark, sf_dir).filter(timecycle.to_local(F.col("captured_at")) <= _now())
    known = monthly.devices(spark, sf_dir)
    open_ = known.select("device_id", timecycle.cycle_start(_now(), F.col("billing_day")).alias("cycle_start"))
    usage = consumption.cycle_usage(past, known, monthly.baselines(past, known)).join(open_, ["device_id", "cycle_start"], "left_semi")
    return consumption.cycle_totals(consumption.daily_net(consumption.daily_deltas(past), BILLING, EXPORT), usage, "cycle_start", BILLING, EXPORT)


def net_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = cycle_projection(spark, sf_dir).filter(F.col("metric") == BILLING).select("device_id", "projected_kwh")
    rows = cycle_totals(spark, sf_dir).join(projected, "device_id")
    net = F.greatest(F.lit(0), F.col("net_cents"))
    return rows.select("device_id", consumption.net_projection(net, F.col("import_cents"), F.col("projected_kwh")).alias("net_kwh"))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines with notes, not all of them of both registers."""
    readings, known = adapters.registers(spark, sf_dir), monthly.devices(spark, sf_dir)
    note = F.when((F.col("metric") == EXPORT) | (F.col("device_id") % 2 == 0), F.concat(F.lit("read "), "metric"))
    return monthly.baselines(readings, known).withColumn("note", note)


def baseline_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.baseline_listing(_noted(spark, sf_dir))


def cycle_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.with_note(cycle_calendar(spark, sf_dir).drop("cycle_end"), _noted(spark, sf_dir))


def actual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = bills.audited_actuals(monthly.entered(monthly.bill(spark, sf_dir)))[1]
    return bills.edit_history(edits).select("device_id", "cycle_start", "place", F.col("amount").cast("double").alias("amount"), F.col("old_amount").cast("double").alias("old_amount"))


def zone_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles by each device's own zone."""
    zone = F.element_at(F.array(F.lit("UTC"), F.lit("Asia/Tokyo"), F.lit("Asia/Kolkata")), (F.col("device_id") % 3 + 1).cast("int"))
    readings = adapters.registers(spark, sf_dir).withColumn("captured_at", F.col("captured_at") + F.expr("interval 20 hours"))
    known = monthly.devices(spark, sf_dir).withColumn("tz", zone)
    return consumption.with_cycle(readings, known).groupBy("device_id", "metric", "cycle_start").agg(F.count("*").alias("readings"), F.max("cents").alias("last_cents"))


def odd_tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills by settings with odd slab texts; every seventh device has no settings at all."""
    rows = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    text = F.element_at(F.array(*map(F.lit, ("abc:5,*:7", "junk", " ", " 10kWh:2,20:x,*:3", "*:4,5:6", "10:1,20:2"))), (F.col("device_id") % 6 + 1).cast("int"))
    pairs = F.array(F.struct(F.lit("tariff_slabs").alias("k"), text.alias("v")), F.struct(F.lit("rate_per_kwh").alias("k"), F.lit("6.5").alias("v")))
    stored = rows.filter("device_id % 7 <> 6").select("device_id", F.explode(pairs).alias("p")).select("device_id", "p.*")
    cycles = rows.select("device_id", F.lit("2026-06-01").cast("date").alias("cycle_start"), (F.col("device_id") * 137 % 60_000).alias("import_cents"), F.lit(0).cast("bigint").alias("export_cents"))
    return bills.cycle_bill(cycles, settings.tariffs(settings.pivoted(stored))).select("device_id", "net_cents", "energy", "total")


def tariff_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    return rows.select("device_id", tariff.has_tariff(F.expr("CASE device_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '10:1' END"), F.col("device_id") % 2).alias("has"))


def tariff_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that change over the years, at different days for each device: readings and greatest register under each."""
    devices = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    years = devices.select("device_id", F.explode(F.sequence(F.lit(0), F.col("device_id").cast("int") % 9)).alias("k"))
    changes = years.select("device_id", F.expr("make_date(1995 + k, 1 + cast((device_id + 5 * k) % 12 as int), 1 + cast(device_id % 28 as int))").alias("valid_from"), (200 + 10 * F.col("k") + F.col("device_id") % 7).alias("rate"))
    valid = validity.intervals(changes, ["device_id"])
    found = validity.valid_at(adapters.registers(spark, sf_dir), valid, ["device_id"], "captured_at", "left")
    return found.groupBy("device_id", "metric", "rate", "valid_from").agg(F.count("*").alias("readings"), F.max("cents").alias("greatest"))


QUERIES = {
    "tariff_history": tariff_history,
    "cycle_totals": cycle_totals, "net_projection": net_projection, "baseline_listing": baseline_listing, "cycle_notes": cycle_notes, "actual_edits": actual_edits,
    "zone_cycles": zone_cycles, "odd_tariffs": odd_tariffs, "tariff_flags": tariff_flags,
    "cycle_usage": cycle_usage, "cycle_bill": monthly.bill, "savings_rollup": savings_rollup, "bill_variance": bill_variance,
    "last_closed_bill": last_closed_bill, "month_on_month": month_on_month, "cycle_projection": cycle_projection,
    "baseline_snapshot": baseline_snapshot, "baseline_upsert": baseline_upsert, "actual_audit": actual_audit,
    "cycle_calendar": cycle_calendar, "daily_deltas": daily_deltas, "daily_net": daily_net, "last14": last14, "period_summary": period_summary,
}

_REGISTERS = """
WITH daily AS (
  SELECT l_suppkey AS device_id, CASE WHEN l_returnflag = 'A' THEN 'ep_cu_fd' ELSE 'ip_cu_fd' END AS metric,
         l_shipdate AS captured_at, sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem GROUP BY 1, 2, 3),
reg AS (
  SELECT device_id, metric, captured_at,
         CAST(50000 + 300 * sum(qty) OVER (PARTITION BY device_id, metric ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents,
         captured_at + INTERVAL 330 MINUTE AS local,
         CASE WHEN device_id % 2 = 0 THEN 15 ELSE 1 END AS bday
  FROM daily),
r AS (
  SELECT *, CAST(date_trunc('month', CAST(local AS DATE) - CAST(bday - 1 AS INTEGER)) AS DATE) + CAST(bday - 1 AS INTEGER) AS cycle_start
  FROM reg),
base AS (
  SELECT device_id, metric, arg_min(cycle_start, captured_at) AS cycle_start, arg_min(cents, captured_at) - 1000 AS cents
  FROM r WHERE device_id % 3 = 0 GROUP BY 1, 2)
"""

_USAGE = (
    _REGISTERS
    + """,
per AS (
  SELECT device_id, metric, cycle_start, arg_min(cents, captured_at) AS first_cents, arg_max(cents, captured_at) AS last_cents,
         min(captured_at) AS first_at, max(captured_at) AS last_at, count(*) AS readings
  FROM r GROUP BY 1, 2, 3),
usage AS (
  SELECT p.device_id, p.metric, p.cycle_start, CAST(p.cycle_start + INTERVAL 1 MONTH AS DATE) AS cycle_end,
         coalesce(b.cents, p.first_cents) AS anchor_cents, b.cents IS NOT NULL AS is_manual,
         first_cents, last_cents, first_at, last_at, readings, last_cents - coalesce(b.cents, p.first_cents) AS usage_cents
  FROM per p LEFT JOIN base b USING (device_id, metric, cycle_start))
"""
)


def _charge(units: str) -> str:
    """Whole-rupee energy charge of so many hundredths of kWh, in integers: rates in paise make hundredths of paise."""
    slabs = f"least({units}, 7500) * 310 + least(greatest({units} - 7500, 0), 12500) * 460 + least(greatest({units} - 20000, 0), 15000) * 605 + greatest({units} - 35000, 0) * 840"
    return f"((CASE WHEN device_id % 5 = 4 THEN {units} * 650 ELSE {slabs} END) + 5000) // 10000"


def _total(energy: str) -> str:
    return f"greatest(0, {energy} + 50 + (({energy} + 50) * 10 + 50) // 100 - (CASE WHEN device_id % 7 = 3 THEN 100 ELSE 0 END))"


_BILL = (
    _USAGE
    + f""",
sides AS (
  SELECT device_id, cycle_start, max(usage_cents) FILTER (WHERE metric = 'ip_cu_fd') AS import_cents,
         coalesce(max(usage_cents) FILTER (WHERE metric = 'ep_cu_fd'), 0) AS export_cents
  FROM usage GROUP BY 1, 2 HAVING max(usage_cents) FILTER (WHERE metric = 'ip_cu_fd') IS NOT NULL),
units AS (
  SELECT *, greatest(0, greatest(0, import_cents) - export_cents) AS net_cents, greatest(0, export_cents - greatest(0, import_cents)) AS surplus_cents FROM sides),
charged AS (
  SELECT *, {_charge("net_cents")} AS e, {_charge("greatest(0, import_cents)")} AS e0, {_charge("greatest(0, import_cents - export_cents)")} AS e1 FROM units),
bill AS (
  SELECT device_id, cycle_start, import_cents, export_cents, net_cents, surplus_cents, CAST(e AS DOUBLE) AS energy, CAST(50 AS DOUBLE) AS fixed,
         CAST(((e + 50) * 10 + 50) // 100 AS DOUBLE) AS surcharge, CAST({_total("e")} AS DOUBLE) AS total
  FROM charged),
entered AS (
  SELECT device_id, cycle_start, total + device_id % 7 - 3 + v.bump AS amount, net_cents // 100 AS units,
         cycle_start + 40 + v.late AS bill_date, v.version AS version
  FROM bill JOIN (VALUES (1, 0, 0), (2, 5, 2)) v(version, bump, late) ON v.version = 1 OR device_id % 4 = 0
  WHERE device_id % 2 = 0),
valid AS (SELECT * FROM entered WHERE amount > 0),
actual AS (SELECT device_id, cycle_start, arg_max(amount, version) AS amount FROM valid GROUP BY 1, 2)
"""
)

_DELTAS = (
    _REGISTERS
    + """,
days AS (SELECT device_id, metric, CAST(local AS DATE) AS day, arg_max(cents, captured_at) AS cents FROM r GROUP BY 1, 2, 3),
lagged AS (SELECT *, cents - lag(cents) OVER (PARTITION BY device_id, metric ORDER BY day) AS delta_cents FROM days),
deltas AS (SELECT device_id, metric, day, delta_cents FROM lagged WHERE delta_cents IS NOT NULL),
net AS (
  SELECT device_id, day, CAST(coalesce(sum(delta_cents) FILTER (WHERE metric = 'ip_cu_fd'), 0) AS BIGINT) AS import_cents,
         CAST(coalesce(sum(delta_cents) FILTER (WHERE metric = 'ep_cu_fd'), 0) AS BIGINT) AS export_cents
  FROM deltas GROUP BY 1, 2)
"""
)

_OPEN = f"CAST(date_trunc('month', DATE '{NOW[:10]}' - CAST(bday - 1 AS INTEGER)) AS DATE) + CAST(bday - 1 AS INTEGER)"
_CALENDAR = (
    _REGISTERS
    + f""",
span AS (SELECT device_id, bday, min(cycle_start) AS first, {_OPEN} AS open FROM r WHERE metric = 'ip_cu_fd' GROUP BY 1, 2),
cal AS (SELECT device_id, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(open AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS cycle_start FROM span WHERE first <= open)
"""
)

_NOTE = "CASE WHEN metric = 'ep_cu_fd' OR device_id % 2 = 0 THEN 'read ' || metric END"
_TOTALS = (
    _DELTAS.replace("FROM reg),", f"FROM reg WHERE local <= TIMESTAMP '{NOW}'),")
    + f""",
per AS (SELECT device_id, metric, bday, cycle_start, arg_min(cents, captured_at) AS first_cents, arg_max(cents, captured_at) AS last_cents FROM r GROUP BY 1, 2, 3, 4),
used AS (SELECT p.*, last_cents - coalesce(b.cents, first_cents) AS usage_cents FROM per p LEFT JOIN base b USING (device_id, metric, cycle_start) WHERE cycle_start = {_OPEN}),
sd AS (SELECT device_id, cycle_start, max(usage_cents) FILTER (WHERE metric = 'ip_cu_fd') AS i, max(usage_cents) FILTER (WHERE metric = 'ep_cu_fd') AS e FROM used GROUP BY 1, 2),
ms AS (SELECT sd.device_id, CAST(sum(import_cents) AS BIGINT) AS mi, CAST(sum(export_cents) AS BIGINT) AS me, count(*) AS days FROM sd JOIN net USING (device_id) WHERE day >= cycle_start GROUP BY 1),
totals AS (
  SELECT device_id, cycle_start, coalesce(i, mi, 0) AS import_cents, coalesce(e, me, 0) AS export_cents, coalesce(mi, 0) AS measured_import, coalesce(me, 0) AS measured_export, coalesce(days, 0) AS days
  FROM sd LEFT JOIN ms USING (device_id))
"""
)

ORACLE_SQL = {
    "tariff_history": _REGISTERS
    + """, ch AS (SELECT s_suppkey AS device_id, make_date(1995 + k, 1 + CAST((s_suppkey + 5 * k) % 12 AS INTEGER), 1 + CAST(s_suppkey % 28 AS INTEGER)) AS valid_from, 200 + 10 * k + s_suppkey % 7 AS rate
  FROM supplier, range(9) t(k) WHERE k <= s_suppkey % 9),
va AS (SELECT *, lead(valid_from) OVER (PARTITION BY device_id ORDER BY valid_from) AS valid_to FROM ch)
SELECT reg.device_id, metric, rate, valid_from, count(*) AS readings, max(cents) AS greatest FROM reg
LEFT JOIN va ON va.device_id = reg.device_id AND CAST(captured_at AS DATE) >= valid_from AND (valid_to IS NULL OR CAST(captured_at AS DATE) < valid_to) GROUP BY 1, 2, 3, 4""",
    "cycle_usage": _USAGE + "SELECT * FROM usage",
    "cycle_bill": _BILL + "SELECT * FROM bill",
    "savings_rollup": _BILL
    + f""",
s AS (SELECT device_id, cycle_start, import_cents, export_cents, import_cents - export_cents AS net_cents, {_total("e0")} AS w0, {_total("e1")} AS w1 FROM charged),
g AS (
  SELECT device_id, cycle_start, sum(import_cents) AS i, sum(export_cents) AS e, sum(net_cents) AS n, sum(w0) AS w0, sum(w1) AS w1
  FROM s GROUP BY ROLLUP (device_id, cycle_start) HAVING device_id IS NOT NULL)
SELECT device_id, cycle_start, CAST(i AS BIGINT) AS import_cents, CAST(e AS BIGINT) AS export_cents, CAST(n AS BIGINT) AS net_cents,
       CAST(w0 AS DOUBLE) AS without, CAST(w1 AS DOUBLE) AS with_export, CAST(w0 - w1 AS DOUBLE) AS saved,
       CASE WHEN w0 > 0 THEN round(CAST(100 * (w0 - w1) AS DOUBLE) / w0) END AS saved_percent,
       CASE WHEN i > 0 THEN round(CAST(100 * e AS DOUBLE) / i) END AS export_percent
FROM g""",
    "bill_variance": _BILL
    + """SELECT device_id, cycle_start, total AS estimate, CAST(amount AS DOUBLE) AS amount, CAST(amount - total AS DOUBLE) AS difference,
       CASE WHEN total > 0 THEN round((amount - total) * 100.0 / total, 1) + 0.0 END AS percent
FROM bill JOIN actual USING (device_id, cycle_start)""",
    "last_closed_bill": _BILL
    + f""",
closed AS (SELECT b.* FROM bill b JOIN (SELECT DISTINCT device_id, bday FROM r) d USING (device_id) WHERE cycle_start < {_OPEN}),
latest AS (SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY cycle_start DESC) = 1)
SELECT device_id, cycle_start, net_cents, total, CAST(amount AS DOUBLE) AS amount FROM latest LEFT JOIN actual USING (device_id, cycle_start)""",
    "month_on_month": _REGISTERS
    + """,
ends AS (SELECT device_id, metric, cycle_start, arg_max(cents, captured_at) AS last_cents FROM r GROUP BY 1, 2, 3),
w AS (SELECT *, lag(last_cents) OVER (PARTITION BY device_id, metric ORDER BY cycle_start) AS before FROM ends)
SELECT device_id, metric, cycle_start, last_cents - coalesce(b.cents, before, last_cents) AS usage_cents FROM w LEFT JOIN base b USING (device_id, metric, cycle_start)""",
    "cycle_projection": _USAGE.replace("FROM r GROUP BY 1, 2, 3)", f"FROM r WHERE local <= TIMESTAMP '{NOW}' GROUP BY 1, 2, 3)")
    + f""",
p AS (
  SELECT u.*, greatest(0.04::DOUBLE, (epoch(TIMESTAMP '{NOW}') - epoch(first_at + INTERVAL 330 MINUTE)) / 86400.0::DOUBLE) AS days,
         greatest(0.0::DOUBLE, (epoch(CAST(cycle_end AS TIMESTAMP)) - epoch(TIMESTAMP '{NOW}')) / 86400.0::DOUBLE) AS remaining,
         greatest(0.04::DOUBLE, (epoch(TIMESTAMP '{NOW}') - epoch(CAST(cycle_start AS TIMESTAMP))) / 86400.0::DOUBLE) AS into_cycle
  FROM usage u JOIN (SELECT DISTINCT device_id, bday FROM r) USING (device_id) WHERE cycle_start = {_OPEN})
SELECT device_id, metric, cycle_start,
       CASE WHEN readings >= 2 THEN round(usage_cents / 100.0::DOUBLE + greatest(0.0::DOUBLE, (last_cents - first_cents) / 100.0::DOUBLE / days) * remaining, 1) END AS projected_kwh,
       CAST(ceil(into_cycle) AS BIGINT) AS day_of_cycle, greatest(1, date_diff('day', cycle_start, cycle_end)) AS cycle_days
FROM p""",
    "baseline_snapshot": _CALENDAR
    + """,
snap AS (
  SELECT c.device_id, r.metric, c.cycle_start, arg_max(r.cents, r.captured_at) AS cents
  FROM cal c JOIN r ON r.device_id = c.device_id AND r.local < CAST(c.cycle_start AS TIMESTAMP) GROUP BY 1, 2, 3)
SELECT device_id, metric, cycle_start, cents FROM base
UNION ALL SELECT s.device_id, s.metric, s.cycle_start, s.cents FROM snap s ANTI JOIN base b USING (device_id, metric, cycle_start)""",
    "baseline_upsert": _REGISTERS
    + """,
old AS (
  SELECT device_id, cycle_start, max(cents) FILTER (WHERE metric = 'ip_cu_fd') AS import_cents, max(cents) FILTER (WHERE metric = 'ep_cu_fd') AS export_cents
  FROM base GROUP BY 1, 2)
SELECT device_id, cycle_start, CASE WHEN device_id % 6 = 0 THEN 12345 ELSE import_cents END AS import_cents,
       CASE WHEN device_id % 6 = 0 THEN device_id * 10 ELSE export_cents END AS export_cents
FROM old""",
    "actual_audit": _BILL
    + """,
w AS (
  SELECT *, lag(amount) OVER o AS old_amount, lag(units) OVER o AS old_units, lag(bill_date) OVER o AS old_bill_date, row_number() OVER o AS place
  FROM valid WINDOW o AS (PARTITION BY device_id, cycle_start ORDER BY version))
SELECT device_id, cycle_start, CAST(amount AS DOUBLE) AS amount, units, bill_date, CAST(old_amount AS DOUBLE) AS old_amount, old_units, old_bill_date FROM w WHERE place > 1""",
    "cycle_calendar": _CALENDAR + "SELECT device_id, cycle_start, CAST(cycle_start + INTERVAL 1 MONTH AS DATE) AS cycle_end FROM cal",
    "cycle_totals": _TOTALS + "SELECT device_id, cycle_start, import_cents, export_cents, import_cents - export_cents AS net_cents, measured_import, measured_export, days, import_cents - measured_import AS pre_gap_cents FROM totals",
    "net_projection": _TOTALS
    + f"""SELECT device_id, CASE WHEN import_cents > 0 AND projected_kwh IS NOT NULL THEN round(greatest(0, import_cents - export_cents) * (projected_kwh / import_cents), 1) ELSE projected_kwh END AS net_kwh
FROM totals JOIN ({{projection}}) USING (device_id) WHERE metric = 'ip_cu_fd'""",
    "baseline_listing": _REGISTERS + f"SELECT device_id, metric, cycle_start, cents, {_NOTE} AS note, CAST(row_number() OVER (PARTITION BY device_id ORDER BY cycle_start DESC, metric) AS INTEGER) AS place FROM base",
    "cycle_notes": _CALENDAR
    + f""", nt AS (SELECT device_id, cycle_start, coalesce(max({_NOTE}) FILTER (WHERE metric = 'ip_cu_fd'), max({_NOTE}) FILTER (WHERE metric = 'ep_cu_fd')) AS note FROM base GROUP BY 1, 2)
SELECT device_id, cycle_start, note FROM cal LEFT JOIN nt USING (device_id, cycle_start)""",
    "actual_edits": _BILL
    + """,
w AS (SELECT *, lag(amount) OVER o AS old_amount, row_number() OVER o AS place FROM valid WINDOW o AS (PARTITION BY device_id, cycle_start ORDER BY version))
SELECT device_id, cycle_start, CAST(row_number() OVER (PARTITION BY device_id, cycle_start ORDER BY version DESC) AS INTEGER) AS place, CAST(amount AS DOUBLE) AS amount, CAST(old_amount AS DOUBLE) AS old_amount FROM w WHERE place > 1""",
    "zone_cycles": _REGISTERS
    + """, z AS (SELECT *, captured_at + INTERVAL 20 HOUR + to_minutes([0, 540, 330][device_id % 3 + 1]) AS wall FROM reg)
SELECT device_id, metric, CAST(date_trunc('month', CAST(wall AS DATE) - CAST(bday - 1 AS INTEGER)) AS DATE) + CAST(bday - 1 AS INTEGER) AS cycle_start, count(*) AS readings, max(cents) AS last_cents FROM z GROUP BY 1, 2, 3""",
    "odd_tariffs": """WITH u AS (SELECT s_suppkey AS device_id, s_suppkey * 137 % 60000 AS u FROM supplier),
e AS (
  SELECT device_id, u, CASE WHEN device_id % 7 = 6 THEN 0 ELSE CASE device_id % 6 WHEN 0 THEN u * 700 WHEN 1 THEN 0 WHEN 2 THEN u * 650 WHEN 3 THEN least(u, 1000) * 200 + greatest(u - 3000, 0) * 300
           WHEN 4 THEN u * 400 ELSE least(u, 1000) * 100 + least(greatest(u - 1000, 0), 2000) * 200 END END AS x FROM u)
SELECT device_id, u AS net_cents, CAST((x + 5000) // 10000 AS DOUBLE) AS energy, CAST((x + 5000) // 10000 AS DOUBLE) AS total FROM e""",
    "tariff_flags": "SELECT s_suppkey AS device_id, s_suppkey % 3 = 1 OR s_suppkey % 2 > 0 AS has FROM supplier",
    "daily_deltas": _DELTAS + "SELECT * FROM deltas",
    "daily_net": _DELTAS + "SELECT *, greatest(0, import_cents - export_cents) AS net_cents FROM net",
    "last14": _DELTAS + "SELECT * FROM deltas QUALIFY row_number() OVER (PARTITION BY device_id, metric ORDER BY day DESC) <= 14",
    "period_summary": _DELTAS
    + f""",
per AS (
  SELECT device_id, CAST(sum(import_cents) AS BIGINT) AS import_cents, CAST(sum(export_cents) AS BIGINT) AS export_cents, count(*) AS days,
         first(day ORDER BY import_cents DESC, day) AS peak_day, max(import_cents) AS peak_cents
  FROM net WHERE day BETWEEN DATE '{NOW[:10]}' - 29 AND DATE '{NOW[:10]}' GROUP BY 1)
SELECT *, greatest(0, import_cents - export_cents) AS net_cents, round(CAST(import_cents AS DECIMAL(20, 2)) / 100 / greatest(1, days), 1) AS mean_kwh FROM per""",
}

ORACLE_SQL["net_projection"] = ORACLE_SQL["net_projection"].replace("{projection}", ORACLE_SQL["cycle_projection"])
