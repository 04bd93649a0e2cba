"""Queries of the guard, audit, analytics and alert operators, over claims made of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import text, timecycle
from gridledger.jobs import storage
from gridledger.operators import alerts, analytics, consumption, guard, guard_ranges, quality, registry
from gridledger.operators.registry import BILLED, EXPORT
from gridledger.sources import adapters

#: Local time of the reports, and UTC times of the two health checks.
NOW, CHECK, CHECK_BEFORE = "2024-01-20 15:00:00", "2024-01-30 23:30:00", "2024-01-29 11:30:00"
GROUP = ["device_id", "metric"]


def _at(value: str):
    return F.lit(value).cast("timestamp_ntz")


def _energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.claims(spark, sf_dir).filter("metric <> 'voltage'")


def _seconds(name: str):
    return F.unix_timestamp(F.col(name).cast("timestamp"))


def today_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.today_usage(_energy(spark, sf_dir), _at(NOW))


def phase_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.phase_averages(adapters.claims(spark, sf_dir), "hour", _at("2024-01-10 00:00:00"))


def phase_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.phase_averages(adapters.claims(spark, sf_dir), "day", _at("2024-01-10 00:00:00"), bounds="local")


def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(adapters.claims(spark, sf_dir), GROUP)


def latest_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(adapters.claims(spark, sf_dir).withColumn("phase", F.coalesce("phase", F.lit("-"))), [*GROUP, "phase"])


def latest40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_rows(adapters.claims(spark, sf_dir).select("device_id", "id", "metric", "cents"), 40)


def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.metric_stats(adapters.claims(spark, sf_dir))


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outages(adapters.claims(spark, sf_dir), 1440)


def outage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sessions(adapters.claims(spark, sf_dir), 1440)


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.change_points(adapters.claims(spark, sf_dir).select("device_id", "id", "captured_at", "metric", "phase", "cents"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.guard(adapters.claims(spark, sf_dir).withColumn("captured_at", F.col("guard_at")))


def guard_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).drop("captured_at")


def guard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes again, from ranges of rows in place of whole devices."""
    return guard_ranges.guard_ranges(adapters.claims(spark, sf_dir).withColumn("captured_at", F.col("guard_at"))).drop("captured_at")


def guard_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.accepted(_judged(spark, sf_dir)).drop("captured_at")


def guard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.outcome_counts(_judged(spark, sf_dir))


def guard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.last_accepted(guard.accepted(_judged(spark, sf_dir))).drop("captured_at")


def guard_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a history, the second from the state that the first leaves."""
    claims = adapters.claims(spark, sf_dir).withColumn("captured_at", F.col("guard_at"))
    half = F.col("captured_at") < _at("2024-01-01 06:00:00")
    seeds = guard.state_after(guard.guard(claims.filter(half)))
    return guard.outcome_counts(guard.guard(claims.filter(~half), seeds=seeds))


def raw_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.staged(range_gate(spark, sf_dir)).select("device_id", "id", "metric", "cents")


def heal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.heal_log(heal_plan(spark, sf_dir), F.lit(CHECK))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.series(adapters.claims(spark, sf_dir), EXPORT)


def guard_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.drops(guard.accepted(_judged(spark, sf_dir)).filter("metric <> 'voltage'"))


def acceptance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _energy(spark, sf_dir).select("device_id", "id", "src", "metric")
    stored = guard.accepted(_judged(spark, sf_dir)).select("device_id", "id").join(raw, ["device_id", "id"])
    return guard.acceptance(raw, stored)


def acceptance_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of acceptance over stored tables in buckets of its keys."""
    keys, run = ["device_id", "src", "metric"], uuid.uuid4().hex
    raw = _energy(spark, sf_dir).select("device_id", "id", "src", "metric")
    kept = guard.accepted(_judged(spark, sf_dir)).select("device_id", "id").join(raw, ["device_id", "id"])
    tables = [storage.bucketed(rows.select(*keys), f"{name}_{run}", keys, 8) for name, rows in (("raw", raw), ("kept", kept))]
    return guard.acceptance(*tables)


def misread_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.consensus(_energy(spark, sf_dir), GROUP)


def trailing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _energy(spark, sf_dir)
    newest = rows.groupBy("device_id").agg(F.max("captured_at").alias("newest"))
    return quality.consensus(rows.join(newest, "device_id").filter("captured_at >= newest - interval 4 hours"), GROUP)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three claims are the raw frames, the third ones what was stored."""
    stored = F.col("id") % 3 == 0
    rows = _energy(spark, sf_dir).select(*GROUP, _seconds("captured_at").alias("at"), "id", "cents", (~stored).alias("is_raw"), stored.alias("is_stored"))
    return quality.audited(rows, GROUP, F.col("metric").isin(*BILLED))


def heal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.heal_plan(_audit(spark, sf_dir), GROUP)


def heal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_fixes(_energy(spark, sf_dir).filter("id % 3 = 0").select(*GROUP, "id", "cents"), heal_plan(spark, sf_dir))


def consensus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statuses(_audit(spark, sf_dir), GROUP)


def rolling_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    decodes = _energy(spark, sf_dir).withColumn("cents", F.when(F.col("id") % 13 != 0, F.col("cents")))
    return quality.rolling_misreads(decodes, GROUP)


def misread_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    decodes = _energy(spark, sf_dir).withColumn("cents", F.when(F.col("id") % 13 != 0, F.col("cents"))).withColumn("setting", F.element_at(F.array(F.lit("clahe"), F.lit("otsu"), F.lit("plain")), (F.col("id") % 3 + 1).cast("int")))
    per = quality.rolling_misreads(decodes, ["setting", *GROUP]).groupBy("setting", "metric").agg(*(F.sum(c).alias(c) for c in ("n_read", "n_failed", "n_misread")))
    return quality.setting_table(per, F.col("metric") == EXPORT)


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stride_sample(adapters.claims(spark, sf_dir).select("device_id", "id", "src"), 7)


def range_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("""CASE WHEN id % 43 = 5 THEN 'junk' WHEN id % 19 = 2 THEN 'IP-HO' WHEN id % 47 = 1 OR metric = 'voltage' THEN 'other'
                           WHEN metric = 'ip_cu_fd' THEN 'IP-Cu-Fd' ELSE 'EP-Cu-Fd' END""")
    glyph = F.expr("CASE WHEN id % 43 = 5 OR id % 19 = 2 THEN NULL WHEN id % 47 = 1 THEN 'A' WHEN metric = 'voltage' THEN 'V' END")
    cents = F.expr("CASE WHEN id % 19 = 2 THEN id % 7000 WHEN id % 47 = 1 THEN id % 20000 ELSE cents END")
    known = registry.registry(spark)
    claimed = adapters.claims(spark, sf_dir).select("device_id", "id", label.alias("label"), glyph.alias("glyph"), cents.alias("cents"), (F.col("id") % 2 == 0).alias("minus"))
    typed = registry.split_power_factor(registry.classify(claimed, known))
    return registry.in_range(registry.signed(typed, known), known).select("device_id", "id", "metric", "unit", "kind", "cents", "in_range")


def _status(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    rows = adapters.claims(spark, sf_dir).filter(F.col("captured_at") <= _at(at)).groupBy("device_id").agg(F.max("captured_at").alias("last"), F.count("*").alias("rows"))
    age = (F.unix_timestamp(F.lit(at)) - _seconds("last")).alias("frame_age")
    return rows.select(
        "device_id", "rows", age, F.expr("rows * 37 % 400").alias("worker_age"), F.expr("rows * 91 % 1200").alias("monitor_age"), F.expr("(device_id * 7 + rows) % 60").alias("free_percent"),
        F.expr("rows % 5").alias("oldest_days"),
        F.expr("""map('ip_cu_fd', struct(CASE rows % 7 WHEN 1 THEN 'poison_high' WHEN 2 THEN 'behind' WHEN 3 THEN 'healed' WHEN 4 THEN 'ok' END AS status, rows * 1000 AS stored_cents, rows * 900 AS consensus_cents),
                       'ep_cu_fd', struct(CASE rows % 6 WHEN 1 THEN 'poison_high' WHEN 2 THEN 'behind' ELSE 'ok' END AS status, rows * 1001 AS stored_cents, rows * 907 AS consensus_cents))""").alias("registers"),
    )


def device_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts(_status(spark, sf_dir, CHECK), 600)


def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushed = lambda at: alerts.pushed(alerts.alerts(_status(spark, sf_dir, at), 600))
    return alerts.transitions(pushed(CHECK), pushed(CHECK_BEFORE))


def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.worst(alerts.board(_status(spark, sf_dir, CHECK)))


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.claims(spark, sf_dir)
    name = timecycle.frame_name(F.col("captured_at"), F.expr("lower(lpad(hex(id), 6, '0'))"))
    return rows.select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("copy_"), name)).otherwise(name).alias("name")).select("id", "name", timecycle.name_time(F.col("name")).alias("named_at"), timecycle.mark_time(F.col("name")).alias("marked_at"))


def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("captured_at")
    return adapters.claims(spark, sf_dir).select("id", timecycle.day_label(at).alias("day"), timecycle.cycle_label(at).alias("cycle"), timecycle.frame_label(F.date_format(at, "yyyy-MM-dd_HH-mm-ss")).alias("frame"))


def frame_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pages(adapters.claims(spark, sf_dir).select("device_id", "id", "src", "captured_at"), 3, 20).select("device_id", "id", "page")


def device_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = adapters.claims(spark, sf_dir).groupBy("device_id").agg(F.max("captured_at").alias("last"))
    return last.select("device_id", alerts.liveness(F.col("last"), _at(CHECK)).alias("l")).select("device_id", "l.*")


def frame_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.frame_retention(adapters.claims(spark, sf_dir).select("device_id", F.col("captured_at").alias("modified_at")), _at(CHECK))


def pending_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = analytics.latest(adapters.claims(spark, sf_dir).withColumn("captured_at", F.col("guard_at")), [*GROUP, "phase"])
    state = held.groupBy("device_id").agg(text.state_json(F.collect_list(F.struct("metric", "phase", F.col("cents").alias("value"), F.col("captured_at").alias("at")))).alias("v"))
    return state.select("device_id", F.explode(text.state_from_json(F.col("v"))).alias("p")).select("device_id", "p.*")


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir, CHECK)
    phases = analytics.latest(adapters.claims(spark, sf_dir).filter("phase is not null"), ["device_id", "phase"]).groupBy("device_id").agg(*(F.max(F.when(F.col("phase") == p, F.col("cents") / 100)).alias(p) for p in "RYB"))
    return rows.join(phases, "device_id", "left").select(
        "device_id", text.age(F.col("frame_age")).alias("seen"), text.trimmed_number(F.col("rows") / 4).alias("quarter"),
        text.money(F.col("rows") * 12.5, F.when(F.col("device_id") % 2 == 0, "INR").otherwise("EUR")).alias("amount"), text.phase_line(F.col("R"), F.col("Y"), F.col("B")).alias("phases"),
        F.array_join(text.page_numbers((F.col("rows") % 9 + 1).cast("int"), F.lit(9)), ",").alias("pages"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        today_usage, phase_hourly, phase_daily, latest_metric, latest_phase, latest40, metric_stats, outages, outage_sessions, change_points,
        guard_outcomes, guard_split, guard_accepted, guard_stats, guard_state, guard_seeded, raw_staging, heal_log, series, guard_monotonic, acceptance_audit, acceptance_stored, misread_rate, trailing_audit, heal_plan,
        heal_apply, consensus_status, rolling_misread, misread_sets, stride_sample, range_gate, device_alerts, alert_transitions, worst_status,
        frame_names, pending_json, display_texts, day_labels, frame_pages, device_liveness, frame_ages,
    )
}

_CLAIMS = """
WITH RECURSIVE ev AS (
  SELECT user_id AS device_id, event_id AS id, ts AS captured_at,
         CASE WHEN event_type IN ('click', 'signup') THEN 'ip_cu_fd' WHEN event_type IN ('view', 'error') THEN 'ep_cu_fd' ELSE 'voltage' END AS metric,
         (CAST(round(value * 100) AS BIGINT) + 50) // 100 AS stp
  FROM events),
run AS (
  SELECT *, 30000 + sum(CASE WHEN metric = 'ip_cu_fd' THEN stp ELSE 0 END) OVER w AS imp, 90000 + sum(CASE WHEN metric = 'ep_cu_fd' THEN stp ELSE 0 END) OVER w AS exp
  FROM ev WINDOW w AS (PARTITION BY device_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING)),
reg AS (SELECT *, CASE WHEN metric = 'ip_cu_fd' THEN imp ELSE exp END AS own, CASE WHEN metric = 'ip_cu_fd' THEN exp ELSE imp END AS sib FROM run),
c AS (
  SELECT device_id, id, captured_at, metric, CASE WHEN metric = 'voltage' THEN ['R', 'Y', 'B'][id % 3 + 1] END AS phase,
         TIMESTAMP '2024-01-01' + to_seconds((epoch_us(captured_at) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000) AS guard_at,
         (epoch_us(captured_at) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS gs,
         epoch_us(captured_at) // 1000000 AS ats,
         CAST(CASE WHEN metric = 'voltage' THEN 23000 + id % 5 * 100 WHEN id % 9 = 4 THEN own + 10000 WHEN id % 23 = 7 THEN own - 10000 WHEN id % 29 = 3 THEN sib
              WHEN id % 31 = 5 THEN own - stp WHEN id % 37 = 11 THEN own + 8000 WHEN id % 41 = 13 THEN own - stp + 2000 ELSE own END AS BIGINT) AS cents,
         strftime(captured_at, '%Y-%m-%d_%H%M%S') || '_' || id AS src
  FROM reg),
en AS (SELECT * FROM c WHERE metric <> 'voltage')
"""

_FLIP = " OR ".join(f"(dv - {k} >= -10 AND 3 * (dv - {k}) <= sec + 300)" for k in (1000, 10000, 100000, 1000000))
_GUARD = (
    _CLAIMS
    + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY gs, id) AS rn FROM c),
g AS (
  SELECT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS iv, CAST(NULL AS BIGINT) AS it,
         CAST(NULL AS BIGINT) AS xv, CAST(NULL AS BIGINT) AS xt, CAST(NULL AS BIGINT) AS piv, CAST(NULL AS BIGINT) AS pit, CAST(NULL AS BIGINT) AS pxv, CAST(NULL AS BIGINT) AS pxt,
         CAST(NULL AS BIGINT) AS vr, CAST(NULL AS BIGINT) AS vy, CAST(NULL AS BIGINT) AS vb
  FROM (SELECT DISTINCT device_id FROM o)
  UNION ALL
  SELECT device_id, rn, id, outcome,
         CASE WHEN metric = 'ip_cu_fd' AND outcome = 'store' THEN v ELSE iv END, CASE WHEN metric = 'ip_cu_fd' AND outcome = 'store' THEN s ELSE it END,
         CASE WHEN metric = 'ep_cu_fd' AND outcome = 'store' THEN v ELSE xv END, CASE WHEN metric = 'ep_cu_fd' AND outcome = 'store' THEN s ELSE xt END,
         CASE WHEN metric <> 'ip_cu_fd' THEN piv WHEN outcome = 'pending' THEN v WHEN outcome IN ('dup', 'store') THEN NULL ELSE piv END,
         CASE WHEN metric <> 'ip_cu_fd' THEN pit WHEN outcome = 'pending' THEN s WHEN outcome IN ('dup', 'store') THEN NULL ELSE pit END,
         CASE WHEN metric <> 'ep_cu_fd' THEN pxv WHEN outcome = 'pending' THEN v WHEN outcome IN ('dup', 'store') THEN NULL ELSE pxv END,
         CASE WHEN metric <> 'ep_cu_fd' THEN pxt WHEN outcome = 'pending' THEN s WHEN outcome IN ('dup', 'store') THEN NULL ELSE pxt END,
         CASE WHEN phase = 'R' THEN v ELSE vr END, CASE WHEN phase = 'Y' THEN v ELSE vy END, CASE WHEN phase = 'B' THEN v ELSE vb END
  FROM (
    SELECT *, CASE
        WHEN sv IS NOT NULL AND abs(v - sv) <= 300 AND (lv IS NULL OR abs(v - lv) > 300) THEN 'label'
        WHEN v = lv THEN 'dup'
        WHEN metric = 'voltage' OR lv IS NULL THEN 'store'
        WHEN dv < -10 THEN 'back'
        WHEN 3 * dv > sec + 300 AND ({_FLIP}) THEN 'digit'
        WHEN v % 1000 = lv % 1000 AND abs(dv) >= 500 THEN 'digit'
        WHEN 3 * dv > least(sec, 15000) + 300 AND (pv IS NULL OR 3 * abs(v - pv) > 900 + greatest(0, s - pt)) THEN 'pending'
        ELSE 'store' END AS outcome
    FROM (
      SELECT *, v - lv AS dv, greatest(0, s - lt) AS sec
      FROM (
        SELECT g.device_id, o.rn, o.id, o.metric, o.phase, o.cents AS v, o.gs AS s, g.iv, g.it, g.xv, g.xt, g.piv, g.pit, g.pxv, g.pxt, g.vr, g.vy, g.vb,
               CASE o.metric WHEN 'ip_cu_fd' THEN g.iv WHEN 'ep_cu_fd' THEN g.xv ELSE CASE o.phase WHEN 'R' THEN g.vr WHEN 'Y' THEN g.vy ELSE g.vb END END AS lv,
               CASE o.metric WHEN 'ip_cu_fd' THEN g.it WHEN 'ep_cu_fd' THEN g.xt END AS lt,
               CASE o.metric WHEN 'ip_cu_fd' THEN g.xv WHEN 'ep_cu_fd' THEN g.iv END AS sv,
               CASE o.metric WHEN 'ip_cu_fd' THEN g.piv WHEN 'ep_cu_fd' THEN g.pxv END AS pv,
               CASE o.metric WHEN 'ip_cu_fd' THEN g.pit WHEN 'ep_cu_fd' THEN g.pxt END AS pt
        FROM g JOIN o ON o.device_id = g.device_id AND o.rn = g.rn + 1)))),
j AS (SELECT c.device_id, c.id, c.metric, c.phase, c.cents, g.outcome, c.gs, c.src FROM g JOIN c ON c.device_id = g.device_id AND c.id = g.id WHERE g.rn > 0)
"""
)

_AUDIT = """
med AS (SELECT *, median(cents) OVER (PARTITION BY device_id, metric) AS m FROM {rows}),
fold AS (SELECT *, cents - CAST(round_even((cents - m) / 10000.0::DOUBLE, 0) * 10000 AS BIGINT) AS folded FROM med),
agreed AS (
  SELECT device_id, metric, count(*) AS frames, count(*) FILTER (WHERE abs(cents - m) > 2000) AS misreads,
         round_even(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE abs(cents - m) > 2000)) / count(*), 1) AS accuracy, max(folded) AS consensus_cents
  FROM fold GROUP BY 1, 2)
"""

_HEAL = (
    _CLAIMS
    + ", rw AS (SELECT * FROM en WHERE id % 3 <> 0),"
    + _AUDIT.format(rows="rw")
    + """,
bg AS (SELECT device_id, metric, min(ats) AS b FROM rw GROUP BY 1, 2),
probe AS (SELECT e.device_id, e.metric, e.ats, e.id, e.cents FROM en e JOIN bg USING (device_id, metric) WHERE e.id % 3 = 0 AND e.ats >= b),
st AS (SELECT device_id, metric, cents AS stored_cents FROM probe QUALIFY row_number() OVER (PARTITION BY device_id, metric ORDER BY ats DESC, id DESC) = 1),
gate AS (SELECT a.*, stored_cents, stored_cents > consensus_cents + 300 AS high, 10 * (frames - misreads) >= 6 * frames AS able FROM agreed a JOIN st USING (device_id, metric)),
pt AS (SELECT device_id, metric, ats AS t, arg_min(folded, id) AS fv, arg_max(folded, id) AS lv FROM fold GROUP BY 1, 2, 3),
lft AS (SELECT p.*, q.t AS lt, q.lv AS lv FROM probe p ASOF LEFT JOIN pt q ON p.device_id = q.device_id AND p.metric = q.metric AND p.ats > q.t),
rgt AS (SELECT p.*, q.t AS rt, q.fv AS rv FROM lft p ASOF LEFT JOIN pt q ON p.device_id = q.device_id AND p.metric = q.metric AND p.ats <= q.t),
tau AS (
  SELECT *, CASE WHEN rt IS NULL THEN CAST(lv AS DOUBLE) WHEN lt IS NULL OR rt = ats THEN CAST(rv AS DOUBLE)
                 ELSE lv + (rv - lv) * (CAST(ats - lt AS DOUBLE) / (rt - lt)) END AS tau FROM rgt),
k AS (SELECT *, CAST(round_even((cents - tau) / 10000.0::DOUBLE, 0) AS BIGINT) AS k FROM tau),
fix AS (
  SELECT k.device_id, k.metric, k.id, k.cents AS old_cents, k.cents - k.k * 10000 AS new_cents
  FROM k JOIN gate USING (device_id, metric) WHERE high AND able AND k.k >= 1 AND abs(k.cents - k.k * 10000 - k.tau) <= 300),
status AS (
  SELECT device_id, metric, frames, misreads, accuracy, consensus_cents, stored_cents, coalesce(n, 0) AS fixes,
         CASE WHEN high THEN CASE WHEN coalesce(n, 0) > 0 THEN 'healed' ELSE 'poison_high' END WHEN consensus_cents > stored_cents + 2300 THEN 'behind' ELSE 'ok' END AS status
  FROM gate LEFT JOIN (SELECT device_id, metric, count(*) AS n FROM fix GROUP BY 1, 2) USING (device_id, metric))
"""
)

_ROLL = """
dec AS (SELECT device_id, metric, id, captured_at, CASE WHEN id % 13 <> 0 THEN cents END AS cents, ['clahe', 'otsu', 'plain'][id % 3 + 1] AS setting FROM en),
loc AS (SELECT *, median(cents) OVER (PARTITION BY {keys} ORDER BY captured_at, id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM dec WHERE cents IS NOT NULL),
roll AS (
  SELECT {keys}, coalesce(n_read, 0) AS n_read, n_failed, coalesce(n_misread, 0) AS n_misread
  FROM (SELECT {keys}, count(*) FILTER (WHERE cents IS NULL) AS n_failed FROM dec GROUP BY ALL)
  LEFT JOIN (SELECT {keys}, count(*) AS n_read, count(*) FILTER (WHERE abs(cents - m) > 2000) AS n_misread FROM loc GROUP BY ALL) USING ({keys}))
"""


def _health(name: str, at: str) -> str:
    registers = [("ip_cu_fd", "import", "rows * 1000", "rows * 900", "rows % 7"), ("ep_cu_fd", "export", "rows * 1001", "rows * 907", "rows % 6")]
    kwh = lambda c: f"printf('%.2f', ({c}) / 100.0::DOUBLE)"
    found = "".join(
        f"""
  UNION ALL SELECT device_id, 'ocr_{m}', 'bad', 'Billing register ''{n}'' looks poisoned: stored ' || {kwh(s)} || ' vs OCR consensus ' || {kwh(c)} || ' — auto-heal couldn''t fix it. Check the meter.' FROM {name} WHERE {r} = 1
  UNION ALL SELECT device_id, 'ocr_{m}', 'warn', 'Billing register ''{n}'' may be stuck/lagging: stored ' || {kwh(s)} || ' vs OCR consensus ' || {kwh(c)} || '.' FROM {name} WHERE {r} = 2"""
        for m, n, s, c, r in registers
    )
    return f"""
{name}0 AS (SELECT device_id, count(*) AS rows, epoch(TIMESTAMP '{at}') - epoch_us(max(captured_at)) // 1000000 AS age FROM c WHERE captured_at <= TIMESTAMP '{at}' GROUP BY 1),
{name} AS (
  SELECT device_id, rows, CAST(age AS BIGINT) AS frame_age, rows * 37 % 400 AS worker_age, rows * 91 % 1200 AS monitor_age, (device_id * 7 + rows) % 60 AS free_percent, rows % 5 AS oldest_days FROM {name}0),
{name}_alerts AS (
  SELECT device_id, 'camera' AS key, 'bad' AS level, 'No camera frames for ' || CAST(round(frame_age / 60.0) AS BIGINT) || ' min — camera or worker may be down.' AS text FROM {name} WHERE round(frame_age / 60.0) > 600
  UNION ALL SELECT device_id, 'worker', 'warn', 'Worker has not run in 3+ min (cron may be stuck).' FROM {name} WHERE worker_age > 180
  UNION ALL SELECT device_id, 'disk', 'bad', 'Disk space low: ' || free_percent || '% free.' FROM {name} WHERE free_percent < 10{found}),
{name}_pushed AS (SELECT device_id, key FROM {name}_alerts WHERE key IN ('camera', 'disk') OR (starts_with(key, 'ocr_') AND level = 'bad'))"""


_MEAN = "((sum(cents) * 20 + 100 * count(*)) // (200 * count(*))) / 10.0::DOUBLE AS mean, count(*) AS n"
_LATEST = "arg_max(captured_at, id) AS captured_at, arg_max(cents, id) AS cents, max(id) AS id"

ORACLE_SQL = {
    "today_usage": _CLAIMS
    + f""",
t AS (SELECT *, captured_at + INTERVAL 330 MINUTE AS local FROM en WHERE captured_at + INTERVAL 330 MINUTE <= TIMESTAMP '{NOW}'),
p AS (
  SELECT device_id, metric, arg_max(cents, captured_at) FILTER (WHERE local < TIMESTAMP '{NOW[:10]}') AS before,
         arg_min(cents, captured_at) FILTER (WHERE local >= TIMESTAMP '{NOW[:10]}') AS first, arg_max(cents, captured_at) FILTER (WHERE local >= TIMESTAMP '{NOW[:10]}') AS last
  FROM t GROUP BY 1, 2)
SELECT device_id, metric, coalesce(last, before) AS last_cents, CASE WHEN last IS NULL THEN 0 ELSE last - coalesce(before, first) END AS usage_cents FROM p""",
    "phase_hourly": _CLAIMS + f"SELECT device_id, metric, phase, date_trunc('hour', captured_at + INTERVAL 330 MINUTE) AS bucket, {_MEAN} FROM c WHERE phase IS NOT NULL AND captured_at >= TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3, 4",
    "phase_daily": _CLAIMS
    + f"SELECT device_id, metric, phase, CAST(date_trunc('day', captured_at + INTERVAL 330 MINUTE) AS TIMESTAMP) AS bucket, {_MEAN} FROM c WHERE phase IS NOT NULL AND captured_at + INTERVAL 330 MINUTE >= TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3, 4",
    "latest_metric": _CLAIMS + f"SELECT device_id, metric, {_LATEST} FROM c GROUP BY 1, 2",
    "latest_phase": _CLAIMS + f"SELECT device_id, metric, coalesce(phase, '-') AS phase, {_LATEST} FROM c GROUP BY 1, 2, 3",
    "latest40": _CLAIMS + "SELECT device_id, id, metric, cents, row_number() OVER (PARTITION BY device_id ORDER BY id DESC) AS place FROM c QUALIFY place <= 40",
    "metric_stats": _CLAIMS + "SELECT device_id, metric, count(*) AS n, min(cents) AS least, max(cents) AS greatest, min(captured_at) AS first_at, max(captured_at) AS last_at FROM c GROUP BY 1, 2",
    "outages": _CLAIMS
    + """, w AS (SELECT device_id, lag(captured_at) OVER (PARTITION BY device_id ORDER BY captured_at) AS from_at, captured_at AS to_at FROM c)
SELECT *, (epoch_us(to_at) - epoch_us(from_at)) // 1000000 AS seconds FROM w WHERE epoch_us(to_at) - epoch_us(from_at) > 86400000000""",
    "outage_sessions": _CLAIMS
    + """, w AS (SELECT device_id, captured_at, CASE WHEN epoch_us(captured_at) - epoch_us(lag(captured_at) OVER (PARTITION BY device_id ORDER BY captured_at)) < 86400000000 THEN 0 ELSE 1 END AS new FROM c),
n AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS s FROM w)
SELECT device_id, min(captured_at) AS from_at, max(captured_at) AS to_at, count(*) AS n FROM n GROUP BY device_id, s""",
    "change_points": _CLAIMS + "SELECT device_id, id, captured_at, metric, phase, cents FROM c QUALIFY cents IS DISTINCT FROM lag(cents) OVER (PARTITION BY device_id, metric, phase ORDER BY captured_at, id)",
    "guard_outcomes": _GUARD + "SELECT device_id, id, metric, phase, cents, outcome FROM j",
    "guard_split": _GUARD + "SELECT device_id, id, metric, phase, cents, outcome FROM j",
    "guard_accepted": _GUARD + "SELECT device_id, id, metric, phase, cents FROM j WHERE outcome = 'store'",
    "guard_stats": _GUARD + "SELECT device_id, outcome, count(*) AS n FROM j GROUP BY 1, 2",
    "guard_state": _GUARD + "SELECT device_id, metric, phase, max(id) AS id, arg_max(cents, id) AS cents FROM j WHERE outcome = 'store' GROUP BY 1, 2, 3",
    "guard_seeded": _GUARD + "SELECT device_id, outcome, count(*) AS n FROM j WHERE gs >= 21600 GROUP BY 1, 2",
    "heal_log": _HEAL + f"SELECT device_id, id, '{CHECK} heal ' || metric || ' id=' || id || ' ' || printf('%.2f', old_cents / 100.0::DOUBLE) || ' -> ' || printf('%.2f', new_cents / 100.0::DOUBLE) AS line FROM fix",
    "series": _CLAIMS + "SELECT device_id, captured_at + INTERVAL 330 MINUTE AS local, cents / 100.0::DOUBLE AS kwh FROM c WHERE metric = 'ep_cu_fd'",
    "guard_monotonic": _GUARD
    + """, f AS (SELECT device_id, metric, lag(cents) OVER (PARTITION BY device_id, metric ORDER BY gs, id) - cents AS fall FROM j WHERE outcome = 'store' AND metric <> 'voltage')
SELECT device_id, metric, count(*) FILTER (WHERE fall > 0) AS falls, coalesce(max(fall) FILTER (WHERE fall > 0), 0) AS deepest FROM f WHERE fall IS NOT NULL GROUP BY 1, 2""",
    "acceptance_audit": _GUARD + "SELECT device_id, metric, count(*) AS claims, count(*) FILTER (WHERE outcome = 'store') AS accepted, count(*) FILTER (WHERE outcome <> 'store') AS rejected FROM j WHERE metric <> 'voltage' GROUP BY 1, 2",
    "misread_rate": _CLAIMS + "," + _AUDIT.format(rows="en") + "SELECT * FROM agreed",
    "trailing_audit": _CLAIMS + ", tr AS (SELECT * FROM en QUALIFY captured_at >= max(captured_at) OVER (PARTITION BY device_id) - INTERVAL 4 HOUR)," + _AUDIT.format(rows="tr") + "SELECT * FROM agreed",
    "heal_plan": _HEAL + "SELECT * FROM fix",
    "heal_apply": _HEAL + "SELECT p.device_id, p.metric, p.id, coalesce(f.new_cents, p.cents) AS cents FROM en p LEFT JOIN fix f USING (device_id, metric, id) WHERE p.id % 3 = 0",
    "consensus_status": _HEAL + "SELECT * FROM status",
    "rolling_misread": _CLAIMS + "," + _ROLL.format(keys="device_id, metric") + "SELECT * FROM roll",
    "misread_sets": _CLAIMS
    + ","
    + _ROLL.format(keys="setting, device_id, metric")
    + """SELECT setting, metric, CAST(sum(n_read) AS BIGINT) AS n_read, CAST(sum(n_failed) AS BIGINT) AS n_failed, CAST(sum(n_misread) AS BIGINT) AS n_misread,
       CAST(sum(CASE WHEN metric = 'ep_cu_fd' THEN n_misread ELSE 0 END) AS BIGINT) AS billed_misread, CAST(sum(CASE WHEN metric = 'ep_cu_fd' THEN n_read ELSE 0 END) AS BIGINT) AS billed_read
FROM roll GROUP BY GROUPING SETS ((setting, metric), (setting))""",
    "stride_sample": _CLAIMS + "SELECT device_id, id, src FROM c QUALIFY (row_number() OVER (PARTITION BY device_id ORDER BY src) - 1) % 7 = 0",
    "range_gate": _CLAIMS
    + """, y AS (
  SELECT device_id, id, CASE WHEN id % 19 = 2 THEN CASE WHEN id % 7000 <= 120 THEN 'pf' ELSE 'md_import' END WHEN id % 47 = 1 THEN 'current' ELSE metric END AS metric,
         CASE WHEN id % 19 = 2 THEN id % 7000 WHEN id % 47 = 1 THEN CASE WHEN id % 2 = 0 THEN -(id % 20000) ELSE id % 20000 END ELSE cents END AS cents
  FROM c WHERE id % 43 <> 5)
SELECT device_id, id, metric, CASE metric WHEN 'pf' THEN '' WHEN 'md_import' THEN 'kW' WHEN 'current' THEN 'A' WHEN 'voltage' THEN 'V' ELSE 'kWh' END AS unit,
       CASE WHEN metric IN ('pf', 'current', 'voltage') THEN 'instant' WHEN metric = 'md_import' THEN 'md' ELSE 'cumulative' END AS kind, cents,
       CASE metric WHEN 'pf' THEN cents BETWEEN 0 AND 120 WHEN 'md_import' THEN cents BETWEEN 120 AND 5000 WHEN 'current' THEN cents BETWEEN -15000 AND 15000
            WHEN 'voltage' THEN cents BETWEEN 5000 AND 32000 ELSE cents BETWEEN 1 AND 100000000 END AS in_range FROM y""",
    "device_alerts": _CLAIMS + "," + _health("h", CHECK) + " SELECT * FROM h_alerts",
    "alert_transitions": _CLAIMS
    + ","
    + _health("h", CHECK)
    + ","
    + _health("b", CHECK_BEFORE)
    + """ SELECT *, 'new' AS event FROM (SELECT * FROM h_pushed EXCEPT SELECT * FROM b_pushed) UNION ALL SELECT *, 'recovered' FROM (SELECT * FROM b_pushed EXCEPT SELECT * FROM h_pushed)""",
    "worst_status": _CLAIMS
    + ","
    + _health("h", CHECK)
    + """SELECT device_id, CAST(greatest(CASE WHEN frame_age < 300 THEN 0 ELSE 2 END, CASE WHEN worker_age < 180 THEN 0 ELSE 2 END, CASE WHEN monitor_age < 600 THEN 0 ELSE 2 END, CASE WHEN rows > 0 THEN 0 ELSE 2 END,
       CASE WHEN free_percent > 15 THEN 0 WHEN free_percent > 8 THEN 1 ELSE 2 END, CASE WHEN oldest_days > 2.6 THEN 1 ELSE 0 END,
       CASE rows % 7 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END, CASE rows % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS INTEGER) AS severity FROM h""",
    "day_labels": _CLAIMS + "SELECT id, strftime(captured_at, '%m-%d') AS day, strftime(captured_at, '%b %Y') AS cycle, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS frame FROM c",
    "frame_pages": _CLAIMS
    + """, p AS (SELECT device_id, id, row_number() OVER (PARTITION BY device_id ORDER BY captured_at DESC, src) AS place, CAST(least(3, ceil(count(*) OVER (PARTITION BY device_id) / 20.0)) AS INTEGER) AS page FROM c)
SELECT device_id, id, page FROM p WHERE place > (page - 1) * 20 AND place <= page * 20""",
    "device_liveness": _CLAIMS + f", l AS (SELECT device_id, CAST(round((epoch(TIMESTAMP '{CHECK}') - max(ats)) / 60.0) AS BIGINT) AS age FROM c GROUP BY 1) SELECT device_id, age, age < 5 AS online FROM l",
    "frame_ages": _CLAIMS
    + f""", d AS (SELECT device_id, (epoch(TIMESTAMP '{CHECK}') - ats) / 86400.0::DOUBLE AS days FROM c),
a AS (SELECT device_id, count(*) AS frames, count(*) FILTER (WHERE days <= 2) AS kept, count(*) FILTER (WHERE days > 2) AS expired, round(max(days), 1) AS oldest_days FROM d GROUP BY 1)
SELECT *, oldest_days > 2.6 AS late FROM a""",
    "frame_names": _CLAIMS
    + """, f AS (SELECT id, captured_at, CASE WHEN id % 10 = 0 THEN 'copy_' ELSE '' END || strftime(captured_at, '%Y-%m-%d_%H%M%S') || '_' || lower(lpad(printf('%x', id), 6, '0')) || '.jpg' AS name FROM c)
SELECT id, name, CASE WHEN id % 10 <> 0 THEN date_trunc('second', captured_at) END AS named_at, date_trunc('second', captured_at) AS marked_at FROM f""",
    "pending_json": _CLAIMS + 'SELECT device_id, metric, phase, arg_max(cents, id) AS "value", arg_max(guard_at, id) AS at FROM c GROUP BY device_id, metric, phase',
    "display_texts": _CLAIMS
    + ","
    + _health("h", CHECK)
    + """, ph AS (SELECT device_id, phase, CAST(round(arg_max(cents, id) / 100.0) AS BIGINT) AS v FROM c WHERE phase IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT device_id, string_agg(phase || ' ' || v, ' · ' ORDER BY CASE phase WHEN 'R' THEN 1 WHEN 'Y' THEN 2 ELSE 3 END) AS phases FROM ph GROUP BY 1)
SELECT device_id, CASE WHEN frame_age < 90 THEN frame_age || 's ago' WHEN frame_age < 5400 THEN CAST(round(frame_age / 60.0) AS BIGINT) || 'm ago'
         WHEN frame_age < 172800 THEN CAST(round(frame_age / 3600.0) AS BIGINT) || 'h ago' ELSE CAST(round(frame_age / 86400.0) AS BIGINT) || 'd ago' END AS seen,
       regexp_replace(regexp_replace(format('{:,.2f}', rows / 4.0::DOUBLE), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS quarter,
       CASE WHEN device_id % 2 = 0 THEN '₹' ELSE 'EUR ' END || format('{:,.2f}', rows * 12.5::DOUBLE) AS amount, coalesce(phases, '—') AS phases,
       array_to_string(list_sort(list_distinct(list_filter([1, 2, rows % 9 - 1, rows % 9, rows % 9 + 1, rows % 9 + 2, rows % 9 + 3, 8, 9], lambda p: p BETWEEN 1 AND 9))), ',') AS pages
FROM h LEFT JOIN pl USING (device_id)""",
}

ORACLE_SQL["raw_staging"] = "SELECT device_id, id, metric, cents FROM (" + ORACLE_SQL["range_gate"] + ") WHERE kind IN ('cumulative', 'md') AND in_range"
ORACLE_SQL["acceptance_stored"] = ORACLE_SQL["acceptance_audit"]
