"""Bills, savings and their comparison with what was charged. Money is exact decimal; amounts leave as doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import tariff
from gridledger.operators.registry import BILLING, EXPORT


def sides(usage: DataFrame, imported: str = BILLING, exported: str = EXPORT) -> DataFrame:
    """A row per device and cycle with import readings: import_cents and export_cents (0 where there are none).

    Both are raw; cycles without an import reading are left out."""
    side = lambda m: F.max(F.when(F.col("metric") == m, F.col("usage_cents")))
    per = usage.filter(F.col("metric").isin(imported, exported)).groupBy("device_id", "cycle_start").agg(side(imported).alias("import_cents"), side(exported).alias("export_cents"))
    return per.filter("import_cents is not null").withColumn("export_cents", F.coalesce("export_cents", F.lit(0)).cast("bigint"))


def with_tariff(cycles: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Adds a device's slabs (parsed), flat rate, fixed charge, percent and subsidy. tariffs: a row per device.

    A device without a row, or with nulls in it, has no slabs and zeros."""
    parsed = tariffs.select("device_id", tariff.parse_slabs(F.col("slabs")).alias("slabs"), "rate", "fixed", "percent", "subsidy")
    return cycles.join(parsed, "device_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rate", "fixed", "percent", "subsidy")})


def _cost(units: Column) -> Column:
    return tariff.slab_cost(units, F.col("slabs"), F.col("rate"), F.col("fixed"), F.col("percent"), F.col("subsidy"))


def cycle_bill(cycles: DataFrame, tariffs: DataFrame) -> DataFrame:
    """The bill of each cycle on net units (import minus export, at least 0; usage is clamped first)."""
    imp = F.greatest(F.lit(0), F.col("import_cents"))
    rows = with_tariff(cycles, tariffs).withColumn("net_cents", F.greatest(F.lit(0), imp - F.col("export_cents")).cast("bigint")).withColumn("surplus_cents", F.greatest(F.lit(0), F.col("export_cents") - imp).cast("bigint"))
    cost = rows.withColumn("cost", _cost(tariff.kwh(F.col("net_cents"))))
    return cost.select("device_id", "cycle_start", "import_cents", "export_cents", "net_cents", "surplus_cents", *(F.col(f"cost.{c}").cast("double").alias(c) for c in ("energy", "fixed", "surcharge", "total")))


def savings(cycles: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Per cycle: the total without export (all import billed) and with it, and what is saved. net_cents is not clamped."""
    rows = with_tariff(cycles, tariffs)
    clamped = F.greatest(F.lit(0), F.col("import_cents") - F.col("export_cents"))
    return rows.select(
        "device_id", "cycle_start", "import_cents", "export_cents", (F.col("import_cents") - F.col("export_cents")).alias("net_cents"),
        _cost(tariff.kwh(F.col("import_cents")))["total"].alias("without"), _cost(tariff.kwh(clamped))["total"].alias("with_export"),
    ).withColumn("saved", F.col("without") - F.col("with_export"))


def savings_rollup(saved: DataFrame) -> DataFrame:
    """The cycles' rows, a total of them for each device (cycle_start null), and ratios in whole percent, null on no base."""
    sums = saved.rollup("device_id", "cycle_start").agg(*(F.sum(c).alias(c) for c in ("import_cents", "export_cents", "net_cents", "without", "with_export", "saved")))
    percent = lambda a, b: F.when(F.col(b) > 0, F.round(F.lit(100) * F.col(a).cast("decimal(20,2)") / F.col(b).cast("decimal(20,2)"), 0)).cast("double")
    return sums.filter("device_id is not null").select(
        "device_id", "cycle_start", "import_cents", "export_cents", "net_cents", *(F.col(c).cast("double").alias(c) for c in ("without", "with_export", "saved")),
        percent("saved", "without").alias("saved_percent"), percent("export_cents", "import_cents").alias("export_percent"),
    )


def variance(bills: DataFrame, actuals: DataFrame) -> DataFrame:
    """Estimate against the amount charged: difference, and percent of the estimate (one decimal, null unless it is > 0)."""
    joined = bills.select("device_id", "cycle_start", F.col("total").cast("decimal(20,2)").alias("estimate")).join(actuals.select("device_id", "cycle_start", F.col("amount").cast("decimal(20,2)").alias("amount")), ["device_id", "cycle_start"])
    difference = F.col("amount") - F.col("estimate")
    return joined.select(
        "device_id", "cycle_start", F.col("estimate").cast("double").alias("estimate"), F.col("amount").cast("double").alias("amount"),
        F.round(difference, 2).cast("double").alias("difference"), F.when(F.col("estimate") > 0, F.round(difference * 100 / F.col("estimate"), 1)).cast("double").alias("percent"),
    )


def last_closed(bills: DataFrame, actuals: DataFrame, current: DataFrame) -> DataFrame:
    """The latest bill of each device before its current cycle, with the amount charged if there is one.

    current: device_id, cycle_start of the open cycle, which is left out."""
    closed = bills.join(current.select("device_id", F.col("cycle_start").alias("open")), "device_id").filter("cycle_start < open")
    last = closed.groupBy("device_id").agg(F.max_by(F.struct("cycle_start", "net_cents", "total"), "cycle_start").alias("b")).select("device_id", "b.*")
    return last.join(actuals.select("device_id", "cycle_start", F.col("amount").cast("double").alias("amount")), ["device_id", "cycle_start"], "left")


def edit_history(edits: DataFrame) -> DataFrame:
    """edits with place: 1 for the newest edit of each device and cycle."""
    return edits.withColumn("place", F.row_number().over(Window.partitionBy("device_id", "cycle_start").orderBy(F.desc("version"))))


def baseline_listing(baselines: DataFrame) -> DataFrame:
    """baselines with place: each device's, newest cycle first, then by metric."""
    return baselines.withColumn("place", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("cycle_start"), "metric")))


def with_note(cycles: DataFrame, baselines: DataFrame, imported: str = BILLING, exported: str = EXPORT) -> DataFrame:
    """cycles with the note of the cycle's baseline: the import's, else the export's, else null."""
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("note")))
    notes = baselines.groupBy("device_id", "cycle_start").agg(F.coalesce(of(imported), of(exported)).alias("note"))
    return cycles.join(notes, ["device_id", "cycle_start"], "left")


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose keys it doesn't have: nothing is overwritten."""
    return existing.unionByName(new.select(existing.columns).join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], values: list[str], version: str) -> DataFrame:
    """The last non-null value of each column by version, else the existing one: a blank field keeps what is there."""
    last = changes.groupBy(*keys).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(version))).alias(f"new_{v}") for v in values))
    return existing.select(*keys, *values).join(last, keys, "full").select(*keys, *(F.coalesce(f"new_{v}", v).alias(v) for v in values))


def audited_actuals(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, edits) of a log of entered bills (device_id, cycle_start, amount, units, bill_date, version).

    Only amounts over 0 count. The state is each cycle's last entry; every later entry leaves an edit, old to new."""
    entered = changes.filter("amount > 0")
    state = entered.groupBy("device_id", "cycle_start").agg(F.max_by(F.struct("amount", "units", "bill_date"), "version").alias("s")).select("device_id", "cycle_start", "s.*")
    order = Window.partitionBy("device_id", "cycle_start").orderBy("version")
    old = {f"old_{c}": F.lag(c).over(order) for c in ("amount", "units", "bill_date")}
    edits = entered.withColumns({**old, "place": F.row_number().over(order)}).filter("place > 1").drop("place")
    return state, edits
