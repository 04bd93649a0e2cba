"""Settings: key-value rows to typed columns, and guarded updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings with their defaults and types; a default stands in for a key that is missing, not for a null.
DEFAULTS = {
    "billing_day": ("1", "int"), "billing_metric": ("ip_cu_fd", "string"), "export_metric": ("ep_cu_fd", "string"), "rate_per_kwh": ("0", "decimal(10,4)"),
    "fixed_charge": ("0", "decimal(10,2)"), "currency": ("INR", "string"), "tz": ("Asia/Kolkata", "string"), "tariff_slabs": ("", "string"),
    "surcharge_pct": ("0", "decimal(8,3)"), "subsidy": ("0", "decimal(10,2)"), "alert_gap_min": ("20", "int"),
}
#: Settings that may be changed.
ALLOWED = ("billing_day", "rate_per_kwh", "fixed_charge", "currency", "billing_metric", "export_metric", "tz", "tariff_slabs", "surcharge_pct", "subsidy")


def pivoted(rows: DataFrame, defaults: dict[str, tuple[str, str]] = DEFAULTS) -> DataFrame:
    """A row per device with rows: a typed column for each known key. Unknown keys are left out; of repeated ones the greatest value counts."""
    per = rows.groupBy("device_id").agg(
        *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in defaults), *(F.count(F.when(F.col("k") == k, 1)).alias(f"has_{k}") for k in defaults)
    )
    typed = lambda k: F.when(F.col(f"has_{k}") > 0, F.col(k)).otherwise(defaults[k][0]).try_cast(defaults[k][1]).alias(k)
    return per.select("device_id", *map(typed, defaults))


def updated(stored: DataFrame, changes: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """stored with the trimmed values of changes, for keys that are allowed and already there; one change a key."""
    new = changes.filter(F.col("k").isin(*allowed)).groupBy("device_id", "k").agg(F.max(F.trim("v")).alias("new"))
    return stored.join(new, ["device_id", "k"], "left").select("device_id", "k", F.coalesce("new", "v").alias("v"))


def tariffs(settings: DataFrame) -> DataFrame:
    """The tariff of each device as the bills take it, from pivoted settings."""
    return settings.select("device_id", F.col("tariff_slabs").alias("slabs"), F.col("rate_per_kwh").alias("rate"), F.col("fixed_charge").alias("fixed"), F.col("surcharge_pct").alias("percent"), "subsidy")
