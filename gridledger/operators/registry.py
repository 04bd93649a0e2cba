"""The metric registry: a small dimension that says how each metric is judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "label string, metric string, unit string, kind string, lo bigint, hi bigint, signed boolean, sibling string"

#: Label, metric, unit, kind, least and greatest value in hundredths, signed, sibling register.
REGISTRY = [
    ("IP-Cu", "ip_cu", "kWh", "cumulative", 1, 100_000_000, False, None),
    ("IP-Cu-Fd", "ip_cu_fd", "kWh", "cumulative", 1, 100_000_000, False, "ep_cu_fd"),
    ("EP-Cu", "ep_cu", "kWh", "cumulative", 1, 100_000_000, False, None),
    ("EP-Cu-Fd", "ep_cu_fd", "kWh", "cumulative", 1, 100_000_000, False, "ip_cu_fd"),
    ("IP-HO", "md_import", "kW", "md", 120, 5_000, False, None),
    ("EP-HO", "md_export", "kW", "md", 120, 5_000, False, None),
    ("Ld-rCt-1", "reactive_1", "kVArh", "cumulative", 1, 100_000_000, False, None),
    ("Ld-rCt-2", "reactive_2", "kVArh", "cumulative", 1, 100_000_000, False, None),
    ("Ld-rCt-3", "reactive_3", "kVArh", "cumulative", 1, 100_000_000, False, None),
    ("Ld-rCt-4", "reactive_4", "kVArh", "cumulative", 1, 100_000_000, False, None),
    ("unit-V", "voltage", "V", "instant", 5_000, 32_000, False, None),
    ("unit-A", "current", "A", "instant", -15_000, 15_000, True, None),
    ("pf", "pf", "", "instant", 0, 120, False, None),
]
#: Bounds of a metric that the registry doesn't have.
DEFAULT_LO, DEFAULT_HI = 1, 100_000_000
BILLING, EXPORT = "ip_cu_fd", "ep_cu_fd"
ENERGY = ("ip_cu", "ip_cu_fd", "ep_cu", "ep_cu_fd")
BILLED = ("ip_cu_fd", "ep_cu_fd")
PF_LIMIT = 120


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table; adding a metric is adding a row."""
    return spark.createDataFrame(REGISTRY, SCHEMA)


def classify(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Metric, unit and kind by label, else by unit glyph (V or A); claims of neither are dropped.

    claims: label, glyph, ...; known: the registry, a few rows, so it may be broadcast."""
    by_label = known.select("label", F.col("metric").alias("m1"), F.col("unit").alias("u1"), F.col("kind").alias("k1"))
    by_glyph = known.filter("label like 'unit-%'").select(F.substring("label", 6, 1).alias("glyph"), F.col("metric").alias("m2"), F.col("unit").alias("u2"), F.col("kind").alias("k2"))
    joined = claims.join(F.broadcast(by_label), "label", "left").join(F.broadcast(by_glyph), "glyph", "left")
    return joined.withColumns({"metric": F.coalesce("m1", "m2"), "unit": F.coalesce("u1", "u2"), "kind": F.coalesce("k1", "k2")}).drop("m1", "m2", "u1", "u2", "k1", "k2").filter("metric is not null")


def split_power_factor(claims: DataFrame) -> DataFrame:
    """A demand of 1.2 or less is a power factor."""
    low = (F.col("kind") == "md") & (F.col("cents") <= PF_LIMIT)
    return claims.withColumns({"metric": F.when(low, "pf").otherwise(F.col("metric")), "unit": F.when(low, "").otherwise(F.col("unit")), "kind": F.when(low, "instant").otherwise(F.col("kind"))})


def minus_seen(top: Column, mid: Column, bottom: Column) -> Column:
    """Whether a minus bar shows in three ink fractions."""
    return (mid > 0.18) & (mid > 2 * top) & (mid > 2 * bottom)


def signed(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Negates values of signed metrics where `minus` is true."""
    flags = known.select("metric", "signed").distinct()
    joined = claims.join(F.broadcast(flags), "metric", "left")
    return joined.withColumn("cents", F.when(F.coalesce("signed", F.lit(False)) & F.coalesce("minus", F.lit(False)), -F.col("cents")).otherwise(F.col("cents"))).drop("signed")


def in_range(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Adds in_range: the value is within the metric's bounds, ends included, else within the default ones."""
    bounds = known.groupBy("metric").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    joined = claims.join(F.broadcast(bounds), "metric", "left")
    return joined.withColumn("in_range", F.col("cents").between(F.coalesce("lo", F.lit(DEFAULT_LO)), F.coalesce("hi", F.lit(DEFAULT_HI)))).drop("lo", "hi")
