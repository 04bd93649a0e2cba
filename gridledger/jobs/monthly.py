"""The daily billing job: registers to usage, bills, savings and variance, with parameters for the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.operators import bills, consumption
from gridledger.sources import adapters


#: Tariff of the test devices: slabs, fixed charge, surcharge in percent.
SLABS, FIXED, PERCENT = "75:3.10,125:4.60,150:6.05,*:8.40", 50, 10


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing days of the test devices: the 15th for even ids, else the 1st."""
    ids = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    return ids.withColumn("billing_day", F.when(F.col("device_id") % 2 == 0, 15).otherwise(1))


def tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slab tariffs of the test devices; every fifth has a flat rate instead."""
    flat = F.col("device_id") % 5 == 4
    return devices(spark, sf_dir).select(
        "device_id", F.when(flat, "").otherwise(SLABS).alias("slabs"), F.when(flat, 6.5).otherwise(0).cast("decimal(10,4)").alias("rate"),
        F.lit(FIXED).alias("fixed"), F.lit(PERCENT).alias("percent"), F.when(F.col("device_id") % 7 == 3, 100).otherwise(0).alias("subsidy"),
    )


def baselines(readings: DataFrame, known: DataFrame) -> DataFrame:
    """Manual baselines of every third device: 10 kWh under its first reading, in that reading's cycle."""
    rows = consumption.with_cycle(readings.filter("device_id % 3 = 0"), known)
    first = rows.groupBy("device_id", "metric").agg(F.min_by("cycle_start", "captured_at").alias("cycle_start"), F.min_by("cents", "captured_at").alias("cents"))
    return first.select("device_id", "metric", "cycle_start", (F.col("cents") - 1000).alias("cents"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, known = adapters.registers(spark, sf_dir), devices(spark, sf_dir)
    return consumption.cycle_usage(readings, known, baselines(readings, known))


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.cycle_bill(bills.sides(usage(spark, sf_dir)), tariffs(spark, sf_dir))


def entered(estimates: DataFrame) -> DataFrame:
    """Bills as entered for even devices, and again, corrected, for every fourth: the log behind actuals."""
    base = estimates.filter("device_id % 2 = 0").select("device_id", "cycle_start", (F.col("total") + F.col("device_id") % 7 - 3).alias("amount"), F.expr("net_cents div 100").alias("units"), F.date_add("cycle_start", 40).alias("bill_date"))
    again = base.filter("device_id % 4 = 0").select("device_id", "cycle_start", (F.col("amount") + 5).alias("amount"), "units", F.date_add("bill_date", 2).alias("bill_date"), F.lit(2).alias("version"))
    return base.withColumn("version", F.lit(1)).unionByName(again)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's bill by cycle, with what its export saved."""
    cycles, terms = bills.sides(usage(spark, sf_dir)), tariffs(spark, sf_dir)
    saved = bills.savings(cycles, terms).select("device_id", "cycle_start", F.col("without").cast("double").alias("without"), F.col("saved").cast("double").alias("saved"))
    return bills.cycle_bill(cycles, terms).join(saved, ["device_id", "cycle_start"])
