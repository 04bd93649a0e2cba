"""The test tables in the shapes of this library: registers, claims, features, bitmaps, uploads. Registers are hundredths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.operators.registry import BILLING, EXPORT

BIRTH = "timestamp_ntz'2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean multi-year registers of lineitem: device_id, metric, captured_at, cents."""
    sold = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), F.when(F.col("l_returnflag") == "A", EXPORT).otherwise(BILLING).alias("metric"), F.col("l_shipdate").cast("timestamp_ntz").alias("captured_at"), F.col("l_quantity").cast("bigint").alias("qty")
    )
    daily = sold.groupBy("device_id", "metric", "captured_at").agg(F.sum("qty").alias("qty"))  # partial sums before the exchange
    run = Window.partitionBy("device_id", "metric").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("device_id", "metric", "captured_at", (F.lit(50_000) + 300 * F.sum("qty").over(run)).alias("cents"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with injected misreads of events: device_id, id, captured_at, guard_at (a slower clock), metric, phase, cents, src."""
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("captured_at"),
        F.when(F.col("event_type").isin("click", "signup"), BILLING).when(F.col("event_type").isin("view", "error"), EXPORT).otherwise("voltage").alias("metric"),
        F.expr("floor((cast(round(value * 100) as bigint) + 50) / 100)").alias("stp"),
    )
    run = Window.partitionBy("device_id").orderBy("captured_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda m: F.sum(F.when(F.col("metric") == m, F.col("stp")).otherwise(0)).over(run)
    both = events.withColumns({"imp": 30_000 + total(BILLING), "exp": 90_000 + total(EXPORT)})
    own, other = F.when(F.col("metric") == BILLING, F.col("imp")).otherwise(F.col("exp")), F.when(F.col("metric") == BILLING, F.col("exp")).otherwise(F.col("imp"))
    cents = (
        F.when(F.col("metric") == "voltage", 23_000 + F.expr("id % 5") * 100)
        .when(F.expr("id % 9 = 4"), own + 10_000)
        .when(F.expr("id % 23 = 7"), own - 10_000)
        .when(F.expr("id % 29 = 3"), other)
        .when(F.expr("id % 31 = 5"), own - F.col("stp"))
        .when(F.expr("id % 37 = 11"), own + 8_000)
        .when(F.expr("id % 41 = 13"), own - F.col("stp") + 2_000)
        .otherwise(own)
    )
    micros = F.unix_micros(F.col("captured_at").cast("timestamp")) - F.expr(f"unix_micros(cast({BIRTH} as timestamp))")
    return both.select(
        "device_id",
        "id",
        "captured_at",
        F.timestamp_seconds(F.floor(micros / 60_000_000) + F.expr(f"unix_seconds(cast({BIRTH} as timestamp))")).cast("timestamp_ntz").alias("guard_at"),
        "metric",
        F.when(F.col("metric") == "voltage", F.element_at(F.array(F.lit("R"), F.lit("Y"), F.lit("B")), F.expr("cast(id % 3 + 1 as int)"))).alias("phase"),
        cents.cast("bigint").alias("cents"),
        F.concat(F.date_format("captured_at", "yyyy-MM-dd_HHmmss"), F.lit("_"), F.col("id").cast("string")).alias("src"),
    )


#: The lit segments, a to g, of each digit.
SEGMENTS = ("1111110", "0110000", "1101101", "1111001", "0110011", "1011011", "1011111", "1110000", "1111111", "1111011")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment features of events: device_id, id, cells array<struct(ink, seg)>, truth (hundredths)."""
    digits = F.array(*map(F.lit, SEGMENTS))
    base = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("id"), F.expr("cast(round(value * 100) as bigint)").alias("truth"), F.expr("lpad(cast(cast(round(value * 100) as bigint) as string), 6, ' ')").alias("s")
    )
    first = F.length(F.regexp_extract("s", "^ *", 0))

    def cell(c, i):
        pattern = F.when(c == " ", F.lit("0000000")).otherwise(F.element_at(digits, c.try_cast("int") + 1))
        seg = F.transform(F.slice(F.split(pattern, ""), 1, 7), lambda b, j: F.when((F.expr("id % 10 = 3")) & (i == first) & (j == 4), F.lit(0.18)).when(b == "1", F.lit(0.60)).otherwise(F.lit(0.05)))
        return F.struct(F.when(c == " ", F.lit(0.01)).otherwise(F.lit(0.30)).alias("ink"), seg.alias("seg"))

    return base.select("device_id", "id", F.transform(F.slice(F.split("s", ""), 1, 6), cell).alias("cells"), "truth")


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 bitmaps of embeddings: id, label, bits array<tinyint>."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: (x > 0).cast("tinyint")).alias("bits"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of pages: id, content; two of three begin like a JPEG."""
    body = F.encode("html", "UTF-8")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.expr("page_id % 3 <> 0"), F.concat(F.unhex(F.lit("FFD8FF")), body)).otherwise(body).alias("content"))
