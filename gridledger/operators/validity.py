"""Settings that change over time, as validity intervals, joined to readings without comparing all with all.

An interval of some days' length belongs to the level of the next power of two, where it covers two buckets at most. A
reading has one bucket on each level that occurs. Both meet on key, level and bucket, and a residual condition drops
what only shares a bucket. So the copies of an interval don't grow with its length, and a long one isn't cut up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days from which an interval without an end counts as open, on a level of its own: one bucket for all of time.
OPEN = 40


def _day(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date"))


def intervals(changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes (keys, valid_from, more) with valid_to: the day of the key's next change, null for the last. Of two changes on
    a day the last by its other columns counts."""
    rest = [c for c in changes.columns if c not in (*keys, "valid_from")]
    last = changes.groupBy(*keys, "valid_from").agg(F.max(F.struct(*rest)).alias("s")).select(*keys, "valid_from", "s.*")
    return last.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))


def _levels(valid: DataFrame) -> DataFrame:
    """valid with __level: the power of two that the days reach."""
    days = F.greatest(_day("valid_to") - _day("valid_from"), F.lit(1))
    return valid.withColumn("__level", F.when(F.col("valid_to").isNull(), F.lit(OPEN)).otherwise(F.ceil(F.log2(days)).cast("int")))


def _bucket(day: Column, level: Column) -> Column:
    return F.when(level == OPEN, F.lit(0).cast("bigint")).otherwise(F.floor(day / F.pow(F.lit(2.0), level)).cast("bigint"))


def valid_at(rows: DataFrame, valid: DataFrame, keys: list[str], at: str, how: str = "inner") -> DataFrame:
    """rows with the other columns of each interval that their day lies in: valid_from <= at < valid_to (open if null).

    how: inner, or left to keep rows without an interval, once each. Empty intervals (valid_to not after valid_from) and
    null keys or times match nothing. Which levels occur is asked for first: a few numbers."""
    spread = _levels(valid.filter("valid_from is not null and (valid_to is null or valid_to > valid_from)"))
    levels = sorted(r["__level"] for r in spread.select("__level").distinct().collect())
    ends = F.array_distinct(F.array(_bucket(_day("valid_from"), F.col("__level")), _bucket(F.coalesce(_day("valid_to") - 1, F.lit(0)), F.col("__level"))))
    told = [c for c in valid.columns if c not in keys]
    right = spread.withColumn("__bucket", F.explode(ends)).select(*keys, "__level", "__bucket", F.struct(*told).alias("__valid"))
    left = rows.withColumn("__row", F.monotonically_increasing_id()) if how == "left" else rows
    wanted = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    left = left.withColumn("__day", _day(at)).withColumn("__level", F.explode_outer(wanted) if how == "left" else F.explode(wanted)).withColumn("__bucket", _bucket(F.col("__day"), F.col("__level")))
    inside = (F.to_date(F.col("__valid.valid_from")) <= F.to_date(F.col(at))) & (F.col("__valid.valid_to").isNull() | (F.to_date(F.col(at)) < F.to_date(F.col("__valid.valid_to"))))
    found = left.join(right, [*keys, "__level", "__bucket"], how)
    columns = [F.col(c) for c in rows.columns] + [F.col(f"__valid.{c}").alias(c) for c in told]
    if how == "inner":
        return found.filter(inside).select(*columns)
    # on a level where nothing fits, a row of a left join is kept only if none fits on any level
    hits = found.withColumn("__hit", F.coalesce(inside, F.lit(False)))
    per = hits.withColumns({"__any": F.max("__hit").over(Window.partitionBy("__row")), "__nth": F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("__hit")))})
    none = ~F.col("__any") & (F.col("__nth") == 1)
    return per.filter("__hit or (not __any and __nth = 1)").withColumn("__valid", F.when(~none, F.col("__valid"))).select(*columns)
