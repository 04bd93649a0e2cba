"""Misread rates against a consensus, and repair of registers that got stuck too high. Values in hundredths.

Python's rounding in the source of these rules is half to even, hence bround; register values are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions.text import fold_flip

#: Tolerances in hundredths: misread band, heal, and the gap at which a register is behind.
MISREAD, HEAL, BEHIND = 2_000, 300, 2_300
CONSENSUS_TENTHS = 6


#: Values of one coarse count; a register has at most 10^4 coarse counts, and one of them 10^4 values.
COARSE = 10_000
_COUNTS = "array<struct<value:bigint,n:bigint>>"


def _at_rank(counts: Column, rank: Column) -> Column:
    """struct(value, left) of the entry that holds a rank (from 1) in ascending (value, n); left: the rank inside it."""
    begin = F.struct(F.lit(None).cast("bigint").alias("value"), rank.cast("bigint").alias("left"))

    def step(acc: Column, e: Column) -> Column:
        here = acc["value"].isNull() & (acc["left"] <= e["n"])
        return F.struct(F.when(here, e["value"]).otherwise(acc["value"]).alias("value"), F.when(here | acc["value"].isNotNull(), acc["left"]).otherwise(acc["left"] - e["n"]).alias("left"))

    return F.aggregate(counts, begin, step)


def _frames(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, e: s + e["n"])


def median_of(counts: Column) -> Column:
    """The exact median of ascending counts by value: the middle value, or the mean of the middle two."""
    n = _frames(counts)
    middle = lambda rank: _at_rank(counts, rank)["value"]
    return (middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / F.lit(2.0)


def figures(counts: Column) -> Column:
    """struct(frames, misreads, accuracy, consensus_cents) of counts by value, in any order; counts of parts merge by
    adding up. For groups whose values are few, as those of some hours."""
    ordered = F.array_sort(counts)

    def of(c: Column) -> Column:
        def known(m: Column) -> Column:
            frames = _frames(c)
            missed = F.aggregate(c, F.lit(0).cast("bigint"), lambda s, e: s + F.when(F.abs(e["value"] - m) > MISREAD, e["n"]).otherwise(F.lit(0).cast("bigint")))
            folded = F.array_max(F.transform(c, lambda e: e["value"] - (F.bround((e["value"] - m) / 10_000.0, 0) * 10_000).cast("bigint")))
            return F.struct(frames.alias("frames"), missed.alias("misreads"), F.bround(F.lit(100.0) * (frames - missed) / frames, 1).alias("accuracy"), folded.alias("consensus_cents"))

        return F.get(F.transform(F.array(median_of(c)), known), F.lit(0))

    return F.get(F.transform(F.array(ordered), of), F.lit(0))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's other columns, null keys being equal."""
    same = [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in keys]
    return a.alias("__a").join(b.alias("__b"), same).select("__a.*", *(F.col(f"__b.{c}") for c in b.columns if c not in keys))


def value_counts(claims: DataFrame, keys: list[str]) -> DataFrame:
    """How often each group has each value: keys, value, n. Counts of parts add up, and meet before the exchange."""
    return claims.filter("cents is not null").groupBy(*keys, F.col("cents").alias("value")).agg(F.count("*").alias("n"))


def medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: exact, from counts by value. Coarse counts tell in which ten thousand values the middle lies, and
    those tell the middle: of a group with any history both lists are bounded, and no window holds its rows."""
    coarse = counts.groupBy(*keys, F.floor(F.col("value") / COARSE).alias("part")).agg(F.sum("n").alias("n"))
    listed = lambda value: F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), "n"))).cast(_COUNTS)
    total = _frames(F.col("parts"))
    asked = coarse.groupBy(*keys).agg(listed("part").alias("parts")).select(*keys, _at_rank(F.col("parts"), F.floor((total + 1) / 2)).alias("low"), _at_rank(F.col("parts"), F.floor(total / 2) + 1).alias("high"))
    part = F.floor(F.col("value") / COARSE)
    near = _joined(counts, asked, keys).filter((part == F.col("low.value")) | (part == F.col("high.value")))
    inside = near.groupBy(*keys, "low", "high").agg(listed("value").alias("values"))
    of = lambda end: _at_rank(F.filter("values", lambda e: F.floor(e["value"] / COARSE) == F.col(f"{end}.value")), F.col(f"{end}.left"))["value"]
    return inside.select(*keys, ((of("low") + of("high")) / F.lit(2.0)).alias("median"))


def consensus(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per group (one metric of one device in one window of hours, say): frames, misreads (folded to the median's hundred,
    still over 20 away from it), accuracy in percent (one decimal, half to even), and the consensus register: the
    largest folded value. All of it comes from counts by value, which are exchanged once."""
    counts = value_counts(claims, keys)
    known = _joined(counts, medians(counts, keys), keys)
    folded = F.col("value") - (F.bround((F.col("value") - F.col("median")) / 10_000.0, 0) * 10_000).cast("bigint")
    missed = F.sum(F.when(F.abs(F.col("value") - F.col("median")) > MISREAD, F.col("n")).otherwise(0))
    return known.groupBy(*keys).agg(F.sum("n").alias("frames"), missed.alias("misreads"), F.bround(F.lit(100.0) * (F.sum("n") - missed) / F.sum("n"), 1).alias("accuracy"), F.max(folded).alias("consensus_cents"))


def with_trend(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, at in seconds, value, seq) with tau: the trend at each row's time, linear between the neighbouring
    points and clamped at the ends. Rows with a value are the points; without one they only ask.

    Points of one time: inside the first (by seq) counts, at the right end the last. Both windows grow from their
    start, one in each direction, so the work is linear in the rows; one exchange by the keys serves all three."""
    point, tie = F.col("value").isNotNull(), Window.partitionBy(*keys, "at")
    up, down = Window.partitionBy(*keys).orderBy("at"), Window.partitionBy(*keys).orderBy(F.desc("at"))
    seq = F.when(point, F.col("seq"))
    ends = rows.withColumns({"__first": F.min_by("value", seq).over(tie), "__last": F.max_by("value", seq).over(tie)})
    marked = ends.withColumn("__p", F.when(point, F.struct(F.col("at").alias("t"), F.col("__first").alias("first"), F.col("__last").alias("last"))))
    near = marked.withColumns({"__left": F.last("__p", True).over(up.rangeBetween(Window.unboundedPreceding, -1)), "__right": F.last("__p", True).over(down.rangeBetween(Window.unboundedPreceding, 0))})
    left, right = F.col("__left"), F.col("__right")
    inside = left["last"] + (right["first"] - left["last"]) * ((F.col("at") - left["t"]).cast("double") / (right["t"] - left["t"]))
    tau = F.when(right.isNull(), left["last"]).when(left.isNull() | (right["t"] == F.col("at")), right["first"]).otherwise(inside)
    return near.withColumn("tau", tau.cast("double")).drop("__first", "__last", "__p", "__left", "__right")


def trend(points: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """probes (keys, at, and more) with tau: the trend of points (keys, at, value, seq) at the probe's time."""
    row = F.struct(*[c for c in probes.columns if c not in (*keys, "at")])
    kind = probes.select(row.alias("r")).schema["r"].dataType
    asked = probes.select(*keys, "at", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("value", "seq")), row.alias("r"))
    both = points.select(*keys, "at", "value", "seq", F.lit(None).cast(kind).alias("r")).unionByName(asked)
    return with_trend(both, keys).filter("r is not null").select(*keys, "at", "r.*", "tau")


def audited(rows: DataFrame, keys: list[str], billed: Column) -> DataFrame:
    """rows (keys, at in seconds, id, cents, is_raw, is_stored) of the audited window with, on each, its group's figures:

    frames, misreads, accuracy and consensus_cents of the raw rows, stored_cents (the last of the stored rows that
    aren't before the first raw one), high (the register stands over its consensus), able (it may be healed: billed,
    and at least six tenths of the frames agree), and new_cents: what a stored row of such a register is set to, if it
    is whole hundreds over the trend of the raw rows and, without them, within 3 of it.
    Groups without a raw or a stored row are left out. All of it takes one exchange by the keys."""
    group = Window.partitionBy(*keys)
    raw = F.when(F.col("is_raw"), F.col("cents"))
    middle = rows.withColumns({"median": F.median(raw).over(group), "begin": F.min(F.when(F.col("is_raw"), F.col("at"))).over(group)})
    folded = F.when(F.col("is_raw"), F.col("cents") - (F.bround((F.col("cents") - F.col("median")) / 10_000.0, 0) * 10_000).cast("bigint"))
    inside = F.coalesce(F.col("is_stored") & (F.col("at") >= F.col("begin")), F.lit(False))
    marked = middle.withColumns({"value": folded, "seq": F.col("id"), "inside": inside, "missed": F.col("is_raw") & (F.abs(F.col("cents") - F.col("median")) > MISREAD)})
    figures = {
        "frames": F.count(raw).over(group), "misreads": F.count(F.when(F.col("missed"), 1)).over(group), "consensus_cents": F.max("value").over(group),
        "stored_cents": F.max(F.when(F.col("inside"), F.struct("at", "id", "cents"))).over(group)["cents"],
    }
    good = F.col("frames") - F.col("misreads")
    known = with_trend(marked.withColumns(figures).filter("frames > 0 and stored_cents is not null"), keys)
    judged = known.withColumns({"accuracy": F.bround(F.lit(100.0) * good / F.col("frames"), 1), "high": F.col("stored_cents") > F.col("consensus_cents") + HEAL, "able": billed & (10 * good >= CONSENSUS_TENTHS * F.col("frames"))})
    k = F.bround((F.col("cents") - F.col("tau")) / 10_000.0, 0).cast("bigint")
    new = F.col("cents") - k * 10_000
    due = F.col("high") & F.col("able") & F.col("inside") & (k >= 1) & (F.abs(new - F.col("tau")) <= HEAL)
    return judged.withColumn("new_cents", F.when(due, new)).drop("median", "begin", "value", "seq", "inside", "missed", "tau")


def heal_plan(audit: DataFrame, keys: list[str]) -> DataFrame:
    """The fixes of an audit: keys, id, old_cents, new_cents."""
    return audit.filter("new_cents is not null").select(*keys, "id", F.col("cents").alias("old_cents"), "new_cents")


def statuses(audit: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group of an audit: its figures, the number of fixes, and status: ok, behind, poison_high or healed."""
    figures = ("frames", "misreads", "accuracy", "consensus_cents", "stored_cents", "high")
    per = audit.groupBy(*keys).agg(*(F.first(c).alias(c) for c in figures), F.count("new_cents").alias("fixes"))
    state = F.when(F.col("high") & (F.col("fixes") > 0), "healed").when(F.col("high"), "poison_high").when(F.col("consensus_cents") > F.col("stored_cents") + BEHIND, "behind").otherwise("ok")
    return per.withColumn("status", state).drop("high")


def apply_fixes(readings: DataFrame, fixes: DataFrame) -> DataFrame:
    """readings with the fixed values; rewrite only the dates that fixes touch."""
    keys = ["device_id", "metric", "id"]
    return readings.join(fixes.select(*keys, "new_cents"), keys, "left").withColumn("cents", F.coalesce("new_cents", "cents")).drop("new_cents")


def heal_log(fixes: DataFrame, checked: Column) -> DataFrame:
    """A line for each fix: time checked, metric, id, old and new value."""
    value = lambda c: F.format_string("%.2f", F.col(c) / 100.0)
    return fixes.select("device_id", "id", F.concat_ws(" ", checked, F.lit("heal"), "metric", F.concat(F.lit("id="), "id"), value("old_cents"), F.lit("->"), value("new_cents")).alias("line"))


def rolling_misreads(decodes: DataFrame, keys: list[str], side: int = 4) -> DataFrame:
    """Per group: decodes read, failed (null), and those over 20 from the median of their up to nine neighbours.

    decodes: keys, captured_at, id, cents (null: failed). Neighbours are non-null ones only, the row itself included."""
    order = Window.partitionBy(*keys).orderBy("captured_at", "id").rowsBetween(-side, side)
    read = decodes.filter("cents is not null").withColumn("local", F.percentile("cents", F.lit(0.5)).over(order))
    missed = read.groupBy(*keys).agg(F.count("*").alias("n_read"), F.count(F.when(F.abs(F.col("cents") - F.col("local")) > MISREAD, 1)).alias("n_misread"))
    failed = decodes.groupBy(*keys).agg(F.count(F.when(F.col("cents").isNull(), 1)).alias("n_failed"))
    return failed.join(missed, keys, "left").select(*keys, F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_failed", F.coalesce("n_misread", F.lit(0)).alias("n_misread"))


def setting_table(counts: DataFrame, billed: Column) -> DataFrame:
    """Settings by metric with a TOTAL row (metric null) and its billed part: counts of rolling_misreads by setting and metric."""
    return counts.withColumn("billed", billed).rollup("setting", "metric").agg(
        F.sum("n_read").alias("n_read"), F.sum("n_failed").alias("n_failed"), F.sum("n_misread").alias("n_misread"),
        F.sum(F.when(F.col("billed"), F.col("n_misread")).otherwise(0)).alias("billed_misread"), F.sum(F.when(F.col("billed"), F.col("n_read")).otherwise(0)).alias("billed_read"),
    ).filter("setting is not null")


def stride_sample(frames: DataFrame, k: int) -> DataFrame:
    """Every k-th frame of each device, in name order, the first included."""
    place = F.row_number().over(Window.partitionBy("device_id").orderBy("src"))
    return frames.withColumn("place", place).filter((F.col("place") - 1) % k == 0).drop("place")


__all__ = ["apply_fixes", "audited", "consensus", "figures", "fold_flip", "heal_plan", "median_of", "medians", "rolling_misreads", "setting_table", "statuses", "stride_sample", "trend", "value_counts", "with_trend"]
