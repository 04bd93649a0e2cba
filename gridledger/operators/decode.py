"""Seven-segment decoding from features, its audit against truth, parameter sweeps, and ink profiles.

Features: cells array<struct(ink, seg array<double>)>, six cells of seven lit fractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.sources.adapters import SEGMENTS

BLANK, LIT = 0.05, 0.20
#: Most different values of one parameter in a grid of settings.
MOST_VALUES = 512


def _shown() -> Column:
    """What is shown for each set of lit segments, the first segment being the highest of seven bits; '?' for no digit."""
    known = {int(s, 2): str(i) for i, s in enumerate(SEGMENTS)}
    return F.array(*(F.lit(known.get(bits, "?")) for bits in range(1 << len(SEGMENTS[0]))))


def digit(cell: Column, blank: Column, lit: Column) -> Column:
    """' ' for a cell with too little ink, the digit whose segments are lit (above the fraction), else '?'."""
    bits = F.aggregate(cell["seg"], F.lit(0), lambda acc, s: acc * 2 + F.when(s > lit, 1).otherwise(0))
    return F.when(cell["ink"] < blank, " ").when(F.size(cell["seg"]) == len(SEGMENTS[0]), F.get(_shown(), bits)).otherwise("?")


def digits(cells: Column, blank: Column | None = None, lit: Column | None = None) -> Column:
    blank, lit = F.lit(BLANK) if blank is None else blank, F.lit(LIT) if lit is None else lit
    return F.transform(cells, lambda c: digit(c, blank, lit))


def value(raw: Column) -> Column:
    """Hundredths of the digits read: the point stands before the last two. Null with a '?', or under three digits."""
    text = F.replace(raw, F.lit(" "), F.lit(""))
    return F.when((F.length(text) >= 3) & ~F.contains(text, F.lit("?")), text.try_cast("bigint"))


def self_test(raw: Column) -> Column:
    """Whether the display shows all eights."""
    return raw.rlike("^8+$")


def decode(features: DataFrame, blank: Column | None = None, lit: Column | None = None) -> DataFrame:
    """features with raw (text), cents, unknown (number of '?'), digits, and reason: no_lcd, decode_fail or ok."""
    without = lambda raw, c: F.length(F.replace(raw, F.lit(c), F.lit("")))

    def told(raw: Column) -> Column:
        return F.struct(raw.alias("raw"), value(raw).alias("cents"), (F.length(raw) - without(raw, "?")).alias("unknown"), without(raw, " ").alias("n_digits"))

    # cells are read once: filters and columns that come later look at what was read
    raw = F.when(F.col("cells").isNotNull(), F.array_join(digits(F.col("cells"), blank, lit), ""))
    rows = features.select(*features.columns, F.inline(F.transform(F.array(raw), told)))
    return rows.withColumn("reason", F.when(F.col("cells").isNull(), "no_lcd").when(F.col("cents").isNull(), "decode_fail").otherwise("ok"))


def without_self_test(decoded: DataFrame) -> DataFrame:
    """Decoded frames that don't show the display's self-test; undecoded ones stay."""
    return decoded.filter(F.coalesce(~self_test(F.replace(F.col("raw"), F.lit(" "), F.lit(""))), F.lit(True)))


def segment_audit(features: DataFrame, lit: float = LIT) -> DataFrame:
    """Per segment of frames with a known truth: phantoms (on, should be off) and missing ones.

    A cell's true digit is that of the truth, right-aligned in six cells; blank cells have none."""
    true = F.split(F.expr("lpad(cast(truth as string), 6, ' ')"), "")
    lights = F.array(*map(F.lit, SEGMENTS))
    rows = features.filter("truth is not null").select(F.posexplode("cells").alias("at", "cell"), true.alias("true")).select("cell", F.get("true", F.col("at")).alias("d")).filter("d <> ' '")
    segments = rows.select(F.posexplode("cell.seg").alias("segment", "fraction"), F.split(F.element_at(lights, F.col("d").cast("int") + 1), "").alias("on")).withColumn("on", F.get("on", F.col("segment")) == "1")
    seen = F.col("fraction") > lit
    return segments.groupBy("segment").agg(F.count("*").alias("n"), F.count(F.when(seen & ~F.col("on"), 1)).alias("phantom"), F.count(F.when(~seen & F.col("on"), 1)).alias("missing"))


def _below(x: Column, values: list[float], strictly: bool) -> Column:
    """How many of the ascending values are below x (or equal to it, unless strictly), by halving."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        v = F.lit(values[mid])
        return F.when(v < x if strictly else v <= x, among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(values))


def _axes(grid: DataFrame, *names: str) -> list[list[float]]:
    """The different values of each parameter, ascending, by one job."""
    values = grid.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names)))).select("col.*").distinct()
    rows = values.limit(len(names) * MOST_VALUES + 1).collect()
    # NaN last, as Spark has it
    axes = [sorted((r["value"] for r in rows if r["name"] == n), key=lambda v: (v != v, v)) for n in names]
    if max(map(len, axes)) > MOST_VALUES:
        raise ValueError(f"a grid has more than {MOST_VALUES} values of a parameter")
    return axes


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is worked out once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _stretches(changes: Column, n: int) -> Column:
    """array<struct(a, b)>: the stretches [a, b) of 0..n-1 between the places where something changes."""
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(changes, lambda c: c < n))))
    return _once(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, n), F.array(F.lit(n))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def sweep(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Per setting of the grid (setting, blank, lit): frames read cleanly, right values, right leading digits.

    Clean: three digits or more and no '?'. A frame's reading changes only where a parameter passes the ink of a cell or
    the fraction of a segment, so it is read once for each rectangle between such places, whatever the number of
    settings. Rectangles are counted, their corners are differences, and running sums over the two parameters
    give the counts of each setting. The grid may have MOST_VALUES different values of each parameter, else ValueError; a
    null blank makes no cell blank, a null lit lights no segment. Without frames each setting has zeros."""
    settings = grid.select("setting", "blank", "lit", F.coalesce("blank", F.lit(float("-inf"))).alias("b"), F.coalesce("lit", F.lit(float("nan"))).alias("l"))
    blanks, lits = _axes(settings, "b", "l")
    if not blanks:
        return grid.select("setting", "blank", "lit", *(F.lit(0).cast("long").alias(c) for c in ("n_clean", "n_right", "n_lead")))
    # a cell is blank from the first value above its ink on; a segment is lit up to the last value below its fraction
    inks = F.transform("cells", lambda c: F.coalesce(_below(c["ink"], blanks, False), F.lit(0)))
    none = F.array().cast("array<int>")
    fractions = F.flatten(F.transform("cells", lambda c: F.coalesce(F.transform(c["seg"], lambda s: _below(s, lits, True)), none)))
    alike = features.groupBy("cells", "truth").agg(F.count("*").alias("times"))
    of_b, of_l = _stretches(F.coalesce(inks, none), len(blanks)), _stretches(F.coalesce(fractions, none), len(lits))
    each = _once(of_l, lambda ls: F.flatten(F.transform(of_b, lambda b: F.transform(ls, lambda l: F.struct(b.alias("of_b"), l.alias("of_l"))))))  # noqa: E741
    rectangles = alike.select("cells", "truth", "times", F.inline(each))
    got = decode(rectangles, F.get(F.array(*map(F.lit, blanks)), F.col("of_b.a")), F.get(F.array(*map(F.lit, lits)), F.col("of_l.a")))
    text, true = F.replace(F.col("raw"), F.lit(" "), F.lit("")), F.col("truth").cast("string")
    told = {
        "n_clean": (F.col("n_digits") >= 3) & (F.col("unknown") == 0),
        "n_right": F.col("cents") == F.col("truth"),
        "n_lead": (F.length(text) == F.length(true)) & (F.substring(text, 1, 1) == F.substring(true, 1, 1)),
    }
    counted = got.groupBy("of_b", "of_l").agg(*(F.sum(F.when(when, F.col("times")).otherwise(0)).alias(c) for c, when in told.items()))
    corner = lambda b, l, sign: F.struct(F.col(f"of_b.{b}").alias("i"), F.col(f"of_l.{l}").alias("j"), F.lit(sign).alias("sign"))  # noqa: E731, E741
    corners = counted.select(*told, F.inline(F.array(corner("a", "a", 1), corner("a", "b", -1), corner("b", "a", -1), corner("b", "b", 1))))
    change = corners.groupBy("i", "j").agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in told))
    places = features.sparkSession.range(len(blanks) * len(lits)).select((F.expr(f"id div {len(lits)}")).cast("int").alias("i"), (F.col("id") % len(lits)).cast("int").alias("j"))
    at = places.join(change, ["i", "j"], "left")
    for along, across in (("j", "i"), ("i", "j")):
        upto = W.partitionBy(across).orderBy(along).rowsBetween(W.unboundedPreceding, 0)
        at = at.select("i", "j", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in told))
    # the place of a setting's own value is the number of smaller ones
    placed = settings.select("setting", "blank", "lit", _below(F.col("b"), blanks, True).alias("i"), _below(F.col("l"), lits, True).alias("j"))
    return placed.join(at, ["i", "j"]).select("setting", "blank", "lit", *told)


def best(scores: DataFrame, n: int = 12) -> DataFrame:
    """The n best settings; equal ones in the grid's order."""
    return scores.orderBy(F.desc("n_clean"), F.desc("n_lead"), "setting").limit(n)


def ink_profile(bitmaps: DataFrame, margin: int, width: int) -> DataFrame:
    """Mean ink of each position over all bitmaps (device_id, bits), 0 in the margins of a width-wide image."""
    at = bitmaps.select("device_id", F.posexplode("bits").alias("pos", "bit")).groupBy("device_id", "pos").agg(F.avg("bit").alias("ink"))
    column = F.col("pos") % width
    return at.withColumn("ink", F.when((column < margin) | (column >= width - margin), 0.0).otherwise(F.col("ink")))


def quad_baseline(corners: DataFrame) -> DataFrame:
    """Mean corner points of a device's frames, cut to integers: device_id, quad array<struct(x, y)> in order of corners."""
    points = corners.select("device_id", F.posexplode("quad").alias("corner", "p")).groupBy("device_id", "corner").agg(F.avg("p.x").cast("int").alias("x"), F.avg("p.y").cast("int").alias("y"))
    return points.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("base"))


def quad_drift(corners: DataFrame, baseline: DataFrame) -> DataFrame:
    """corners with drift: the farthest that a corner is from the device's baseline; null without one."""
    far = F.array_max(F.zip_with("quad", "base", lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))))
    return corners.join(baseline, "device_id", "left").withColumn("drift", F.when(F.col("base").isNotNull(), far)).drop("base")
