"""Display text and small pure functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column, currency: Column) -> Column:
    return F.concat(F.when(currency == "INR", F.lit("₹")).otherwise(F.concat(currency, F.lit(" "))), F.format_number(value, 2))


def trimmed_number(value: Column) -> Column:
    """Two decimals with thousands, without trailing zeros: "100.00" is "100", "1,234.50" is "1,234.5"."""
    return F.regexp_replace(F.regexp_replace(F.format_number(value, 2), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def age(seconds: Column) -> Column:
    """Humanised: under 90 s, under 90 min, under 2 days, else days."""
    whole = lambda n: F.round(seconds / n, 0).cast("bigint").cast("string")
    return (
        F.when(seconds.isNull(), "never")
        .when(seconds < 90, F.concat(seconds.cast("bigint").cast("string"), F.lit("s ago")))
        .when(seconds < 5400, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 172_800, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86_400), F.lit("d ago")))
    )


def phase_line(r: Column, y: Column, b: Column) -> Column:
    """"R 230 · Y 231 · B 229" of the phases there are, or a dash."""
    parts = F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{n} "), F.round(v, 0).cast("bigint").cast("string"))) for n, v in (("R", r), ("Y", y), ("B", b))))
    line = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")
    return F.when(line == "", "—").otherwise(line)


def fold_flip(value: Column, reference: Column, scale: int = 1) -> Column:
    """A value with whole hundreds taken off or added so that it is nearest to the reference; ties to even.

    value and reference in units of 1/scale; integers stay integers."""
    k = F.bround((value - reference) / F.lit(100 * scale), 0)
    return (value - k * (100 * scale)).cast("bigint") if scale > 1 else F.round(value - k * 100, 3)


def page_numbers(page: Column, pages: Column) -> Column:
    """Distinct page numbers to show: the first two, those around the page, the last two."""
    wanted = F.array(F.lit(1), F.lit(2), page - 2, page - 1, page, page + 1, page + 2, pages - 1, pages)
    return F.array_sort(F.array_distinct(F.filter(wanted, lambda p: p.between(1, pages))))


def state_json(pending: Column) -> Column:
    """Pending suspects as JSON: map "metric\\tphase" -> [value, iso time]. pending: array<struct(metric, phase, value, at)>."""
    entries = F.transform(
        pending,
        lambda p: F.struct(
            F.concat(p["metric"], F.lit("\t"), F.coalesce(p["phase"], F.lit(""))).alias("key"),
            F.array(p["value"].cast("string"), F.date_format(p["at"], "yyyy-MM-dd'T'HH:mm:ss")).alias("value"),
        ),
    )
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def state_from_json(text: Column) -> Column:
    """The inverse of state_json."""
    entries = F.map_entries(F.from_json(text, "map<string,array<string>>"))
    return F.transform(
        entries,
        lambda e: F.struct(
            F.split_part(e["key"], F.lit("\t"), F.lit(1)).alias("metric"),
            F.nullif(F.split_part(e["key"], F.lit("\t"), F.lit(2)), F.lit("")).alias("phase"),
            e["value"][0].cast("bigint").alias("value"),
            e["value"][1].cast("timestamp_ntz").alias("at"),
        ),
    )
