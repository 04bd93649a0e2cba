"""Literal cases of tariffs, cycles, consensus, healing, decoding, texts and storage."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from gridledger.functions import tariff, text, timecycle
from gridledger.jobs import monthly, storage
from gridledger.operators import alerts, analytics, bills, decode, quality, registry
from gridledger.sources import adapters
from gridledger.sources.adapters import SEGMENTS
from tests.conftest import SF


@pytest.mark.parametrize(("units", "fixed", "energy", "extra", "total"), [(0, 0, 0, 0, 0), (40, 0, 124, 12, 136), (250, 0, 1110, 111, 1221), (450, 0, 2555, 256, 2811), (-7, 0, 0, 0, 0), (40, 50, 124, 17, 191)])
def test_slab_cost(spark, units, fixed, energy, extra, total):
    row = spark.range(1).select(tariff.slab_cost(F.lit(units), tariff.parse_slabs(F.lit(monthly.SLABS)), F.lit(0), F.lit(fixed), F.lit(10), F.lit(0)).alias("c")).first()["c"]
    assert (row["energy"], row["surcharge"], row["total"]) == (energy, extra, total)


def test_slabs_without_a_rest_are_free_beyond_it(spark):
    slabs = tariff.parse_slabs(F.lit("10:1,junk,20:2"))
    row = spark.range(1).select(tariff.energy_charge(F.lit(100), slabs, F.lit(9)).alias("a"), tariff.energy_charge(F.lit(100), tariff.parse_slabs(F.lit(None).cast("string")), F.lit(9)).alias("b")).first()
    assert (row["a"], row["b"]) == (50, 900)


def test_odd_slabs(spark):
    charge = lambda t: tariff.energy_charge(F.lit(100), tariff.parse_slabs(F.lit(t)), F.lit(3))
    row = spark.range(1).select(*(charge(t).cast("double").alias(f"c{i}") for i, t in enumerate(("abc:5,*:7", "junk", " ", "30kWh:2, *:x", "*:1,5:9")))).first()
    assert tuple(row) == (700, 0, 300, 60, 100)


@pytest.mark.parametrize(("day", "want"), [("2026-03-14", "2026-02-15"), ("2026-03-15", "2026-03-15"), ("2026-01-02", "2025-12-15")])
def test_cycle_start(spark, day, want):
    assert str(spark.range(1).select(timecycle.cycle_start(F.lit(day).cast("date"), F.lit(15)).alias("c")).first()["c"]) == want


def test_names(spark):
    row = spark.range(1).select(timecycle.name_time(F.lit("2026-06-15_051422_eaeceb.jpg")).alias("a"), timecycle.name_time(F.lit("x_2026-06-15_051422_e.jpg")).alias("b"), timecycle.mark_time(F.lit("x_2026-06-15_051422_e.jpg")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (dt.datetime(2026, 6, 15, 5, 14, 22), None, dt.datetime(2026, 6, 15, 5, 14, 22))


def test_fold(spark):
    rows = spark.createDataFrame([(412.25, 312.5), (312.25, 312.5), (1312.75, 312.5)], "v double, r double").select(text.fold_flip(F.col("v"), F.col("r")).alias("f")).collect()
    assert [r["f"] for r in rows] == [312.25, 312.25, 312.75]




def test_consensus(spark):
    # a register that rises by 0.25; every third frame reads a hundred too much
    values = [31_000 + 25 * i + (10_000 if i % 3 == 1 else 0) for i in range(12)]
    rows = spark.createDataFrame([(1, "ep", v) for v in values], "device_id bigint, metric string, cents bigint")
    got = quality.consensus(rows, ["device_id", "metric"]).first()
    assert (got["frames"], got["misreads"], got["consensus_cents"]) == (12, 4, 31_275)


def test_heal(spark):
    schema = "device_id bigint, at bigint, id bigint, cents bigint, is_raw boolean, is_stored boolean"
    raw = [(1, at, 100 + at, v, True, False) for at, v in ((0, 42_000), (20, 42_050), (40, 42_100), (60, 42_150))]
    stored = [(1, 10, 1, 42_020, False, True), (1, 30, 2, 52_070, False, True), (1, 50, 3, 52_120, False, True)]

    def plan(rows, billed=True):
        audit = quality.audited(spark.createDataFrame(rows, schema), ["device_id"], F.lit(billed))
        return {(r["id"], r["old_cents"], r["new_cents"]) for r in quality.heal_plan(audit, ["device_id"]).collect()}, quality.statuses(audit, ["device_id"]).first()["status"]

    fixes = {(2, 52_070, 42_070), (3, 52_120, 42_120)}
    assert plan([*raw, *stored]) == (fixes, "healed")
    assert plan([*raw, *stored[:1]]) == (set(), "ok")
    assert plan([*raw, *stored], billed=False) == (set(), "poison_high")
    assert plan([*raw, stored[0], (1, 50, 3, 47_000, False, True)]) == (set(), "poison_high")  # not a whole hundred over the trend
    # too few frames agree, and what was stored before the first frame doesn't count
    assert plan([*raw[:2], *((1, 90 + i, 500 + i, 42_000 + 3_000 * i, True, False) for i in range(1, 9)), *stored])[0] == set()
    assert plan([*raw, (1, -5, 9, 52_000, False, True), *stored[1:]])[0] == fixes


def test_trend_is_linear_work(spark):
    n = 32_000
    points = spark.range(n).selectExpr("1 as device_id", "id * 7 as at", "id * 3 as value", "id as seq")
    probes = spark.range(n).selectExpr("1 as device_id", "id * 7 + 3 as at", "id")
    began = time.perf_counter()
    assert quality.trend(points, probes, ["device_id"]).filter("tau is null").count() == 0
    assert time.perf_counter() - began < 60


def test_trend_ends_and_ties(spark):
    points = spark.createDataFrame([(1, 10, 100, 1), (1, 10, 200, 2), (1, 20, 300, 3), (1, 20, 400, 4)], "device_id bigint, at bigint, value bigint, seq bigint")
    probes = spark.createDataFrame([(1, a, a) for a in (5, 10, 15, 20, 25)], "device_id bigint, at bigint, id bigint")
    assert [r["tau"] for r in quality.trend(points, probes, ["device_id"]).orderBy("at").collect()] == [100, 100, 250, 300, 400]


def test_decode(spark):
    cell = lambda p, ink=0.3: (ink, [0.6 if b == "1" else 0.0 for b in p])
    shown = [cell("0000000", 0.0), cell("1111111"), cell("1110000"), cell("1111110"), cell("1111001"), cell("1111110")]
    rows = spark.createDataFrame([(1, shown), (2, [cell("0000001"), *shown[1:]]), (3, None), (4, [shown[0]] * 4 + shown[1:3])], "id bigint, cells array<struct<ink:double,seg:array<double>>>")
    got = {r["id"]: (r["cents"], r["reason"]) for r in decode.decode(rows).collect()}
    assert got == {1: (87030, "ok"), 2: (None, "decode_fail"), 3: (None, "no_lcd"), 4: (None, "decode_fail")}
    assert [r["x"] for r in spark.createDataFrame([("888888",), ("88",), ("880",)], "r string").select(decode.self_test(F.col("r")).alias("x")).collect()] == [True, True, False]


def test_sweep_is_each_setting_decoded(spark):
    """Against decoding every frame with every setting: random fractions, ties with the grid, nulls, odd cells, a scattered grid."""
    rng = random.Random(4)
    some = lambda: rng.choice([0.0, 0.1, 0.2, 0.3, rng.random(), None, float("nan")])
    good = [(0.3, [0.6 if x == "1" else 0.05 for x in s]) for s in SEGMENTS]
    cell = lambda: rng.choice([(some(), [some() for _ in range(7)]), rng.choice(good), rng.choice(good), (0.01, [0.0] * 7), None, (0.3, None), (0.3, [0.5])])
    frames = [([rng.choice(good) for _ in range(rng.randrange(6))] if k % 2 else [cell() for _ in range(rng.randrange(5))], rng.choice([None, 880, 123, 11])) for k in range(120)] + [(None, 5), ([], 1), ([good[1], good[2], good[3]], 123)] * 2
    features = spark.createDataFrame([(i, *f) for i, f in enumerate(frames)], "id int, cells array<struct<ink double, seg array<double>>>, truth long")
    values = [(0.05, 0.2), (0.3, 0.1), (0.1, 0.3), (0.3, 0.2), (None, 0.2), (0.05, None), (0.0, 0.0), (9.0, 9.0), (-1.0, -1.0), (float("nan"), 0.1), (0.05, float("nan")), (0.05, 0.2)]
    grid = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "setting int, blank double, lit double")
    got = {r["setting"]: (r["n_clean"], r["n_right"], r["n_lead"]) for r in decode.sweep(features, grid).collect()}
    assert len(got) == len(values)
    for i, (blank, lit) in enumerate(values):
        rows = decode.decode(features, F.lit(blank).cast("double"), F.lit(lit).cast("double")).collect()
        bare = [(r, r["raw"].replace(" ", "") if r["raw"] is not None else None, str(r["truth"]) if r["truth"] is not None else None) for r in rows]
        clean = sum(r["raw"] is not None and r["n_digits"] >= 3 and r["unknown"] == 0 for r, _, _ in bare)
        right = sum(r["cents"] is not None and r["cents"] == r["truth"] for r, _, _ in bare)
        lead = sum(t is not None and w is not None and len(t) == len(w) and t[:1] == w[:1] for _, t, w in bare)
        assert got[i] == (clean, right, lead), values[i]
    assert max(c for c, _, _ in got.values()) > 10
    assert [tuple(r) for r in decode.sweep(features.limit(0), grid.limit(1)).collect()] == [(0, 0.05, 0.2, 0, 0, 0)]
    assert decode.sweep(features, grid.limit(0)).count() == 0
    with pytest.raises(ValueError):
        decode.sweep(features, spark.range(decode.MOST_VALUES + 1).selectExpr("cast(id as int) as setting", "cast(id as double) as blank", "0.1D as lit"))


def test_sweep_joins_no_frame_with_the_grid(spark):
    """No nested loop, and as many readings for a hundred settings between the same places as for one."""
    frames = adapters.features(spark, SF)
    grid = spark.range(100).selectExpr("cast(id as int) as setting", "0.06D + id * 0.001D as blank", "0.2D + id * 0.001D as lit")
    many = decode.sweep(frames, grid)
    assert "NestedLoop" not in many._jdf.queryExecution().toString() and "Cartesian" not in many._jdf.queryExecution().toString()
    one = decode.sweep(frames, grid.limit(1)).first()
    assert {tuple(r)[3:] for r in many.collect()} == {tuple(one)[3:]}


def test_quad_drift(spark):
    quads = "device_id bigint, quad array<struct<x:double,y:double>>"
    base = decode.quad_baseline(spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.9)]), (1, [(1.0, 0.0), (11.0, 0.9)])], quads))
    rows = decode.quad_drift(spark.createDataFrame([(1, [(0.0, 3.0), (10.0, 4.0)]), (2, [(0.0, 0.0), (0.0, 0.0)])], quads), base)
    assert [r["drift"] for r in rows.orderBy("device_id").collect()] == [4.0, None]


def test_texts(spark):
    ages = spark.createDataFrame([(0, 89), (1, 90), (2, 5400), (3, 172800), (4, None)], "i int, s bigint").orderBy("i").select(text.age(F.col("s")).alias("a")).collect()
    assert [r["a"] for r in ages] == ["89s ago", "2m ago", "2h ago", "2d ago", "never"]
    row = spark.range(1).select(text.trimmed_number(F.lit(100.0)).alias("a"), text.trimmed_number(F.lit(1234.5)).alias("b"), text.phase_line(F.lit(230.2), F.lit(None).cast("double"), F.lit(229.0)).alias("c"), text.phase_line(*[F.lit(None).cast("double")] * 3).alias("d")).first()
    assert tuple(row) == ("100", "1,234.5", "R 230 · B 229", "—")


def test_minus_and_tariff_flags(spark):
    row = spark.range(1).select(
        registry.minus_seen(F.lit(0.1), F.lit(0.3), F.lit(0.1)).alias("a"), registry.minus_seen(F.lit(0.2), F.lit(0.3), F.lit(0.1)).alias("b"), tariff.has_tariff(F.lit(" "), F.lit(0)).alias("c"), tariff.has_tariff(F.lit(None).cast("string"), F.lit(2)).alias("d"),
        alerts.liveness(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2026-01-01 00:04:00").cast("timestamp_ntz")).alias("e"),
    ).first()
    assert tuple(row)[:4] == (True, False, False, True)
    assert tuple(row["e"]) == (4, True)


def test_blank_fields_keep_what_is_there(spark):
    old = spark.createDataFrame([(1, 5, 6)], "k int, a int, b int")
    new = spark.createDataFrame([(1, 7, None, 1), (1, None, None, 2), (2, None, 9, 1)], "k int, a int, b int, v int")
    assert {tuple(r) for r in bills.upsert(old, new, ["k"], ["a", "b"], "v").collect()} == {(1, 7, 6), (2, None, 9)}


def test_heal_rewrites_only_touched_dates(spark, tmp_path):
    path = str(tmp_path / "readings")
    rows = spark.createDataFrame([(1, "ep", i, dt.datetime(2026, 1, 1 + i % 3), 100 * i) for i in range(9)], "device_id bigint, metric string, id bigint, captured_at timestamp_ntz, cents bigint")
    storage.append_by_date(rows, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "readings").rglob("*.parquet")}
    storage.heal(path, spark.createDataFrame([(1, "ep", 4, 7, dt.date(2026, 1, 2))], "device_id bigint, metric string, id bigint, new_cents bigint, dt date"), spark)
    assert {(r["id"], r["cents"]) for r in spark.read.parquet(path).collect()} == {(i, 7 if i == 4 else 100 * i) for i in range(9)}
    assert {p.parent.name for p in before if p.exists()} == {"dt=2026-01-01", "dt=2026-01-03"}


def test_pages_are_clamped(spark):
    frames = spark.createDataFrame([(1, f"f{i:03}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)) for i in range(100)], "device_id bigint, src string, captured_at timestamp_ntz")
    assert analytics.pages(frames, 9).count() == 4
    assert sorted(r["src"] for r in analytics.pages(frames, 0, 2).collect()) == ["f098", "f099"]


def test_listing_after_a_mark(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in storage.listed(spark, str(tmp_path), "a.jpg").collect()] == ["b.jpg"]
    assert [r["name"] for r in storage.listed(spark, str(tmp_path), first=1).collect()] == ["a.jpg"]


def test_frames_are_taken_in_once(spark, tmp_path):
    source = tmp_path / "frames"
    source.mkdir()

    def run(checkpoint: str, out: str = str(tmp_path / "out")) -> int:
        stream = storage.listed_stream(spark, str(source), 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / checkpoint))
        stream.trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    counts = []
    for names in (("a.jpg", "b.jpg", "c.jpg"), ("d.jpg",), ()):
        for name in names:
            (source / name).write_bytes(b"x")
        counts.append(run("mark"))
    assert [*counts, run("reset", str(tmp_path / "again"))] == [3, 4, 4, 4]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "device_id bigint, metric string, cents bigint")
    assert quality.consensus(empty, ["device_id", "metric"]).count() == 0
    assert bills.savings_rollup(spark.createDataFrame([], "device_id bigint, cycle_start date, import_cents bigint, export_cents bigint, net_cents bigint, without decimal(20,2), with_export decimal(20,2), saved decimal(20,2)")).count() == 0
