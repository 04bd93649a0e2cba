"""The guard over ranges: equal to one pass at any cut, one hot device and registers that disagree for long included."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from gridledger.operators import guard
from gridledger.operators.guard_ranges import guard_ranges
from tests.test_guard import EP, IP, SCHEMA, _outcomes

START = dt.datetime(2026, 6, 15, 1)


def history(seed: int, n: int, devices: int = 3, hot: float = 0.7, noise: float = 0.2, mixed: float = 0.03, quiet: bool = False, kinds: tuple = (10_000, -10_000, 1_000, 5_000, -700, 100_000, 7_000)) -> list[tuple]:
    """Devices with rising registers and misreads of every kind; the first one has most of the rows."""
    rng, value, out = random.Random(seed), {}, []
    for i in range(n):
        device = 0 if rng.random() < hot else rng.randrange(devices)
        metric = rng.choice((IP, EP, "voltage", "reactive_1"))
        key = device, metric
        value[key] = value.get(key, 50_000 + 40_000 * (metric == IP)) + rng.randrange(0, 30)
        read = value[key]
        if rng.random() < noise and i > 100 * quiet:
            read += rng.choice(kinds)
        cents = 23_000 + rng.randrange(4) if metric == "voltage" else value.get((device, EP if metric == IP else IP), read) if rng.random() < mixed else read
        out.append((device, i, START + dt.timedelta(seconds=20 * i + rng.randrange(15)), metric, rng.choice("RYB") if metric == "voltage" else None, max(1, cents)))
    return out


@pytest.mark.parametrize(("seed", "ranges", "look"), [(1, 7, 512), (2, 23, 5), (3, 30, 2), (4, 1, 512)])
def test_any_cuts_are_one_pass(spark, seed, ranges, look):
    claims = spark.createDataFrame(history(seed, 900), SCHEMA)
    want, report = _outcomes(guard.guard(claims)), []
    assert _outcomes(guard_ranges(claims, ranges=ranges, look=look, report=report)) == want
    assert len(want) == 900 and report[0]["ranges"] <= ranges


def test_a_poisoned_register_is_mended_through_many_ranges(spark):
    """A jump that gets confirmed at the start makes the guard reject all that follows, which no later range can guess."""
    rows = [(0, 0, START, EP, None, 50_000), (0, 1, START + dt.timedelta(seconds=10), EP, None, 157_333), (0, 2, START + dt.timedelta(seconds=20), EP, None, 157_350)]
    rows += [(0, i, START + dt.timedelta(seconds=30 * i), EP, None, 50_000 + 7 * i) for i in range(3, 400)]
    claims = spark.createDataFrame(rows, SCHEMA)
    want, report = _outcomes(guard.guard(claims)), []
    assert list(want.values()).count("back") > 380
    assert _outcomes(guard_ranges(claims, ranges=12, look=8, report=report)) == want
    assert 1 < len(report) < 5  # the ranges behind are mended together


def test_clean_histories_need_few_rows_anew(spark):
    claims = spark.createDataFrame(history(5, 6000, devices=1, hot=1.0, noise=0.3, mixed=0.0, quiet=True, kinds=(10_000, -10_000, -700)), SCHEMA)
    report: list[dict] = []
    assert _outcomes(guard_ranges(claims, ranges=10, report=report)) == _outcomes(guard.guard(claims))
    assert sum(r["rows"] for r in report) < 900  # ten ranges of 600


def test_seeds(spark):
    rows = history(6, 600)
    claims = spark.createDataFrame(rows, SCHEMA)
    half = START + dt.timedelta(seconds=20 * 300)
    seeds = guard.state_after(guard.guard(claims.filter(claims.captured_at < half)))
    later = claims.filter(claims.captured_at >= half)
    assert _outcomes(guard_ranges(later, seeds=seeds, ranges=9)) == _outcomes(guard.guard(later, seeds=seeds))
    judged = guard_ranges(claims.filter(claims.captured_at < half), ranges=5)
    assert sorted(map(str, guard.state_after(judged).collect())) == sorted(map(str, seeds.collect()))


def test_odd_rows(spark):
    assert guard_ranges(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, START, IP, None, 100), (None, 4, START, IP, None, 100), (1, 2, START, IP, None, None), (1, 3, START, IP, None, 100), (1, 3, START, IP, None, 100), (2, 5, START, None, None, 1)]
    claims = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(guard_ranges(claims, ranges=4)) == key(guard.guard(claims))


def test_a_register_that_stays_poisoned_costs_a_few_passes(spark):
    """The first value is a misread, and later misreads of the same kind keep it up."""
    rows = history(5, 1500, devices=1, hot=1.0, noise=0.3, mixed=0.0, kinds=(10_000, -10_000, -700))
    claims, report = spark.createDataFrame(rows, SCHEMA), []
    assert _outcomes(guard_ranges(claims, ranges=8, report=report)) == _outcomes(guard.guard(claims))
    assert sum(r["rows"] for r in report) < 5 * len(rows)
