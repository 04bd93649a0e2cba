"""A history judged in parts has the outcomes of one pass, for all metrics."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from gridledger.operators import guard
from tests.test_guard import EP, SCHEMA, _outcomes, _rows


def test_parts_are_one_pass(spark):
    start = dt.datetime(2026, 6, 15, 1)
    # a jump that the first part holds and the second confirms
    jump = [(9, 1000 + i, start + dt.timedelta(minutes=m), EP, None, v) for i, (m, v) in enumerate([(0, 55_333), (30, 61_000), (150, 61_020), (160, 61_025)])]
    rows = [*_rows(240), *jump]
    claims = spark.createDataFrame(rows, SCHEMA)
    want = _outcomes(guard.guard(claims))
    assert [want[1000 + i] for i in range(4)] == ["store", "pending", "store", "store"]
    got, seeds = {}, None
    for low, high in ((0, 60), (60, 100), (100, 1000)):
        part = claims.filter(claims.captured_at.between(start + dt.timedelta(minutes=low), start + dt.timedelta(minutes=high, seconds=-1)))
        judged = guard.guard(part, seeds=seeds)
        got |= _outcomes(judged)
        seeds = guard.state_after(judged, seeds)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_any_cuts_are_one_pass(spark, seed):
    rng = random.Random(seed)
    claims = spark.createDataFrame(_rows(240), SCHEMA).cache()
    want = _outcomes(guard.guard(claims))
    cuts = [0, *sorted(rng.sample(range(1, 160), 3)), 10_000]
    start, got, seeds = dt.datetime(2026, 6, 15, 1), {}, None
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = claims.filter((claims.captured_at >= start + dt.timedelta(minutes=low)) & (claims.captured_at < start + dt.timedelta(minutes=high)))
        judged = guard.guard(part, seeds=seeds)
        got |= _outcomes(judged)
        seeds = guard.state_after(judged, seeds)
    assert got == want
