"""Interval joins against a plain loop, and joins of stored tables where they lie."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from gridledger.jobs import storage
from gridledger.operators import guard, validity

BASE = dt.date(2000, 1, 1)


def day(n: int) -> dt.date:
    return BASE + dt.timedelta(days=n)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_are_a_plain_loop(spark, how):
    rng = random.Random(9)
    valid = [(rng.randrange(4), day(b), None if rng.random() < 0.1 else day(b + rng.choice((0, 1, 2, 7, 30, 365, 3000))), f"v{i}") for i, b in enumerate(rng.randrange(4000) for _ in range(60))] + [(5, None, None, "x"), (None, day(1), None, "y")]
    rows = [(rng.randrange(5), dt.datetime.combine(day(rng.randrange(-50, 5000)), dt.time(23, 59)), i) for i in range(400)] + [(None, dt.datetime(2001, 1, 1), 400), (1, None, 401)]
    left = spark.createDataFrame(rows, "device_id bigint, at timestamp_ntz, i bigint")
    right = spark.createDataFrame(valid, "device_id bigint, valid_from date, valid_to date, name string")
    found = validity.valid_at(left, right, ["device_id"], "at", how)
    want = []
    for d, at, i in rows:
        hits = [n for k, b, e, n in valid if d is not None and at is not None and k == d and b is not None and b <= at.date() and (e is None or at.date() < e)]
        want += [(i, n) for n in hits] or ([(i, None)] if how == "left" else [])
    assert sorted((r["i"], r["name"] or "") for r in found.collect()) == sorted((i, n or "") for i, n in want)
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    none = validity.valid_at(left, right.limit(0), ["device_id"], "at", how)
    assert none.count() == (len(rows) if how == "left" else 0)


def test_changes_become_intervals(spark):
    changes = spark.createDataFrame([(1, day(0), "a"), (1, day(5), "b"), (1, day(5), "c"), (2, day(3), "d")], "device_id bigint, valid_from date, name string")
    got = sorted(map(tuple, validity.intervals(changes, ["device_id"]).collect()))
    assert got == [(1, day(0), "a", day(5)), (1, day(5), "c", None), (2, day(3), "d", None)]


def test_stored_tables_are_joined_without_an_exchange(spark):
    keys = ["device_id", "src", "metric"]
    raw = spark.range(1000).selectExpr("id % 50 as device_id", "cast(id as string) as src", "if(id % 2 = 0, 'a', 'b') as metric")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, tables = raw.filter("device_id % 3 = 0"), []
        for name, rows in (("raw_claims", raw), ("kept_claims", kept)):
            tables.append(storage.bucketed(rows, name, keys, 4))
        audit = guard.acceptance(*tables)
        plan = audit._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and "SortMergeJoin" in plan  # partial counts alone
        assert sorted(map(str, audit.collect())) == sorted(map(str, guard.acceptance(raw, kept).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("raw_claims", "kept_claims"):
            spark.sql(f"drop table if exists {name}")
