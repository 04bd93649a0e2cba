"""Typed state of the streaming guard: restarts, a start from a batch's state, and state that expires."""

from __future__ import annotations

import datetime as dt

import pytest

from gridledger.operators import guard
from gridledger.streaming import guard_stream
from tests.test_guard import EP, SCHEMA, _outcomes, _rows
from tests.test_guard_ranges import START, history


def run(spark, folder, rows, batches: list[list[tuple]], **kept) -> dict:
    """Each batch is written, and the stream is started anew from its checkpoint."""
    source, out, point = (str(folder / x) for x in ("in", "out", "point"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = guard_stream.guard_stream(spark.readStream.schema(SCHEMA).parquet(source), **kept)
        stream.writeStream.format("parquet").option("checkpointLocation", point).trigger(**({"once": True} if "keep_days" in kept else {"availableNow": True})).start(out).awaitTermination()
    return _outcomes(spark.read.parquet(out))


@pytest.mark.parametrize("parts", [1, 4])
def test_restarts_are_one_pass(spark, tmp_path, parts):
    rows = sorted(history(3, 400), key=lambda r: (r[2], r[1]))
    want = _outcomes(guard.guard(spark.createDataFrame(rows, SCHEMA)))
    n = len(rows) // parts
    assert run(spark, tmp_path, rows, [rows[i : i + n] for i in range(0, len(rows), n)]) == want


def test_a_stream_goes_on_where_a_batch_ended(spark, tmp_path):
    rows = [*_rows(200), *[(9, 1000 + i, START + dt.timedelta(minutes=m), EP, None, v) for i, (m, v) in enumerate([(0, 55_333), (30, 61_000), (70, 61_020), (80, 61_025)])]]
    claims = spark.createDataFrame(rows, SCHEMA).cache()
    want = _outcomes(guard.guard(claims))
    cut = START + dt.timedelta(minutes=60)
    seeds = guard.state_after(guard.guard(claims.filter(claims.captured_at < cut)))
    assert seeds.filter("pending").count() >= 1
    later = [r for r in rows if r[2] >= cut]
    got = run(spark, tmp_path, rows, [later, [(0, 5000, START, EP, None, 1)]], initial=seeds)
    assert got.pop(5000) == "late"
    assert got == {i: o for i, o in want.items() if i in {r[1] for r in later}}


def test_dead_devices_are_forgotten(spark, tmp_path):
    """With a life of no days, a register is new in every micro-batch: a jump is stored, not held."""
    first, jump = [(1, 1, START, EP, None, 50_000)], [(1, 2, START + dt.timedelta(minutes=1), EP, None, 58_123)]
    assert run(spark, tmp_path / "kept", [], [first, jump]) == {1: "store", 2: "pending"}
    guard_ttl = guard_stream.Guard(None)
    assert guard_ttl.ttl is None and guard_stream.Guard(2).ttl == 172_800_000
    assert run(spark, tmp_path / "days", [], [first, jump], keep_days=30) == {1: "store", 2: "pending"}
