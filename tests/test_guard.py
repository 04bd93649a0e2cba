"""The guard's scenarios, its invariants, and batch against stream."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.operators import guard
from gridledger.operators.guard import State, judge
from gridledger.streaming import guard_stream

IP, EP = "ip_cu_fd", "ep_cu_fd"


L = 400_000  # a last value, in hundredths, accepted at second 0


@pytest.mark.parametrize(
    ("v", "at", "want"),
    [
        (L, 50, "dup"),
        (L - guard.BACK, 50, "store"), (L - guard.BACK - 1, 50, "back"),
        (L + (900 + guard.BASE) // 3, 900, "store"), (L + (900 + guard.BASE) // 3 + 1, 900, "pending"),
        (L + (guard.CAP + guard.BASE) // 3, 9 * guard.CAP, "store"), (L + (guard.CAP + guard.BASE) // 3 + 1, 9 * guard.CAP, "pending"),
        *((L + k - guard.BACK, 60, "digit") for k in guard.FLIPS), *((L + k - guard.BACK - 1, 60, "pending") for k in guard.FLIPS),
        *((L + k + (60 + guard.BASE) // 3, 60, "digit") for k in guard.FLIPS), *((L + k + (60 + guard.BASE) // 3 + 1, 60, "pending") for k in guard.FLIPS),
        (L + 2_000, 60, "digit"), (L + 2_001, 60, "pending"), (L + 2_000, 6_000, "digit"),
    ],
)
def test_each_rule_at_its_boundary(v, at, want):
    state = State({(EP, None): (L, 0)})
    assert judge(state, EP, None, v, at) == want
    assert ((EP, None) in state.pending) == (want == "pending") and state.last[EP, None] == ((v, at) if want == "store" else (L, 0))


@pytest.mark.parametrize(("off", "later", "want"), [(guard.CONFIRM, 0, "store"), (guard.CONFIRM + 1, 0, "pending"), (guard.CONFIRM + 20, 60, "store"), (guard.CONFIRM + 21, 60, "pending"), (-guard.CONFIRM, 0, "store")])
def test_a_jump_is_confirmed_by_one_near_it(off, later, want):
    state = State({(EP, None): (L, 0)})
    assert judge(state, EP, None, L + 7_777, 60) == "pending"
    assert judge(state, EP, None, L + 7_777 + off, 60 + later) == want
    assert ((EP, None) in state.pending) == (want == "pending")


@pytest.mark.parametrize(("near", "own", "want"), [(guard.SIBLING, None, "label"), (guard.SIBLING + 1, None, "store"), (-guard.SIBLING, 5_000, "label"), (0, guard.SIBLING + 1, "label"), (guard.SIBLING, 0, "dup")])
def test_a_value_near_the_sibling_and_not_near_its_own(near, own, want):
    """own: how far this register's last value is from the read one; none: it has none yet."""
    v = L + near
    state = State({(IP, None): (L, 0)} | ({} if own is None else {(EP, None): (v - own, 0)}))
    before = dict(state.last)
    assert judge(state, EP, None, v, 10) == want
    assert state.last == before | ({(EP, None): (v, 10)} if want == "store" else {})


def test_repeats_clear_a_suspect_and_instants_are_never_held():
    state = State({(IP, None): (L, 0)}, {(IP, None): (L + 9_999, 5)})
    assert judge(state, IP, None, L, 10) == "dup" and not state.pending
    assert [judge(state, "voltage", "R", v, 11) for v in (23_000, 99_000, 99_000, 1)] == ["store", "store", "dup", "store"]


@pytest.mark.parametrize("seed", range(5))
def test_an_incident_never_poisons_the_register(seed):
    """Two hours of a rising register; a third of the frames read a hundred too much, and some come twice."""
    rng = random.Random(seed)
    rows, true = [], 41_230
    for minute in range(0, 120, 6):
        true += rng.randrange(8, 30)
        read = true + (10_000 if rng.random() < 0.35 else 0)
        rows += [(EP, read / 100, minute)] * rng.choice((1, 1, 2))
    state = State({(EP, None): (41_200, -300)})
    got = [judge(state, m, None, round(v * 100), at * 60) for m, v, at in rows]
    stored = [v for (_, v, _), outcome in zip(rows, got, strict=True) if outcome == "store"]
    assert stored == sorted(stored) and max(stored) < 420
    assert "digit" in got and "back" not in got
    assert state.last[EP, None][0] == round(stored[-1] * 100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([IP, EP, "voltage"]), st.integers(1, 200_000), st.integers(0, 50_000)), max_size=40))
def test_accepted_registers_hardly_fall(rows):
    state, stored = State(), {}
    for metric, v, at in sorted(rows, key=lambda r: r[2]):
        outcome = judge(state, metric, None, v, at)
        assert outcome in guard.OUTCOMES
        if outcome == "store":
            if metric != "voltage" and metric in stored:
                assert v >= stored[metric] - guard.BACK
            stored[metric] = v


def _rows(n: int) -> list[tuple]:
    start, out = dt.datetime(2026, 6, 15, 1), []
    for i in range(n):
        device = i % 3
        metric = (IP, EP, "voltage")[i // 3 % 3]
        cents = 23_000 + i % 4 if metric == "voltage" else (90_000 if metric == IP else 50_000) + i * 2 + (10_000 if i % 11 == 4 else 0) - (700 if i % 13 == 5 else 0)
        out.append((device, i, start + dt.timedelta(seconds=40 * i), metric, "R" if metric == "voltage" else None, cents))
    return out


SCHEMA = "device_id bigint, id bigint, captured_at timestamp_ntz, metric string, phase string, cents bigint"


def _outcomes(df) -> dict:
    return {r["id"]: r["outcome"] for r in df.collect()}


def test_order_and_partitions_do_not_matter(spark):
    rows = _rows(300)
    want = _outcomes(guard.guard(spark.createDataFrame(rows, SCHEMA)))
    assert len(want) == 300
    assert _outcomes(guard.guard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), 5)) == want


def test_stream_of_batches_is_the_batch(spark, tmp_path):
    rows = _rows(240)
    want = _outcomes(guard.guard(spark.createDataFrame(rows, SCHEMA)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 240, 80):
        spark.createDataFrame(rows[i : i + 80], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = guard_stream.guard_stream(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    assert _outcomes(spark.read.parquet(out)) == want
    # a row from before the mark is late, and changes nothing
    spark.createDataFrame([(0, 900, rows[30][2], IP, None, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query = guard_stream.guard_stream(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert _outcomes(spark.read.parquet(out))[900] == "late"


def test_nulls_and_empty(spark):
    assert guard.guard(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, dt.datetime(2026, 1, 1), IP, None, 100), (1, 2, dt.datetime(2026, 1, 1), IP, None, None), (1, 3, dt.datetime(2026, 1, 2), IP, None, 100)]
    assert _outcomes(guard.guard(spark.createDataFrame(rows, SCHEMA))) == {1: "store", 2: None, 3: "store"}
