"""The guard on a stream: the batch fold's rules, with a device's state kept between micro-batches.

State is typed: the last accepted and the pending value of each register are maps, the last row seen is a value. It
lives in RocksDB, can begin from what a batch leaves (guard.state_after), and that of dead devices expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridledger.operators.guard import State, judge

OUTPUT = "device_id bigint, id bigint, captured_at timestamp_ntz, metric string, phase string, cents bigint, outcome string"
#: The state store that typed state needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ("device_id", "id", "captured_at", "metric", "phase", "cents")


def use_typed_state(spark: SparkSession) -> None:
    """Streams that start in this session from now on keep their state in RocksDB."""
    spark.conf.set(*PROVIDER)


def step(state: State, rows: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one device's new rows, in any order; rows at or before the last one seen are late."""
    rows = rows.sort_values(["captured_at", "id"], kind="stable").reset_index(drop=True)
    micros = rows["captured_at"].astype("datetime64[us]").astype("int64")
    out: list[str | None] = []
    for metric, phase, v, moment, i in zip(rows["metric"], rows["phase"], rows["cents"], micros, rows["id"], strict=True):
        mark = (int(moment), int(i))
        if state.mark is not None and mark <= state.mark:
            out.append("late")
            continue
        state.mark = mark
        out.append(None if pd.isna(v) or metric is None else judge(state, metric, None if pd.isna(phase) else phase, int(v), mark[0] // 1_000_000))
    return rows.assign(outcome=out)


class Guard(StatefulProcessor):
    """One device's guard. A batch reads its few registers once and writes those that changed."""

    def __init__(self, keep_days: int | None):
        self.ttl = None if keep_days is None else keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        register, value = "metric string, phase string", "cents bigint, second bigint"
        self.maps = {name: handle.getMapState(name, register, value, self.ttl) for name in ("last", "pending")}
        self.mark = handle.getValueState("mark", "moment bigint, id bigint", self.ttl)

    def _held(self) -> State:
        maps = {name: {tuple(k): tuple(v) for k, v in kept.iterator()} for name, kept in self.maps.items()}
        return State(**maps, mark=tuple(mark) if (mark := self.mark.get()) else None)

    def _keep(self, before: State, now: State) -> None:
        for name, kept in self.maps.items():
            old, new = getattr(before, name), getattr(now, name)
            for key in old.keys() - new.keys():
                kept.removeKey(key)
            for key, value in new.items():
                if old.get(key) != value:
                    kept.updateValue(key, value)
        if now.mark is not None and now.mark != before.mark:
            self.mark.update(now.mark)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        now = State(dict(before.last), dict(before.pending), before.mark)
        out = step(now, pd.concat(list(rows)))
        self._keep(before, now)
        yield out[[*COLUMNS, "outcome"]]

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timerValues) -> None:
        """initial: rows of guard.state_after. The latest of them is the last row seen, so older ones are late."""
        state = State()
        for r in initial.itertuples(index=False):
            moment = pd.Timestamp(r.captured_at).value // 1_000
            register, value = (r.metric, None if pd.isna(r.phase) else r.phase), (int(r.cents), moment // 1_000_000)
            (state.pending if r.pending else state.last)[register] = value
            state.mark = max(state.mark or (moment, int(r.id)), (moment, int(r.id)))
        self._keep(State(), state)

    def close(self) -> None:
        pass


def guard_stream(claims: DataFrame, initial: DataFrame | None = None, keep_days: int | None = None) -> DataFrame:
    """A stream of claims (as for the batch guard) with outcomes; one more outcome, late, for rows out of order.

    State is keyed by device, since sibling registers look at each other. A micro-batch brings a device's new rows
    only, so what a task holds follows the trigger, not the history. initial: a batch's state_after, taken over with
    the first micro-batch, so that a history in a table and its stream are one pass. keep_days: the state of a register
    that hasn't changed for so long is dropped, as if the device were new; such a stream looks at the clock without
    data, too, so it is for a trigger by time: one on all data at hand (availableNow) never ends."""
    use_typed_state(claims.sparkSession)
    seeds = None
    if initial is not None:
        seeds = initial.select(*COLUMNS, "pending").groupBy("device_id")
    return claims.select(*COLUMNS).groupBy("device_id").transformWithStateInPandas(Guard(keep_days), OUTPUT, "append", "None" if keep_days is None else "ProcessingTime", seeds)
