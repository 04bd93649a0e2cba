"""Guarded acceptance of claims: one ordered fold per device, the same in batch and in streams.

A claim is judged against the last accepted value of its (metric, phase) and a pending suspect. Everything is in
hundredths and seconds, so tolerances are exact. The order of the rules is fixed: sibling mislabel, repeat, backward,
digit flip, frozen low digits, jump held until it is confirmed, else stored.

A device's history can't be split, for each decision depends on the last accepted row; devices are independent.
The fold reads rows sorted by device and time from a partition and starts anew where the device changes, so a
device with a third of all rows streams through one task in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.operators.registry import REGISTRY

OUTCOMES = ("label", "dup", "back", "digit", "pending", "store")
#: Tolerances in hundredths: sibling, backward, confirmation, frozen digits.
SIBLING, BACK, CONFIRM, FROZEN = 300, 10, 300, 500
#: 12 kW is a hundredth every three seconds; a jump is held over 1 kWh more, and the rate counts for 15,000 s at most.
BASE, CAP = 300, 15_000
FLIPS = (1_000, 10_000, 100_000, 1_000_000)

CUMULATIVE = frozenset(m for _, m, _, kind, *_ in REGISTRY if kind == "cumulative")
SIBLINGS = {m: s for _, m, *_, s in REGISTRY if s}


@dataclass
class State:
    """Of one device: last accepted and pending (value, second) by (metric, phase); the last row seen."""

    last: dict[tuple, tuple[int, int]] = field(default_factory=dict)
    pending: dict[tuple, tuple[int, int]] = field(default_factory=dict)
    mark: tuple[int, str] | None = None


def judge(state: State, metric: str, phase: str | None, v: int, at: int) -> str:
    """The outcome of one claim; the state moves on."""
    key = metric, phase
    last = state.last.get(key)
    sibling = SIBLINGS.get(metric)
    if sibling and (other := state.last.get((sibling, phase))) and abs(v - other[0]) <= SIBLING and (last is None or abs(v - last[0]) > SIBLING):
        return "label"
    if last is not None and v == last[0]:
        state.pending.pop(key, None)
        return "dup"
    if last is not None and metric in CUMULATIVE:
        step, seconds = v - last[0], max(0, at - last[1])
        if step < -BACK:
            return "back"
        if 3 * step > seconds + BASE and any(step - k >= -BACK and 3 * (step - k) <= seconds + BASE for k in FLIPS):
            return "digit"
        if v % 1000 == last[0] % 1000 and abs(step) >= FROZEN:
            return "digit"
        if 3 * step > min(seconds, CAP) + BASE:
            held = state.pending.get(key)
            if held is None or 3 * abs(v - held[0]) > 3 * CONFIRM + max(0, at - held[1]):
                state.pending[key] = v, at
                return "pending"
        state.pending.pop(key, None)
    state.last[key] = v, at
    return "store"


def _seconds(column: pa.Array) -> np.ndarray:
    return np.floor_divide(column.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False), 1_000_000)


def _fold(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, state = None, State()
        for batch in batches:
            at = _seconds(batch.column("captured_at"))
            out = []
            names = ("device_id", "metric", "phase", "cents", "seed", "held")
            for d, metric, phase, v, seed, held, second in zip(*(batch.column(n).to_pylist() for n in names), at.tolist(), strict=True):
                if d != device:
                    device, state = d, State()
                if seed:
                    (state.pending if held else state.last)[metric, phase] = v, second
                    out.append(None)
                    continue
                out.append(None if v is None or metric is None else judge(state, metric, phase, v, second))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "outcome"])

    return run


def guard(claims: DataFrame, partitions: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """claims with outcome: label, dup, back, digit, pending or store.

    claims: device_id, id, captured_at (no zone), metric, phase (null where there is none), cents; other columns
    don't cross the exchange. Order within a device: captured_at, then id. A null metric or value has no outcome.
    seeds: the state from before (state_after), so that a history can be taken in parts: last accepted values, and
    pending suspects in rows whose column pending is true; without that column (last_accepted) there are none."""
    columns = ["device_id", "id", "captured_at", "metric", "phase", "cents"]
    rows = claims.select(*columns, F.lit(False).alias("seed"), F.lit(False).alias("held"))
    if seeds is not None:
        held = F.coalesce("pending", F.lit(False)) if "pending" in seeds.columns else F.lit(False)
        rows = rows.unionByName(seeds.select(*columns, F.lit(True).alias("seed"), held.alias("held")))
    dealt = rows.repartition(partitions, "device_id") if partitions else rows.repartition("device_id")
    ordered = dealt.sortWithinPartitions("device_id", F.desc("seed"), "captured_at", "id")
    judged = ordered.mapInArrow(_fold([*columns, "seed", "held"]), rows.schema.add("outcome", "string"))
    return judged.filter("not seed").drop("seed", "held")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("outcome = 'store'").drop("outcome")


def outcome_counts(judged: DataFrame) -> DataFrame:
    """Claims of each outcome for each device."""
    return judged.groupBy("device_id", "outcome").agg(F.count("*").alias("n"))


def last_accepted(readings: DataFrame) -> DataFrame:
    """The latest reading by insertion (id, not time) of each device, metric and phase: the state a run starts from."""
    return readings.groupBy("device_id", "metric", "phase").agg(F.max_by(F.struct("id", "captured_at", "cents"), "id").alias("s")).select("device_id", "metric", "phase", "s.*")


def state_after(judged: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """What the guard remembers of judged claims and of the seeds they were judged with, as seeds of the next part.

    A suspect is held until a repeat or an accepted value of its register follows."""
    columns = ["device_id", "id", "captured_at", "metric", "phase", "cents", "outcome"]
    rows = judged.select(*columns, F.lit(1).alias("part"))
    if seeds is not None:
        rows = rows.unionByName(seeds.withColumn("outcome", F.expr("if(pending, 'pending', 'store')")).select(*columns, F.lit(0).alias("part")))
    value, order = F.struct("id", "captured_at", "cents"), F.struct("part", "captured_at", "id")
    of = lambda *which: F.when(F.col("outcome").isin(*which), order)
    ends = rows.groupBy("device_id", "metric", "phase").agg(
        F.max_by(value, of("store")).alias("last"), F.max_by(value, of("pending")).alias("held"), F.max(of("pending")).alias("held_at"), F.max(of("store", "dup")).alias("cleared")
    )
    keys = ["device_id", "metric", "phase"]
    last = ends.filter("last is not null").select(*keys, "last.*", F.lit(False).alias("pending"))
    return last.unionByName(ends.filter("held_at is not null and (cleared is null or held_at > cleared)").select(*keys, "held.*", F.lit(True).alias("pending")))


def drops(readings: DataFrame) -> DataFrame:
    """How often a register's accepted series falls, and by how much at most. Falls of up to 0.10 are allowed."""
    before = F.lag("cents").over(Window.partitionBy("device_id", "metric").orderBy("captured_at", "id"))
    steps = readings.withColumn("fall", before - F.col("cents")).filter("fall is not null")
    return steps.groupBy("device_id", "metric").agg(F.count(F.when(F.col("fall") > 0, 1)).alias("falls"), F.coalesce(F.max(F.when(F.col("fall") > 0, F.col("fall"))), F.lit(0)).cast("bigint").alias("deepest"))


def staged(claims: DataFrame) -> DataFrame:
    """Claims that are kept before any judgement: cumulative registers and demands in range (kind, in_range)."""
    return claims.filter(F.col("kind").isin("cumulative", "md") & F.col("in_range"))


def acceptance(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw claims of each device and metric, how many of them became readings, and how many didn't.

    Both sides are joined on device, frame and metric."""
    keys = ["device_id", "src", "metric"]
    joined = raw.select(*keys).join(stored.select(*keys).distinct().withColumn("kept", F.lit(True)), keys, "left")
    return joined.groupBy("device_id", "metric").agg(F.count("*").alias("claims"), F.count("kept").alias("accepted"), F.count(F.when(F.col("kept").isNull(), 1)).alias("rejected"))
