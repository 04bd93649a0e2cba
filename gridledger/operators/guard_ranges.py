"""The guard over a history in parallel: ranges of a device's rows are judged from guessed states, then mended.

Rows are dealt over ranges of (device, time), so a device with a third of all rows has many tasks. Only the first device
of a range can have begun in an earlier one; its rows are judged from a guess, values near the medians of its first ones. What
the range before really leaves is then known, and the guess is mended: rows are judged from both states side by side
until these agree, which a stored value soon brings about. What follows stays as it is. Only where they never agree, as
with a register that stands too high and rejects all that comes, does a range leave another state than was thought.
Then the ranges behind it are mended in one more round, on the supposition that the register stays as it is through all
of them; where that is wrong, another round follows. Each round settles one range more at least, and a
range is supposed upon twice at most, so rounds end, no range is judged more than a few times, and all outcomes are those
of one pass. Registers that a misread keeps poisoned for very long are thus judged range after range, as by one task.

The driver sees a few states for each range, never rows; their number is the number of partitions.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median_low
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.jobs import storage
from gridledger.operators.guard import BACK, BASE, CUMULATIVE, FROZEN, SIBLINGS, State, _seconds, judge

#: Values of a register that its guess is taken from, and rows that a mend looks at before it takes the whole range.
GUESSED, LOOK = 9, 512
#: Times that a range is judged from a state that is only supposed.
TRIES = 2
_COLUMNS = ("device_id", "id", "captured_at", "metric", "phase", "cents", "seed", "held")
_JUDGED = "device_id bigint, id bigint, captured_at timestamp_ntz, metric string, phase string, cents bigint, seed boolean, held boolean, outcome string"
_TOLD = _JUDGED + ", range int, place bigint, open boolean, told string"


def packed(state: State) -> dict[str, list]:
    """A state as lists, for JSON."""
    return {name: [[*k, *v] for k, v in getattr(state, name).items()] for name in ("last", "pending")}


def unpacked(lists: dict[str, list]) -> State:
    return State(*({(m, p): (v, at) for m, p, v, at in lists[name]} for name in ("last", "pending")))


@dataclass
class Row:
    metric: str | None
    phase: str | None
    cents: int | None
    second: int
    seed: bool
    held: bool

    @property
    def key(self) -> tuple[str | None, str | None]:
        return self.metric, self.phase


def advance(state: State, row: Row) -> str | None:
    """The outcome of a row, null for one without metric or value; a seed has none and sets the state."""
    if row.seed:
        (state.pending if row.held else state.last)[row.key] = row.cents, row.second
        return None
    return None if row.cents is None or row.metric is None else judge(state, *row.key, row.cents, row.second)


def guess(rows: list[Row]) -> State:
    """What a state may have been before these rows: of each register a little less than the first value near the median
    of its first ones, as much as may be made up at once. A value from later on would make a rise look too small for a
    flipped digit, and two such rises would be taken for the register."""
    values: dict[tuple, list[Row]] = {}
    for row in rows:
        if row.metric in CUMULATIVE and row.cents is not None and len(found := values.setdefault(row.key, [])) < GUESSED:
            found.append(row)
    middle = {key: median_low(r.cents for r in found) for key, found in values.items()}
    first = {key: next(r for r in found if abs(r.cents - middle[key]) <= FROZEN) for key, found in values.items()}
    return State({key: (r.cents - BASE // 3 + BACK, values[key][0].second) for key, r in first.items()})


@dataclass
class Span:
    """What a range tells of its first or last device: rows, the registers they touch, the state at the end."""

    device: int | None
    rows: int = 0
    keys: set[tuple] = field(default_factory=set)
    begin: State = field(default_factory=State)
    state: State = field(default_factory=State)

    def take(self, row: Row) -> str | None:
        self.rows += 1
        self.keys.add(row.key)
        return advance(self.state, row)

    def told(self) -> dict[str, Any]:
        return {"device": self.device, "rows": self.rows, "keys": [list(k) for k in self.keys], "begin": packed(self.begin), "end": packed(self.state)}


def _read(batch: pa.RecordBatch) -> list[Row]:
    fields = (batch.column(c).to_pylist() for c in ("metric", "phase", "cents"))
    return [Row(*x) for x in zip(*fields, _seconds(batch.column("captured_at")).tolist(), batch.column("seed").to_pylist(), batch.column("held").to_pylist(), strict=True)]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _COLUMNS), *columns.values()], names=[*_COLUMNS, *columns])


def _notes(rows: list[tuple[int, int, str]], types: list[pa.DataType]) -> pa.RecordBatch:
    """Rows that only tell: (range, place, told)."""
    empty = [pa.nulls(len(rows), t) for t in types]
    columns = {"outcome": pa.nulls(len(rows), pa.string()), "range": pa.array([r[0] for r in rows], pa.int32()), "place": pa.array([r[1] for r in rows], pa.int64()), "open": pa.nulls(len(rows), pa.bool_()), "told": pa.array([r[2] for r in rows], pa.string())}
    return pa.RecordBatch.from_arrays([*empty, *columns.values()], names=[*_COLUMNS, *columns])


_TYPES = [pa.int64(), pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of a sorted range, the first device's from a guess, and at the end what the range tells."""
    first: Span | None = None
    span: Span | None = None
    number = place = 0
    for batch in batches:
        rows, devices = _read(batch), batch.column("device_id").to_pylist()
        number = batch.column("range")[0].as_py() if rows else number
        if first is None and rows:
            begin = guess([r for r, d in zip(rows, devices, strict=True) if d == devices[0]])
            first = span = Span(devices[0], begin=begin, state=copy.deepcopy(begin))
        outcomes, is_open = [], []
        for row, device in zip(rows, devices, strict=True):
            if device != span.device:
                span = Span(device)
            outcomes.append(span.take(row))
            is_open.append(span is first)
        places = pa.array(range(place, place + len(rows)), pa.int64())
        place += len(rows)
        yield _with(batch, outcome=pa.array(outcomes, pa.string()), range=pa.array([number] * len(rows), pa.int32()), place=places, open=pa.array(is_open, pa.bool_()), told=pa.nulls(len(rows), pa.string()))
    if first is not None:
        yield _notes([(number, place, json.dumps({"first": first.told(), "last": span.told(), "one": span is first}))], _TYPES)


@dataclass
class Mend:
    """A range to judge anew: the true state before it, and what it told of its first device."""

    start: dict[str, list]
    told: dict[str, Any]


class Mending:
    """Judges the rows of a range's first device from the true state and from the guess, until the two agree."""

    def __init__(self, mend: Mend):
        self.true, self.other, self.end = unpacked(mend.start), unpacked(mend.told["begin"]), unpacked(mend.told["end"])
        self.keys = {tuple(k) for k in mend.told["keys"]}
        # a register may be looked at beside its sibling, too
        self.looked = self.keys | {(s, phase) for m, phase in self.keys if (s := SIBLINGS.get(m))}
        self.apart = {k for k in self.looked if self._differs(k)}
        self.rows, self.left = 0, mend.told["rows"]

    def _differs(self, key: tuple) -> bool:
        return any(getattr(self.true, n).get(key) != getattr(self.other, n).get(key) for n in ("last", "pending"))

    @property
    def done(self) -> bool:
        return not self.apart or self.rows == self.left

    def take(self, row: Row) -> str | None:
        outcome = advance(self.true, row)
        advance(self.other, row)
        (self.apart.add if self._differs(row.key) else self.apart.discard)(row.key)
        self.rows += 1
        return outcome

    def told(self) -> dict[str, Any]:
        """How many rows were judged anew, whether that is enough, and the state that the range leaves."""
        if self.rows < self.left:
            for name in ("last", "pending"):
                kept, ends = getattr(self.true, name), getattr(self.end, name)
                for key in self.keys:
                    kept.pop(key, None)
                kept.update({k: v for k, v in ends.items() if k in self.keys})
        return {"rows": self.rows, "done": self.done, "end": packed(self.true), "apart": [list(k) for k in self.apart]}


def _mended(mends: dict[int, Mend]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, work = None, None
        for batch in batches:
            ranges, take, outcomes, notes = batch.column("range").to_pylist(), [], [], []
            for i, (at, row) in enumerate(zip(ranges, _read(batch), strict=True)):
                if at != number:
                    if work:
                        notes.append((number, work.rows, json.dumps(work.told())))
                    number, work = at, Mending(mends[at])
                if not work.done:
                    outcomes.append(work.take(row))
                    take.append(i)
            rows = batch.take(pa.array(take, pa.int64()))
            yield _with(rows, outcome=pa.array(outcomes, pa.string()), range=rows.column("range"), place=rows.column("place"), open=rows.column("open"), told=pa.nulls(len(take), pa.string()))
            if notes:
                yield _notes(notes, _TYPES)
        if work:
            yield _notes([(number, work.rows, json.dumps(work.told()))], _TYPES)

    return run


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = storage.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _judge_again(first: DataFrame, mends: dict[int, Mend], look: int) -> tuple[list[tuple[DataFrame, list[int]]], dict[int, dict[str, Any]]]:
    """Tables of rows judged anew, each with the ranges that it is good for, and what each range tells now.

    Most ranges need their first few rows; the others are read whole."""
    tables, told = [], {}
    for limit in (look, None):
        if not (todo := {r: m for r, m in mends.items() if r not in told}):
            break
        rows = first.filter("open").filter(F.col("range").isin(list(todo)))
        rows = rows if limit is None else rows.filter(F.col("place") < limit)
        ordered = rows.repartition(max(1, min(len(todo), int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "range").sortWithinPartitions("range", "place")
        again = _saved(ordered.select(*_COLUMNS, "range", "place", "open").mapInArrow(_mended(todo), _TOLD), "mended")
        found = {r["range"]: json.loads(r["told"]) for r in again.filter("told is not null").select("range", "told").collect()}
        good = {r: t for r, t in found.items() if t["done"]}
        tables.append((again.filter("told is null"), list(good)))
        told |= good
    return tables, told


def guard_ranges(claims: DataFrame, seeds: DataFrame | None = None, ranges: int | None = None, look: int = LOOK, report: list[dict] | None = None) -> DataFrame:
    """claims with outcome, as guard gives them, whatever a device's share of the rows.

    claims and seeds are those of guard. ranges: parts that the rows are dealt over, spark.sql.shuffle.partitions unless
    given; look: rows of a range that are judged anew at first. report, if given, gets a line a round: ranges mended and
    rows judged anew. Null devices are one device; null times come first; an empty table gives no rows."""
    spark = claims.sparkSession
    columns = ["device_id", "id", "captured_at", "metric", "phase", "cents"]
    rows = claims.select(*columns, F.lit(False).alias("seed"), F.lit(False).alias("held"))
    if seeds is not None:
        held = F.coalesce("pending", F.lit(False)) if "pending" in seeds.columns else F.lit(False)
        rows = rows.unionByName(seeds.select(*columns, F.lit(True).alias("seed"), held.alias("held")))
    order = ["device_id", F.desc("seed"), "captured_at", "id"]
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    first = _saved(dealt.withColumn("range", F.spark_partition_id()).mapInArrow(_speculate, _TOLD), "speculated")
    told = {r["range"]: json.loads(r["told"]) for r in first.filter("told is not null").select("range", "told").orderBy("range").collect()}
    ends = {r: t["last"]["end"] for r, t in told.items()}
    nothing = packed(State())

    def start(r: int, before: int | None) -> dict[str, list]:
        return ends[before] if before is not None and told[before]["last"]["device"] == told[r]["first"]["device"] else nothing

    behind = dict(zip(list(told)[1:], told, strict=False))
    tables, judged, used, tries = [], {}, {}, dict.fromkeys(told, 0)

    def due() -> dict[int, Mend]:
        """Ranges that weren't judged from the state that the one before them leaves, or is supposed to leave."""
        found, carried, supposed = {}, {}, False
        for r, t in told.items():
            b = behind.get(r)
            begin = unpacked(start(r, b))
            if b is None or told[b]["last"]["device"] != t["first"]["device"]:
                carried, supposed = {}, False
            _put(begin, carried)
            if r not in used or unpacked(used[r]) != begin:
                if not supposed or tries[r] < TRIES:
                    found[r] = Mend(packed(begin), t["first"])
                    tries[r] += int(supposed)
                supposed = True
            else:
                carried = _taken(unpacked(judged[r]["end"]), judged[r]["apart"])
            carried = carried if t["one"] else {}
        return found

    while todo := due():
        made, found = _judge_again(first, todo, look)
        tables += made
        judged |= found
        used |= {r: m.start for r, m in todo.items()}
        ends |= {r: t["end"] for r, t in found.items() if told[r]["one"]}
        if report is not None:
            report.append({"ranges": len(todo), "rows": sum(t["rows"] for t in found.values())})
    # of a range that was mended more than once the last time counts
    good: dict[int, int] = {r: i for i, (_, ranges_) in enumerate(tables) for r in ranges_}
    anew = spark.createDataFrame([(r, t["rows"]) for r, t in judged.items()], "range int, anew bigint")
    kept = first.filter("told is null").join(F.broadcast(anew), "range", "left").filter(~F.col("open") | (F.col("place") >= F.coalesce("anew", F.lit(0))))
    out = kept.filter("not seed").select(*columns, "outcome")
    for i, (again, _) in enumerate(tables):
        if mine := [r for r, j in good.items() if j == i and judged[r]["rows"]]:
            out = out.unionByName(again.filter(F.col("range").isin(mine) & ~F.col("seed")).select(*columns, "outcome"))
    return out


def _taken(state: State, keys: list[list]) -> dict[tuple, tuple]:
    """What a state holds of some registers: key to (last, pending)."""
    return {tuple(k): (state.last.get(tuple(k)), state.pending.get(tuple(k))) for k in keys}


def _put(state: State, held: dict[tuple, tuple]) -> None:
    for key, values in held.items():
        for kept, value in zip((state.last, state.pending), values, strict=True):
            kept.pop(key, None)
            if value is not None:
                kept[key] = value
