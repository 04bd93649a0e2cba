"""Conversation repair by weighted finite-state composition.

A conversation is an acceptor of its rows, the edits are a transducer with weights, and the role grammar is an
acceptor of role initials. They are composed lazily: a state of the composition is a place between rows, the inserts
made there so far and a grammar state; it is expanded only where a path needs it, and steps that look alike are
remembered. Weights are pairs (cost, label string), least first. The composition has no cycle, since more inserts in
a row than the grammar has states are never cheapest, so the shortest path is found in reverse topological order.

Weights before a row depend on what follows it through the grammar state alone. So a conversation of any length is
cut into chunks: each gives a matrix of weights from every state to every state, the matrices of a conversation are
folded from its end, and each chunk then traces its own part of the best path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.shared import saved, table

#: Bounds of a chunk: what a task holds of a conversation at once.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 22
SPACE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials. State 0 is the first."""

    arcs: dict[tuple[int, str], int]
    accepting: frozenset[int]
    #: The roles that rows may be given and that inserted rows have, by initial.
    roles: dict[str, str]

    @property
    def n(self) -> int:
        return 1 + max(s for (a, _), b in self.arcs.items() for s in (a, b))


#: (s?(ua)+)?: nothing, or turns of user and assistant, after one of system or none.
DIALOGUE = Grammar({(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, frozenset((0, 3)), {"u": "user", "a": "assistant"})


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    #: For a truncated row that stays.
    truncated: int = 1


#: What follows a place, by grammar state: (cost, rank of the label string among them), or None where nothing can.
Weights = tuple["tuple[int, int] | None", ...]
#: (labels, initials of the roles that come out, next grammar state): inserts before a row, and its own edit.
Choice = tuple[str, str, int]


@dataclass
class Composition:
    """The lazily composed machine; its remembered steps are few, as costs count from the cheapest state."""

    grammar: Grammar = DIALOGUE
    costs: Costs = field(default_factory=Costs)
    _steps: dict[tuple, tuple[int, Weights, tuple[Choice | None, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.costs.insert <= 0:
            raise ValueError("an insert must cost something, else paths have no end")

    def _edits(self, state: int, initial: str, fault: int) -> Iterator[tuple[int, str, str, int]]:
        """Arcs of the edit transducer over one row, met by the grammar: (cost, label, initial out, next state)."""
        c = self.costs
        yield c.delete, "D", "", state
        if fault in (BLANK, DUPLICATE):
            return
        more = c.truncated if fault == TRUNCATED else 0
        if (state, initial) in self.grammar.arcs:
            yield c.keep + more, "K", initial, self.grammar.arcs[state, initial]
        for out in self.grammar.roles:
            if (state, out) in self.grammar.arcs:
                yield c.rerole + more, "R", out, self.grammar.arcs[state, out]

    def _before(self, state: int, inserts: int, initial: str, fault: int, after: Weights) -> tuple | None:
        """The least (cost, labels, rank after, initials, next state) from a state before a row."""
        best = None
        for cost, label, out, to in self._edits(state, initial, fault):
            if (rest := after[to]) is not None and (best is None or (cost + rest[0], label, rest[1]) < best[:3]):
                best = cost + rest[0], label, rest[1], out, to
        if inserts < self.grammar.n - 1:
            for out in self.grammar.roles:
                if (to := self.grammar.arcs.get((state, out))) is not None and (rest := self._before(to, inserts + 1, initial, fault, after)):
                    found = rest[0] + self.costs.insert, "I" + rest[1], rest[2], out + rest[3], rest[4]
                    if best is None or found[:3] < best[:3]:
                        best = found
        return best

    def step(self, initial: str, fault: int, after: Weights) -> tuple[int, Weights, tuple[Choice | None, ...]]:
        """Weights before a row from those after it: what all have in common, the weights beyond it, and the choices."""
        key = initial, fault, after
        if (known := self._steps.get(key)) is None:
            best = [self._before(s, 0, initial, fault, after) for s in range(self.grammar.n)]
            least = min(b[0] for b in best if b)
            order = sorted({b[1:3] for b in best if b})
            known = least, tuple(b and (b[0] - least, order.index(b[1:3])) for b in best), tuple(b and (b[1], b[3], b[4]) for b in best)
            self._steps[key] = known
        return known

    def ends(self) -> tuple[Weights, list[tuple[str, str] | None]]:
        """Weights after the last row, and the labels and initials of the inserts that reach an accepting state."""
        found: list[tuple[str, str] | None] = [("", "") if s in self.grammar.accepting else None for s in range(self.grammar.n)]
        for _ in range(self.grammar.n):
            for s in range(self.grammar.n):
                for out in self.grammar.roles:
                    to = self.grammar.arcs.get((s, out))
                    if to is not None and found[to] is not None and (found[s] is None or len(found[to][0]) + 1 < len(found[s][0])):
                        found[s] = "I" + found[to][0], out + found[to][1]
        order = sorted({x[0] for x in found if x})
        return tuple(x and (len(x[0]) * self.costs.insert, order.index(x[0])) for x in found), found

    def backward(self, rows: list[tuple[str, int]], after: Weights) -> tuple[int, Weights, list[tuple[Choice | None, ...]]]:
        """Of rows (initial, fault): the cost that all states share, the weights before the first row, and all choices."""
        total, choices = 0, []
        for initial, fault in reversed(rows):
            least, after, chosen = self.step(initial, fault, after)
            total += least
            choices.append(chosen)
        return total, after, choices[::-1]

    def trace(self, choices: list[tuple[Choice | None, ...]], state: int) -> tuple[list[Choice], int]:
        """The best path from a state: a choice for each row, and the state after the last one."""
        path = []
        for chosen in choices:
            path.append(chosen[state])
            state = chosen[state][2]
        return path, state

    def only(self, state: int) -> Weights:
        """Weights of paths that must end in a state."""
        return tuple((0, 0) if s == state else None for s in range(self.grammar.n))

    def matrix(self, rows: list[tuple[str, int]]) -> tuple[list[int | None], list[int | None]]:
        """Costs from each state to each state, and the rank of each label string among those from the same state.

        A path ends with a row's own edit, so of two label strings neither begins with the other."""
        n = self.grammar.n
        costs: list[list[int | None]] = [[None] * n for _ in range(n)]
        labels: list[list[str | None]] = [[None] * n for _ in range(n)]
        for end in range(n):
            total, before, choices = self.backward(rows, self.only(end)) if rows else (0, self.only(end), [])
            for start in range(n):
                if before[start] is not None:
                    costs[start][end] = total + before[start][0]
                    labels[start][end] = "".join(c[0] for c in self.trace(choices, start)[0])
        ranks = [[x if x is None else sorted({y for y in row if y is not None}).index(x) for x in row] for row in labels]
        return sum(costs, []), sum(ranks, [])

    def fold(self, costs: list[int | None], ranks: list[int | None], after: Weights) -> tuple[int, Weights, list[int | None]]:
        """Weights before a chunk from those after it, and the state in which the best path from each state leaves it.

        In a deterministic grammar two label strings from one state that are alike end alike, so their ranks decide."""
        n, least, leave = self.grammar.n, [], []
        for start in range(n):
            ways = [(costs[i] + after[end][0], ranks[i], after[end][1], end) for end in range(n) if costs[i := start * n + end] is not None and after[end] is not None]
            least.append(min(ways, default=None))
            leave.append(least[-1] and least[-1][3])
        common = min(w[0] for w in least if w)
        order = sorted({w[1:3] for w in least if w})
        return common, tuple(w and (w[0] - common, order.index(w[1:3])) for w in least), leave


_FIELDS = ("turn", "role", "text", "fault", "digest")


@dataclass
class Chunk:
    """Rows of one conversation that lie together, in order; names only are those of conversations without rows."""

    conv_id: int | None
    turn: list[int | None] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    fault: list[int] = field(default_factory=list)
    digest: list[bytes] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: int, digest: bytes) -> None:
        if fault != BLANK:
            if digest in self.seen:
                fault = DUPLICATE
            self.seen.add(digest)
        for name, value in zip(_FIELDS, (turn, role, text, fault, digest), strict=True):
            getattr(self, name).append(value)
        self.size += len(role) + len(text)

    def symbols(self) -> list[tuple[str, int]]:
        return [(r[:1], f) for r, f in zip(self.role, self.fault, strict=True)]

    def counted(self) -> dict[str, Any]:
        turns = [t for t in self.turn if t is not None]
        heads = [r[:1] for r in self.role]
        return {
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "head": heads[0] if heads else None, "tail": heads[-1] if heads else None,
            "blank": self.fault.count(BLANK), "duplicate": self.fault.count(DUPLICATE), "truncated": self.fault.count(TRUNCATED), "illegal": sum(a + b not in LEGAL for a, b in pairwise(heads)),
        }

    def repaired(self, path: list[Choice], roles: dict[str, str]) -> tuple[str, list[str]]:
        """The audit, and the rows that are left as role:text."""
        lines = []
        for role, text, (labels, out, _) in zip(self.role, self.text, path, strict=True):
            last = labels[-1]
            lines += [f"{roles[x]}:" for x in (out if last == "D" else out[:-1])]
            if last != "D":
                lines.append(f"{role if last == 'K' else roles[out[-1]]}:{text}")
        return "".join(labels for labels, _, _ in path), lines


#: The pairs of initials that may follow each other.
LEGAL = ("su", "ua", "au")
_COUNTS = "low bigint, high bigint, turns bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_OPEN = "chunk bigint, turn array<bigint>, role array<string>, text array<string>, fault array<int>, digest array<binary>"
_MATRIX = f"conv_id bigint, chunk bigint, costs array<bigint>, ranks array<int>, {_COUNTS}"


class Total:
    """Sums of a conversation's chunks, as they come in order; constant but for the audit, which is a result."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.sums = conv_id, dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.tail = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), False

    def add(self, counted: dict[str, Any], cost: int, audit: str, lines: list[str]) -> None:
        for name in self.sums:
            self.sums[name] += cost if name == "cost" else counted[name]
        if counted["low"] is not None:
            self.sums["turns"] -= int(self.high == counted["low"])
            self.low = counted["low"] if self.low is None else self.low
            self.high = counted["high"]
        if counted["head"] is not None:
            self.sums["illegal"] += int(self.tail is not None and self.tail + counted["head"] not in LEGAL)
            self.tail = counted["tail"]
        self.audit.append(audit)
        for line in lines:
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines = True

    def row(self) -> tuple:
        s = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - s["turns"]
        return self.conv_id, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(self.audit), self.digest.hexdigest()


def _whole(machine: Composition, chunk: Chunk) -> tuple:
    """The result of a conversation that is one chunk."""
    after, last = machine.ends()
    total, before, choices = machine.backward(chunk.symbols(), after)
    path, state = machine.trace(choices, 0)
    audit, lines = chunk.repaired(path, machine.grammar.roles)
    labels, out = last[state]
    done = Total(chunk.conv_id)
    done.add(chunk.counted(), total + before[0][0], audit + labels, [*lines, *(f"{machine.grammar.roles[x]}:" for x in out)])
    return done.row()


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of names and types, arrays among them."""
    kind = lambda t: pa.list_(kind(t[6:-1])) if t.startswith("array<") else _ARROW[t]
    return pa.schema([(name, kind(t)) for name, t in (x.split() for x in ddl.split(", "))])


def _first(grammar: Grammar, costs: Costs, ddl: str, most_rows: int, most_bytes: int):
    """Over sorted rows of a range: results of conversations that lie within it, and chunks of all others.

    The first and the last conversation may go on in other ranges; those beyond a chunk's bounds are cut too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, schema = Composition(grammar, costs), _arrow(ddl)
        out: list[tuple] = []
        chunk: Chunk | None = None
        number, is_open = 0, True
        width = len(RESULT.split(", "))

        def flush() -> None:
            nonlocal number
            out.append((chunk.conv_id, *[None] * (width - 1), (part << 32) + number, *(list(getattr(chunk, n)) for n in _FIELDS)))
            number += 1

        part = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "conv_id", "there", *_FIELDS)), strict=True):
                part, conv_id, there = row[:3]
                if chunk is None or conv_id != chunk.conv_id:
                    if chunk is not None:
                        flush() if is_open else out.append((*_whole(machine, chunk), *[None] * 6))
                        is_open = False
                    chunk = Chunk(conv_id)
                elif len(chunk.turn) >= most_rows or chunk.size >= most_bytes:
                    flush()
                    is_open, chunk = True, Chunk(conv_id)
                if there:
                    chunk.add(*row[3:])
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        if chunk is not None:
            flush()
        yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], k) for k in schema.types], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _rowwise(ddl: str, each) -> Any:
    """A function over batches from one over dictionaries, which may keep state: each(records) yields tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = _arrow(ddl), [], 0
        for row in each(_records(batches)):
            out.append(row)
            held += 64 + sum(len(x) for v in row if isinstance(v, (list, str)) for x in (v if isinstance(v, list) else [v]) if isinstance(x, str))
            if held > CHUNK_BYTES:
                yield _batch(out, schema)
                out, held = [], 0
        yield _batch(out, schema)

    return run


def _chunk_of(row: dict[str, Any]) -> Chunk:
    chunk = Chunk(row["conv_id"], *(row[n] for n in _FIELDS))
    for place in row["again"] or ():
        chunk.fault[place] = DUPLICATE
    return chunk


def _matrices(grammar: Grammar, costs: Costs):
    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        machine = Composition(grammar, costs)
        for row in rows:
            chunk = _chunk_of(row)
            yield chunk.conv_id, row["chunk"], *machine.matrix(chunk.symbols()), *chunk.counted().values()

    return _rowwise(_MATRIX, each)


_LEAVE = "conv_id bigint, chunk bigint, leave array<int>, costs array<bigint>, last boolean"


def _folded(grammar: Grammar, costs: Costs):
    """Over matrices from each conversation's last chunk to its first."""

    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        machine, held = Composition(grammar, costs), ()
        after = machine.ends()[0]
        for row in rows:
            last = (row["conv_id"],) != held
            if last:
                held, after = (row["conv_id"],), machine.ends()[0]
            _, after, leave = machine.fold(row["costs"], row["ranks"], after)
            yield row["conv_id"], row["chunk"], leave, row["costs"], last

    return _rowwise(_LEAVE, each)


_ROUTE = "conv_id bigint, chunk bigint, enter int, leave int, part_cost bigint, last boolean"


def _routed(n: int):
    """Over what _folded gives, from first chunk to last: where the best path enters and leaves each."""

    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        held, state = (), 0
        for row in rows:
            if (row["conv_id"],) != held:
                held, state = (row["conv_id"],), 0
            leave = row["leave"][state]
            yield row["conv_id"], row["chunk"], state, leave, row["costs"][state * n + leave], row["last"]
            state = leave

    return _rowwise(_ROUTE, each)


_PIECE = f"conv_id bigint, chunk bigint, part_cost bigint, audit string, lines array<string>, {_COUNTS}"


def _traced(grammar: Grammar, costs: Costs):
    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        machine = Composition(grammar, costs)
        for row in rows:
            chunk, cost = _chunk_of(row), row["part_cost"]
            choices = machine.backward(chunk.symbols(), machine.only(row["leave"]))[2] if chunk.role else []
            audit, lines = chunk.repaired(machine.trace(choices, row["enter"])[0], grammar.roles)
            if row["last"]:
                labels, out = machine.ends()[1][row["leave"]]
                audit, lines, cost = audit + labels, [*lines, *(f"{grammar.roles[x]}:" for x in out)], cost + costs.insert * len(labels)
            yield chunk.conv_id, row["chunk"], cost, audit, lines, *chunk.counted().values()

    return _rowwise(_PIECE, each)


def _totals():
    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        total = None
        for row in rows:
            if total is None or row["conv_id"] != total.conv_id:
                if total:
                    yield total.row()
                total = Total(row["conv_id"])
            total.add(row, row["part_cost"], row["audit"], row["lines"])
        if total:
            yield total.row()

    return _rowwise(RESULT, each)


def repair(rows: DataFrame, grammar: Grammar = DIALOGUE, costs: Costs | None = None, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    rows: conv_id, turn, role, text, and there, if it has that column: a row without it only names a conversation.
    The order in a conversation is turn (nulls first), role, text. A row's first fault counts: blank (white space
    only), duplicate (role and text seen earlier), truncated (doesn't end in a stop). audit: the initials of the
    cheapest edits (keep, rerole, delete, insert), of equally cheap ones the least in ASCII; repaired_sha256: of the
    rows that are left as role:text, joined by line feeds. Blank and duplicate rows must go. gaps: turns missing
    between the least and the greatest; illegal: neighbouring initials that may not follow each other.

    Null roles and texts are one space; rows of a null conv_id are one conversation; repeated rows are duplicates;
    a conversation of any length, and of any number of equal rows, is cut into chunks of bounded size over many
    tasks, and only its chunks' digests of text are joined in one stream; other columns are not looked at; an empty
    table gives no rows."""
    costs = costs or Costs()
    spark = rows.sparkSession
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), named("role"), named("text"), there.alias("there"))
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may be dealt over ranges too: which of them is where makes no difference
    ranged = plain.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(n, *order, "spread").sortWithinPartitions(*order)
    read = ranged.select(F.spark_partition_id().alias("range"), "conv_id", "there", "turn", "role", "text", fault.alias("fault"), digest.alias("digest"))
    ddl = f"{RESULT}, {_OPEN}"
    first = saved(read.mapInArrow(_first(grammar, costs, ddl, most_rows, most_bytes), ddl), "repaired")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    chunks = first.filter("chunk is not null").select("conv_id", *(c.split()[0] for c in _OPEN.split(", ")))
    # a text that an earlier chunk of the conversation has: a chunk gives each of its texts once
    sides = chunks.select("conv_id", "chunk", F.posexplode(F.arrays_zip("fault", "digest")).alias("place", "x")).filter(~F.col("x.fault").isin(BLANK, DUPLICATE)).select("conv_id", "chunk", "place", "x.digest")
    earliest = sides.groupBy("conv_id", "digest").agg(F.min("chunk").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    same = lambda *names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    again = sides.alias("a").join(earliest.alias("b"), same("conv_id", "digest")).filter("chunk > earliest").groupBy("a.conv_id", "chunk").agg(F.collect_list("place").alias("again"))
    told = saved(chunks.alias("a").join(again.alias("b"), same("conv_id", "chunk"), "left").select("a.*", "b.again"), "chunks")
    matrices = told.mapInArrow(_matrices(grammar, costs), _MATRIX).select("conv_id", "chunk", "costs", "ranks")
    together = matrices.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_folded(grammar, costs), _LEAVE)
    routes = together.sortWithinPartitions("conv_id", "chunk").mapInArrow(_routed(grammar.n), _ROUTE)
    pieces = told.alias("a").join(routes.alias("b"), same("conv_id", "chunk")).select("a.*", "b.enter", "b.leave", "b.part_cost", "b.last").mapInArrow(_traced(grammar, costs), _PIECE)
    whole = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_totals(), RESULT)
    return first.filter("chunk is null").select(*columns).unionByName(whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with one fault in five, by their conv_id and turn: 0 isn't there, 1 has no text, 2 no stops,
    3 comes twice, 4 is the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda j: CAST(ascii(name[j]) AS BIGINT)), lambda crc, byte:
        list_reduce(range(8), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295)) % 20 AS k
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM o, range(2) t(c) WHERE k <> 0 AND (c = 0 OR k = 3)),
e AS (SELECT *, row_number() OVER w AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, role[1] AS c,
      lag(role[1]) OVER w AS p FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM e),
r AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM n),
ins(g, h, w, l, t) AS (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
arc(g, c, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
own AS (SELECT conv_id, i, a.g, a.h, CASE WHEN f = 3 THEN 1 ELSE 0 END AS w, 'K' AS l, [role || ':' || text] AS t FROM r JOIN arc a USING (c) WHERE f IN (0, 3)
    UNION ALL SELECT conv_id, i, a.g, a.h, CASE WHEN f = 3 THEN 3 ELSE 2 END, 'R', [CASE a.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM r JOIN arc a ON a.c IN ('u', 'a') WHERE f IN (0, 3)
    UNION ALL SELECT conv_id, i, g, g, 3, 'D', [] FROM r, range(4) x(g)),
step AS (SELECT conv_id, i, n.g, o.h, n.w + o.w AS w, n.l || o.l AS l, n.t || o.t AS t FROM own o JOIN ins n ON n.h = o.g),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS g, 0 AS w, '' AS l, CAST([] AS VARCHAR[]) AS t FROM o
    UNION ALL SELECT conv_id, i, h, w, l, t FROM (
        SELECT dp.conv_id, s.i, s.h, dp.w + s.w AS w, dp.l || s.l AS l, list_concat(dp.t, s.t) AS t, row_number() OVER (PARTITION BY dp.conv_id, s.h ORDER BY dp.w + s.w, dp.l || s.l) AS best
        FROM dp JOIN step s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1 AND s.g = dp.g) WHERE best = 1),
fin AS (SELECT dp.conv_id, dp.w + n.w AS cost, dp.l || n.l AS audit, list_concat(dp.t, n.t) AS t, row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.w + n.w, dp.l || n.l) AS best
    FROM dp JOIN (SELECT conv_id, max(i) AS i FROM dp GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i JOIN ins n ON n.g = dp.g AND n.h IN (0, 3)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT fin.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(t, chr(10))) AS repaired_sha256
FROM fin LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM fin.conv_id WHERE best = 1
"""
