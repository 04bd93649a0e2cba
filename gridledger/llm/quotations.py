"""Quotation linking: conversations in reply order, without the quoted text.

A line's quote level is the number of > signs before its text. Lines of one level in a row are a passage. The
normalised passage and its lines are hashed, and so are the paragraphs, lines and whole of what each message says
itself. A quoted hash is joined to the message of its conversation that said it first; a message replies to the
latest of those that it quotes at the lowest level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm.shared import saved, table

_LEVEL = re.compile(r"\s*((?:>[ \t]?)+)")
_WROTE = re.compile(r"^.*\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$")
ROUNDS = 40


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """What a message says itself, and its quoted passages with their levels.

    A line that only says who wrote what is quoted next is dropped with the quote."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        mark = _LEVEL.match(line)
        level = mark[1].count(">") if mark else 0
        if level:
            if not last and own and _WROTE.match(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[mark.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip() if passages else text, [(level, "\n".join(lines)) for level, lines in passages]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def units(text: str) -> set[int]:
    """Hashes of a text's normalised whole, paragraphs and lines; nothing of an empty one."""
    parts = {normal(text), *map(normal, re.split(r"\n\s*\n", text)), *map(normal, text.split("\n"))}
    return {_hash(p) for p in parts if p}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, said, quoted = [], [], []
        for text in batch.column("text"):
            whole = text.as_py()
            own, passages = parse(whole or "")
            texts.append(None if whole is None else own)
            said.append(sorted(units(own)))
            quoted.append([{"level": level, "hash": h} for level, h in sorted({(level, h) for level, p in passages for h in units(p)})])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind)],
            names=["conv_id", "turn", "role", "text", "said", "quoted"],
        )


def _placed(rows: DataFrame) -> DataFrame:
    """position (from 0) in each conversation, by thread and turn, however long a conversation is: a range of the
    order is numbered by itself, and the ranges' counts give where each begins."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("spread", F.xxhash64("role", "text")).repartitionByRange(n, "conv_id", "thread", "turn", "spread").withColumn("range", F.spark_partition_id())
    ranged = saved(ranged, "ranges")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("conv_id", "range").orderBy("thread", "turn", "spread")
    numbered = ranged.withColumn("place", F.row_number().over(within) - 1)
    joined = numbered.alias("a").join(begins.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.range") == F.col("b.range")))
    return joined.select("a.*", (F.col("b.begin") + F.col("place")).cast("long").alias("position"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, depth, thread, position: a row per row of messages.

    reply_to: the turn quoted, null if nothing quoted is found in an earlier turn of the conversation. depth:
    replies from the thread's first message, whose turn is thread. position: place in the conversation, threads in
    the order of their first messages and their messages by turn, so that each comes after the one it answers.
    Rows with a null conv_id or turn link with nothing and are threads of their own. Null texts stay null, empty
    ones empty; repeated rows are kept, and share links. Other columns are not looked at."""
    schema = "conv_id bigint, turn bigint, role string, text string, said array<bigint>, quoted array<struct<level:int,hash:bigint>>"
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    read = saved(rows.mapInArrow(_read, schema), "messages")
    asked = read.filter("size(quoted) > 0 and turn is not null").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash")
    first = read.filter("turn is not null").select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    parents = (
        asked.join(first, ["conv_id", "hash"])
        .filter("original < turn")
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct(-F.col("level"), "original"))["original"].alias("reply_to"))
    )
    # threads: each message points ever further up until all point at a first message
    up = saved(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(ROUNDS):
        over = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        further = up.join(over, ["conv_id", "thread"])
        if further.isEmpty():
            break
        up = saved(
            up.join(over, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads"
        )
    else:
        raise RuntimeError(f"threads deeper than 2^{ROUNDS}")
    all_rows = (
        read.select("conv_id", "turn", "role", "text")
        .join(parents, ["conv_id", "turn"], "left")
        .join(up, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("thread", "turn").alias("thread"))
    )
    return _placed(all_rows).select("conv_id", "turn", "role", "text", "reply_to", "depth", "thread", "position")


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
