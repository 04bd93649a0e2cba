"""Fill-in-the-middle: a text's units are cut at two ranks, and prefix, middle and suffix put in another order.

One Aho-Corasick automaton finds, in a single pass, the ASCII characters at which units change and the sentinels. Of
a text only the places of these events are kept: what lies in the gaps between them is counted by arithmetic, so the
number of units and the place where a unit of some rank ends come from the sparse events alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.shared import table

SENTINELS = ("<P>", "<S>", "<M>")
#: The characters at which units change. line: up to a line feed, with it. word: runs of white space and runs of
#: anything else in turn. char: each code point.
CHANGES = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
SEED, RATE, SPM = 7, 100, 50
_CHANGE, _SENTINEL = 0, 1


@dataclass
class Ranks:
    """Units of one text, from its events: how many, and where the unit of a rank (from 1) ends."""

    unit: str
    length: int
    #: Places of class-changing characters, ascending.
    at: np.ndarray
    #: Units that have ended up to and with each of them.
    ended: np.ndarray
    n: int

    @classmethod
    def of(cls, unit: str, length: int, at: np.ndarray) -> Ranks:
        if unit == "char":
            return cls(unit, length, at, at, length)
        if unit == "line":
            return cls(unit, length, at, np.arange(1, len(at) + 1), len(at) + int(length > (at[-1] + 1 if len(at) else 0)))
        # a gap that holds something is one unit, and ends the run of white space before it
        gaps = np.diff(at, prepend=-1, append=length) - 1
        full = gaps > 0
        ended = np.cumsum(full[:-1]) + np.cumsum(full[1:])
        return cls(unit, length, at, ended, int(ended[-1] if len(at) else 0) + int(full[-1]) + int(len(at) > 0 and not full[-1]))

    def end(self, rank: int) -> int:
        """The code points before the end of that many units."""
        if not rank or self.unit == "char":
            return rank
        if rank == self.n:
            return self.length
        i = int(np.searchsorted(self.ended, rank))
        if self.unit == "line":
            return int(self.at[i]) + 1
        # the i-th white space ends a word before it and, if its run ends there, the run too
        word_first = i and self.at[i] - self.at[i - 1] > 1 or not i and self.at[0] > 0
        before = int(self.ended[i - 1]) if i else 0
        return int(self.at[i]) if word_first and rank == before + 1 else int(self.at[i]) + 1


class Scanner:
    """Finds unit changes and sentinels of texts with one automaton."""

    def __init__(self, unit: str = "line", sentinels: Sequence[str] = SENTINELS):
        if unit not in CHANGES:
            raise ValueError(f"unit is one of {', '.join(CHANGES)}")
        if len(set(sentinels)) < 3 or not all(len(s) > 1 and not any(s.endswith(x) for x in CHANGES[unit]) for s in sentinels):
            raise ValueError("three sentinels are needed, of two characters at least, that don't end where units change")
        self.unit, self.automaton = unit, ahocorasick.Automaton()
        for word, kind in [*((c, _CHANGE) for c in CHANGES[unit]), *((s, _SENTINEL) for s in sentinels)]:
            self.automaton.add_word(word, kind)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[Ranks, bool]:
        """The units of a text, and whether it holds a sentinel."""
        events = np.fromiter((end * 2 + kind for end, kind in self.automaton.iter(text)), np.int64)
        changes = events[events & 1 == _CHANGE] >> 1
        return Ranks.of(self.unit, len(text), changes), len(changes) < len(events)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(text: str, doc_id: int | None, scanner: Scanner, sentinels: Sequence[str], seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars and the text as it is trained on."""
    ranks, marked = scanner.scan(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or marked or h3 % 100 >= rate:
        return ranks.n, "plain", None, None, text
    a, b = sorted(ranks.end(h % (ranks.n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm:
        return ranks.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return ranks.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())


def fill_middle(docs: DataFrame, unit: str = "line", sentinels: Sequence[str] = SENTINELS, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: one row per row of docs.

    rate: of 100 documents so many are rearranged; spm: of 100 of these so many begin with the suffix. The cuts depend
    on the seed and the id alone, so a run again cuts alike, and repeated rows are cut alike; rows with a null id
    share their draws. Null and empty texts, and texts that hold a sentinel, are plain; of any text only the events
    are kept beside it, so very long ones need no more than a few times their size; other columns are not looked at;
    an empty table gives no rows."""
    sentinels = tuple(sentinels)
    Scanner(unit, sentinels)  # bad settings are told at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        for batch in batches:
            ids, texts = (batch.column(c) for c in ("doc_id", "text"))
            rows = [arrange(t.as_py() or "", d.as_py(), scanner, sentinels, seed, rate, spm) for d, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES[1:], strict=True))] if rows else [pa.array([], k) for k in _TYPES], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that fill_middle was given, from its output and form: the sentinels are found from the left, each
    after the one before it. None can lie across the seam of a part and a sentinel, unless one overlaps itself."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    behind, ahead, between = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(ahead, between, behind)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
