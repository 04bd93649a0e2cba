"""Fill-in-the-middle against regular expressions, an exact round trip and SQL."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gridledger.llm import fill_middle as fim
from tests.conftest import SF

DOCS = "doc_id bigint, text string, n bigint, form string"
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", "char": r"(?s:.)"}
ODD = [
    "", "\n", "a", "\n\n\n", "a\n", "a\nb", " a", "a ", "  ", "é ü\n\n😀 日本\n", "x\r\ny\r\n", "  no line ", "<P> holds one", "<S", "<<P", "a<P\n>b", "<M>", "one\n<S>\n",
    "<", "<<", "S>", "<\n<\n<\n", "long line " * 5000, "\n" * 20_000, "many lines\n" * 9_000, "\x00\n\x00",
]


@pytest.mark.parametrize("unit", UNITS)
def test_ranks_are_the_units_of_a_regular_expression(unit):
    scanner, rng = fim.Scanner(unit), random.Random(5)
    for text in [*ODD, *("".join(rng.choice("ab \n\té<P>") for _ in range(rng.randrange(40))) for _ in range(2000))]:
        units = re.findall(UNITS[unit], text)
        ranks, marked = scanner.scan(text)
        assert marked == any(s in text for s in fim.SENTINELS) and ranks.n == len(units), text
        total = 0
        for rank in range(0, len(units) + 1, max(1, len(units) // 50)):
            total = sum(map(len, units[:rank]))
            assert ranks.end(rank) == total, (text, rank)


def brute(doc_id, text: str, unit: str, sentinels, seed: int, rate: int, spm: int) -> tuple:
    units = re.findall(UNITS[unit], text)
    h = fim.draws(doc_id, seed)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, s, m = sentinels
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(pre), len(mid), p + pre + s + suf + m + mid if form == "psm" else s + suf + p + pre + m + mid


@pytest.mark.parametrize(("unit", "sentinels", "seed", "rate", "spm"), [("line", fim.SENTINELS, 7, 100, 50), ("word", ("<|pre|>", "<|suf|>", "<|mid|>"), 3, 60, 20), ("char", fim.SENTINELS, 1, 90, 100)])
def test_whole_tables(spark, unit, sentinels, seed, rate, spm):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [*((10_000 + i, t) for i, t in enumerate(ODD)), (None, "no\nid"), (20_000, None), (20_001, rows[0][1]), (20_001, rows[0][1])]
    docs = spark.createDataFrame([(d, t, -1, "clash") for d, t in rows], DOCS)
    out = fim.fill_middle(docs, unit, sentinels, seed, rate, spm)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), sentinels)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(d, *brute(d, t or "", unit, sentinels, seed, rate, spm), t or "") for d, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == ({"plain", "spm", "psm"} if spm < 100 else {"plain", "spm"})


def test_empty_table_and_bad_settings(spark):
    assert fim.fill_middle(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fim.Scanner("page")
    with pytest.raises(ValueError, match="sentinels"):
        fim.Scanner("line", ("<P>", "<P>", "<M>"))


def test_query_is_its_sql(spark, duck):
    got = fim.op11_fill_middle(spark, SF)
    want = duck.sql(fim.OP11_SQL)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
