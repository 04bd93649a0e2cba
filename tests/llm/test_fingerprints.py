"""Bottom-k sketches against sets of shingles in plain Python, their estimates against exact figures."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from gridledger.llm import fingerprints as fp
from tests.conftest import SF

DOCS = "doc_id bigint, text string, key string, copies bigint, sketch string"
ODD = ["", " ", "one", "One two", "a b c d", "a b c d e", "a b c d e f", "  a\tb\nc  d e ", "é ü ñ ß 日 本", "x" * 5000, "w " * 3000, "no-space" * 40 + " z", "A B C D E", "😀 a b c d"]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str, size: int = fp.WORDS) -> set[int]:
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]

    def chain(run: list[int]) -> int:
        seed = 42
        for w in run:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", w), seed=seed)
        return signed(seed)

    return {chain(words)} if 0 < len(words) < size else {chain(words[i : i + size]) for i in range(len(words) - size + 1)}


def least(hashes: set[int], k: int = fp.K) -> list[int]:
    return sorted(hashes)[:k]


def alike(a: list[int], b: list[int], k: int = fp.K) -> float:
    union = least({*a, *b}, k)
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def documents(spark) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute(rows: list[tuple]) -> list[tuple]:
    name = lambda r: hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, name(r)))
    out = []
    for i, (d, text) in enumerate(rows):
        text, then = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + then[:q]
        own, other, after = (least(shingles(t)) for t in (text, new, then))
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), *("".join(f"{x % (1 << 64):016X}" for x in s) for s in (own, other)), alike(own, other), alike(own, after)))
    return out


def test_query_is_its_brute_force(spark, tmp_path):
    rows = [*documents(spark), *((10_000 + i, t) for i, t in enumerate(ODD)), (None, "no id at all here"), (None, None), (20_000, None), *[(20_001, "five words that are repeated")] * 4, (20_001, "another of this id")]
    random.Random(3).shuffle(rows)
    spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op13_fingerprints(spark, str(tmp_path)).drop("shingles", "contained")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_planted_likeness(spark):
    got = {r["doc_id"]: r for r in fp.op13_fingerprints(spark, SF).collect()}
    texts = dict(documents(spark))
    long = [d for d, t in texts.items() if len(t.split()) > 100]
    assert len(got) == len(texts) and sum(got[d]["near_edited"] for d in long) / len(long) > 0.5
    same: dict[str, set] = {}
    for d, t in texts.items():
        same.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("rows", [[], [(1, "only one document of a few words here")], [(1, None)], [(1, "same")] * 3])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op13_fingerprints(spark, str(tmp_path)).drop("shingles", "contained")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_parts_merge_to_the_whole_and_estimates_hold(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (3, 40, 700, 4000, 9000)]
    rows = []
    for d, t in enumerate(texts):
        words, i = t.split(), 0
        while True:
            n = rng.randrange(5, 400)
            rows.append((d, " ".join(words[i : i + n])))
            i += n - 4
            if i + 4 >= len(words):
                break
    parts = spark.createDataFrame([*rows, (None, ""), (None, "a b c d e f")], "doc_id bigint, text string").repartition(6).select("doc_id", fp.sketch(F.col("text")).alias("s"))
    got = {r["doc_id"]: r for r in fp.merged(parts, ["doc_id"], "s").select("doc_id", "s", fp.distinct_shingles(F.col("s")).alias("n")).collect()}
    for d, t in enumerate(texts):
        own = shingles(t)
        assert got[d]["s"] == least(own)
        assert got[d]["n"] == pytest.approx(len(own), rel=0 if len(own) < fp.K else 0.25)
    assert got[None]["s"] == least(shingles("a b c d e f"))


def test_resemblance_and_containment(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(4000)]
    cases = [(base, base[:3000]), (base[:2000], base), (base, base[2000:] + [f"v{i}" for i in range(1000)]), (base[:50], base[20:60]), (base[:3], base[:3]), ([], base), ([], []), (base, rng.sample(base, 4000))]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string").select("i", fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    rows = df.select("i", "a", "b", fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.read(fp.written(F.col("a"))).alias("back")).collect()
    for r in rows:
        a, b = (shingles(" ".join(x)) for x in cases[r["i"]])
        assert r["r"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.12)
        assert r["c"] == pytest.approx(len(a & b) / len(a) if a else 1.0, abs=0.15)
        assert r["back"] == r["a"]


def test_main_path_is_native(spark):
    plan = fp.op13_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_texts_are_exchanged_once(spark):
    done = fp.edited(spark.read.parquet(f"{SF}/documents.parquet"))
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and len(re.findall(r"partial_first\(text", plan)) == 1
