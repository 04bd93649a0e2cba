"""Conversation repair against all edit sequences of short conversations, one pass over long ones, and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from gridledger.llm import role_repair as rr
from tests.conftest import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost bigint, chunk bigint"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows: list[tuple[int | None, str, str]]) -> tuple:
    """All edit sequences of a short conversation, with up to three inserts at each place."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults([r[1:] for r in rows])
    inserts = [x for k in range(4) for x in product(("user", "assistant"), repeat=k) if all(a != b for a, b in zip(x, x[1:], strict=False))]
    paths = [(0, "", ())]
    for (_, role, text), fault in zip(rows, found, strict=True):
        more = int(fault == "truncated")
        own = [(3, "D", ())]
        if fault in ("", "truncated"):
            own += [(more, "K", ((role, text),)), *((2 + more, "R", ((r, text),)) for r in ("user", "assistant"))]
        paths = [(c + 2 * len(i) + w, a + "I" * len(i) + lab, (*out, *((r, "") for r in i), *o)) for c, a, out in paths for i in inserts for w, lab, o in own]
        paths = [p for p in paths if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in p[2]))]
    paths = [(c + 2 * len(i), a + "I" * len(i), (*out, *((r, "") for r in i))) for c, a, out in paths for i in inserts]
    cost, audit, out = min((p for p in paths if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in p[2]))), key=lambda p: p[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    heads = [r[1][:1] for r in rows]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), cost, audit, digest


def made(rng: random.Random, n: int) -> list[tuple]:
    roles, texts = ["user", "assistant", "system", "tool", ""], ["a.", "b!", "no stop", "", " \t", "q? ", "　", "é.\n"]
    return [(rng.choice([None, *range(6)]), rng.choice(roles[: rng.choice((2, 3, 5))]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("bounds", [(4096, 1 << 22), (1, 1 << 22), (2, 5)])
def test_short_conversations_against_all_edits(spark, bounds):
    rng = random.Random(4)
    convs = {i: made(rng, rng.randrange(1, 4)) for i in range(60)}
    rows = [(i, *r, 9, 9) for i, c in convs.items() for r in c]
    rng.shuffle(rows)
    got = rr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), most_rows=bounds[0], most_bytes=bounds[1]).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {i: brute(c) for i, c in convs.items()} and len(got) == 60


def one_pass(rows: list[tuple]) -> tuple:
    chunk = rr.Chunk(1)
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        fault = {"blank": rr.BLANK, "truncated": rr.TRUNCATED}.get(faults([(role, text)])[0], rr.FINE)
        chunk.add(turn, role, text, fault, f"{len(role)}:{role}{text}".encode())
    return rr._whole(rr.Composition(), chunk)[1:]


def test_long_conversations_in_chunks_are_one_pass(spark):
    rng = random.Random(8)
    convs = {i: made(rng, n) for i, n in enumerate((700, 90, 1, 333))}
    convs[4] = [(3, "user", "the same.")] * 400
    convs[5] = [(i, ("user", "assistant")[i % 2], f"turn {i // 3}.") for i in range(500)]
    rows = [(i, *r, 9, 9) for i, c in convs.items() for r in c]
    rng.shuffle(rows)
    got = rr.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), most_rows=7, most_bytes=60).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {i: one_pass(c) for i, c in convs.items()}


def test_other_grammars_and_costs():
    """A tool's turn may follow the assistant's; the best of all edit sequences again, by a plain search."""
    grammar = rr.Grammar({(0, "u"): 1, (1, "a"): 2, (2, "t"): 1, (2, "u"): 1}, frozenset((2,)), {"u": "user", "a": "assistant", "t": "tool"})
    machine, rng = rr.Composition(grammar, rr.Costs(keep=0, rerole=1, delete=2, insert=1, truncated=1)), random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("uatx"), rng.choice((rr.FINE, rr.BLANK, rr.TRUNCATED))) for _ in range(rng.randrange(5))]
        best = {(0, 0): (0, "")}
        for at in range(len(rows) + 1):
            for _ in range(4):
                for (i, s), (w, lab) in list(best.items()):
                    for o in "uat":
                        if i == at and (s, o) in grammar.arcs:
                            key = at, grammar.arcs[s, o]
                            best[key] = min(best.get(key, (99, "")), (w + 1, lab + "I"))
            for (i, s), (w, lab) in list(best.items()):
                if i == at < len(rows):
                    for c, x, _, to in machine._edits(s, *rows[at]):
                        best[at + 1, to] = min(best.get((at + 1, to), (99, "")), (w + c, lab + x))
        want = min(v for (i, s), v in best.items() if i == len(rows) and s == 2)
        after, last = machine.ends()
        total, before, choices = machine.backward(rows, after)
        path, state = machine.trace(choices, 0)
        assert (total + before[0][0], "".join(c[0] for c in path) + last[state][0]) == want
    with pytest.raises(ValueError, match="insert"):
        rr.Composition(grammar, rr.Costs(insert=0))


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1, 1), (None, 1, "user", "Hm?", 1, 1), (7, 1, "user", None, 1, 1), (8, 1, None, "Yes.", 1, 1), (9, 5, "user", "x" * 200_000, 1, 1), (9, -5, "system", "Be kind.", 1, 1)]
    got = {r["conv_id"]: r for r in rr.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None]["audit"] == "DD" or got[None]["audit"] == "DKI"
    assert (got[7]["audit"], got[7]["blank"], got[8]["audit"], got[9]["gaps"], got[9]["audit"]) == ("D", 1, "D", 9, "KKI")
    assert rr.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = rr.repair(spark.createDataFrame([(5, 1, "user", "Hm.", False)], "conv_id bigint, turn bigint, role string, text string, there boolean")).collect()
    assert [tuple(r) for r in empty] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}. Is it?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = rr.damaged(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_query_is_its_brute_force(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    convs: dict = {}
    for r in rr.damaged(conversations).collect():
        convs.setdefault(r["conv_id"], []).extend([(r["turn"], r["role"], r["text"])] if r["there"] else [])
    got = rr.op12_role_repair(spark, SF).collect()
    assert len(got) == len(convs)
    short = 0
    for r in got:
        rows = convs[r["conv_id"]]
        assert tuple(r)[1:] == one_pass(rows)
        if len(rows) <= 3:
            short += 1
            assert tuple(r)[1:] == brute(rows)
    assert short > 5


def test_query_is_its_sql(spark, duck):
    got, want = rr.op12_role_repair(spark, SF), duck.sql(rr.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
