"""Near duplicates, nearest neighbours and components against brute force, and their odd cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from gridledger.llm import near_vectors, neighbours, ngram_join
from gridledger.llm.components import components
from tests.conftest import SF

DOCS = "doc_id bigint, text string"


def shingles(text: str | None) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple]) -> tuple[dict, dict]:
    sets = [(d, shingles(t)) for d, t in rows]
    links, root = defaultdict(int), {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-12:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: links[d] for d in root}, {d: find(d) for d in root}


def corpus(n: int = 150) -> list[tuple]:
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    base = [[word() for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(base[i % 12] if i % 3 else [word() for _ in range(rng.randrange(1, 90))])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    return [*rows, (n, rows[1][1]), (n + 1, rows[1][1].upper()), (n + 2, "two words"), (n + 3, " Two\twords\n"), (n + 4, ""), (n + 5, None), (n + 6, " \n ")]


@pytest.mark.parametrize("block", [768, 8])
def test_ngram_join_is_brute_force(spark, tmp_path, block):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    got = ngram_join.near_duplicates(spark.read.parquet(str(tmp_path / "docs")), block=block).collect()
    links, root = brute(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == links
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    assert {r["doc_id"] for r in got if r["kept"]} == set(root.values())


def test_ngram_join_on_the_test_table(spark):
    from gridledger.llm.shared import table

    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links, root = brute(rows)
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == {d: (links[d], root[d]) for d in root}


def test_ngram_join_odd_rows(spark, tmp_path):
    text = "one two three four five six seven"
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (9, None, 4)]
    spark.createDataFrame(rows, DOCS + ", rid int").write.parquet(str(tmp_path / "docs"))
    got = sorted((r["doc_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect())
    assert got == [(-1, 2, 3, False), (3, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert ngram_join.near_duplicates(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_rows_meet_at_different_depths(spark):
    """Few links tell nothing, so prefixes are shortened until a pair at the threshold is found; each row meets as deep as it can."""
    got = ngram_join.near_duplicates(spark.createDataFrame(corpus(), DOCS), trees=3, recall=0.9).collect()
    depths = [r["depth"] for r in got if r["depth"]]
    assert len(set(depths)) >= 2 and min(depths) >= 2
    assert all((r["depth"] is None) or r["n_links"] for r in got)


def test_prefixes_shorten_until_the_recall():
    far, near = np.zeros(ngram_join.STEPS), np.zeros(ngram_join.STEPS)
    far[0], near[20] = 5000, 5000  # links at 0.8 and at 0.9
    shortened = lambda links: next(k for k in range(6, 0, -1) if ngram_join.missed_share(links, k) <= 1e-4)
    assert (shortened(near), shortened(far), shortened(np.zeros(40))) == (6, 4, 4)
    assert abs(ngram_join.missed_share(far, 6) - (1 - ngram_join.found_share(0.8, 6))) < 1e-9


def test_blocks_are_bounded_in_bytes(spark):
    rows = corpus()
    links, root = brute(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", minima string, depth int"), block_bytes=2000).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == {d: (links[d], root[d]) for d in root}


def test_only_texts_that_meet_are_shuffled(spark, tmp_path):
    """Most texts meet no other: sending all of them to the meetings, once for each length of prefix, is what this forbids."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(3000))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(5)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, was = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        got = ngram_join.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).filter("n_links > 0").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == sorted(x for i in range(5) for x in ((i, 1, i), (200 + i, 1, i)))
    assert written() - before < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [1, 2, 1 << 20])
def test_texts_that_meet_are_all_found(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BITS", most)
    rids = [*range(300), *(i + (5 << 33) for i in range(300)), -1, -64]
    docs = spark.createDataFrame([(r, None if r == 7 else str(r)) for r in rids], "rid bigint, text string")
    wanted = {7, 63, 64, 299, (5 << 33) + 1, -1, -64}
    got = {r["rep"]: r["text"] for r in ngram_join._meeting_texts(docs, spark.createDataFrame([(r,) for r in wanted] * 2, "rep bigint")).collect()}
    assert wanted <= set(got) and got[7] is None and got[-64] == "-64"
    assert most < 3 or set(got) == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (130, 100), (40, 39)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 131)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n: int = 500, width: int = 24) -> list[tuple]:
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, width))
    for i in range(0, n, 5):
        x[i] = x[i % 25] + rng.standard_normal(width) * rng.choice([0.05, 0.2, 0.4])
    x[7] = x[8] * 3
    return [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]


ODD = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] + [1.0] * 23, 0), (1003, [float("inf")] + [1.0] * 23, 0), (1004, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0)]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_are_brute_force(spark, block):
    rows = vectors()
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows + ODD, VECTORS), leaf=60, block=block).collect()}
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    assert {i: got[i]["n_links"] for i in range(len(rows))} == dict(enumerate(near.sum(1) - 1))
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    assert [got[i]["component_id"] for i in range(len(rows))] == root
    assert all(got[i]["kept"] == (root[i] == i) for i in range(len(rows)))
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in range(1000, 1005)} == {i: (0, i) for i in range(1000, 1005)}
    assert got[None]["n_links"] == 0


def test_near_vectors_repeats_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert near_vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_near_vectors_split_below_the_sample(spark):
    """A sample of 64 tells three levels; the levels below are fitted on samples of their own, for as many rounds as it takes."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    x[1::2] = x[::2] + 0.1 * rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(frame, leaf=16, sample=64).collect()}
    near = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i]["n_links"] <= near[i] for i in range(3000))
    assert sum(got[i]["n_links"] for i in range(3000)) >= 0.99 * near.sum()


def test_splits_deepen_in_rounds(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest, spill = near_vectors.fitted(x[:64], 8, 2, 0.9, 0.001, 0.0, rng)
    routed = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep bigint, copies bigint, v array<double>")
    routed = near_vectors.saved(routed.mapInArrow(near_vectors._route(forest, spill), "rep bigint, copies bigint, v array<double>, leaves array<bigint>"), "leaves")
    assert [len(t.splits).bit_length() for t in forest] == [3, 3]
    deep = near_vectors.deepened(routed, forest, spill, 16, 64)
    sizes = defaultdict(int)
    for r in deep.collect():
        assert list(r["leaves"]) == sorted(set(r["leaves"])) and {y >> near_vectors.NODE for y in r["leaves"]} == {0, 1}
        for y in r["leaves"]:
            sizes[y] += 1
    assert deep.count() == 4000 and max(sizes.values()) <= near_vectors.LARGE * 16


@pytest.mark.parametrize("groups", [1, 12])
def test_large_leaves_that_cannot_be_split(spark, groups):
    """Dense groups larger than a leaf may be: no split is found for one, and some nodes below a split of several stay leaves."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 16))
    of = np.arange(2000) % (groups + 1)
    x[of < groups] = x[of[of < groups]] + 0.001 * rng.standard_normal(((of < groups).sum(), 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS.replace("float", "double"))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(frame, leaf=4, sample=64).collect()}
    assert [got[i] for i in range(2000)] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()


def test_a_dense_group_is_not_copied_to_both_sides(monkeypatch):
    """A third of all vectors lie closer together than the strip is wide. Splits that would cut through them double them at each level; such nodes stay leaves."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    x[::3] = x[0] + 0.001 * rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def copies() -> float:
        forest, spill = near_vectors.fitted(x, 9, 4, 0.9, 0.02, 0.99, np.random.default_rng(1))
        return sum(len(tree.leaves(x[::3], spill)[0]) for tree in forest) / 8000

    guarded = copies()
    monkeypatch.setattr(near_vectors, "BOTH", 2)
    assert guarded < 6 and copies() > 20 * guarded


def test_vectors_of_several_lengths(spark):
    """Shorter vectors are filled up with zeros."""
    rows = [(0, [1.0, 0.0], 0), (1, [2.0], 0), (2, [1.0, 0.1, 0.0], 0), (3, [0.0, 0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(frame).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]
    found = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(frame).collect()]
    assert sorted(found) == [(1, 1, 2.0), (2, 2, 1.0), (3, 3, 0.0)]


def test_pairs_of_an_earlier_leaf_are_known(monkeypatch):
    rng = np.random.default_rng(3)
    before = [np.unique(rng.integers(0, 60, rng.integers(0, 6))) for _ in range(40)]
    monkeypatch.setattr(near_vectors, "COLUMNS", 7)
    left, right = np.arange(0, 40, 2), np.arange(40)
    seen = np.zeros((20, 40), bool)
    for part in near_vectors._shared(before, left, right):
        seen |= part
    # a leaf of one member joins nothing, itself included
    want = [[len(np.intersect1d(before[i], before[j])) > 0 for j in right] for i in left]
    assert all(seen[a, j] == want[a][j] for a, i in enumerate(left) for j in right if i != j)


def test_neighbours_recall_and_scores(spark):
    rows = [(i, [float(np.float32(v * (1 + i % 3))) for v in x], label) for i, x, label in vectors(1200)]
    got = neighbours.search(spark.createDataFrame(rows + ODD, VECTORS)).collect()
    x = np.array([r[1] for r in rows], float)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 1200, 20))
    hits = 0
    for q, near in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        hits += len(set(best) & {v for v, _ in near})
        assert len(near) == 20
        assert [v for v, _ in near] == sorted([v for v, _ in near], key=lambda v: (-score[v], v))
        assert np.allclose([s for _, s in near], [score[v] for v, _ in near], rtol=1e-12)
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_few_ties_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (5, [0.5, 1.0], 0), (3, [0.5, 2.0], 0), (4, [-1.0, 0.0], 0)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(spark.createDataFrame(rows, VECTORS)).collect()]
    assert sorted(got) == [(0, 1, 3, 0.5), (0, 2, 5, 0.5), (0, 3, 4, -1.0)]
    assert neighbours.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_scans_abandon_and_keep_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)) @ neighbours.rotation(64)
    q = x[:5] + 0.3 * rng.standard_normal((5, 64))
    for one, alive in zip(q, neighbours.scan(q, x, 10), strict=True):
        best = np.argsort(((x - one) ** 2).sum(1))[:10]
        assert len(set(best) & set(alive)) >= 9
        assert len(alive) < 2500
