"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the unit sphere again and again, each node by a random direction, at the median of a sample of the
vectors there; a vector near a split goes to both sides, so that near vectors share a leaf in at least one of
many trees. How near is measured: the strip is widened until pairs at the threshold meet. A node that a split
would mostly copy to both sides, such as a dense group, stays a leaf. Levels below those that one sample can tell are fitted on
samples of their own, a group of rows for each leaf that is still too large. Vectors are compared within leaves,
pairs are verified by cosine, and linked vectors are united.

Equal vectors are one class from the start. A pair is looked at in the first of its common leaves only. Large
leaves are divided into pairs of blocks, and a block gives each member's links and one edge to the smallest
member it is joined to, so no pair becomes a row and no task holds a whole group. Copies of vectors cross an exchange in
passes, so that their files stay a bounded multiple of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.components import components
from gridledger.llm.neighbours import checked, padded
from gridledger.llm.shared import forget, mix, saved, swept, table

THRESHOLD = 0.9
#: Trees, vectors a leaf should have, and half the width of the strip at a split that goes to both sides.
TREES, LEAF, SPILL = 8, 400, 0.02
#: Share of made-up pairs at the threshold that must meet in some leaf, their number, and the factor that the strip is widened by.
RECALL, PAIRS, WIDER = 0.999, 4000, 1.25
#: Random directions that the nodes of a tree choose from.
DIRECTIONS = 256
#: Bound of the sample that a node's splits are fitted on, and of its vectors those that a split must have.
SAMPLE, LEAST = 16_384, 8
#: A leaf is split further from so many times its intended size on; a node is not split if more than this share of it would go to both sides.
LARGE, BOTH = 8, 0.5
#: Vectors that splits below the first sample's are fitted on, for each leaf that they make.
OWN = 32
#: Bits of a leaf's number that tell its node; those above tell the tree.
NODE = 40
#: A vector that is at least one of so many rows is joined by broadcast.
HOT = 64
#: Members of a block of a leaf, more than leaves have that can be split further, and earlier leaves that are compared at once.
BLOCK, COLUMNS = 4096, 512
#: Bytes of copied rows that cross an exchange at once, before compression; twice the vectors' own if these are more.
PASS = 1 << 30


@dataclass
class Tree:
    """Splits of the nodes below `start`, in heap order from 0; nan: the node is a leaf. A node's direction is one of the
    tree's, by a hash of its number in the whole tree."""

    directions: np.ndarray
    splits: np.ndarray
    start: int = 0

    def along(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each row's place along its node's direction."""
        own = (mix(node.astype(np.uint64) + np.uint64(1)) % np.uint64(len(self.directions))).astype(np.int64)
        return np.einsum("ij,ij->i", x[row], self.directions[own])

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves) of unit vectors, a row for each leaf that a vector spills into."""
        row, node, local = np.arange(len(x)), np.full(len(x), self.start), np.zeros(len(x), np.int64)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(len(self.splits).bit_length()):
            split = self.splits[local]
            cut = ~np.isnan(split)
            ended.append((row[~cut], node[~cut]))
            row, node, local = row[cut], node[cut], local[cut]
            side = self.along(x, row, node) - split[cut]
            left, right = side < spill, side >= -spill
            row = np.concatenate([row[left], row[right]])
            node, local = (np.concatenate([2 * of[left] + 1, 2 * of[right] + 2]) for of in (node, local))
        ended.append((row, node))
        return np.concatenate([r for r, _ in ended]), np.concatenate([k for _, k in ended])


def grow(x: np.ndarray, levels: int, directions: np.ndarray, spill: float, start: int = 0) -> Tree:
    """A tree that splits a sample's unit vectors at medians, for as many levels as their nodes hold some."""
    levels = min(levels, max(0, round(np.log2(max(1, len(x) / LEAST)))))  # rounded, as samples vary about a power of two
    tree = Tree(directions, np.zeros(0), start)
    row, node, local = np.arange(len(x)), np.full(len(x), start), np.zeros(len(x), np.int64)
    for level in range(levels):
        place, first = tree.along(x, row, node), 2**level - 1
        order = np.lexsort((place, local))
        row, node, local, place = row[order], node[order], local[order], place[order]
        n = np.bincount(local - first, minlength=2**level)
        split = np.full(2**level, np.nan)
        held = np.flatnonzero(n >= 2)
        middle = (np.cumsum(n) - n + n // 2)[held]
        split[held] = (place[middle] + place[middle - 1]) / 2
        in_strip = np.bincount(local - first, weights=np.abs(place - split[local - first]) < spill, minlength=2**level)
        split[in_strip > BOTH * n] = np.nan
        tree.splits = np.concatenate([tree.splits, split])
        own = split[local - first]
        cut = ~np.isnan(own)
        right = place[cut] >= own[cut]
        row, node, local = row[cut], 2 * node[cut] + 1 + right, 2 * local[cut] + 1 + right
    return tree


def share_met(forest: list[Tree], x: np.ndarray, y: np.ndarray, spill: float, levels: int) -> float:
    """The expected share of pairs (x[i], y[i]) that are in a leaf together after so many levels: levels below those fitted part pairs as often as these do."""
    missed = np.ones(len(x))
    for tree in forest:
        keys = [(row << NODE) + node for row, node in (tree.leaves(x, spill), tree.leaves(y, spill))]
        met = np.unique(np.intersect1d(*keys) >> NODE)
        fitted = len(tree.splits).bit_length()
        missed[met] *= 1 - (len(met) / len(x)) ** (levels / fitted - 1) if fitted else 0
    return float(1 - missed.mean())


def planted(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Made-up pairs at the threshold, one of each an evenly drawn vector."""
    a = x[rng.integers(0, len(x), PAIRS)]
    away = rng.standard_normal(a.shape)
    away -= (away * a).sum(1)[:, None] * a
    length = np.linalg.norm(away, axis=1)[:, None]
    return a, threshold * a + np.sqrt(1 - threshold**2) * away / np.where(length > 1e-9, length, 1)


def fitted(x: np.ndarray, levels: int, trees: int, threshold: float, spill: float, recall: float, rng: np.random.Generator) -> tuple[list[Tree], float]:
    """A forest, and the width of the strip at which made-up pairs meet often enough in it."""
    ways = rng.standard_normal((trees, DIRECTIONS, x.shape[1]))
    ways /= np.linalg.norm(ways, axis=2)[:, :, None]
    a, b = planted(x, threshold, rng)
    while True:
        forest = [grow(x, levels, way, spill) for way in ways]
        if spill >= 1 or share_met(forest, a, b, spill, levels) >= recall:
            return forest, spill
        spill *= WIDER


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _route(trees: list[Tree], spill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column("v"))
            rows, leaves = [], []
            for t, tree in enumerate(trees):
                row, node = tree.leaves(x, spill)
                rows.append(row)
                leaves.append(node + (t << NODE))
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaf, row))
            ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[order]))], names=["rep", "copies", "v", "leaves"])

    return run


def _fit(forest: list[Tree], spill: float, leaf_size: int):
    """The splits below a leaf, from the sampled vectors there; a leaf that can't be split gives none. By Arrow, as pandas
    gives the column of no splits a type that is no array's, and turns nan, a node that stays a leaf, into null."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        x = _units(rows.column("v").combine_chunks())
        x = x[np.lexsort(x.T)]
        node = leaf & (1 << NODE) - 1
        levels = min(int(np.ceil(np.log2(rows.column("n")[0].as_py() / leaf_size))), NODE - (node + 1).bit_length())
        splits = grow(x, levels, forest[leaf >> NODE].directions, spill, node).splits
        some = len(splits) > 0 and not np.isnan(splits[0])
        return pa.table({"leaf": pa.array([leaf] * some, pa.int64()), "splits": pa.array([splits] * some, pa.list_(pa.float64()))})

    return run


def _deeper(forest: list[Tree], spill: float):
    """Rows come in order of their leaf, each leaf's splits before its vectors; one leaf's splits are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            leaf, splits = batch.column("leaf").to_numpy(), batch.column("splits")
            heads = np.flatnonzero(splits.is_valid().to_numpy(zero_copy_only=False))
            for begin, end in zip([0, *heads], [*heads, len(leaf)], strict=True):
                if begin < end and splits[int(begin)].is_valid:
                    at = int(leaf[begin])
                    tree, begin = Tree(forest[at >> NODE].directions, np.array(splits[int(begin)].as_py()), at & (1 << NODE) - 1), begin + 1
                if begin == end:
                    continue
                row, node = tree.leaves(_units(batch.column("v").slice(begin, end - begin)), spill)
                of, rep = leaf[begin:end][row], batch.column("rep").slice(begin, end - begin).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(of), pa.array(node + (of >> NODE << NODE))], names=["rep", "leaf", "own"])

    return run


def deepened(routed: DataFrame, forest: list[Tree], spill: float, leaf_size: int, sample: int) -> DataFrame:
    """Split leaves that are much larger than intended, by splits fitted on OWN of their vectors for each leaf intended, about `sample` at most, until none is left that can be split.

    A round takes eleven levels with the usual sample, so two do for 10^9 vectors."""
    row_bytes = forest[0].directions.shape[1] * (4 if "float" in routed.schema["v"].dataType.simpleString() else 8)
    while True:
        flat = routed.select("rep", "v", F.explode("leaves").alias("leaf"))
        large = saved(flat.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE * leaf_size), "large")
        if large.isEmpty():
            return routed
        some = flat.join(large, "leaf").filter(F.pmod(F.xxhash64("leaf", "v"), F.lit(1_000_003)) < F.least(F.lit(1.0), sample / F.col("n"), F.lit(OWN / leaf_size)) * 1_000_003)
        fits = saved(some.groupBy("leaf").applyInArrow(_fit(forest, spill, leaf_size), "leaf bigint, splits array<double>"), "splits")
        if fits.isEmpty():
            return routed
        none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("rep", "bigint"), ("v", routed.schema["v"].dataType), ("splits", "array<double>"))}
        rows = flat.join(fits.select("leaf"), "leaf").select("leaf", "rep", "v", none["splits"]).unionByName(fits.select("leaf", none["rep"], none["v"], "splits"))
        deal = lambda some: some.repartition("leaf").sortWithinPartitions("leaf", F.col("splits").isNull()).mapInArrow(_deeper(forest, spill), "rep bigint, leaf bigint, own bigint")
        times = passes(large.join(fits, "leaf").agg(F.sum("n")).first()[0], row_bytes, row_bytes * routed.count())
        placed = in_passes(rows, times, ["leaf"], deal, "placed")
        changed = placed.groupBy("rep").agg(F.collect_set("leaf").alias("gone"), F.collect_list("own").alias("own"))
        then, routed = routed, saved(
            routed.join(changed, "rep", "left").select("rep", "copies", "v", F.expr("if(own is null, leaves, array_sort(concat(array_except(leaves, gone), own)))").alias("leaves")), "leaves"
        )
        for old in (then, large, fits, placed):
            forget(old)


def _shared(before: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """For COLUMNS earlier leaves at a time, whether members left[i] and right[j] were together in one."""
    owner = np.repeat(np.arange(len(before)), [len(b) for b in before])
    if not len(owner):
        return
    names, column, often = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # a leaf of one member here joins nothing
    owner, column = owner[often[column] > 1], place[column[often[column] > 1]]
    upto = int((often > 1).sum())
    for low in range(0, upto, COLUMNS):
        inside = (column >= low) & (column < low + COLUMNS)
        seen = np.zeros((len(before), min(COLUMNS, upto - low)), np.float32)
        seen[owner[inside], column[inside] - low] = 1
        yield seen[left] @ seen[right].T > 0


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks()
        order = np.argsort(rows.column("rep").to_numpy())
        rep, copies, part = (rows.column(name).to_numpy()[order] for name in ("rep", "copies", "part"))
        x = _units(rows.column("v").combine_chunks())[order]
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def roots(of: np.ndarray) -> np.ndarray:
            now, up = root[of], root[root[of]]
            while (now != up).any():
                now, up = up, root[up]
            return now

        # members of a pair of blocks are few, so this is a small matrix of bits
        near, short = np.zeros((len(left), len(right)), bool), x.astype(np.float32)
        unsure = (x.shape[1] + 8) * 2.0**-23  # more than single precision may be wrong by
        for k in range(0, len(left), 256):
            a, b = left[k : k + 256], right[k:] if i == j else right
            cosine = short[a] @ short[b].T
            bits = cosine >= threshold
            again = np.flatnonzero((np.abs(cosine - threshold) <= unsure).any(1))
            bits[again] = x[a[again]] @ x[b].T >= threshold
            near[k : k + 256, len(right) - len(b) :] = bits
        if i == j:
            near &= left[:, None] < right[None, :]
        some = np.flatnonzero(near.any(1))
        near, left = near[some], left[some]
        # a pair that shares an earlier leaf has been looked at there
        if len(some):
            before = rows.column("before").combine_chunks()
            ends, leaves = before.offsets.to_numpy(), before.values.to_numpy()
            for together in _shared([leaves[ends[k] : ends[k + 1]] for k in order], left, right):
                near &= ~together
        for k in range(0, len(left), 256):
            bits = near[k : k + 256].astype(np.float64)
            links[left[k : k + 256]] += np.rint(bits @ copies[right]).astype(np.int64)
            links[right] += np.rint(copies[left[k : k + 256]] @ bits).astype(np.int64)
        for a, bits in zip(left, near, strict=True):
            both = np.append(right[bits], a)
            found = roots(both)
            if found.min() < found.max():
                root[found] = found.min()
            root[both] = found.min()
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[roots(some)]})

    return run


def passes(rows: int, row_bytes: float, table_bytes: int) -> int:
    """In how many parts rows cross an exchange, so that their files stay a bounded multiple of the table's size."""
    return max(1, int(np.ceil(rows * row_bytes / max(PASS, 2 * table_bytes))))


def in_passes(rows: DataFrame, times: int, keys: list[str], run, name: str) -> DataFrame:
    """run(rows), saved, for as many parts of the rows' keys one after the other; the files of one part's exchange go before the next begins."""
    done = []
    for k in range(times):
        done.append(saved(run(rows.filter(F.pmod(F.xxhash64(*keys), F.lit(times)) == k)), name))
        if k < times - 1:
            swept(rows.sparkSession)
    return reduce(DataFrame.unionByName, done)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK, seed: int = 3, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors that has a vec_id.

    n_links: other vectors found with cosine at or above the threshold; component_id: the smallest vec_id that
    links lead to, itself included; kept: vec_id = component_id. Vectors that are null, zero, or hold null or
    non-finite components link with nothing. Rows of one vec_id are told apart: repeated rows are links of each
    other. A null vec_id is passed on without links and kept is null. Vectors shorter than the longest are filled up with
    zeros. Other columns are not looked at. An empty table gives no rows."""
    # single precision is kept as it is, which halves the rows that are copied; cosines are computed in double
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    every = checked(vectors).withColumn("v", F.col("v").cast(kind))
    alone = every.filter("vec_id is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sound = every.filter("vec_id is not null and v is not null")
    classes_of = lambda rows: saved(rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    reps = classes_of(sound)
    n, shortest, width = reps.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    if shortest < width:
        sound = padded(sound, width).withColumn("v", F.col("v").cast(kind))
        reps = classes_of(sound)
    picked = reps.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < min(1.0, sample / n) * 1_000_003).select("v").toArrow().column("v").combine_chunks()
    if not len(picked):
        picked = reps.limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _units(picked)
    x = x[np.lexsort(x.T)]
    levels = int(np.ceil(np.log2(max(1, n / leaf))))
    rng = np.random.default_rng(seed)
    forest, spill = fitted(x, levels, trees, threshold, spill, recall, rng)
    routed = saved(reps.select("rep", "copies", "v").mapInArrow(_route(forest, spill), f"rep bigint, copies bigint, v {kind}, leaves array<bigint>"), "leaves")
    routed = deepened(routed, forest, spill, leaf, sample)
    large = saved(
        routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("leaf", "n", F.expr(f"cast(ceil(n / {block}) as int)").alias("parts")), "large"
    )
    copied = routed.agg(F.sum(F.size("leaves"))).first()[0]
    again = large.agg(F.sum(F.expr("n * (parts - 1)"))).first()[0] or 0
    members = (
        routed.withColumn("leaf", F.explode("leaves"))
        .join(large.select("leaf", "parts"), "leaf", "left")
        .withColumn("part", F.expr("cast(pmod(xxhash64(rep), coalesce(parts, 1)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
        .select("leaf", F.expr("least(part, other)").alias("i"), F.expr("greatest(part, other)").alias("j"), "part", "rep", "copies", "v", F.expr("filter(leaves, x -> x < leaf)").alias("before"))
    )
    size = 4 if kind == "array<float>" else 8
    times = passes(copied + again, size * width + 4 * copied / n, size * width * n)
    found = in_passes(members, times, ["leaf", "i", "j"], lambda rows: rows.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), "rep bigint, links bigint, root bigint"), "links")
    forget(routed)
    group = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    of_rep = (
        reps.select("rep", "first", "copies", "v")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    named = of_rep.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = saved(of_rep.join(named, "component").select("v", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "classes")
    # vectors that are one of HOT rows are few, so they may be broadcast; the others have no hot key
    often = F.col("copies") * HOT >= classes.agg(F.sum("copies")).first()[0]
    hot, rest = F.broadcast(classes.filter(often).drop("copies")), classes.filter(~often).drop("copies")
    linked = sound.join(hot, "v").unionByName(sound.join(F.broadcast(classes.filter(often).select("v")), "v", "left_anti").join(rest, "v")).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same rows by DuckDB, from all pairs.
OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id
"""
