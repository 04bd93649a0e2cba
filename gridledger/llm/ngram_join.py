"""Jaccard self-join of documents on word shingles, by a MinHash LSH forest and exact verification.

Each text's shingle set gets a signature of trees * depth minima. A tree is a sorted prefix trie of its part of
the signatures; two texts meet in a tree's node if their prefixes agree. Matching starts at full depth, and prefixes
are shortened by one as long as the links found so far, by their similarities, tell that too many are still missed;
while there are few links to tell by, as long as a pair at the threshold could be missed. A shorter prefix is looked at
only where the trie branches, and a pair only where it meets first, so shortening repeats no work.

Copies (equal sets) are one class from the start. Nodes with many members or long texts are divided into pairs of
blocks, so that no task holds a whole group and no pair of one becomes a row: a block gives each member's links and
one edge to the smallest member it is joined to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.components import components
from gridledger.llm.shared import forget, mapped, mix, numbered, saved, table, text_chunks, weights, words

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Links that are enough to measure the recall by, and steps of similarity that they are counted in.
EVIDENCE, STEPS = 1000, 40
#: Most members of a block, and bytes of their texts.
BLOCK, BLOCK_BYTES = 768, 64 << 20
#: Most rows of 64 bits that tell tasks which texts meet any other.
BITS = 1 << 20
#: Agreeing minima, in standard deviations below their mean at the threshold, under which a pair is not verified.
DEVIATIONS = 5.5


def found_share(similarity: np.ndarray | float, k: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair agrees in a prefix of k minima of some tree."""
    return 1 - (1 - np.asarray(similarity) ** k) ** trees


def missed_share(links: np.ndarray, k: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """The share of links missed at depth k: links counts those found by similarity, in steps from the threshold to 1.

    Each link found stands for as many like it as its chance to be found tells. Few links tell nothing: then all
    are taken to be at the threshold."""
    if links.sum() < EVIDENCE:
        return float(1 - found_share(threshold, k, trees))
    share = found_share(threshold + (1 - threshold) * np.arange(len(links)) / len(links), k, trees)
    return float((links * (1 - share) / share).sum() / (links / share).sum())


def shingles(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the text each is in; a shorter text has one run, of all its words."""
    h, doc = words(raw, offs)
    n = len(h)
    if not n:
        return h, doc
    counts = np.bincount(doc, minlength=len(offs) - 1)
    begin = np.cumsum(counts) - counts
    w = weights(size, 7)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, n - size + 1), np.uint64)
        for i in range(size):
            runs += h[i : n - size + 1 + i] * w[i]
        full = doc[: len(runs)] == doc[size - 1 :] if len(runs) else np.zeros(0, bool)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            at = np.repeat(begin[short], counts[short]) + _within(counts[short])
            part = np.add.reduceat(h[at] * w[_within(counts[short])], np.cumsum(counts[short]) - counts[short])
            out, of = np.concatenate([runs[full], part + counts[short].astype(np.uint64)]), np.concatenate([doc[: len(runs)][full], short])
            order = np.argsort(of, kind="stable")
            return mix(out[order]), of[order]
        return mix(runs[full]), doc[: len(runs)][full]


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _signatures(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = weights(trees * depth, 11).astype(np.uint32) | np.uint32(1), weights(trees * depth, 13).astype(np.uint32)
        for batch in batches:
            for begin, raw, offs in text_chunks(batch.column("text")):
                n = len(offs) - 1
                s, doc = shingles(raw, offs)
                size, lo, hi = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                minima = np.zeros((n, trees * depth), np.uint32)
                if len(s):
                    # each text's distinct shingles, in order
                    order = np.lexsort((s, doc))
                    s, doc = s[order], doc[order]
                    new = np.ones(len(s), bool)
                    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
                    s, doc = s[new], doc[new]
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    of = doc[first]
                    size[of] = np.diff(np.append(first, len(doc)))
                    with np.errstate(over="ignore"):
                        lo[of] = np.add.reduceat(mix(s), first)
                        hi[of] = np.add.reduceat(mix(s ^ weights(1, 23)[0]), first)
                        x = (s >> np.uint64(32)).astype(np.uint32)
                        for i in range(trees * depth):
                            minima[of, i] = np.minimum.reduceat(x * a[i] + b[i], first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(begin, n) for c in ("rid", "doc_id")),
                        pa.array(size),
                        pa.array(np.diff(offs)),
                        pa.array(lo.view(np.int64)),
                        pa.array(hi.view(np.int64)),
                        pa.array(list(map(bytes, minima)), pa.binary()),
                    ],
                    names=["rid", "doc_id", "size", "bytes", "lo", "hi", "minima"],
                )

    return run


def _prefixes(trees: int, depth: int, k: int):
    """Each class's node of depth k in each tree, the branch of it that the class is on (what its prefix of k + 1 is,
    the same for all at full depth), and what pairs are compared by: 32 bits of both for each tree, 8 of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, level = weights(trees, 17), weights(depth + 1, 19)
        for batch in batches:
            n = batch.num_rows
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, trees, depth)
            with np.errstate(over="ignore"):
                own, longer = (mix((minima[:, :, :m].astype(np.uint64) * level[:m]).sum(2) + salt * level[depth] + np.uint64(m)) for m in (k, min(k + 1, depth)))
            branch = longer.astype(np.uint32) if k < depth else np.zeros((n, trees), np.uint32)
            digests = np.concatenate([own.astype(np.uint32), branch], 1) if k < depth else own.astype(np.uint32)
            low = ((minima >> np.uint32(24)).astype(np.uint8) ^ (minima & np.uint32(255)).astype(np.uint8)).reshape(n, -1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * trees + 1, trees, dtype=np.int32)), pa.array(x.ravel())) for x in (own.view(np.int64), branch.view(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "copies", "bytes")), *lists, pa.array(list(map(bytes, digests)), pa.binary()), pa.array(list(map(bytes, low)), pa.binary())],
                names=["rep", "copies", "bytes", "prefixes", "branches", "digests", "low"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        edge = np.zeros(len(t) - 1, bool)
        for c in cols:
            edge |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(t)]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield pa.concat_tables(held)
            held = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(i, j - i))
    if held:
        yield pa.concat_tables(held)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block's left and right side; the same for a block of the diagonal."""
    part, i, j = (t.column(c).to_numpy() for c in ("part", "i", "j"))
    if i[0] == j[0]:
        return np.arange(len(t)), np.arange(len(t))
    return np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])


def _candidates(t: pa.Table, trees: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) that this node is the first to bring together and whose signatures agree enough."""
    tree = t.column("tree")[0].as_py()
    both = np.frombuffer(b"".join(t.column("digests").to_pylist()), np.uint32).reshape(len(t), -1)
    digest = both[:, [*range(tree), *range(trees, both.shape[1])]]  # nodes of earlier trees, and all longer prefixes
    low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(t), -1)
    left, right = _sides(t)
    for at, a in enumerate(left):
        others = right[at + 1 :] if left is right or (len(left) == len(right) and left[0] == right[0]) else right
        others = others[(low[others] == low[a]).sum(1) >= least]
        if digest.shape[1] and len(others):
            others = others[~(digest[others] == digest[a]).any(1)]
        if len(others):
            yield a, others


def _meetings(trees: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["prefix", "i", "j"]):
            wanted = np.zeros(len(t), bool)
            for a, others in _candidates(t, trees, least):
                wanted[a] = True
                wanted[others] = True
            if wanted.any():
                yield from t.filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def _verify(threshold: float, trees: int, least: int, steps: int = STEPS):
    """A block's links: of each member, how many; one edge; and on the first row how many links have which similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["prefix", "i", "j"]):
            n = len(t)
            copies, rep = t.column("copies").to_numpy(), t.column("rep").to_numpy()
            found: list[np.ndarray] = []
            for _, raw, offs in text_chunks(t.column("text").cast(pa.large_string()).combine_chunks()):
                s, doc = shingles(raw, offs)
                edges = np.searchsorted(doc, np.arange(len(offs)))
                found += [np.unique(s[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
            sizes = np.array(list(map(len, found)))
            # shingles of two texts or more, as bits
            names, inverse, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(n), sizes)
            often = count[inverse] > 1
            column = np.cumsum(count > 1) - 1
            width = -(-max(1, int((count > 1).sum())) // 64) * 64
            bits = np.zeros((n, width // 64), np.uint64)
            c = column[inverse[often]]
            np.bitwise_or.at(bits, (owner[often], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
            links, root, alike = np.zeros(n, np.int64), np.arange(n), np.zeros(steps, np.int64)

            def find(x: int, root: np.ndarray = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, others in _candidates(t, trees, least):
                shared = np.bitwise_count(bits[a] & bits[others]).sum(1, dtype=np.int64)
                union = sizes[a] + sizes[others] - shared
                close = shared >= threshold * union - 1e-9
                near = others[close]
                if len(near):
                    links[a] += copies[near].sum()
                    links[near] += copies[a]
                    step = ((shared[close] / union[close] - threshold) / (1 - threshold) * steps).astype(int)
                    alike += np.bincount(np.clip(step, 0, steps - 1), minlength=steps)
                    for b in near:
                        x, y = find(a), find(b)
                        if x != y:
                            x, y = (x, y) if rep[x] < rep[y] else (y, x)
                            root[y] = x
            some = np.flatnonzero(links)
            if len(some):
                to = rep[[find(x) for x in some]]
                tally = pa.array([alike.tolist(), *[None] * (len(some) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(to), tally], names=["rep", "links", "root", "alike"])

    return run


def _meeting_texts(docs: DataFrame, meetings: DataFrame) -> DataFrame:
    """(rep, text) of the rows of docs that meetings name; the others are left out where they lie and cross no exchange.

    A bit for each, by its number, is sent to the tasks. From the number of rows on at which bits are shared, some texts
    pass that meet nobody; none is lost."""
    place, bit = (f"pmod(xxhash64(shiftright(rep, 6)), {BITS})", "shiftleft(1L, cast(rep & 63 as int))")
    wanted = meetings.groupBy(F.expr(place).alias("place")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    texts = docs.select(F.col("rid").alias("rep"), "text").withColumn("place", F.expr(place))
    return texts.join(F.broadcast(wanted), "place").filter(f"bits & {bit} <> 0").select("rep", "text")


def _links_at(reps: DataFrame, docs: DataFrame, k: int, depth: int, trees: int, threshold: float, least: int, block: int, block_bytes: int) -> DataFrame:
    """The links of classes that meet in a prefix of k minima and in no longer one, block by block, as a saved table."""
    schema = "rep bigint, copies bigint, bytes bigint, prefixes array<bigint>, branches array<int>, digests binary, low binary"
    placed = reps.select("rep", "copies", "bytes", "minima").mapInArrow(_prefixes(trees, depth, k), schema)
    nodes = placed.select("rep", "bytes", F.posexplode(F.arrays_zip("prefixes", "branches")).alias("tree", "p")).select("rep", "bytes", "tree", F.col("p.prefixes").alias("prefix"), F.col("p.branches").alias("branch"))
    sizes = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("branch").alias("one"), F.max("branch").alias("other"))
    many = sizes.filter("n > 1" if k == depth else "n > 1 and one <> other").select("tree", "prefix", F.expr(f"cast(greatest(ceil(n / {block}), ceil(bytes / {block_bytes})) as int)").alias("parts"))
    members = (
        nodes.select("tree", "prefix", "rep")
        .join(many, ["tree", "prefix"])
        .withColumn("part", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("tree", "prefix", "rep", "part", F.expr("least(part, other)").alias("i"), F.expr("greatest(part, other)").alias("j"))
        .join(placed.select("rep", "copies", "low", "digests"), "rep")
    )
    order = ["prefix", "i", "j"]
    kept = ["tree", "prefix", "rep", "part", "i", "j", "copies", "low", "digests"]
    meetings = saved(members.select(*kept).repartition(*order).sortWithinPartitions(*order).mapInArrow(_meetings(trees, least), members.select(*kept).schema), "meetings")
    blocks = meetings.join(_meeting_texts(docs, meetings), "rep").repartition(*order).sortWithinPartitions(*order, "rep")
    links = saved(mapped(blocks, _verify(threshold, trees, least), "rep bigint, links bigint, root bigint, alike array<bigint>"), "links")
    forget(meetings)
    return links


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, rid: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """rid, doc_id, n_links, component_id, kept, depth: one row per row of docs.

    n_links: other documents with Jaccard similarity at or above the threshold, copies included. component_id:
    the smallest doc_id that links lead to; kept: true for one row of each component, that of the smallest
    (doc_id, rid). depth: the longest prefix at which a link of it was found, null without one other than copies.
    rid: the column of that name in a saved table, which tells repeated rows apart; without a name
    rows are numbered once and saved. Words are
    divided by ASCII white space and A-Z are lower-cased; a text of fewer than five words is one shingle. Null and
    empty texts link with nothing; very long texts are read whole, a block of them is bounded in bytes. A null doc_id
    is passed on, and sorts last when a component is named. Other columns are not looked at. An empty table gives no rows."""
    bits = trees * depth
    agree = threshold + (1 - threshold) / 256
    least = int(np.floor(bits * agree - DEVIATIONS * np.sqrt(bits * agree * (1 - agree))))
    docs = docs.select(F.col(rid).alias("rid"), "doc_id", "text") if rid else numbered(docs.select("doc_id", "text")).select("rid", "doc_id", "text")
    full = saved(mapped(docs, _signatures(trees, depth), "rid bigint, doc_id bigint, size int, bytes bigint, lo bigint, hi bigint, minima binary"), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = saved(full.filter("size > 0").groupBy("lo", "hi").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min(name).alias("name")), "classes")
    # minima are most of these tables' bytes: they are kept once, and only while classes meet
    reps = saved(classes.select("rep", "copies").join(full.select(F.col("rid").alias("rep"), "bytes", "minima"), "rep"), "minima")
    signed = saved(full.drop("bytes", "minima"), "members")
    forget(full)
    alike, verified = np.zeros(STEPS), None
    for k in range(depth, 0, -1):
        new = _links_at(reps, docs, k, depth, trees, threshold, least, block, block_bytes)
        verified = new.withColumn("depth", F.lit(k)) if verified is None else verified.unionByName(new.withColumn("depth", F.lit(k)))
        for step, n in new.select(F.posexplode("alike").alias("step", "n")).groupBy("step").agg(F.sum("n")).collect():  # STEPS rows at most
            alike[step] += n
        if missed_share(alike, k, threshold, trees) <= 1 - recall:
            break
    forget(reps)
    group = components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    of_class = (
        classes.join(verified.groupBy("rep").agg(F.sum("links").alias("links"), F.max("depth").alias("depth")), "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    of_class = of_class.join(of_class.groupBy("component").agg(F.min("name").alias("first")), "component").select(
        "lo", "hi", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first", "depth"
    )
    empty = signed.filter("size = 0").select("rid", "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("int").alias("depth"))
    return (
        signed.filter("size > 0")
        .join(of_class, ["lo", "hi"])
        .select("rid", "doc_id", "n_links", F.col("first.doc_id").alias("component_id"), (F.col("first.rid") == F.col("rid")).alias("kept"), "depth")
        .unionByName(empty)
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "depth")


#: The same rows by DuckDB: all pairs that share a shingle, and their closure.
OP1_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept FROM documents JOIN c ON c.node = doc_id LEFT JOIN k ON k.a = doc_id
"""
