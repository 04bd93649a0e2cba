"""Largest inner products by adaptive dimension scans of probed lists.

An inner product becomes a distance by one more component, which gives all vectors the length of the longest one.
Vectors are then turned by a random rotation, so that any block of columns is a fair sample of a distance. Lists
are the cells of centres fitted on a bounded sample; every vector is in one list. A query probes the lists whose
centres are nearest. In a list, distances are summed a block of columns at a time, and a candidate is abandoned
when its partial distance says, by a test of bounded error, that it can't be among the best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm.shared import saved, table

NEAREST = 20
#: Bound of the sample that the centres are fitted on.
SAMPLE = 8192
#: Lists for each square root of the vectors, and columns of a block.
LISTS, COLUMNS = 0.3, 16
#: Recall within the sample that sets the number of lists a query probes, and the sample's queries for it.
RECALL, TRIALS = 0.96, 300
#: The test's bound, in standard deviations of a scaled partial distance.
DEVIATIONS = 2.5
#: Most vectors and most queries of a task's piece of a list.
BLOCK, QUERIES = 16_384, 8192
#: Queries whose distances are computed at once.
TOGETHER = 64


def checked(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v), where v is null for vectors that are null, empty, zero, or hold null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, v).alias("v"))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows with an id and a vector that takes part."""
    return checked(vectors, id_col, vector).filter("vec_id is not null and v is not null")


def padded(rows: DataFrame, width: int) -> DataFrame:
    """Vectors of one length: zeros fill up shorter ones, which changes neither inner products nor lengths."""
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))


def rotation(n: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means on a sample; no more centres than distinct vectors."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Places of the n nearest centres, nearest first."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    if n == 1:
        return d.argmin(1)[:, None]
    if n >= len(c):
        return np.argsort(d, axis=1, kind="stable")
    some = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))
    return np.column_stack([x, extra])


def probes_for(x: np.ndarray, c: np.ndarray, n: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Lists to probe, so that sampled queries find that share of their n nearest in the sample."""
    own, ask = nearest(x, c, 1)[:, 0], x[:: max(1, len(x) // trials)].copy()
    near = nearest(ask, x, n + 1)
    ask[:, -1] = 0  # a query has no added component
    place = np.argsort(nearest(ask, c, len(c)), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), recall, method="higher")) + 1


def _place(c: np.ndarray, longest: float, probed: int):
    """Each vector's list; each query's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            ask = batch.column("is_query").to_numpy(zero_copy_only=False)
            own = nearest(_lifted(x, longest, False), c, 1)
            lists: list[list[int]] = own.tolist()
            probes: list[list[int]] = [[] for _ in lists]
            if ask.any():
                for i, near in zip(np.flatnonzero(ask), nearest(_lifted(x[ask], longest, True), c, probed).tolist(), strict=True):
                    probes[i] = near
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array([y[0] for y in lists], pa.int32()), pa.array(probes, pa.list_(pa.int32()))],
                names=["vec_id", "v", "list", "probes"],
            )

    return run


def scan(queries: np.ndarray, x: np.ndarray, n: int, columns: int = COLUMNS, deviations: float = DEVIATIONS) -> Iterator[np.ndarray]:
    """For each rotated query the places of candidates that no test abandoned, at least the n nearest with high probability."""
    width = x.shape[1]
    if len(x) <= 4 * n:
        yield from (np.arange(len(x)) for _ in queries)
        return
    squares = x * x

    def distances(q: np.ndarray, rows: np.ndarray | slice, low: int, high: int) -> np.ndarray:
        part = q[:, low:high]
        return np.maximum((part * part).sum(1)[:, None] + squares[rows, low:high].sum(1) - 2 * (part @ x[rows, low:high].T), 0)

    for first in range(0, len(queries), TOGETHER):
        q = queries[first : first + TOGETHER]
        # a first part of the list gives each query's bound
        bound = np.partition(distances(q, slice(0, 4 * n), 0, width), n - 1, axis=1)[:, n - 1 : n]
        rows, partial, done = np.arange(len(x)), np.zeros((len(q), len(x))), 0
        alive = np.ones(partial.shape, bool)
        for upto in range(columns, width, columns):
            partial += distances(q, rows, done, upto)
            # of a random upto of width columns, the scaled length has this relative deviation
            spread = np.sqrt((1 - upto / width) / (2 * upto))
            alive &= partial * (width / upto) <= bound * (1 + deviations * spread) ** 2
            still, done = alive.any(0), upto
            rows, partial, alive = rows[still], partial[:, still], alive[:, still]
            if len(rows) <= 2 * n:
                break
        yield from (rows[a] for a in alive)


def _search(nearest_n: int, longest: float, turn: np.ndarray):
    def run(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(found):
            return empty
        x, q = np.stack(found["of_v"].to_numpy()), np.stack(queries["v"].to_numpy())
        ids, asks = found["of_vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        rows: list[tuple[np.ndarray, ...]] = []
        for ask, exact, alive in zip(asks, q, scan(_lifted(q, longest, True) @ turn, _lifted(x, longest, False) @ turn, nearest_n + 1), strict=True):
            alive = alive[ids[alive] != ask]
            score = (x[alive] * exact).sum(1)
            best = np.lexsort((ids[alive], -score))[:nearest_n]
            rows.append((np.full(len(best), ask), ids[alive][best], score[best]))
        return pd.DataFrame({name: np.concatenate([r[i] for r in rows]) for i, name in enumerate(empty.columns)}).astype(empty.dtypes)

    return run


def search(vectors: DataFrame, every: int = NEAREST, nearest_n: int = NEAREST, lists: float = LISTS, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the largest inner products found for rows whose vec_id is divisible by `every`.

    Candidates are all rows with another vec_id; fewer than nearest_n give fewer rows. Scores are inner products of
    the vectors as given, in double precision; ties go to the smaller vec_id; rows that are alike count once,
    and different vectors of one vec_id are asked and answered under that id together. Null ids and vectors that are null,
    zero, or hold null or non-finite components take no part; shorter vectors are filled up with zeros. Other columns are
    not looked at. An empty table gives no rows."""
    rows = saved(usable(vectors).distinct(), "vectors")
    stats = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("v")), F.min(F.size("v"))).first()
    n = stats[0]
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    longest, width = float(np.sqrt(stats[1])), stats[2]
    if stats[3] < width:
        rows = saved(padded(rows, width).distinct(), "vectors")
    picked = rows.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < min(1.0, sample / n) * 1_000_003).select("v").toArrow().column("v").combine_chunks()
    if not len(picked):
        picked = rows.limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _lifted(_matrix(picked), longest, False)
    x = x[np.lexsort(x.T)]
    c = centres(x, max(1, round(lists * n**0.5)))
    probes = probes_for(x, c, nearest_n, recall)
    ask = F.col("vec_id") % every == 0
    placed = saved(rows.withColumn("is_query", ask).mapInArrow(_place(c, longest, probes), "vec_id bigint, v array<double>, list int, probes array<int>"), "lists")
    # large lists are cut into pieces, and so are their queries; the counts are one row a list
    pieces = placed.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("pieces"))
    asked = placed.select("vec_id", "v", F.explode("probes").alias("list"))
    groups = asked.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {QUERIES}) as int)").alias("groups"))
    plan = pieces.join(groups, "list")
    mine = F.broadcast(plan)  # one row for each centre, of which there are fewer than the sample's rows
    turned = rotation(width + 1)
    left = (
        asked.join(mine, "list")
        .withColumn("group", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
        .withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
        .select("list", "piece", "group", "vec_id", "v")
    )
    right = (
        placed.join(mine, "list")
        .withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
        .withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
        .select(*(F.col(c).alias(f"of_{c}") for c in ("list", "piece", "group", "vec_id", "v")))
    )
    keys = ["list", "piece", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*(f"of_{k}" for k in keys))).applyInPandas(_search(nearest_n, longest, turned), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest_n).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
