"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting goes round the features, fits a shallow tree on one
feature's bins at a time, and adds it to that feature's lookup table; then the pairs of features that explain
most of what is left get small two-way tables in the same manner. A text's score is the sum of its bins' entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm.shared import mapped, mix, table, text_chunks, words

#: Bound of the training sample, in labelled texts.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SMOOTH = 120, 60, 0.15, 4, 5.0

FEATURES = (
    "bytes", "words", "word_bytes", "upper", "letters", "digits", "punctuation", "symbols", "exclamation", "white",
    "lines", "distinct_words", "distinct_bigrams", "same_as_last", "sign_words", "sign_ends", "most_common", "sentence_ends",
)

_SYMBOLS = b"#$%&*@^~|<>{}[]\\/=+_`"


def _class(members) -> np.ndarray:
    lut = np.zeros(256, np.float32)
    lut[list(members)] = 1
    return lut


_UPPER, _ASCII = _class(range(65, 91)), _class([*range(65, 91), *range(97, 123)])
_LETTERS = _class([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS, _WHITE, _LINE = _class(range(48, 58)), _class([32, *range(9, 14)]), _class([10])
_SYMBOL, _BANG, _STOP = _class(_SYMBOLS), _class(b"!"), _class(b".?;:")
_PUNCT = _class(b for b in range(33, 127) if not chr(b).isalnum())


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, features) of whole texts; an empty text has zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    sizes = np.diff(offs)
    some = np.flatnonzero(sizes)
    first = offs[:-1][some]
    total = np.maximum(sizes, 1)

    def share(lut: np.ndarray) -> np.ndarray:
        sums = np.zeros(n)
        sums[some] = np.add.reduceat(lut[raw], first, dtype=np.float64)
        return sums

    h, doc = words(raw, offs)
    count = np.bincount(doc, minlength=n)
    each = np.maximum(count, 1)
    ascii_ = share(_ASCII)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(count), sizes / each
    for i, lut in ((4, _LETTERS), (5, _DIGITS), (6, _PUNCT), (7, _SYMBOL), (8, _BANG), (9, _WHITE)):
        out[:, i] = share(lut) / total
    out[:, 3] = share(_UPPER) / np.maximum(ascii_, 1)
    out[:, 10] = share(_LINE) / each
    out[count == 0, 11:13] = 1
    if len(h):
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 13] = np.bincount(doc, weights=same, minlength=n) / each
        with np.errstate(over="ignore"):
            two = mix(np.append(h[0], h[:-1]) * np.uint64(31) + h)
        for at, x in ((11, h), (12, two)):
            order = np.lexsort((x, doc))
            new = np.ones(len(x), bool)
            new[1:] = (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            out[:, at] = np.where(count > 0, np.bincount(doc[order], weights=new, minlength=n) / each, 1)
            if at == 11:
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(x)))
                top = np.zeros(n)
                np.maximum.at(top, doc[order][starts], times)
                out[:, 16] = top / each
        # the first and last byte of each word
        inside = _WHITE[raw] == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first] = inside[first]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = offs[1:][some] - 1
        ends[last] = inside[last]
        head, tail = raw[begins], raw[ends]
        out[:, 14] = np.bincount(doc, weights=_PUNCT[head], minlength=n) / each
        out[:, 15] = np.bincount(doc, weights=_SYMBOL[tail] + _BANG[tail], minlength=n) / each
        out[:, 17] = np.bincount(doc, weights=_STOP[tail], minlength=n) / each
    return out


@dataclass
class Additive:
    """Bin edges and a lookup table of each feature, and of each pair of features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, lut) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += lut[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, lut in self.pairs:
            out += lut[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(x) else np.zeros(0)


def _shallow(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values, by bin, of a tree that splits a row of bins where the gain is largest, up to so many leaves."""
    parts = [(0, len(grad))]
    g, h = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))

    def value(i: int, j: int) -> float:
        return (g[j] - g[i]) / (h[j] - h[i] + SMOOTH)

    def best(i: int, j: int) -> tuple[float, int]:
        k = np.arange(i + 1, j)
        if not len(k):
            return 0.0, i
        gain = (g[k] - g[i]) ** 2 / (h[k] - h[i] + SMOOTH) + (g[j] - g[k]) ** 2 / (h[j] - h[k] + SMOOTH) - (g[j] - g[i]) ** 2 / (h[j] - h[i] + SMOOTH)
        return float(gain.max()), int(k[gain.argmax()])

    while len(parts) < leaves:
        gain, k, (i, j) = max(((*best(*p), p) for p in parts), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts.remove((i, j))
        parts += [(i, k), (k, j)]
    out = np.zeros(len(grad))
    for i, j in parts:
        out[i:j] = value(i, j)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of one cut in each direction of a two-way grid."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    a, b = g[:-1, :-1], h[:-1, :-1]
    right_g, right_h = g[:-1, -1:] - a, h[:-1, -1:] - b
    below_g, below_h = g[-1:, :-1] - a, h[-1:, :-1] - b
    rest_g, rest_h = g[-1, -1] - a - right_g - below_g, h[-1, -1] - b - right_h - below_h
    gain = a**2 / (b + SMOOTH) + right_g**2 / (right_h + SMOOTH) + below_g**2 / (below_h + SMOOTH) + rest_g**2 / (rest_h + SMOOTH)
    if not gain.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(grad)
    for rows, cols, x, y in (
        (slice(0, i + 1), slice(0, j + 1), a, b),
        (slice(0, i + 1), slice(j + 1, None), right_g, right_h),
        (slice(i + 1, None), slice(0, j + 1), below_g, below_h),
        (slice(i + 1, None), slice(j + 1, None), rest_g, rest_h),
    ):
        out[rows, cols] = x[i, j] / (y[i, j] + SMOOTH)
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting on the logistic loss. With one label only, the score is that label's smoothed share."""
    f = x.shape[1]
    model = Additive([_cuts(x[:, j], BINS) for j in range(f)], [], [_cuts(x[:, j], PAIR_BINS) for j in range(f)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    mean = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(mean / (1 - mean)))
    if not 0 < y.sum() < len(y):
        return model
    places = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(f):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[j])
            step = RATE * _shallow(np.bincount(places[j], y - p, size), np.bincount(places[j], p * (1 - p), size))
            model.tables[j] += step
            logit += step[places[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        cell = coarse[i] * sizes[j] + coarse[j]
        return tuple(np.bincount(cell, w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for w in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grid(i, j))[0], i, j) for i in range(f) for j in range(i)), reverse=True)[:PAIRS]
    luts = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), lut in luts.items():
            step = RATE * _quadrants(*grid(i, j))[1]
            lut += step
            logit += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, lut) for (i, j), lut in luts.items()]
    return model


def _apply(keep: list[str], model: Additive | None, only_good: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, raw, offs in text_chunks(batch.column("__text")):
                n = len(offs) - 1
                x = features(raw, offs)
                part = batch.slice(begin, n)
                columns = [part.column(c) for c in keep]
                if model is None:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*columns, lists], names=[*keep, "features"])
                else:
                    p = model.probability(x)
                    out = pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])
                    yield out.filter(pa.array(p >= 0.5)) if only_good else out

    return run


def _mapped(docs: DataFrame, keep: tuple[str, ...], model: Additive | None, only_good: bool, *fields: T.StructField) -> DataFrame:
    kept = docs.select(*keep, docs["text"].alias("__text"))
    return mapped(kept, _apply(list(keep), model, only_good), T.StructType([*(kept.schema[c] for c in keep), *fields]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Learn labels.quality from docs (doc_id, text): about `sample` labelled documents, picked by the hash of doc_id.

    Labels other than 0 and 1, and null ids, are left out. Without any, the score is 0.5 everywhere."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    picked = known.filter(spread < min(1.0, sample / max(1, n)) * 1_000_003)  # of bounded size: may be broadcast
    got = _mapped(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ("doc_id", "quality"), None, False, T.StructField("features", T.ArrayType(T.DoubleType())))
    got = got.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).toPandas()  # one row an id, however often it comes
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, got["quality"].to_numpy(float))


def classify(docs: DataFrame, model: Additive, keep: tuple[str, ...] = ("doc_id",), only_good: bool = False) -> DataFrame:
    """keep..., score double (0 to 1), predicted int: one row per row of docs; with only_good, those predicted 1.

    Null texts count as empty, and empty texts are scored like any other. Kept columns are passed on, nulls too;
    repeated rows are scored each; an empty table gives no rows; very long texts are read whole, one at a time; columns
    that aren't kept are dropped before any clash of names."""
    return _mapped(docs, keep, model, only_good, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return classify(docs, fit(docs.filter("not held_out"), table(spark, sf_dir, "labels").filter(~held_out())), keep=("doc_id", "held_out"))
