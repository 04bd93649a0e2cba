"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows. In each, one gated unit layer runs forward and one backward over the bytes; every
position gets language probabilities from both states, and a text's probability is the mean over the positions
of its letters. The gates are piecewise linear (a clipped line for the sigmoid and for tanh), which numpy computes
an order of magnitude faster. Training is backpropagation through time with Adam, on windows of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm.shared import mapped, saved, table, text_chunks

UNDETERMINED = "und"
#: Units of a direction, positions of a window, windows computed at once.
UNITS, WINDOW, BATCH = 8, 64, 4096
#: Bound of the training sample: texts of a language, windows of a text.
SAMPLE, WINDOWS = 1200, 3
#: A value of lang is learned if one labelled row in so many holds it.
RAREST = 1000
ROUNDS, TRAIN_BATCH, RATE = 500, 256, 0.03

_CODE = np.arange(256, dtype=np.intp)
_CODE[ord("A") : ord("Z") + 1] += 32
_CODE[ord("0") : ord("9") + 1] = ord("0")
_CODE[[b for b in range(128) if not chr(b).isalnum()]] = ord(" ")
_LETTER = np.zeros(256, np.float32)
_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1


@dataclass
class Network:
    """Weights of both directions: input table (3 units x 256), recurrent (3 units x units), output (languages x units)."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.output, self.bias]


def new_network(languages: list[str], units: int = UNITS, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Network(
        languages,
        [draw(3 * units, 256, by=0.3) for _ in range(2)],
        [draw(3 * units, units, by=0.4 / np.sqrt(units)) for _ in range(2)],
        [draw(len(languages), units, by=0.3) for _ in range(2)],
        np.zeros(len(languages), np.float32),
    )


def _forward(codes: np.ndarray, tab: np.ndarray, rec: np.ndarray, keep: bool):
    """States after each position of codes (positions, windows); with keep, what backpropagation needs."""
    steps, n = codes.shape
    u = rec.shape[1]
    states = np.zeros((steps + 1, u, n), np.float32)
    x, g = np.empty((3 * u, n), np.float32), np.empty((3 * u, n), np.float32)
    kept = []
    for t in range(steps):
        h = states[t]
        np.take(tab, codes[t], axis=1, out=x, mode="clip")
        np.matmul(rec, h, out=g)
        gates = x[: 2 * u]
        gates += g[: 2 * u]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:u], gates[u:]
        new = states[t + 1]
        np.multiply(r, g[2 * u :], out=new)
        new += x[2 * u :]
        np.clip(new, -1, 1, out=new)
        if keep:
            kept.append((z.copy(), r.copy(), g[2 * u :].copy(), new.copy()))
        # h = new + z * (h - new)
        x[2 * u :] = h
        x[2 * u :] -= new
        x[2 * u :] *= z
        new += x[2 * u :]
    return states, kept


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    logit = net.output[0] @ forward
    logit += net.output[1] @ backward
    logit += net.bias[:, None]
    logit -= logit.max(0)
    np.exp(logit, out=logit)
    logit /= logit.sum(0)
    return logit


def pooled(net: Network, codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Sums, over each window's letter positions, of the probability of each language: (languages, windows)."""
    forward, _ = _forward(codes, net.tables[0], net.recurrent[0], False)
    backward, _ = _forward(codes[::-1], net.tables[1], net.recurrent[1], False)
    total = np.zeros((len(net.languages), codes.shape[1]), np.float32)
    steps = len(codes)
    for t in range(steps):
        p = _probabilities(net, forward[t + 1], backward[steps - t])
        p *= letters[t]
        total += p
    return total


def _backward(grads: np.ndarray, codes: np.ndarray, states: np.ndarray, kept, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights, through time. grads: of each position's state."""
    steps, n = codes.shape
    u = rec.shape[1]
    d_rec, d_in = np.zeros_like(rec), np.empty((steps, 3 * u, n), np.float32)
    later = np.zeros((u, n), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, g, new = kept[t]
        h = states[t]
        d = grads[t] + later
        d_z = d * (h - new) * ((z > 0) & (z < 1)) * 0.25
        d_new = d * (1 - z) * (np.abs(new) < 1)
        d_r = d_new * g * ((r > 0) & (r < 1)) * 0.25
        d_g = np.concatenate([d_z, d_r, d_new * r])
        d_rec += d_g @ h.T
        d_in[t, :u], d_in[t, u : 2 * u], d_in[t, 2 * u :] = d_z, d_r, d_new
        later = d * z + rec.T @ d_g
    flat = codes.ravel()
    d_tab = np.stack([np.bincount(flat, weights=d_in[:, i].ravel(), minlength=256) for i in range(3 * u)]).astype(np.float32)
    return d_tab, d_rec


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], units: int = UNITS, rounds: int = ROUNDS, seed: int = 1) -> Network:
    """windows: bytes (n, positions); label: place of each window's language. Cross-entropy at every letter."""
    net, rng = new_network(languages, units, seed), np.random.default_rng(seed)
    if len(languages) < 2 or not len(windows):
        return net
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    by_label = [np.flatnonzero(label == k) for k in range(len(languages))]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(rows, max(2, TRAIN_BATCH // len(languages))) for rows in by_label if len(rows)])
        raw = windows[pick].T
        codes, letters = _CODE[raw], _LETTER[raw]
        forward, kept_f = _forward(codes, net.tables[0], net.recurrent[0], True)
        backward, kept_b = _forward(codes[::-1], net.tables[1], net.recurrent[1], True)
        steps = len(codes)
        target = np.eye(len(languages), dtype=np.float32)[:, label[pick]]
        norm = 1 / max(1.0, float(letters.sum()))
        d_f, d_b = np.empty((steps, units, len(pick)), np.float32), np.empty((steps, units, len(pick)), np.float32)
        d_out, d_bias = [np.zeros_like(o) for o in net.output], np.zeros_like(net.bias)
        for t in range(steps):
            d = (_probabilities(net, forward[t + 1], backward[steps - t]) - target) * (letters[t] * norm)
            d_out[0] += d @ forward[t + 1].T
            d_out[1] += d @ backward[steps - t].T
            d_bias += d.sum(1)
            d_f[t], d_b[steps - 1 - t] = net.output[0].T @ d, net.output[1].T @ d
        tab_f, rec_f = _backward(d_f, codes, forward, kept_f, net.recurrent[0])
        tab_b, rec_b = _backward(d_b, codes[::-1], backward, kept_b, net.recurrent[1])
        rate = RATE * min(1, step / 20) * (1 - step / (rounds + 1))
        for p, g, (m, v) in zip(net.parts(), [tab_f, tab_b, rec_f, rec_b, *d_out, d_bias], moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _windows_of(n: int):
    """A sampled text's windows at evenly spread places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                for start in sorted({round((len(raw) - WINDOW) * i / max(1, n - 1)) for i in range(n)} if len(raw) > WINDOW else {0}):
                    part = raw[start : start + WINDOW]
                    if any(_LETTER[b] for b in part):
                        langs.append(lang)
                        out.append(part.ljust(WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "part"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, units: int = UNITS, rounds: int = ROUNDS) -> Network | None:
    """Learn from docs (text, lang): about `sample` texts of each language, picked by the hash of the text.

    Rows with a null lang or text are left out; without any row there is no network. Learned are values that one row
    in RAREST holds at least, so never more than RAREST, however many misspelt ones there are."""
    docs = docs.select("text", "lang").filter("lang is not null and text is not null")
    counts = saved(docs.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    learned = counts.filter(F.col("n") * RAREST >= total)
    languages = sorted(r["lang"] for r in learned.collect())
    shares = F.broadcast(learned.select("lang", F.least(F.lit(1.0), sample / F.col("n")).alias("share")))
    picked = docs.join(shares, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("text", "lang")
    got = mapped(picked, _windows_of(windows), "lang string, part binary").distinct().toArrow().to_pydict()  # a repeated text counts once
    rows = sorted(set(zip(got["part"], got["lang"], strict=True)))
    raw = np.frombuffer(b"".join(p for p, _ in rows), np.uint8).reshape(-1, WINDOW)
    return train(raw, np.array([languages.index(k) for _, k in rows], np.int64), languages, units, rounds)


def _predict(net: Network | None, least: float | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, raw, offs in text_chunks(batch.column("__text")):
                n = len(offs) - 1
                names, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                if net is not None and len(raw):
                    letter = _LETTER[raw]
                    weight = np.bincount(np.repeat(np.arange(n), np.diff(offs)), weights=letter, minlength=n)
                    ascii_ = np.bincount(np.repeat(np.arange(n), np.diff(offs)), weights=letter * (raw < 128), minlength=n)
                    for i in np.flatnonzero((weight > 0) & (ascii_ == 0)):  # a letter beyond ASCII, or only signs
                        if not any(c.isalpha() for c in bytes(raw[offs[i] : offs[i + 1]]).decode()):
                            weight[i] = 0
                    sums = _text_sums(net, raw, offs)
                    some = weight > 0
                    p = sums[:, some] / sums[:, some].sum(0)
                    best = p.argmax(0)
                    names[some] = np.array(net.languages, object)[best]
                    score[some] = p[best, np.arange(p.shape[1])]
                part = batch.slice(begin, n)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
                if least is None:
                    yield out
                else:
                    yield out.filter(pa.array((names != UNDETERMINED) & (score >= least)))

    return run


def _text_sums(net: Network, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(languages, texts): sums of the probabilities at letters, over all windows of each whole text."""
    sizes = np.diff(offs)
    pieces = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), pieces)
    start = np.repeat(offs[:-1], pieces) + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(start + WINDOW, np.repeat(offs[1:], pieces))
    sums = np.zeros((len(net.languages), len(sizes)))
    places = np.arange(WINDOW)[:, None]
    for i in range(0, len(text), BATCH):
        at = start[i : i + BATCH] + places
        inside = at < stop[i : i + BATCH]
        part = np.where(inside, raw[np.minimum(at, len(raw) - 1)], np.uint8(32))
        total = pooled(net, _CODE[part], _LETTER[part])
        for k in range(len(sums)):
            sums[k] += np.bincount(text[i : i + BATCH], weights=total[k], minlength=len(sizes))
    return sums


def identify(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), least: float | None = None) -> DataFrame:
    """keep..., lang_pred string, score double (mean probability of lang_pred over the text's letters).

    One row per row of docs; with `least`, only rows of a determined language scored at least that. Null texts, and
    texts without a letter, are `und` with score 0, as is everything without a network. Kept columns are passed on,
    nulls too; repeated rows are scored each, columns that aren't kept are dropped before any clash of names; an empty
    table gives no rows. Whole texts are read, in windows, whatever their length."""
    kept = docs.select(*keep, docs["text"].alias("__text"))
    schema = T.StructType([*(kept.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return mapped(kept, _predict(net, least, list(keep)), schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return identify(docs, fit(docs.filter("not held_out")), keep=("doc_id", "held_out"))
