"""Scoring by a probabilistic suffix tree over words.

The tree's states are contexts of up to `depth` previous words. The root is the whole vocabulary with one added
to each count. A longer context is a state if its next-word distribution diverges from that of its longest suffix.
A state's distribution is discounted counts of the next words seen with it `least` times that diverge from what the
suffix says, with the rest of the mass given to the next shorter state, so every distribution sums to 1 over the
vocabulary and one unknown word. A word is scored in the longest state that its history ends with.

Everything is counted over all training texts, and the least count is the same at every size: what the tree holds
grows with the corpus. Runs of words are named by 64-bit hashes. A run can be frequent only if both runs that are one
word shorter are; a first pass counts such runs by shortened names, packed in few bytes, and leaves a bit filter
without false negatives; a second pass counts those that the filter lets through, packed too. States and pairs (state, next word)
are saved tables. The log of a word's probability is a sum of terms: the root's, one for each state of its history,
and one for each pair that it makes with them. So the most used terms, as many as `HEAD`, are sent to the tasks, and
the others, like rare words, are looked up by shuffle and added for each text afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.shared import forget, mix, saved, table, text_chunks, words

DEPTH = 3
#: Least count of a pair, discount taken from each, and least divergence (nats a word) of a state.
LEAST, DISCOUNT, DIVERGENCE = 8, 0.75, 0.02
#: Least divergence (nats over all its uses) of a pair from what the shorter state says; others are left to that state.
PAIR_DIVERGENCE = 4.0
#: Bounds of what is sent to tasks: least share of the words, number of the terms, and 2^ bits of a filter.
WORD_SHARE, HEAD, FILTER = 2.5e-7, 1 << 22, 27
#: The end of a text, and what stands before its start.
END, START = np.uint64(0x1D), np.uint64(0x1C)
#: Words that a task counts before it passes the counts on, and words for each bucket of shortened names.
FLUSH, BUCKET = 1_000_000, 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _int(x: np.uint64) -> int:
    return int(np.uint64(x).view(np.int64))


def stream(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes with an end after each text, text of each word) of runs of whole texts."""
    for begin, raw, offs in text_chunks(column):
        h, doc = words(raw, offs)
        n = len(offs) - 1
        counts = np.bincount(doc, minlength=n)
        ends = np.cumsum(counts + 1) - 1
        out, of = np.full(len(h) + n, END, np.uint64), np.repeat(np.arange(n), counts + 1)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = h
        yield begin, out, of


def _longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a run from those of its two runs that are one word shorter."""
    with np.errstate(over="ignore"):
        return mix(left * _ODD + right)


def _runs(h: np.ndarray, doc: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text of each place, its distance from the text's start, for each length the run that ends there), with a start before each text."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    h, doc = np.insert(h, first, START), np.insert(doc, first, doc[first])
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    since = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    out = [h]
    for _ in range(1, upto):
        out.append(_longer(np.append(out[-1][:1], out[-1][:-1]), out[-1]))
    return doc, since, out


@dataclass
class Filter:
    """A bit for each place that names of 64 bits are put in by their first bits."""

    shift: int
    bits: np.ndarray

    def may(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(self.shift)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _filter(words_of_bits: DataFrame, size: int) -> Filter:
    """The filter from rows (at, bits): its 64-bit words that aren't zero, 2^(size - 6) of them at most."""
    at, bits = _arrays(words_of_bits.groupBy("at").agg(F.bit_or("bits").alias("bits")))
    out = np.zeros(1 << (size - 6), np.uint64)
    out[at] = bits.view(np.uint64)
    return Filter(64 - size, out)


def _bits(keys: DataFrame, size: int) -> DataFrame:
    """Rows (at, bits) of a table's keys."""
    place = F.shiftrightunsigned("key", 64 - size)
    return keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))").alias("bits"))


def _size(n: int, most: int) -> int:
    """Bits that name a place of a filter: eight places a key up to the bound; beyond, more keys pass that aren't in it."""
    return min(most, max(10, (8 * n).bit_length()))


@dataclass
class Index:
    """Sorted names and where those with the same first bits begin: names are spread evenly, so few share these."""

    keys: np.ndarray
    shift: int
    begins: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted name; -1 where it isn't among the keys."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = self.begins[wanted >> np.uint64(self.shift)].astype(np.int64)
        last = len(self.keys) - 1
        open_ = np.flatnonzero(self.keys[np.minimum(at, last)] < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] <= last]
            open_ = open_[self.keys[at[open_]] < wanted[open_]]
        at[(at > last) | (self.keys[np.minimum(at, last)] != wanted)] = -1
        return at


def _index(keys: np.ndarray) -> Index:
    bits = min(24, max(4, len(keys).bit_length()))
    begins = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return Index(keys, 64 - bits, begins.astype(np.int32))


@dataclass
class Tree:
    """What is sent to tasks: frequent words by hash, and the most used terms; the other terms are a table."""

    hashes: Index
    counts: np.ndarray
    total: int
    distinct: int
    #: Sorted names of states (inverted) and pairs, and their terms; the filter of all terms, those of the table too.
    keys: Index = field(default_factory=lambda: _index(np.zeros(0, np.uint64)))
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0))
    filter: Filter | None = None
    #: (key, term) of those that aren't sent.
    rest: DataFrame | None = None
    depth: int = 0

    def root_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def term(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms that are known here, which these are, and which are to be looked for in the table."""
        out, found_, open_ = np.zeros(len(keys)), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        if self.filter is not None:
            some = np.flatnonzero(self.filter.may(keys))
            at = self.keys.find(keys[some])
            missing = at < 0
            out[some[~missing]] = self.terms[at[~missing]]
            found_[some] = ~missing
            open_[some] = missing & (self.rest is not None)
        return out, found_, open_


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, passed on in sorted runs."""
    parts: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        parts.clear()
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], names=["word", "n"])

    n = 0
    for batch in batches:
        for _, h, _ in stream(batch.column("text")):
            parts.append(h)
            n += len(h)
            if n >= FLUSH:
                yield from flush()
                n = 0
    if n:
        yield from flush()


def _candidates(shorter: Filter, h: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places where runs of m words end whose two shorter runs may be frequent, and the runs by length."""
    _, since, runs = _runs(h, doc, m)
    may = shorter.may(runs[m - 2])
    return np.flatnonzero((since >= m - 1) & may & np.append(False, may[:-1])), runs


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers as differences, and their counts, byte place by byte place: the upper ones are zeros, which compress."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(blob, np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(rows[:8].T).view(np.uint64).ravel()), np.ascontiguousarray(rows[8:].T).view(np.uint32).ravel()


def _cuts(keys: np.ndarray, bits: int, buckets: int) -> list[int]:
    """Where the buckets of rising names of so many bits begin, and the end."""
    of = _bucket(keys, bits, buckets)
    return [*np.flatnonzero(np.diff(of, prepend=np.uint64(1 << 63))).tolist(), len(keys)]


def _bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return keys >> np.uint64(bits - buckets) if buckets else np.zeros(len(keys), np.uint64)


def _dealt(keys: np.ndarray, bits: int, buckets: int, blobs: list[bytes]) -> pa.RecordBatch:
    """Packed rows by the bucket of a name of each."""
    return pa.RecordBatch.from_arrays([pa.array(_bucket(keys, bits, buckets).astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed rows of each bucket, of batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield held


def _shortened(shorter, m: int, bits: int, buckets: int):
    """Packed counts of candidates of m words by the first bits of their names, a row for each bucket of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            cuts = _cuts(keys, bits, buckets)
            return _dealt(keys[cuts[:-1]], bits, buckets, [_packed(keys[i:j], counts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])

        n = 0
        for batch in batches:
            for _, h, doc in stream(batch.column("text")):
                some, runs = _candidates(shorter.value, h, doc, m)
                parts.append(runs[m - 1][some] >> np.uint64(64 - bits))
                n += len(some)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def _frequent(least: int, bits: int, size: int):
    """The filter's words (at, bits) of the shortened names counted `least` times, bucket by bucket."""

    def words_of(blobs: list[bytes]) -> pa.RecordBatch:
        keys, counts = (np.concatenate(c) for c in zip(*map(_unpacked, blobs), strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        many = np.add.reduceat(counts[order].astype(np.int64), first) >= least
        place = keys[first[many]] >> np.uint64(bits - size) if bits >= size else keys[first[many]] << np.uint64(size - bits)
        if not len(place):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["at", "bits"])
        at = place >> np.uint64(6)
        begin = np.flatnonzero(np.diff(at, prepend=~at[:1]))
        word = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), begin)
        return pa.RecordBatch.from_arrays([pa.array(at[begin].view(np.int64)), pa.array(word.view(np.int64))], names=["at", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(words_of, _by_bucket(batches))

    return run


def _packed_runs(p: np.ndarray, s: np.ndarray, counts: np.ndarray) -> bytes:
    """Runs by the names of their two shorter ones, and their counts, byte place by byte place; the first names rise."""
    return _packed(p, counts) + s.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = len(blob) // 20 * 12
    p, counts = _unpacked(blob[:cut])
    return p, np.ascontiguousarray(np.frombuffer(blob[cut:], np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), counts


def _count_runs(shorter, own, m: int, buckets: int):
    """Packed counts of runs of m words that may be frequent, a row for each bucket of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            keys, p, s = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            p, s = p[first], s[first]
            order = np.lexsort((p, _bucket(keys, 64, buckets)))  # a word begins many runs: equal names lie together
            cuts = _cuts(keys, 64, buckets)
            blobs = [_packed_runs(p[x], s[x], counts[x]) for x in (order[i:j] for i, j in zip(cuts, cuts[1:], strict=False))]
            return _dealt(keys[cuts[:-1]], 64, buckets, blobs)

        n = 0
        for batch in batches:
            for _, h, doc in stream(batch.column("text")):
                some, runs = _candidates(shorter.value, h, doc, m)
                some = some[own.value.may(runs[m - 1][some])]
                parts.append((runs[m - 1][some], runs[m - 2][some - 1], runs[m - 2][some]))
                n += len(some)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def _frequent_runs(least: int):
    """(key, p, s, n) of the runs counted `least` times, bucket by bucket."""

    def rows_of(blobs: list[bytes]) -> pa.RecordBatch:
        p, s, counts = (np.concatenate(c) for c in zip(*map(_unpacked_runs, blobs), strict=True))
        keys = _longer(p, s)
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        n = np.add.reduceat(counts[order].astype(np.int64), first)
        at = order[first[n >= least]]
        return pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in (keys, p, s)), pa.array(n[n >= least])], names=["key", "p", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(rows_of, _by_bucket(batches))

    return run


def _buckets(total: int) -> int:
    """Bits that name a bucket, of that many words in all."""
    return min(20, max(0, (total // BUCKET).bit_length()))


def _run_filter(texts: DataFrame, shorter, m: int, least: int, total: int, most: int) -> Filter:
    """The filter of the runs of m words that are seen `least` times."""
    size = _size(total, most)
    # names are cut to so many bits that few of them meet at this number of words
    bits = min(64, max(size, total.bit_length() + 8))
    buckets = _buckets(total)
    packed = texts.select("text").mapInArrow(_shortened(shorter, m, bits, buckets), "bucket int, blob binary")
    return _filter(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(least, bits, size), "at bigint, bits bigint"), size)


def _score(shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            for begin, h, doc in stream(batch.column("text")):
                n = int(doc[-1]) + 1
                ids = tree.hashes.find(h)
                known = ids >= 0
                root = np.full(len(h), tree.root_log(np.zeros(1))[0])
                root[known] = tree.root_log(tree.counts[ids[known]])
                of, since, runs = _runs(h, doc, depth + 1)
                log = np.bincount(doc, weights=root, minlength=n)
                base = log.copy()
                far, far_of = [h[~known]], [doc[~known]]
                for d in range(1, depth + 1):
                    at = np.flatnonzero(since >= d)
                    for pair in (False, True):
                        keys = runs[d][at] if pair else ~runs[d - 1][at - 1]
                        term, found, open_ = tree.term(keys)
                        log += np.bincount(of[at], weights=term, minlength=n)
                        far.append(keys[open_])
                        far_of.append(of[at[open_]])
                        at = at[found | open_]  # a pair has a term only if its state has one
                rare, rare_of = np.concatenate(far), np.concatenate(far_of)
                order = np.lexsort((rare, rare_of))
                rare, rare_of = rare[order], rare_of[order]
                new = np.diff(rare_of, prepend=-1) != 0
                new[1:] |= rare[1:] != rare[:-1]
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                edges = np.searchsorted(rare_of[first], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(begin, n) for c in ("rid", "doc_id", "held_out")),
                        pa.array(np.bincount(doc, minlength=n)),
                        pa.array(np.bincount(doc, weights=known, minlength=n).astype(np.int64)),
                        pa.array(base),
                        pa.array(log),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(rare[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(times.astype(np.int32))),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    return run


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """Columns of a table of bounded size."""
    t = df.toArrow()
    return [c.combine_chunks().to_numpy(zero_copy_only=False) for c in t.columns]


def fit(texts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, least: int = LEAST, head: int = HEAD, bits: int = FILTER) -> tuple[Tree, DataFrame]:
    """The tree, and the counts of all words (word, n) as a saved table. head and bits only tell what is sent to tasks."""
    spark = texts.sparkSession
    counted = saved(texts.select("text").mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    total, distinct, ends = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == _int(END), F.col("n"))), F.lit(0))).first()
    h, n = _arrays(counted.filter(F.col("n") >= max(1.0, WORD_SHARE * total)))
    h = h.view(np.uint64)
    order = np.argsort(h)
    tree = Tree(_index(h[order]), n[order], total, distinct, depth=depth)
    if not total:
        return tree, counted
    root = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    starts = spark.range(1).select(F.lit(_int(START)).alias("word"), F.lit(ends).cast("long").alias("n"))
    # runs of a length: count, and log10 of the last word in the context before it and in its longest state
    level = counted.unionByName(starts).filter(F.col("n") >= least).select(F.col("word").alias("key"), "n", root.alias("plain"), root.alias("final"))
    size = _size(distinct, bits)
    shorter = spark.sparkContext.broadcast(_filter(_bits(level.select("key"), size), size))
    terms = None
    for m in range(2, depth + 2):
        own = spark.sparkContext.broadcast(_run_filter(texts, shorter, m, least, total, bits))
        packed = texts.select("text").mapInArrow(_count_runs(shorter, own, m, _buckets(total)), "bucket int, blob binary")
        seen = saved(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent_runs(least), "key bigint, p bigint, s bigint, n bigint"), "runs")
        shorter.unpersist()
        shorter = own
        lower = level.select(F.col("key").alias("s"), F.col("plain").alias("below"), F.col("final").alias("below_final"))
        context = level.select(F.col("key").alias("p"), F.col("n").alias("uses"))
        pair = seen.join(lower, "s").join(context, "p").withColumn("prob", (F.col("n") - DISCOUNT) / F.col("uses"))
        gain = F.ln("prob") - F.col("below") * np.log(10)
        pair = saved(pair.select("key", "p", "n", "uses", "below", "below_final", "prob", (F.abs(F.col("n") * gain) >= PAIR_DIVERGENCE).alias("kept")), "pairs")
        forget(seen)
        one = lambda x: F.greatest(F.lit(1e-9), F.lit(1.0) - x)
        sums = pair.filter("kept").groupBy("p").agg(
            F.first("uses").alias("n"),
            one(F.sum("prob")).alias("rest"),
            one(F.sum(F.pow(F.lit(10.0), "below"))).alias("left"),
            one(F.sum(F.pow(F.lit(10.0), "below_final"))).alias("left_final"),
            F.sum(F.col("prob") * gain).alias("gain"),
        )
        states = saved(sums.filter(F.col("gain") + F.col("rest") * F.ln(F.col("rest") / F.col("left")) >= divergence).select("p", "n", F.log10(F.col("rest") / F.col("left_final")).alias("rest_log")), "states")
        plain = F.log10("prob")
        level = saved(
            pair.join(states.select("p", "rest_log"), "p", "left").select(
                "key", "n", plain.alias("plain"), F.when(F.col("kept") & F.col("rest_log").isNotNull(), plain).otherwise(F.col("below_final") + F.coalesce("rest_log", F.lit(0.0))).alias("final"),
                F.when(F.col("kept"), plain - F.col("below_final") - F.col("rest_log")).alias("term"),
            ),
            "level",
        )
        forget(pair)
        both = states.select(F.bitwise_not("p").alias("key"), "n", F.col("rest_log").alias("term")).unionByName(level.filter("term is not null").select("key", "n", "term"))
        terms = both if terms is None else terms.unionByName(both)
    shorter.unpersist()
    if terms is not None:
        _send(tree, terms, head, bits)
    return tree, counted


def _send(tree: Tree, terms: DataFrame, head: int, bits: int) -> None:
    """Put the most used terms into the tree, as many as the bound allows, and leave the others in the table."""
    often, many = _arrays(terms.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n")))
    fit_in = np.cumsum(many) <= head
    least = int(often[fit_in][-1]) if fit_in.any() else int(often[0]) + 1 if len(often) else 0
    key, term = _arrays(terms.filter(F.col("n") >= least).select("key", "term"))
    order = np.argsort(key.view(np.uint64))
    size = _size(int(many.sum()), bits)
    tree.keys, tree.terms, tree.filter = _index(key.view(np.uint64)[order]), term[order], _filter(_bits(terms.select("key"), size), size)
    tree.rest = None if fit_in.all() else terms.filter(F.col("n") < least).select("key", "term")


def score(docs: DataFrame, tree: Tree, counted: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text, held_out).

    Scores are log10 probabilities of whole texts. Null and empty texts are one end each; very long texts are read
    whole, one at a time; repeated rows are scored each; null ids are passed on; other columns are not looked at; an
    empty table gives no rows; without any training text all words are unknown, with probability 1."""
    spark = docs.sparkSession
    sent = replace(tree, rest=None if tree.rest is None else True)
    shared = spark.sparkContext.broadcast(sent)
    known = saved(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(
            _score(shared, tree.depth), "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, times array<int>"
        ),
        "scores",
    )
    rare = known.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    # tasks have taken each word that they don't have for an unknown one
    far = counted.select(F.col("word").alias("key"), F.log10(F.col("n") + 1).alias("term"), F.lit(True).alias("is_word"))
    if tree.rest is not None:
        far = far.unionByName(tree.rest.withColumn("is_word", F.lit(False)))
    part = F.col("times") * F.col("term")
    tail = (
        rare.join(far, "key")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("is_word"), F.col("times")).otherwise(0)).cast("long").alias("tail_known"),
            F.sum(F.when(F.col("is_word"), part).otherwise(0.0)).alias("tail_base"),
            F.sum(part).alias("tail"),
        )
    )
    return known.join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    tree, counted = fit(docs.filter(~F.col("held_out")))
    return score(docs, tree, counted)
