"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest of short pieces (map side, so only sizes travel).
Pieces are dealt evenly over partitions; there, batches of bounded size are divided into windows of nearly
equal load: two partial partitions are merged with opposing imbalances, largest spread first, and the number
of windows rises as long as the fullest one exceeds the capacity.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.shared import mapped, saved, table

CAPACITY = 2048
#: Longest piece that a document's rest is cut into; it divides a window.
PIECE = 512
#: Pieces that one differencing run divides; bounds a task's memory.
BATCH = 2048
#: Pieces for each partition of the second step.
PIECES_A_PARTITION = 24_000
END_ID = 1
#: Share of the excess of the fullest window by which their number rises.
RISE = 0.3
#: Distinct words whose ids a task remembers.
CACHE = 400_000

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PACKED = _PIECES + ", sequence_id bigint, offset bigint"


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def byte_bpe(path: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit words, equal to the tokenizers library's.

    A space before a word belongs to the word, so the ids of a text are those of its space-separated parts;
    parts seen before are looked up, others go through tiktoken with the same vocabulary. Texts with runs of
    spaces or special strings are encoded whole by tokenizers."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    odd = re.compile("|".join(["  ", *map(re.escape, special)]))
    of = _byte_of_char()
    ranks = {bytes(of[c] for c in word): i for word, i in tok.get_vocab(with_added_tokens=False).items() if word not in special}
    parts = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
    seen: dict[str, bytes] = {}

    def pack(ids) -> bytes:
        return array("I", ids).tobytes()

    def encode(text: str) -> bytes:
        if odd.search(text):
            return pack(tok.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        out = [pack(parts(first))]
        for w in rest:
            ids = seen.get(w)
            if ids is None:
                if len(seen) >= CACHE:
                    seen.clear()
                ids = seen[w] = pack(parts(" " + w))
            out.append(ids)
        return b"".join(out)

    return encode


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of the pieces of a document of n ids: whole windows, pieces that divide a window, and what is left.

    Pieces of one size fill windows exactly, and the varied ends balance them."""
    full, rest = divmod(n, capacity)
    equal, end = divmod(rest, piece)
    return [capacity] * full + [piece] * equal + [end] * (end > 0)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, of k, that each size goes to, by largest differencing."""
    n = len(sizes)
    owner = np.arange(n)
    # a partial partition: its loads, largest first (zeros are left out), and an item that stands for each load
    heap = [(-int(s), i, np.array([int(s)]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both > 0:  # the smallest loads of a meet the smallest that b has left for them: opposing order
            lo = len(a) - both
            meet = slice(len(b) - 1, len(b) - 1 - both if len(b) > both else None, -1)
            owner[bt[meet]] = at[lo:]
            loads = np.concatenate([a[:lo], a[lo:] + b[meet], b[: len(b) - both]])
            names = np.concatenate([at, bt[: len(b) - both]])
        else:
            loads, names = np.concatenate([a, b]), np.concatenate([at, bt])
        order = np.argsort(-loads, kind="stable")
        loads, names = loads[order], names[order]
        spread = int(loads[0]) - (int(loads[-1]) if len(loads) == k else 0)
        tie += 1
        heapq.heappush(heap, (-spread, tie, loads, names))
    while True:
        up = owner[owner]
        if (up == owner).all():
            break
        owner = up
    return np.unique(owner, return_inverse=True)[1]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size (all from 1 to capacity), none above capacity; more windows until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = differencing(sizes, k)
        load = np.bincount(part, weights=sizes)
        if load.max() <= capacity or k >= len(sizes):
            return part
        k = max(k + 1, round(k * (1 + RISE * (load.max() - capacity) / capacity)))


def _pieces(path: str, end_id: int, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity, piece):
                    for to, x in zip(rows, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        to.append(x)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(capacity: int, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        following = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def divided(t: pa.Table) -> pa.Table:
            nonlocal following
            size = t.column("length").to_numpy()
            part = np.empty(len(size), np.int64)
            short = size < capacity
            part[~short] = np.arange((~short).sum())
            if short.any():
                part[short] = windows(size[short], capacity) + (~short).sum()
            order = np.lexsort((np.arange(len(size)), part))
            run_of = np.cumsum(size[order]) - size[order]
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            offset = run_of - np.repeat(run_of[first], np.diff(np.append(first, len(size))))
            out = t.take(pa.array(order)).append_column("sequence_id", pa.array(part[order] + following)).append_column("offset", pa.array(offset))
            following += int(part.max()) + 1
            return out

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= 2 * batch_size:
                t = pa.Table.from_batches(held)
                yield from divided(t.slice(0, batch_size)).to_batches()
                held, n = t.slice(batch_size).to_batches(), n - batch_size
        if n:
            t = pa.Table.from_batches(held)
            parts = -(-n // batch_size)
            for i in range(parts):
                yield from divided(t.slice(n * i // parts, n * (i + 1) // parts - n * i // parts)).to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty texts are the end id alone; a null doc_id stays null; repeated rows are packed each; an empty
    table gives no rows; other columns are not looked at. Very long texts are encoded whole, one at a time, and leave
    as rows of short pieces."""
    pieces = saved(mapped(docs.select("doc_id", "text"), _pieces(tokenizer, end_id, capacity, piece), _PIECES), "pieces")
    n = max(1, -(-pieces.count() // PIECES_A_PARTITION))
    return pieces.repartition(n).mapInArrow(_pack(capacity, batch), _PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
