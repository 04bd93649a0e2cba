"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Encoding reads symbols, holds a buffer, and emits a token once no later symbol can change it. Which tokens are
settled follows from the merge list: rules apply in rank order, so the last known token can be claimed from the
right only by a rule that has it as left part. Such a claim passes the doubt to the token before it, which can be
claimed only by a later rule, one whose right part begins with the doubtful token. The heaviest chain of rules that
may follow each other so is the lookahead that suffices for the merge list, whatever the text; it is computed when
the list is compiled, and the machine never holds more than that and one symbol before it emits.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridledger.llm.shared import table

#: Symbols in doubt at which a machine looks first for settled tokens.
FIRST = 4
NEVER = 1 << 40
#: Words whose ids a task remembers, and the longest of them in characters.
CACHE, CACHE_CHARS = 300_000, 64
#: Runs of symbols whose test or merging a task remembers, and the longest of them: words begin and end alike far oftener than they are alike.
RUNS, RUN = 1 << 17, 8
#: Characters of a text that are normalised and split at once.
SPAN = 1 << 16

#: The characters with the Unicode property White_Space, which separate words.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Fixed value: the pattern of word pieces in the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list, compiled: rules by pair of token ids, and for each token the ranks at which it can be claimed from the right."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        self.vocab, self.end = vocab, end
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        made: set[str] = set()
        left: dict[int, list[int]] = defaultdict(list)
        for rank, (a, b) in enumerate(merges):
            if (a + b) in made:
                raise ValueError(f"two rules make {a + b}: not a proper merge list")
            made.add(a + b)
            self.rules[vocab[a], vocab[b]] = rank, vocab[a + b]
            left[vocab[a]].append(rank)
        self.claims = dict(left)
        halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        #: Ranks at which a token can be claimed by a right part that begins with a token: of all rules (left, right), by each token of right's left edge.
        self.chained: dict[tuple[int, int], list[int]] = defaultdict(list)
        #: Symbols after which the tokens before them are settled for any text: the heaviest chain of claims. heaviest: by the rules so far, of those with this left part.
        self.lookahead, heaviest = 0, defaultdict(int)
        for rank, (a, b) in enumerate(merges):
            edge, later = vocab[b], 0
            while True:
                self.chained[vocab[a], edge].append(rank)
                later = max(later, heaviest[edge])
                if edge not in halves:
                    break
                edge = halves[edge][0]
            weight = len(a.removesuffix(end) if end else a) + later
            heaviest[vocab[a]] = max(heaviest[vocab[a]], weight)
            self.lookahead = max(self.lookahead, weight)
        #: The same rules by one number, for short words; the symbols of a token that a rule makes (others are one).
        self.ranks = {a << 20 | b: rank for (a, b), (rank, _) in self.rules.items()}
        self.made = [vocab[a + b] for a, b in merges]
        self.symbols: dict[int, int] = {}
        for a, b in merges:
            self.symbols[vocab[a + b]] = self.symbols.get(vocab[a], 1) + self.symbols.get(vocab[b], 1)
        #: What a task remembers of short runs.
        self.tested = lru_cache(RUNS)(self._settled_short)
        self.merged = lru_cache(RUNS)(self._merge_short)

    def _merge_short(self, symbols: Sequence[int]) -> list[int]:
        """merge() of few symbols, by the least rank in a list."""
        get, made, out = self.ranks.get, self.made, list(symbols)
        ranks = [get(a << 20 | b, NEVER) for a, b in pairwise(out)]
        while ranks and (rank := min(ranks)) < NEVER:
            i = ranks.index(rank)
            out[i : i + 2] = [made[rank]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(out[i] << 20 | out[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(out[i - 1] << 20 | out[i], NEVER)
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of a whole sequence of symbols."""
        n = len(symbols)
        rules = self.rules
        if n < 24:
            return list(self.merged(tuple(symbols))) if n <= RUN else self._merge_short(symbols)
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rules[p], i) for i, p in enumerate(pairwise(token)) if p in rules]
        heap = [(rank, i, token[i], token[i + 1]) for rank, _, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue
            token[i], token[j] = rules[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rules.get((token[x], token[y]))):
                    heapq.heappush(heap, (found[0], x, token[x], token[y]))
        return [t for t in token if t >= 0]

    def _settled_short(self, symbols: Sequence[int]) -> tuple[list[int], int]:
        """settled() for few symbols, by the least rank in a list; tokens that doubt reaches leave the list's end."""
        get, claims_of, chained = self.ranks.get, self.claims.get, self.chained.get
        out = list(symbols)
        ranks = [get(a << 20 | b, NEVER) for a, b in pairwise(out)]
        edge, rank = -1, -1  # the token in doubt next to the list's last, and the rank up to which the list is known
        while True:
            r = min(ranks) if ranks else NEVER
            while True:
                claims = claims_of(out[-1]) if edge < 0 else chained((out[-1], edge))
                if not claims or claims[-1] <= rank:
                    break
                first = claims[bisect_right(claims, rank)]
                if first >= r:
                    break
                rank, edge = first, out.pop()
                if not ranks:
                    return out, 0  # the first token is in doubt
                if ranks.pop() == r:
                    r = min(ranks) if ranks else NEVER
            if r == NEVER:
                return out, sum([self.symbols.get(t, 1) for t in out])
            i = ranks.index(r)
            out[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(out[i] << 20 | out[i + 1], NEVER)
            else:
                rank = max(rank, r)  # the joined token exists only from this rank on
            if i:
                ranks[i - 1] = get(out[i - 1] << 20 | out[i], NEVER)

    def settled(self, symbols: list[int]) -> tuple[list[int], int]:
        """The tokens of a prefix that no continuation can change, and the number of symbols in it."""
        n = len(symbols)
        if 0 < n < 24:
            return self.tested(tuple(symbols)) if n <= RUN else self._settled_short(symbols)
        rules, claims, chained = self.rules, self.claims, self.chained
        token = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[p][0], i, token[i], token[i + 1]) for i, p in enumerate(pairwise(token)) if p in rules]
        heapq.heapify(heap)
        edge, rank = n, -1  # symbols before edge are known up to that rank
        last = n - 1

        def doubt(upto: int) -> None:
            """Let the doubt move left through every claim of a rank before `upto`."""
            nonlocal edge, rank, last
            while last >= 0:
                ranks = claims.get(token[last]) if edge == n else chained.get((token[last], token[edge]))
                k = bisect_right(ranks, rank) if ranks else 0
                if not ranks or k == len(ranks) or ranks[k] >= upto:
                    return
                rank, edge, last = ranks[k], last, before[last]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if i >= edge or token[i] != a:
                continue
            doubt(r)
            j = after[i]
            if i >= edge or j >= edge or token[j] != b:
                continue
            token[i], token[j] = rules[a, b][1], -1
            if last == j:
                last = i
                # the joined token exists only from this rank on
                rank = max(rank, r)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < edge and (found := rules.get((token[x], token[y]))):
                    heapq.heappush(heap, (found[0], x, token[x], token[y]))
        doubt(1 << 60)
        return [token[i] for i in range(edge) if token[i] >= 0], edge


class Transducer:
    """Bytes in, settled tokens out. A test of what is settled comes at the first few symbols and whenever those in doubt have
    doubled since the last one, but at the latest with one symbol more than the lookahead held, of which some are
    settled. So the merge list alone bounds what is held, whatever the word's length."""

    def __init__(self, merges: Merges, first: int = FIRST) -> None:
        self.merges, self.first = merges, first
        chars = byte_chars()
        #: The symbol of each byte, inside a word and as its last.
        self.inner, self.last = [merges.vocab[c] for c in chars], [merges.vocab[c + merges.end] for c in chars]
        #: Symbols in doubt, the newest byte, which may turn out to be the last, and the number of symbols at which to test.
        self.held: list[int] = []
        self.newest = -1
        self.wait = first

    def feed(self, raw: bytes) -> list[int]:
        """Take bytes of the current word; the newest is kept back."""
        out: list[int] = []
        held, inner, newest, wait = self.held, self.inner, self.newest, self.wait
        for byte in raw:
            if newest >= 0:
                held.append(inner[newest])
                if len(held) >= wait:
                    tokens, used = self.merges.settled(held)
                    if used:
                        out += tokens
                        del held[:used]
                    wait = min(max(self.first, 2 * len(held)), self.merges.lookahead + 1)
            newest = byte
        self.newest, self.wait = newest, wait
        return out

    def finish(self) -> list[int]:
        """End the word."""
        if self.newest < 0:
            return []
        symbols = [*self.held, self.last[self.newest]]
        self.held, self.newest, self.wait = [], -1, self.first
        return self.merges.merge(symbols)


class Decoder:
    """Ids in, text out. With bytes: a UTF-8 machine that holds back an unfinished character; otherwise the
    vocabulary's own strings with spaces between, which is what a file without a decoder means."""

    def __init__(self, names: dict[int, str], specials: set[str], as_bytes: bool) -> None:
        self.names, self.specials, self.as_bytes = names, specials, as_bytes
        self.of = {c: b for b, c in enumerate(byte_chars())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        names = [self.names[i] for i in ids if i in self.names]
        if not names:
            return ""
        if self.as_bytes:
            return "".join(x if x in self.specials else self.utf8.decode(bytes(map(self.of.__getitem__, x))) for x in names)
        begun, self.begun = self.begun, True
        return " " * begun + " ".join(names)

    def finish(self) -> str:
        rest, self.begun = self.utf8.decode(b"", True) if self.as_bytes else "", False
        self.utf8.reset()
        return rest


class Codec:
    """Encoder and decoder of a word-level tokenizer file: NFC, white space dropped, lower case, words with ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: w for w, i in model["vocab"].items()} | {i: w for w, i in self.special.items()}
        self.as_bytes = bool(spec["decoder"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces, self.white, self.control = regex.compile(PIECES), regex.compile(WHITE), regex.compile(r"[\x1c-\x1f]")
        self.machine = Transducer(self.merges)
        self.decoder = Decoder(self.names, set(self.special), self.as_bytes)
        #: Words coded lately, and those before them.
        self.seen: dict[str | int, tuple[bytes, str]] = {}
        self.older: dict[str | int, tuple[bytes, str]] = {}
        #: Short pieces are parts of many parts.
        self.short = lru_cache(CACHE)(self.piece)

    def piece(self, piece: str) -> list[int]:
        """The ids of a word of the merge list."""
        return self.machine.feed(piece.encode()) + self.machine.finish()

    def word(self, part: str) -> list[int]:
        """The ids of a part without white space."""
        ids = []
        for piece in (part,) if part.isalpha() else self.pieces.findall(part):
            ids += self.short(piece) if len(piece) <= CACHE_CHARS else self.piece(piece)
        return ids

    def parts(self, text: str) -> Iterator[str | int]:
        """Parts between white space, normalised, and the ids of special strings, a span of the text at a time."""
        for segment in self.marks.splititer(text) if self.marks else [text]:
            if segment in self.special:
                yield self.special[segment]
                continue
            at, n = 0, len(segment)
            while at < n:
                end = at + SPAN
                if end < n:
                    gap = self.white.search(segment, end)
                    end = gap.start() if gap else n
                span, at = unicodedata.normalize("NFC", segment[at:end]), end
                # sigma is lower-cased letter by letter, without regard to the word's end
                span = "".join(c.lower() for c in span) if "Σ" in span else span.lower()
                # str.split() also splits at four control characters that are no white space here
                yield from filter(None, self.white.split(span)) if self.control.search(span) else span.split()

    def code(self, text: str) -> tuple[bytes, str]:
        """Ids as 32-bit words, and decoded text. Both machines are at their start again after each part, so parts can be looked up."""
        ids, texts, seen = [], [], self.seen
        for part in self.parts(text):
            known = seen.get(part) or self.older.get(part)
            if known is None:
                own = [part] if isinstance(part, int) else self.word(part)
                known = array("i", own).tobytes(), self.decoder.feed(own) + self.decoder.finish()
                if isinstance(part, int) or len(part) <= CACHE_CHARS:
                    if len(seen) >= CACHE:
                        self.older = seen
                        seen = self.seen = {}
                    seen[part] = known
            if known[0]:
                ids.append(known[0])
                texts.append(known[1])
        return b"".join(ids), ("" if self.as_bytes else " ").join(texts)


@lru_cache(2)
def codec_of(path: str) -> Codec:
    """One for each file and Python worker, so that words stay known from task to task."""
    return Codec(path)


def _code(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            column, begin, flat, ends, texts = batch.column("__text"), 0, bytearray(), [0], []
            for i, text in enumerate(column):
                ids, back = codec.code(text.as_py() or "")
                flat += ids
                ends.append(len(flat) // 4)
                texts.append(back)
                if len(flat) > 2_000_000 or i + 1 == len(column):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(bytes(flat))]))
                    part = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(texts, pa.string())], names=[*keep, "ids", "decoded"])
                    begin, flat, ends, texts = i + 1, bytearray(), [0], []

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., ids array<int>, decoded string: one row per row of docs, in no order.

    Null and empty texts give no ids and the empty string; kept columns are passed on, nulls too; others are
    dropped before any clash of names; an empty table gives no rows; repeated rows stay repeated."""
    kept = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*(kept.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(_code(tokenizer, list(keep)), schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).selectExpr(
        "doc_id", "cast(size(ids) as bigint) as n_tokens", "sha2(array_join(ids, ' '), 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256"
    )
