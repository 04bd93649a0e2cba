"""Tokenizing, packing, scoring, classifiers, personal data and quotations against brute force or held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridledger.llm import bpe, language_id, packing, private_data, quality, quotations, suffix_tree
from gridledger.llm.shared import table
from tests.conftest import SF

DOCS = "doc_id bigint, text string"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b", "a   b", " x", "x ", "\n a", "a\n b", "a \n b", "Hello<|endoftext|> x<|startoftext|>", "it's 12 o'clock we'LL", "é ü  ñ é İx ΑΣ ΣΑΣ",
    "\x85a\xa0b c　d​e", "\x1ca\x1cb \x1d", "😀👍🏽 ok ½ Ⅷ ٣", "a" * 3000, "ab" * 1500, "!?" * 900, "lo" * 2000 + "l", "<|ENDOFTEXT|>",
    "".join(random.Random(1).choice("aeinrst") for _ in range(4000)), "".join(random.Random(2).choice("abcdeéß!?") for _ in range(3000)),
]


def texts(spark) -> list[tuple]:
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    return [*rows, *((10_000 + i, t) for i, t in enumerate(ODD)), (20_000, None), (None, "no id"), (20_001, rows[0][1]), (20_001, rows[0][1])]


def test_encoding_is_the_library(spark):
    rows = texts(spark)
    tok = Tokenizer.from_file(WORD)
    got = bpe.encode(spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS + ", ids string"), WORD).collect()
    want = [(d, tok.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    assert sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in got) == sorted((d or -1, ids, tok.decode(ids, skip_special_tokens=False)) for d, ids in want)
    assert bpe.encode(spark.createDataFrame([], DOCS), WORD).count() == 0


@pytest.mark.parametrize("first", [1, 4, 16, 64])
def test_transducer_emits_early_and_right(first):
    merges = bpe.codec_of(WORD).merges
    for text in ODD[-8:]:
        raw, machine, out, held = text.lower().encode(), bpe.Transducer(merges, first), [], 0
        for b in raw:
            out += machine.feed(bytes([b]))
            held = max(held, len(machine.held))
        early = len(out)
        out += machine.finish()
        assert out == merges.merge([*(machine.inner[b] for b in raw[:-1]), machine.last[raw[-1]]])
        assert held <= merges.lookahead
        if len(raw) > 1000:
            assert early > 0 and held < len(raw)


def test_lookahead_suffices_for_any_merge_list():
    """For random merge lists and all continuations of random prefixes: what is settled stays, and no more is held back than the lookahead."""
    rng = random.Random(11)
    early = 0
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(1, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        compiled = bpe.Merges({t: i for i, t in enumerate(tokens)}, merges)
        for _ in range(12):
            prefix = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
            settled, used = compiled.settled(prefix)
            assert len(prefix) - used <= compiled.lookahead
            early += used > 0
            for _ in range(60):
                more = [rng.randrange(3) for _ in range(rng.randrange(0, 14))]
                assert compiled.merge(prefix + more)[: len(settled)] == settled
    assert early > 300


def test_the_query_runs_the_machine(monkeypatch):
    calls, codec = [], bpe.Codec(WORD)
    settled = codec.merges.settled
    monkeypatch.setattr(codec.merges, "settled", lambda symbols: calls.append(len(symbols)) or settled(symbols))
    codec.code("a few unquestionably incomprehensible words https://example.org/some/path and " + "x" * 5000)
    assert len(calls) > 3 and max(calls) <= codec.merges.lookahead + 1


def test_short_words_go_through_the_machine_and_emit_early(spark, monkeypatch):
    """Every word of more than four symbols is tested for settled tokens, and most such words of the documents emit some before they end."""
    codec = bpe.Codec(WORD)
    machine, tested = codec.machine, []
    settled = codec.merges.settled
    monkeypatch.setattr(codec.merges, "settled", lambda symbols: tested.append(1) or settled(symbols))
    words = sorted({p for _, t in texts(spark) for p in codec.parts(t or "") if isinstance(p, str) and p.isalpha()})
    early = long = 0
    for word in words:
        raw, before = word.encode(), len(tested)
        out = machine.feed(raw)
        early += bool(out)
        long += len(raw) > bpe.FIRST
        assert (len(tested) > before) == (len(raw) > bpe.FIRST)
        assert out + machine.finish() == codec.merges.merge([*(machine.inner[b] for b in raw[:-1]), machine.last[raw[-1]]])
    assert 2 * early > long > 500


def test_short_and_long_paths_settle_alike():
    """The list for few symbols and the heap for many give the same settled tokens."""
    merges, rng = bpe.codec_of(WORD).merges, random.Random(5)
    inner = bpe.Transducer(merges).inner
    for _ in range(400):
        symbols = [inner[b] for b in rng.choices(b"aeinrst", k=rng.randrange(24, 40))]
        assert merges.settled(symbols) == merges._settled_short(symbols)


def test_merge_list_must_be_proper():
    vocab = {x: i for i, x in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    with pytest.raises(ValueError, match="proper"):
        bpe.Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_byte_decoder_holds_back_unfinished_characters():
    spec = Tokenizer.from_file(BYTE)
    names = {i: w for w, i in spec.get_vocab().items()}
    decoder = bpe.Decoder(names, {"<|endoftext|>"}, True)
    text = "naïve 😀 日本<|endoftext|>"
    parts = [decoder.feed([i]) for i in spec.encode(text, add_special_tokens=False).ids]
    assert "".join(parts) + decoder.finish() == text
    assert "�" not in "".join(parts)


def test_packing(spark):
    rows = texts(spark)
    tok = Tokenizer.from_file(BYTE)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows if d != 20_001}
    got = [r for r in packing.pack(spark.createDataFrame(rows, DOCS), BYTE).collect()]
    for r in got:
        if r["doc_id"] in ids:
            own = ids[r["doc_id"]]
            part = own[r["start"] : r["start"] + r["length"]]
            assert (r["doc_tokens"], len(part), r["ids_crc32"]) == (len(own), r["length"], zlib.crc32(np.array(part, "<u4").tobytes()))
    for d, own in ids.items():
        pieces = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) == len(own)
    windows: dict[int, list] = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert sum(r["length"] for r in got) > 0.95 * 2048 * len(windows)
    assert packing.pack(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_differencing_is_near_equal_and_windows_rise():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 600)
    loads = np.bincount(packing.differencing(sizes, 40), weights=sizes)
    assert len(loads) == 40 and loads.max() - loads.min() <= 0.03 * loads.mean()
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    tight = np.full(9, 1500)
    assert packing.windows(tight).max() + 1 == 9  # two of them don't fit a window


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["\0end"]


def test_scores(spark):
    rows = [*texts(spark)[:200], (901, None), (902, ""), (903, "new words only zzz"), (904, "a " * 30_000)]
    docs = spark.createDataFrame([(d, t, d % 7 == 2) for d, t in rows], DOCS + ", held_out boolean")
    tree, counted = suffix_tree.fit(docs.filter("not held_out"), least=3)
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, counted).collect()}
    counts = Counter(w for d, t in rows if d % 7 != 2 for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    sums = [0.0, 0.0]
    for d, t in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t))
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words(t)), sum(counts[w] > 0 for w in words(t)), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if d % 7 == 2:
            sums[0] += r["base_score"]
            sums[1] += r["score"]
    assert sums[1] > sums[0]  # the contexts help on texts that were not learned
    empty = spark.createDataFrame([], DOCS + ", held_out boolean")
    assert suffix_tree.score(empty, *suffix_tree.fit(empty)).count() == 0
    assert suffix_tree.score(docs.limit(3), *suffix_tree.fit(empty)).filter("n_known = 0").count() == 3


class BruteTree:
    """The suffix tree of token lists, by plain counting."""

    def __init__(self, lists: list[list[str]], depth: int, divergence: float, least: int) -> None:
        self.counts = Counter(w for t in lists for w in t)
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        runs = [Counter(tuple(t[i : i + m]) for t in (["\0start", *t] for t in lists) for i in range(len(t) - m + 1)) for m in range(1, depth + 2)]
        plain = {r: self.root(r[0]) for r, n in runs[0].items() if n >= least}
        final, uses = dict(plain), {r: n for r, n in runs[0].items() if n >= least}
        self.depth, self.rest, self.pairs = depth, {}, {}
        for m in range(2, depth + 2):
            followers: dict[tuple, dict] = {}
            for r, n in runs[m - 1].items():
                if n >= least:
                    followers.setdefault(r[:-1], {})[r] = (n - 0.75) / uses[r[:-1]]
            probs = {r: q for own in followers.values() for r, q in own.items()}
            for p, all_own in followers.items():
                own = {r: q for r, q in all_own.items() if abs(runs[m - 1][r] * math.log(q / 10 ** plain[r[1:]])) >= 4}
                rest, left = max(1e-9, 1 - sum(own.values())), max(1e-9, 1 - sum(10 ** plain[r[1:]] for r in own))
                gain = sum(q * math.log(q / 10 ** plain[r[1:]]) for r, q in own.items()) + rest * math.log(rest / left)
                if own and gain >= divergence:
                    self.rest[p] = math.log10(rest / max(1e-9, 1 - sum(10 ** final[r[1:]] for r in own)))
                    self.pairs |= {r: math.log10(q) for r, q in own.items()}
            plain = {r: math.log10(q) for r, q in probs.items()}
            final = {r: self.pairs.get(r, final[r[1:]] + self.rest.get(r[:-1], 0)) for r in plain}
            uses = {r: runs[m - 1][r] for r in plain}

    def root(self, w: str) -> float:
        return math.log10((self.counts[w] + 1) / (self.total + self.distinct + 1))

    def log(self, history: tuple, w: str) -> float:
        """In the longest state that the history ends with; a pair that a state hasn't is left to the next shorter one."""
        h, more = history[-self.depth :], 0.0
        while h:
            if h in self.rest:
                if (*h, w) in self.pairs:
                    return more + self.pairs[*h, w]
                more += self.rest[h]
            h = h[1:]
        return more + self.root(w)

    def score(self, words: list[str]) -> float:
        t = ["\0start", *words]
        return sum(self.log(tuple(t[:i]), t[i]) for i in range(1, len(t)))


@pytest.mark.parametrize("head", [1 << 21, 40])
def test_scores_are_those_of_a_plain_tree(spark, head):
    rng = random.Random(7)
    passages = [[f"v{rng.randrange(30)}" for _ in range(12)] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(4)) for w in [*rng.choice(passages), f"v{rng.randrange(12)}", f"u{rng.randrange(400)}"])) for i in range(140)]
    rows += [(500, None), (501, ""), (502, "V1 V2  v1\tv2"), (None, rows[1][1]), (503, rows[2][1]), (503, rows[2][1])]
    docs = spark.createDataFrame([(d, t, d is not None and d % 7 == 2, 0.0, "x") for d, t in rows], DOCS + ", held_out boolean, score double, key string")
    lists = [words(t) for d, t in rows if d is None or d % 7 != 2]
    brute = BruteTree(lists, 3, 0.02, 3)
    assert len(brute.rest) > 40 and max(map(len, brute.rest)) == 3
    tree, counted = suffix_tree.fit(docs.filter("not held_out"), least=3, head=head, bits=12)
    assert (tree.rest is None) == (head > 40)
    got = sorted((r["doc_id"] or -1, r["score"]) for r in suffix_tree.score(docs, tree, counted).collect())
    want = sorted((d or -1, brute.score(words(t))) for d, t in rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)
    for h in [*list(brute.rest)[:20], *list(brute.rest)[-20:], ("never", "seen")]:
        assert math.isclose(sum(10 ** brute.log(h, w) for w in [*brute.counts, "unknown"]), 1, rel_tol=1e-9)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents").unionByName(spark.createDataFrame([(None, "x", None, None, None), (77_777, None, None, None, None)], table(spark, SF, "documents").schema)), table(spark, SF, "labels")
    marked = docs.withColumn("held_out", quality.held_out())
    got = {r["doc_id"]: r for r in quality.classify(marked, quality.fit(marked.filter("not held_out"), labels), keep=("doc_id", "held_out")).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [(truth[d], r["predicted"]) for d, r in got.items() if d in truth and r["held_out"]]
    assert len(known) >= 20 and sum(a == b for a, b in known) >= 0.95 * len(known)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_quality_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], DOCS)
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (3, 7)], "doc_id bigint, quality int")
    assert {r["predicted"] for r in quality.classify(docs, quality.fit(docs.selectExpr("*", "'x' as quality", "1 as features"), one)).collect()} == {1}
    none = quality.classify(docs, quality.fit(docs, one.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.classify(docs.limit(0), quality.fit(docs, one)).count() == 0


def test_shallow_trees_and_interactions():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (2000, 2)).astype(float) + rng.random((2000, 2)) * 0.1
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (quality.train(x, y).probability(x).round() == y).mean() > 0.95  # either feature alone tells nothing


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents").withColumn("held_out", language_id.held_out())
    net = language_id.fit(docs.filter("not held_out"))
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "12 !? 34"), (90_004, "😀 ½"), (None, "und der die mit")], DOCS).withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text", "held_out").unionByName(odd), net, keep=("doc_id", "held_out")).collect()}
    assert {(got[d]["lang_pred"], got[d]["score"]) for d in range(90_001, 90_005)} == {("und", 0.0)}
    assert got[None]["lang_pred"] == "de"
    truth = {r["doc_id"]: r["lang"] for r in docs.filter("held_out").collect()}
    assert sum(got[d]["lang_pred"] == lang for d, lang in truth.items()) >= 0.95 * len(truth)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(odd, net, least=0.0).count() == 1
    assert language_id.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    # values that hardly any row holds are no languages, however many there are
    dirty = spark.range(3000).selectExpr("concat('words of a text ', id) as text", "if(id % 3 = 0, concat('x', id), if(id % 3 = 1, 'a', 'b')) as lang")
    assert language_id.fit(dirty.unionByName(dirty.filter("lang in ('a', 'b')")), rounds=2).languages == ["a", "b"]
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_backpropagation_is_the_slope():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 123, (6, 8)).astype(np.uint8)
    codes, u = language_id._CODE[raw.T], 3
    tab, rec, up = rng.standard_normal((3 * u, 256)) * 0.4, rng.standard_normal((3 * u, u)) * 0.4, rng.standard_normal((8, u, 6))
    tab, rec, up = (x.astype(np.float32) for x in (tab, rec, up))
    states, kept = language_id._forward(codes, tab, rec, True)
    d_tab, d_rec = language_id._backward(up, codes, states, kept, rec)

    def value(t, r):
        return float((language_id._forward(codes, t, r, False)[0][1:].astype(float) * up).sum())

    for grad, place in ((d_rec, [(0, 1), (4, 2), (8, 0)]), (d_tab, [(i, int(codes[3, 2])) for i in (1, 4, 7)])):
        for at in place:
            moved = [p.copy() for p in (tab, rec)]
            k = 1 if grad is d_rec else 0
            low, high = [[m.copy() for m in moved] for _ in range(2)]
            low[k][at] -= 1e-2
            high[k][at] += 1e-2
            assert math.isclose(grad[at], (value(*high) - value(*low)) / 2e-2, rel_tol=0.05, abs_tol=0.02)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple]:
    def valid(kind: str, m: str) -> bool:
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def private_rows(spark) -> list[tuple]:
    odd = [
        "a@b.c_d@e.f x@y a.b@c.d.e. ü@b.de é+x%@a-b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.004 1.2.3 9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 3  4",
        "+1 (555) 123-4567 +12 +1234567 +49 30 1234567 tel+4", "7" * 3000, "x" * 20_000 + "@a.b", "token = \"" + "0a" * 20 + "\" password=abcdef12345", "😀 a@b.cd 😀 1.1.1.1", "+1" * 50, "a@b.c@d.e",
    ]
    return [*((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()), *((5000 + i, t) for i, t in enumerate(odd)), (6000, None), (6001, ""), (None, odd[0])]


def test_private_base_is_the_regex(spark, tmp_path):
    rows = private_rows(spark)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "docs"))
    got = private_data.find(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted((r["doc_id"] or -1, [tuple(s) for s in r["base"]]) for r in got) == sorted((d or -1, base_spans(t or "")) for d, t in rows)
    extra = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["extra"]] for r in got}
    assert [k for k, _, _ in extra[5006]] == ["secret", "secret"]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert private_data.find(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_contexts_find_what_no_pattern_has(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"please call +1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)} soon") for i in range(30)]
    rows += [(100 + i, f"badge AKIA{''.join(rng.choice('ABCDEFGH23456789') for _ in range(16))} ok") for i in range(20)]
    rows += [(200, "badge qx7-99-k1 ok"), (201, "chapter 7 of 9"), (202, "please call 743 555 0199 soon"), (203, "x" * 90 + " " + "0" * 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "docs"))
    extra = {r["doc_id"]: [tuple(s) for s in r["extra"]] for r in private_data.find(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert extra[200] == [("secret", 6, 15)]
    assert extra[201] == [] and extra[203] == []
    assert extra[202] == [("phone", 12, 24)]  # a phone of several words is a seed, and so is a run of them an identifier


def brute_contexts(rows: list[tuple]) -> dict:
    """The added spans of single words by plain loops: (start, end, kind) by id, for texts whose entities are single words."""
    def shape(w: str) -> str:
        w = re.sub("[,;:.!?]+$", "", w)
        w = re.sub("(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![A-Za-z0-9])", "H", w)
        w = re.sub("(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}", "M", w)
        return re.sub("[0-9]+", "0", re.sub("[A-Za-z]{3,}", "a", w))

    seen, nodes = [], {}
    for d, text in rows:
        before = ""
        for m in re.finditer(r"\S+", text):
            if re.search("[0-9@]", m[0]):
                kind = next((k for k, s, e in base_spans(text) if m.start() <= s and e <= m.end()), None)
                seen.append((d, m.start(), m.end(), before, shape(m[0]), kind))
                before = "#"
            else:
                before = m[0].lower()
    for _, _, _, b, s, kind in seen:
        node = nodes.setdefault((b, s), [0, 0, Counter()])
        node[0] += 1
        node[1] += kind is not None
        node[2][kind] += kind is not None
    score = {k: n[1] / n[0] for k, n in nodes.items()}
    for _ in range(3):
        side = []
        for at in (0, 1):
            total = {}
            for k, n in nodes.items():
                t = total.setdefault(k[at], [0.0, 0, 0])
                t[0], t[1], t[2] = t[0] + score[k] * n[0], t[1] + n[0], t[2] + n[1]
            side.append({x: (t[0] / (t[1] + 0.5) if t[2] >= 3 else 0.0) for x, t in total.items()})
        best = {k: max(side[0][k[0]], side[1][k[1]]) for k in nodes}
        score = {k: max(n[1] / n[0], best[k]) for k, n in nodes.items()}
    out = {d: set() for d, _ in rows}
    for d, s, e, b, sh, kind in seen:
        if kind is None and best[b, sh] >= 0.8 and e - s >= 6:
            out[d].add((s, e))
    return out


def test_added_spans_are_those_of_plain_loops(spark):
    rng = random.Random(3)
    ids = lambda: rng.choice(["{}@mail.org", "{}-{}", "x{}y", "{}.{}.7.8"]).format(rng.randrange(10, 200), rng.randrange(10, 200))
    rows = [(i, " ".join(f"{rng.choice(['mail', 'host', 'see', 'page'])} {ids()} and" for _ in range(rng.randrange(1, 4)))) for i in range(120)]
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["extra"]} for r in private_data.find(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", found int, base string")).collect()}
    want = brute_contexts(rows)
    assert got == want and any(want.values())


def test_masking(spark, tmp_path):
    schema = DOCS + ", rid string, spans string, n_chars bigint"
    rows = [(1, "é a@b.cd, then 1.2.3.4 end", "en", "s", 26), (2, None, None, None, None), (3, "clean", "en", "s", 5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "docs"))
    out = private_data.masked(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert {(r["rid"], r["spans"]) for r in out} == {("en", "s"), (None, None)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out}
    assert got == {1: ("é <EMAIL>, then <IP> end", 24), 2: (None, None), 3: ("clean", 5)}


TALK = "conv_id bigint, turn bigint, role string, text string"


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"),
        (1, 1, "b", "Unrelated words."),
        (1, 2, "c", "On Monday a wrote:\n> how ARE   you?\nFine, thanks."),
        (1, 3, "a", "> > How are you?\n> Fine, thanks.\n\nGood to hear."),
        (1, 4, "b", "> never said\nHm."),
        (2, 0, "x", "> How are you?\nWhat?"),
        (2, 1, None, None),
        (2, 2, "x", ""),
        (2, 2, "x", ""),
        (None, 0, "y", "> quoted\nown"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotations.link(spark.createDataFrame([(*r, 1) for r in rows], TALK + ", depth int")).collect()}
    assert {k: (r["reply_to"], r["depth"], r["thread"]) for k, r in got.items() if k[0] == 1} == {(1, 0): (None, 0, 0), (1, 1): (None, 0, 1), (1, 2): (0, 1, 0), (1, 3): (2, 2, 0), (1, 4): (None, 0, 4)}
    assert got[1, 2]["text"] == "Fine, thanks." and got[1, 3]["text"] == "Good to hear." and got[1, 4]["text"] == "Hm."
    assert [t for (c, t), r in sorted(got.items(), key=lambda x: x[1]["position"]) if c == 1] == [0, 2, 3, 1, 4]
    assert got[2, 0]["reply_to"] is None and got[2, 1]["text"] is None
    assert got[None, 0]["text"] == "own"
    assert quotations.link(spark.createDataFrame(rows, TALK)).count() == len(rows)
    assert quotations.link(spark.createDataFrame([], TALK)).count() == 0


def test_quotations_without_quotes_are_the_messages(spark):
    rows = table(spark, SF, "conversations")
    got = quotations.link(rows)
    assert got.select("conv_id", "turn", "role", "text").exceptAll(rows.select("conv_id", "turn", "role", "text")).count() == 0
    assert got.filter("position <> turn or reply_to is not null").count() == 0


def test_op6_digests(spark):
    r = bpe.op6_bpe(spark, SF).orderBy("doc_id").first()
    tok = Tokenizer.from_file(WORD)
    text = table(spark, SF, "documents").filter(F.col("doc_id") == r["doc_id"]).first()["text"]
    ids = tok.encode(text, add_special_tokens=False).ids
    assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_suffix_tree_keeps_rare_contexts_at_every_size(spark):
    """A context seen four times among two million words counts, and what isn't sent to tasks is looked up with the same result."""
    filler = [(10 + i, "filler " * 200_000) for i in range(10)]
    rows = [(i, "rare " + ("north" if i % 2 else "south") + " wind" + str(i % 2)) for i in range(8)]
    docs = spark.createDataFrame([*rows, *filler], DOCS).withColumn("held_out", F.lit(False))
    scores = []
    for head, bits in ((1 << 21, 27), (3, 8)):
        tree, counted = suffix_tree.fit(docs, least=3, head=head, bits=bits)
        scores.append({r["doc_id"]: (r["base_score"], r["score"]) for r in suffix_tree.score(docs, tree, counted).collect()})
    for d, (base, score) in scores[0].items():
        assert math.isclose(base, scores[1][d][0], rel_tol=1e-9) and math.isclose(score, scores[1][d][1], rel_tol=1e-9)
    base, score = scores[0][0]
    assert score > base + 6  # "wind0" after "south" is near certain


def test_many_identifiers_in_one_text_are_those_of_its_pieces(spark):
    """Blocks of matches change nothing: a long text has the spans of its pieces, moved."""
    rng = random.Random(12)
    kinds = (lambda i: f"call +1 (743) 555-{rng.randrange(1000, 9999)} now", lambda i: f"mail u{i}@ex.org.", lambda i: f"id AB{rng.randrange(10**8)}x, so", lambda i: f"host 10.0.{i % 250}.7 is up")
    pieces = [rng.choice(kinds)(i) + " and then on" for i in range(900)]
    docs = spark.createDataFrame([(0, " ".join(pieces)), *((i + 1, p) for i, p in enumerate(pieces))], DOCS)
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in private_data.find(docs).select("doc_id", "base").collect()}
    want, at = [], 0
    for i, piece in enumerate(pieces):
        want += [(kind, begin + at, end + at) for kind, begin, end in got[i + 1]]
        at += len(piece) + 1
    assert sorted(got[0]) == sorted(want) and len(want) > 500
    assert [k for k, _, _ in got[0]] == sorted((k for k, _, _ in got[0]), key=private_data.KINDS.index)
    out = private_data.masked(docs.withColumn("n_chars", F.length("text").cast("long")))
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == " ".join(texts[i + 1] for i in range(len(pieces)))


@pytest.mark.parametrize("buckets", [0, 3])
def test_suffix_tree_counts_runs_in_packed_rows(monkeypatch, buckets):
    """A task passes on a row for each bucket, however many runs become frequent, and each run's count is exact."""
    from types import SimpleNamespace

    monkeypatch.setattr(suffix_tree, "FLUSH", 2000)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(200)) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10])], names=["text"]) for i in range(0, 50, 10)]
    every = SimpleNamespace(value=SimpleNamespace(may=lambda keys: np.ones(len(keys), bool)))
    packed = pa.Table.from_batches(list(suffix_tree._count_runs(every, every, 2, buckets)(iter(batches))))
    assert len(packed) <= 6 << buckets
    found = pa.Table.from_batches(list(suffix_tree._frequent_runs(8)(packed.sort_by("bucket").to_batches(max_chunksize=2)))).to_pylist()
    name = dict(zip([*"abcdefghijklmnopqrst", "end", "start"], [*suffix_tree.words(np.frombuffer(b"a b c d e f g h i j k l m n o p q r s t", np.uint8), np.array([0, 39]))[0], suffix_tree.END, suffix_tree.START], strict=True))
    wanted = Counter(pair for t in texts for pair in itertools.pairwise(["start", *t.split(), "end"]))
    signed = lambda w: int(np.uint64(name[w]).view(np.int64))
    assert {(r["p"], r["s"]): r["n"] for r in found} == {(signed(x), signed(y)): n for (x, y), n in wanted.items() if n >= 8}
    keys = suffix_tree._longer(*(np.array([r[c] for r in found], np.int64).view(np.uint64) for c in ("p", "s")))
    assert [r["key"] for r in found] == keys.view(np.int64).tolist() and len(set(keys.tolist())) == len(found) > 300
