"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IP, card, phone) come from fixed patterns. They and a few well-known forms of secrets are the
seeds; an entity of several words is one seed. An identifier is a word with a digit or an at-sign, or a run of such
words. Its context is the word before it and its own shape; each context of a seed is a pattern. Spark
scores the graph of patterns and instances in rounds: a pattern is as good as its instances are, and an instance
as its best pattern. Patterns of high confidence then mark identifiers that no base pattern has found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.shared import numbered, saved, table

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A match starts where the last one ended, or not inside a run of its first
#: characters: these are the leftmost matches, found without trying every place of a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Forms of secrets that are seeds beside the base entities.
SECRETS = r"^(?:AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api[_-]?key)=\S{8,}|\"[0-9a-f]{32,}\")$"
#: Identifiers: words with a digit or an at-sign.
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Runs of two such words and more.
RUN = IDENTIFIER + r"(?:\x20[^\s0-9@]*+[0-9@]\S*+)++"

ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 3
#: Parts that a key of a join is dealt over, as a third of all identifiers may share it.
SALTS = 16
#: A shorter word isn't an identifier that a context may mark.
LEAST_LENGTH = 6
PART = "part"
#: Weight of doubt in a pattern's confidence: as many instances that are none.
DOUBT = 0.5


#: Elements that one aggregation appends to an array, which copies it each time. Longer arrays are read in blocks.
BLOCK = 64
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(array: Column) -> Column:
    """An array in blocks; one empty block if it is empty."""
    last = lambda a: F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))
    return _let(array, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda k: F.slice(a, k * BLOCK + 1, BLOCK)))


def _by_blocks(array: Column, begin: int, moved, combined, read) -> Column:
    """read(block, at) of each block of an array, where at is what combined() makes of begin and of moved(element) of all
    elements before the block. So work is linear in an array's length, but for a copy of the blocks' places."""

    def blocks(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.aggregate(p, F.lit(None).cast("int"), lambda acc, x: combined(F.coalesce(acc, moved(x)), moved(x)) if combined is F.greatest else F.coalesce(acc, F.lit(0)) + moved(x)))
        state = F.struct(F.lit(begin).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(ends, state, lambda acc, e: F.struct(F.when(e.isNull(), acc["at"]).otherwise(combined(acc["at"], e)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.zip_with(parts, starts, read)

    return _let(_blocks(array), blocks)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, kind: str, pattern: str, needs: Column) -> Column:
    """array<struct(kind, start, end, value, before)> of all matches: the texts between them give the places, and the
    words before them; # for the match that comes right before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        word = F.regexp_extract(F.reverse(pair["gap"]), r"^\s*+(\S++)", 1)
        before = F.when((word == "") & (acc["at"] > 0), "#").otherwise(F.reverse(word))
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def read(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]

    pairs = _let(found, lambda all_: F.zip_with(F.slice(gaps, 1, F.size(all_)), all_, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))))
    each = _by_blocks(pairs, 0, lambda p: F.length(p["gap"]) + F.length(p["value"]), _sum, read)
    return F.when(needs, F.flatten(each)).otherwise(F.array().cast(_SPAN))


def _valid(span: Column) -> Column:
    """Whether a base match is what it looks like."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    n = F.length(digits)
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)).otherwise(d.cast("int")))
    luhn = F.aggregate(doubled, F.lit(0).cast("bigint"), lambda s, d: s + d.cast("bigint")) % 10 == 0
    parts = F.forall(F.split(span["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    return (
        F.when(span["kind"] == "ip", parts)
        .when(span["kind"] == "card", F.when(n.between(16, 19), luhn).otherwise(False))
        .when(span["kind"] == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _needs(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    return F.flatten(F.array(*(F.filter(_spans(text, k, PATTERNS[k], _needs(text, k)), _valid) for k in KINDS)))


def _shape(word: Column) -> Column:
    """An identifier with its letters and digits classed and runs shortened; hexadecimal runs are one class."""
    bare = F.regexp_replace(word, r"[,;:.!?]+$", "")
    hexed = F.regexp_replace(bare, "(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{8,}+(?![A-Za-z0-9])", "H")
    mixed = F.regexp_replace(hexed, "(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}+", "M")
    return F.regexp_replace(F.regexp_replace(mixed, r"\p{L}{3,}+", "a"), "[0-9]++", "0")


def _context(before: Column) -> Column:
    """The word before, in lower case; # for one that is an identifier itself, and a hash of a very long one."""
    low = F.lower(F.when(before.rlike("[0-9@]"), F.lit("#")).otherwise(before))
    return F.when(F.length(low) > 64, F.hex(F.xxhash64(low))).otherwise(low)


def scan(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """rid, doc_id, base (spans), found (identifiers with the word before, shape and whether they are seeds), saved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9@]")
    numbered_ = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), "doc_id", text.alias("text"))
    read = numbered_.select("rid", "doc_id", base_spans(F.col("text")).alias("base"), _spans(F.col("text"), "word", IDENTIFIER, digits).alias("words"), _spans(F.col("text"), "run", RUN, digits).alias("runs"))
    bare = lambda c: F.regexp_replace(c["value"], r"[,;:.!?]+$", "")
    touched = lambda c, near: F.exists(near, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    places = F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.element_at(order, b["kind"]).alias("rank"), b["kind"].alias("kind"))))
    reach = lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(p, lambda b: b["end"])).alias("hi"), p.alias("places"))

    def beside(spans: str, told) -> Column:
        """told(span, the base spans near it) of each span: a block's neighbours are looked up once."""

        def block(based: Column, part: Column) -> Column:
            low, high = F.get(part, F.lit(0))["start"], F.get(part, F.size(part) - 1)["end"]
            close = F.filter(based, lambda x: (x["hi"] > low) & (x["lo"] < high))
            near = F.flatten(F.transform(close, lambda x: F.filter(x["places"], lambda b: (b["end"] > low) & (b["start"] < high))))
            return _let(near, lambda n: F.transform(part, lambda c: told(c, n)))

        based = F.transform(_blocks(F.col("__places")), reach)
        return F.flatten(_let(based, lambda x: F.transform(_blocks(F.col(spans)), lambda part: block(x, part))))

    def described(c: Column, end: Column, seed: Column) -> Column:
        return F.struct(c["start"].alias("start"), end.alias("end"), _context(c["before"]).alias("before"), _shape(c["value"]).alias("shape"), seed.cast("string").alias("seed"))

    def word(c: Column, near: Column) -> Column:
        whole = F.filter(near, lambda b: (b["start"] >= c["start"]) & (b["end"] <= c["end"]))
        first = F.array_min(F.transform(whole, lambda b: F.struct(b["rank"], b["start"], b["kind"].alias("kind"))))["kind"]
        # a word that is only part of an entity says nothing about words like it
        seed = F.when(first.isNotNull(), first).when(touched(c, near), F.lit(PART)).when(bare(c).rlike(SECRETS), F.lit("secret"))
        return described(c, c["start"] + F.length(bare(c)), seed)

    entities = F.transform(F.filter("base", lambda b: F.contains(b["value"], F.lit(" "))), lambda b: described(b, b["end"], b["kind"]))
    free = F.filter(beside("runs", lambda c, near: F.struct(c.alias("c"), (~touched(c, near)).alias("free"))), lambda x: x["free"])
    runs = F.transform(free, lambda x: described(x["c"], x["c"]["start"] + F.length(bare(x["c"])), F.lit(None)))
    placed = read.withColumn("__places", places)
    return saved(placed.select("rid", "doc_id", "base", F.concat(beside("words", word), entities, runs).alias("found")), "identifiers")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key: left's rows of a key are dealt over SALTS parts by the column `by`."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def patterns(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(before, shape, kind): contexts whose confidence passes, after that many rounds over the graph.

    An instance is a (before, shape) of a word; it carries two patterns, the word before with the shape's
    surroundings open, and the shape alone. Counts are of all identifiers of all texts."""
    seen = (
        scanned.select(F.explode("found").alias("f"))
        .select("f.before", "f.shape", "f.seed")
        .filter(~F.col("seed").eqNullSafe(F.lit(PART)))
        .groupBy("before", "shape", "seed")
        .agg(F.count("*").alias("n"))
    )
    nodes = saved(
        seen.groupBy("before", "shape").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("seed").isNotNull(), F.col("n"))), F.lit(0)).alias("seeds"),
            F.max(F.when(F.col("seed").isNotNull(), F.struct("n", "seed")))["seed"].alias("kind"),
        ),
        "contexts",
    )
    # instance confidence starts at the share of seeds; patterns and instances score each other in turn
    score = nodes.withColumn("score", F.col("seeds") / F.col("n"))
    for _ in range(rounds):
        left = score.groupBy("before").agg(
            (F.sum(F.col("score") * F.col("n")) / (F.sum("n") + DOUBT)).alias("left_score"), F.sum("seeds").alias("left_seeds"), F.max(F.struct("seeds", "kind"))["kind"].alias("left_kind")
        )
        own = score.groupBy("shape").agg(
            (F.sum(F.col("score") * F.col("n")) / (F.sum("n") + DOUBT)).alias("own_score"), F.sum("seeds").alias("own_seeds"), F.max(F.struct("seeds", "kind"))["kind"].alias("own_kind")
        )
        best = F.greatest(
            F.when(F.col("left_seeds") >= support, F.col("left_score")).otherwise(0.0),
            F.when(F.col("own_seeds") >= support, F.col("own_score")).otherwise(0.0),
        )
        score = saved(
            _salted(_salted(nodes, left, ["before"], "shape"), own, ["shape"], "before").select(
                *nodes.columns,
                F.greatest(F.col("seeds") / F.col("n"), best).alias("score"),
                best.alias("pattern"),
                F.when(F.coalesce("left_score", F.lit(0.0)) >= F.coalesce("own_score", F.lit(0.0)), F.coalesce("left_kind", "own_kind")).otherwise(F.coalesce("own_kind", "left_kind")).alias("as"),
            ),
            "scores",
        )
    return score.filter((F.col("pattern") >= confidence) & F.col("as").isNotNull()).select("before", "shape", F.col("as").alias("kind"))


def _outermost(spans: Column) -> Column:
    """Spans (start, -end, kind), sorted, as (start, end, kind) without those that lie in one before them."""
    kind = "array<struct<start:int,end:int,kind:string>>"

    def step(acc: Column, s: Column) -> Column:
        one = F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(-s["back"] > acc["at"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def read(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step)["out"]

    return F.flatten(_by_blocks(spans, -1, lambda s: -s["back"], F.greatest, read))


def find(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """rid, doc_id, base, extra: spans struct(kind, start, end), in code points, end exclusive; one row per row of docs.

    base: the base patterns' spans by kind as listed, then start. extra: identifiers and runs of them, outside of these,
    that a confident context marks, by start. rid: the column of that name in a saved table; without a name
    it is given in the only scan of docs, and saved.
    Null texts are empty and have no spans; null ids are passed on; repeated rows are read each; without seeds
    there are no patterns; very long texts are read whole; other columns are not looked at; an empty table gives no rows."""
    scanned = scan(docs, rid)
    found = scanned.select("rid", F.explode("found").alias("f")).filter("f.seed is null or f.seed = 'secret'").select("rid", "f.start", "f.end", "f.before", "f.shape", "f.seed")
    marked = (
        _salted(found, patterns(scanned), ["before", "shape"], "rid", "left")
        .withColumn("kind", F.coalesce("seed", "kind"))
        .filter(F.col("kind").isNotNull() & (F.col("end") - F.col("start") >= LEAST_LENGTH))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("extra"))
        .withColumn("extra", _outermost(F.col("extra")))
    )
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(marked, "rid", "left").select(
        "rid", "doc_id", F.transform("base", bare).alias("base"), F.coalesce(F.transform("extra", bare), none).alias("extra")
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, and n_chars as it is then.

    Overlapping spans are replaced together, under the name of the first. Texts without spans, null ones included,
    are left alone."""
    sorted_spans = F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = numbered(docs, "__rid")
    spans = find(rows, "__rid").select(F.col("rid").alias("__rid"), sorted_spans.alias("__spans")).filter("size(__spans) > 0")

    def block(part: Column, begin: Column) -> Column:
        """The text from begin to the end of a block's last span, with its spans replaced."""

        def written(piece: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(piece, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                new = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

            return F.array_join(F.aggregate(part, F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], "")

        return _let(F.substring(F.col("text"), begin + 1, F.greatest(last(part) - begin, F.lit(0))), written)

    last = lambda spans_: F.array_max(F.transform(spans_, lambda s: s["end"]))
    pieces = _by_blocks(F.col("__spans"), 0, lambda s: s["end"], F.greatest, block)
    text = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last(F.col("__spans")) + 1, F.length("text")))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))  # every span holds one; other texts needn't be shuffled
    found = rows.filter(may).join(spans, "__rid", "left")
    clean = F.col("__spans").isNull()
    new = found.withColumn("text", F.when(clean, F.col("text")).otherwise(text))
    new = new.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return new.select(*docs.columns).unionByName(rows.filter(~may).select(*docs.columns))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    ordered = F.array_sort(
        F.transform(F.concat("base", "extra"), lambda s: F.struct(F.coalesce(F.element_at(rank, s["kind"]), F.lit(9)).alias("r"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    )
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"))
