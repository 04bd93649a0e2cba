"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch holds the k least hashes of a text's distinct shingles of five words, so that of two parts' sketches the
sketch of the whole follows: the k least of both. Two sketches estimate how alike two texts are, how much of one is in
the other, and one estimates how many distinct shingles its text has. Of up to k shingles all of this is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm.shared import saved, table

WORDS = 5
#: The deviation of a resemblance J is sqrt(J (1 - J) / K).
K = 192

_SPACE = r"[\x20\x09-\x0D]++"
#: A text's last run of characters that aren't white space.
_OPEN_END = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order."""
    return F.transform(F.filter(F.split(F.lower(text), _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of so many words; none if there are fewer."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))
    return F.when(F.size(hashes) >= size, runs(hashes)).otherwise(F.array().cast("array<bigint>"))


def _whole(hashes: Column, size: int) -> Column:
    """Shingles of a whole text: one of all words if there are fewer than a shingle has, none without words."""
    return F.when(F.size(hashes).between(1, size - 1), F.array(F.xxhash64(hashes))).otherwise(_shingles(hashes, size))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, size: int = WORDS, k: int = K) -> Column:
    """The k least hashes of a text's distinct shingles, ascending. A null or empty text has none; a shorter text than
    a shingle has one, of all its words."""
    return _let(words(F.coalesce(text, F.lit(""))), lambda h: _least(_whole(h, size), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def two_endings(common: Column, first: Column, second: Column, size: int = WORDS, k: int = K) -> Column:
    """Sketches of common + first and of common + second, as struct(first, second), which share the sketch of what is
    common. It must be empty or end in white space."""

    def body(h: Column) -> Column:
        last = F.slice(h, F.greatest(F.size(h) - (size - 2), F.lit(1)), size - 1)

        def ending(part: Column, rest: Column) -> Column:
            across = F.concat(last, words(rest))
            # with fewer words than a shingle in common, what is across is the whole text
            seam = lambda x: F.when(F.size(h) < size, _whole(x, size)).otherwise(_shingles(x, size))
            return merge(part, _let(across, lambda x: _least(seam(x), k)), k)

        return _let(_least(_shingles(h, size), k), lambda part: F.struct(ending(part, first).alias("first"), ending(part, second).alias("second")))

    return _let(words(common), body)


def merged(sketches: DataFrame, by: Sequence[str], column: str, k: int = K) -> DataFrame:
    """The sketch of each group's parts: by, column. The k least of a task go on, so that a large group is never met whole."""
    least = F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))
    each = sketches.select(*by, F.explode(column).alias("__hash")).distinct().withColumn("__place", least).filter(F.col("__place") <= k)
    found = each.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias(column))
    names = sketches.select(*by).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    none = F.array().cast("array<bigint>")
    return names.alias("a").join(found.alias("b"), same, "left").select(*(f"a.{c}" for c in by), F.coalesce(f"b.{column}", none).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shared shingles in all of both, 0 to 1; 1 if neither has any."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(_let(merge(a, b, k), both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 if a has none. Null where b's sketch ends before a's begins,
    so that nothing is known: b has far more shingles than a."""
    seen = F.filter(a, lambda x: (F.size(b) < k) | (x <= F.element_at(b, -1)))
    share = lambda s: F.when(F.size(s) > 0, F.size(F.array_intersect(s, b)) / F.size(s))
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(_let(seen, share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def written(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def read(text: Column) -> Column:
    """The sketch that was written."""
    high, low = (lambda p: F.conv(F.substring(p, 1, 8), 16, 10).cast("bigint")), (lambda p: F.conv(F.substring(p, 9, 8), 16, 10).cast("bigint"))
    each = F.transform(F.filter(F.split(text, "(?<=\\G.{16})"), lambda p: p != ""), lambda p: F.shiftleft(high(p), 32).bitwiseOR(low(p)))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(each)


def fingerprints(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_chars, sketch, shingles (estimated distinct ones): one row per row of docs. Null texts are empty, equal
    texts have equal sketches, whole texts are read, other columns are not looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), sketch(text, size, k).alias("sketch"))
    return found.withColumn("shingles", distinct_shingles(F.col("sketch"), k))


def neighbours(keyed: DataFrame) -> DataFrame:
    """key, doc_id, n_chars, copies, before_key, before_chars of keyed documents (doc_id, key, n_chars), a row for each key.

    Before: the key that comes before it in the order of doc_id (nulls first) and key; before the first one the last. Each
    range of the order is looked at by itself, and what ranges end with, one row each, joins them."""
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ranged = saved(distinct.repartitionByRange(n, "doc_id", "key").withColumn("range", F.spark_partition_id()), "ranges")
    one = F.struct("doc_id", "key", "n_chars")
    ends = ranged.groupBy("range").agg(F.max(one).alias("last"))  # a row for each range
    order, everything = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = ends.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("before"))
    linked = ranged.withColumn("lag", F.lag(one).over(Window.partitionBy("range").orderBy("doc_id", "key"))).join(F.broadcast(beside), "range")
    before = F.coalesce("lag", "before")
    return saved(linked.select("key", "doc_id", "n_chars", "copies", before["key"].alias("before_key"), before["n_chars"].alias("before_chars")), "neighbours")


def edited(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch: one row per row of docs.

    A text is edited by putting the first floor(n_chars / 4) code points (or all) of the next document in place of its
    last as many; next is by doc_id, nulls first, then by a digest of id and text; after the last comes the first, and a
    single document follows itself. Of repeated rows each is followed by its copy, the last by the next document.
    Equal rows meet before the exchange, so however many there are, one text of them travels. Null texts are empty;
    whole texts are read; other columns are not looked at; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.unhex(F.md5(name.cast("binary"))).alias("key"))
    near = neighbours(keyed.select("doc_id", "key", F.length("text").alias("n_chars")))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))  # one exchange, which both of the sides below read
    base = texts.join(near, "key")
    given = base.select(F.col("before_key").alias("key"), F.left("text", F.floor(F.col("before_chars") / 4).cast("int")).alias("given"), sketch(F.col("text"), size, k).alias("next_sketch"))
    both = base.select("key", "doc_id", "text", "n_chars", "copies").join(given, "key")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    # a copy is followed by its like: its own first characters take the place of its last, and its sketch is the next one
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.col("copies"), F.lit(2)).cast("int") - 1)))
    rest = F.when(F.col("copy") == 0, F.col("given")).otherwise(F.left("text", quarter))
    cut = each.select("*", F.left("text", F.col("n_chars") - quarter).alias("kept"), F.right("text", quarter).alias("gone"), rest.alias("come"))
    common = cut.withColumn("common", F.regexp_replace("kept", _OPEN_END, "")).withColumn("open", F.substring("kept", F.length("common") + 1, F.length("kept")))
    done = common.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.concat("kept", "come").cast("binary"), 256).alias("edited_sha256"),
        two_endings(F.col("common"), F.concat("open", "gone"), F.concat("open", "come"), size, k).alias("s"),
        "next_sketch",
        "copy",
        F.when(F.col("copy") == 0, F.lit(1)).otherwise(F.col("copies") - 1).cast("int").alias("times"),
    )
    rows = done.select("doc_id", "n_chars", "edited_sha256", F.col("s.first").alias("sketch"), F.col("s.second").alias("edited_sketch"), F.when(F.col("copy") == 0, F.col("next_sketch")).otherwise(F.col("s.first")).alias("next_sketch"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return rows.drop("time")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained"),
    )
