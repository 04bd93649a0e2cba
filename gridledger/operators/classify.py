"""Template classification: median templates, best overlap under small shifts, and gated decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def templates(references: DataFrame) -> DataFrame:
    """label, bits: 1 where more than half of a label's bitmaps have ink (an even split is background)."""
    at = references.select("label", F.posexplode("bits").alias("pos", "bit")).groupBy("label", "pos").agg((2 * F.sum("bit") > F.count("*")).cast("tinyint").alias("bit"))
    return at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bit"))), lambda p: p["bit"]).alias("bits"))


def _overlaps(names: list, bits: np.ndarray, height: int, width: int, reach: int, bands: list[tuple[int, int]], columns: list[str], out: list[str]):
    """Best overlap with each template in each band of columns, over shifts that wrap within the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
        moved = [[np.roll(bits.reshape(len(bits), height, width)[:, :, lo:hi], s, (1, 2)).reshape(len(bits), -1).astype(np.float32) for s in shifts] for lo, hi in bands]
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, height, width)
            found = []
            for (lo, hi), templates_ in zip(bands, moved, strict=True):
                x = image[:, :, lo:hi].reshape(len(image), -1).astype(np.float32)
                best = np.zeros((len(x), len(names)))
                for m in templates_:
                    both = (x @ m.T).astype(np.float64)
                    either = x.sum(1)[:, None] + m.sum(1)[None, :] - both
                    np.maximum(best, np.where(either > 0, both / np.maximum(either, 1), 0), out=best)
                found.append(pa.array(best.ravel()))
            row = pa.array(np.repeat(np.arange(len(image)), len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in columns), pa.array(names * len(image), pa.int64()), *found], names=[*columns, "template", *out])

    return run


#: Columns that tell labels apart that differ in their first or last character, as shares of the width.
FIRST, LAST = (0.0, 0.12), (0.75, 1.0)


def overlaps(frames: DataFrame, known: DataFrame, height: int, width: int, reach: int = 2, bands: dict[str, tuple[float, float]] | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, template, iou: best overlap of each frame's ink with each template, over shifts of up to `reach`.

    bands: a column for each name, over a band of columns (shares of the width); shifts wrap within it. The templates
    are a row for each label of a display, so they travel with the code."""
    bands = bands or {"iou": (0.0, 1.0)}
    rows = sorted((r["label"], r["bits"]) for r in known.select("label", "bits").collect())
    bits = np.array([b for _, b in rows], np.uint8).reshape(len(rows), -1)
    kept = frames.select(*keys, "bits")
    places = [(int(width * lo), max(int(width * lo) + 1, round(width * hi))) for lo, hi in bands.values()]
    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("template", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in bands)])
    return kept.mapInArrow(_overlaps([label for label, _ in rows], bits, height, width, reach, places, list(keys), list(bands)), schema)


def decide_label(scores: DataFrame, names: DataFrame, least: float = 0.84, margin: float = 0.05, first: float = 0.55, last: float = 0.40, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, label (null: other) by overlap (iou) and by bands (first, last); names: template, label.

    The best two are siblings if they differ in their first or last character only: then the margin isn't asked
    for, the band that tells them apart decides, and the second wins only with a strictly greater overlap there. Of
    others, the best needs its margin and first character, and of the numbered reactive labels the last one, too."""
    named = scores.join(F.broadcast(names), "template")
    row = F.struct("iou", "label", "first", "last")
    top = named.groupBy(*keys).agg(F.slice(F.reverse(F.array_sort(F.collect_list(row))), 1, 2).alias("top"))  # a row for each template, some ten
    a, b = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    same = lambda expr: F.expr(expr.format("top[0].label")) == F.expr(expr.format("get(top, 1).label"))
    alike = F.length(a["label"]) == F.length(b["label"])
    by_first, by_last = alike & same("substr({}, 2)"), alike & same("left({0}, length({0}) - 1)")
    chosen = lambda band, gate: F.when(b[band] > a[band], F.when(b[band] >= gate, b["label"])).otherwise(F.when(a[band] >= gate, a["label"]))
    alone = (a["iou"] - F.coalesce(b["iou"], F.lit(0.0)) >= margin) & (a["first"] >= first) & (~a["label"].startswith("Ld-rCt") | (a["last"] >= last))
    label = F.when(a["iou"] < least, None).when(by_first, chosen("first", first)).when(by_last, chosen("last", last)).when(alone, a["label"])
    return top.select(*keys, label.alias("label"))


def phase(scores: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Phase glyph of each frame, null unless it overlaps by 0.48 and is 0.08 ahead."""
    return decide(scores, 0.48, 0.08, keys)


def unit(scores: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Unit glyph of each frame, null unless it overlaps by 0.55 and is 0.15 ahead."""
    return decide(scores, 0.55, 0.15, keys)


def decide(scores: DataFrame, least: float, margin: float, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, label (null: other), iou, margin: the best template if it overlaps enough and is far enough ahead.

    Equal overlaps: the greater label wins."""
    top = scores.groupBy(*keys).agg(F.max(F.struct("iou", "template")).alias("best"))
    rest = scores.join(top, list(keys)).filter(F.col("template") != F.col("best.template")).groupBy(*keys).agg(F.max(F.struct("iou", "template")).alias("second"))
    both = top.join(rest, list(keys), "left").withColumns({"iou": F.col("best.iou"), "ahead": F.col("best.iou") - F.coalesce("second.iou", F.lit(0.0))})
    enough = (F.col("iou") >= least) & (F.col("ahead") >= margin)
    return both.select(*keys, F.when(enough, F.col("best.template")).alias("label"), "iou", F.col("ahead").alias("margin"))


def siblings(labels: DataFrame) -> DataFrame:
    """Pairs of labels that are alike but for the first or the last character: a, b, differs (first or last)."""
    parts = labels.select("label", F.explode(F.array(F.struct(F.lit("first").alias("differs"), F.expr("substr(label, 2)").alias("rest")), F.struct(F.lit("last").alias("differs"), F.expr("left(label, length(label) - 1)").alias("rest")))).alias("p"))
    side = lambda name: parts.select(F.col("label").alias(name), "p.differs", "p.rest", F.length("label").alias("n"))
    pairs = side("a").join(side("b"), ["differs", "rest", "n"]).filter("a < b")
    # labels of one character differ in both; that counts as the first
    return pairs.groupBy("a", "b").agg(F.min("differs").alias("differs"))


def ranked(scores: DataFrame, n: int = 2, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The n best templates of each frame, with their rank."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("iou"), F.desc("template")))
    return scores.withColumn("rank", place).filter(F.col("rank") <= n)
