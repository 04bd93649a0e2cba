"""Acceptance of uploaded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024


def judged(uploads: DataFrame) -> DataFrame:
    """uploads (content binary, ...) with reason: ok, Invalid size (empty, null, or over 10 MiB), Not a JPEG."""
    size = F.coalesce(F.length("content"), F.lit(0))
    magic = F.substring("content", 1, 3) == F.unhex(F.lit("FFD8FF"))
    return uploads.withColumn("reason", F.when((size < 1) | (size > MOST_BYTES), "Invalid size").when(magic, "ok").otherwise("Not a JPEG"))


def split(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined), the latter with reasons."""
    rows = judged(uploads)
    return rows.filter("reason = 'ok'").drop("reason"), rows.filter("reason <> 'ok'")
