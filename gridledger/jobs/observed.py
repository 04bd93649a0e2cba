"""Figures of a run that come with the run itself: no second pass over what it writes."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gridledger.operators.guard import OUTCOMES

RUN = "guard_run"


def figures() -> list[Column]:
    """Rows, rows of each outcome, and rows without one."""
    count = lambda when, name: F.count(F.when(when, 1)).alias(name)
    return [F.count("*").alias("rows"), *(count(F.col("outcome") == o, o) for o in (*OUTCOMES, "late")), count(F.col("outcome").isNull(), "none")]


def written(judged: DataFrame, path: str) -> dict[str, int]:
    """Writes judged claims and gives the figures of the same pass."""
    seen = Observation(RUN)
    judged.observe(seen, *figures()).write.parquet(path)
    return {name: int(n) for name, n in seen.get.items()}


def watched(judged: DataFrame) -> DataFrame:
    """A stream of judged claims whose every batch tells its figures to listeners."""
    return judged.observe(RUN, *figures())


class Figures(StreamingQueryListener):
    """Adds up the figures of all batches of watched streams. Add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.total: Counter[str] = Counter()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(RUN)
        if seen is not None:
            self.total.update({name: int(n) for name, n in seen.asDict().items()})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
