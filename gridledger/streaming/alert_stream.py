"""Alerts on a stream: what changed since the last status, and silence, which a timer tells although nothing arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridledger.streaming.guard_stream import use_typed_state

CAMERA = "camera"
OUTPUT = "device_id bigint, key string, event string, at timestamp"


def silence_seconds(gap_minutes: int) -> int:
    """The age at which a rounded number of minutes exceeds the gap."""
    return 60 * gap_minutes + 30


class Watch(StatefulProcessor):
    """One device's open alerts, its last frame, and a timer for when it will have been silent for too long."""

    def __init__(self, silence: int | None):
        self.silence = None if silence is None else silence * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "key string", "since bigint")
        self.last = handle.getValueState("last", "moment bigint")

    def _rows(self, device: int, events: list[tuple[str, str, int]]) -> Iterator[pd.DataFrame]:
        if events:
            keys, kinds, moments = zip(*events, strict=True)
            yield pd.DataFrame({"device_id": device, "key": keys, "event": kinds, "at": pd.to_datetime(pd.Series(moments), unit="us")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.assign(moment=frame["at"].astype("datetime64[us]").astype("int64")).sort_values(["moment"], kind="stable")
        held = self.last.get()
        begun = last = held[0] if held else None
        before = {k[0]: v[0] for k, v in self.open.iterator()}
        now, events = dict(before), []

        def change(name: str, kind: str, moment: int) -> None:
            events.append((name, kind, moment))
            now.__setitem__(name, moment) if kind == "new" else now.pop(name)

        for moment, told in zip(frame["moment"].tolist(), frame["keys"], strict=True):
            if told is not None:  # a status: the alerts that are on
                on = {k for k in told if k != CAMERA or self.silence is None}
                for name in sorted(on - now.keys()):
                    change(name, "new", moment)
                for name in sorted(now.keys() - on - ({CAMERA} if self.silence is not None else set())):
                    change(name, "recovered", moment)
            elif last is None or moment > last:  # a frame
                if self.silence is not None and last is not None and moment - last >= self.silence and CAMERA not in now:
                    change(CAMERA, "new", last + self.silence)
                if CAMERA in now and self.silence is not None:
                    change(CAMERA, "recovered", moment)
                last = moment
        for name in before.keys() - now.keys():
            self.open.removeKey((name,))
        for name in now.keys() - before.keys():
            self.open.updateValue((name,), (now[name],))
        if last is not None and last != begun:
            self.last.update((last,))
            if self.silence is not None:
                if begun is not None:
                    self.handle.deleteTimer(self._due(begun))
                self.handle.registerTimer(self._due(last))
        yield from self._rows(key[0], events)

    def _due(self, last: int) -> int:
        """Milliseconds, rounded up."""
        return -(-(last + self.silence) // 1_000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment = self.last.get()[0] + self.silence
        if expiredTimerInfo.getExpiryTimeInMs() == self._due(moment - self.silence) and not self.open.containsKey((CAMERA,)):
            self.open.updateValue((CAMERA,), (moment,))
            yield from self._rows(key[0], [(CAMERA, "new", moment)])

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, gap_minutes: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """device_id, key, event (new or recovered), at: changes of alerts, each once.

    rows: device_id, at, keys. Rows with keys (maybe none) are statuses: the keys of the alerts that are on, as
    alerts.pushed has them. Rows without are frames. With gap_minutes the camera's alert follows from frames alone: it is
    on once none has come for so long, as soon as the watermark has passed that time, and off with the next frame;
    without, it comes with the statuses like the others. Frames that come after later ones change nothing.
    Statuses at one time count in the order of their rows."""
    use_typed_state(rows.sparkSession)
    watch = Watch(None if gap_minutes is None else silence_seconds(gap_minutes))
    timed = rows.select("device_id", F.col("at").cast("timestamp").alias("at"), "keys").withWatermark("at", lateness)
    return timed.groupBy("device_id").transformWithStateInPandas(watch, OUTPUT, "append", "EventTime")
