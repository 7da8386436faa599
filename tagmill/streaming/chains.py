"""Chains of frames in the order of their numbers, also where frames arrive late and in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedChain(StatefulProcessor):
    """Holds a chain's frames until the watermark has passed them, then takes them by (time, frame number).

    A frame waits in a map of its time and number, so a frame that comes twice waits once. A timer at the earliest waiting
    time releases what the watermark has passed, and is set anew for the next. The chain itself is three numbers. ``idle``
    milliseconds after a chain's last frame was taken its state goes.
    """

    def __init__(self, key: str, kind: str, least: float, idle: int):
        self.key, self.kind, self.least, self.idle = key, kind, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, frame_no long", "likeness double")
        self.chain = handle.getValueState("chain", "frame_no long, steps long, alive boolean, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, added = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for ms, frame_no, likeness in zip(pdf["ms"], pdf["frame_no"], pdf["likeness"], strict=True):
                if ms >= passed:  # what is older was released already
                    self.waiting.updateValue((int(ms), int(frame_no)), (float(likeness),))
                    added.append(int(ms))
        if added:
            self._set(min(added))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(k) for k in self.waiting.keys())
        ready = [k for k in held if k[0] < passed]
        frame, n, alive, last = self.chain.get() if self.chain.exists() else (-1, 0, True, None)
        out = []
        for ms, frame_no in ready:
            (value,) = self.waiting.getValue((ms, frame_no))
            self.waiting.removeKey((ms, frame_no))
            last = ms
            if alive:
                frame, n, alive = frame_no, n + (value >= self.least), value >= self.least
                out.append((key[0], frame, int(n), bool(alive)))
        if ready:
            self.chain.update((frame, int(n), bool(alive), last))
        if len(ready) < len(held):
            self._set(held[len(ready)][0])
        elif last is not None:
            if passed > last + self.idle:
                self.chain.clear()
            else:
                self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame(out, columns=[self.key, "frame_no", "steps", "alive"])

    def _set(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def ordered_chains(steps: DataFrame, key: str = "clip_id", least: float = 0.40, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """key, frame_no, steps, alive: one row for each frame of each chain, in order, up to the first whose likeness is below ``least``.

    ``steps``: key, ts, frame_no, likeness, as a stream; frames may come up to ``late`` after others with a later time, and
    later ones are left out. A chain that stays away for ``idle_ms`` beyond its last frame begins anew.
    """
    spark: SparkSession = steps.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = dict(steps.dtypes)[key]
    rows = steps.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).select(key, "ts", "ms", "frame_no", "likeness")
    schema = f"{key} {kind}, frame_no long, steps long, alive boolean"
    return rows.groupBy(key).transformWithStateInPandas(OrderedChain(key, kind, least, idle_ms), schema, "append", "EventTime")
