"""Who holds a tree's write lock, by a state machine with timers over a stream of lock events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "timestamp timestamp, event string, tree string, owner string"
TOLD = "tree string, state string, owner string, at timestamp"
#: Seconds after which a lock that nobody gave back counts as stale.
STALE_AFTER = 600


def events(spark: SparkSession, folder: str, late: str = "1 minute") -> DataFrame:
    """lock_acquire, lock_refused and lock_release events as a stream."""
    return spark.readStream.schema(SCHEMA).json(folder).withWatermark("timestamp", late)


class Locks(StatefulProcessor):
    """By tree: the holder and since when, with a timer for the time at which the lock gets stale."""

    def __init__(self, stale_after: int = STALE_AFTER):
        self.stale_ms = stale_after * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "owner string, since long")

    def _dropped(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = [(int(t.value // 1_000_000), e, o) for frame in rows for t, e, o in zip(frame["timestamp"], frame["event"], frame["owner"], strict=True) if not pd.isna(t)]
        told = []
        # a release goes before an acquisition of the same moment
        for at, event, owner in sorted(every, key=lambda e: (e[0], e[1] != "lock_release", e[1], e[2] or "")):
            now = self.held.get() if self.held.exists() else None
            if event == "lock_acquire":
                if now and now[0] != owner and at - now[1] < self.stale_ms:
                    told.append((key[0], "contended", owner, at))
                    continue
                told.append((key[0], "held" if not now or now[0] == owner else "taken_over", owner, at))
                self._dropped()
                self.held.update((owner, at))
                self.handle.registerTimer(at + self.stale_ms)
            elif event == "lock_refused":
                told.append((key[0], "contended", owner, at))
            elif event == "lock_release" and now and now[0] == owner:
                told.append((key[0], "free", owner, at))
                self._dropped()
        yield _rows(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.held.get() if self.held.exists() else None
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.held.clear()
        yield _rows([(key[0], "stale", now[0], at)] if now else [])

    def close(self) -> None:
        pass


def _rows(told: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(told, columns=["tree", "state", "owner", "at"])
    return frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))


def lock_states(stream: DataFrame, stale_after: int = STALE_AFTER) -> DataFrame:
    """(tree, state, owner, at): each change of a lock's state, and each refusal.

    held, free, contended (somebody else has it), taken_over (from a stale
    holder) and stale (not given back in time, by the watermark). Events later
    than the watermark are dropped, those without a tree too. Needs the RocksDB
    state store.
    """
    keyed = stream.where("tree is not null").groupBy("tree")
    told = keyed.transformWithStateInPandas(Locks(stale_after), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
    return told.select("tree", "state", "owner", F.col("at"))
