"""Idle locks and trust states over streams, with one small state for each key.

What is at hand of one key is worked off in time order. ``session_starts`` takes
every activity, however late. ``session_locks`` works in event time: a timer of
each key's state fires when the watermark passes the end of a session, so a lock
is seen without a further activity, and activities behind the watermark are left
out and counted by Spark (``numRowsDroppedByWatermark`` of the query's progress).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glasspane.operators.sessions import DEFAULT

SESSION_STARTS = "key string, session long, started timestamp"
TRUST_STATES = "key string, seq long, state string, previous int, refused boolean"


class IdleLock(StatefulProcessor):
    """Emits the start of each session; polls do not prolong one."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, session long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, session = self.last.get() if self.last.exists() else (None, 0)
        seen = sorted(x for frame in rows for x, poll in zip(frame["micros"], frame["poll"]) if not poll)
        starts = []
        for micros in map(int, seen):
            if at is None or micros - at >= self.limit * 1_000_000:
                session += 1
                starts.append((str(key[0]), session, pd.Timestamp(micros, unit="us")))
            at = max(micros, at or micros)
        if at is not None:
            self.last.update((at, session))
        yield pd.DataFrame(starts, columns=["key", "session", "started"])

    def close(self) -> None:
        pass


def session_starts(activity: DataFrame, key: str, ts: str, limit: int = DEFAULT, poll=None, late: str = "1 hour") -> DataFrame:
    """A stream of the sessions that begin; ``activity`` is a stream with a timestamp column."""
    rows = activity.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("micros"), F.coalesce(poll if poll is not None else F.lit(False), F.lit(False)).alias("poll"))
    return rows.groupBy("key").transformWithStateInPandas(IdleLock(limit), SESSION_STARTS, "Append", "None")


SESSION_EVENTS = "key string, session long, event string, at timestamp"


class IdleLockTimer(StatefulProcessor):
    """Emits the start and the lock of each session; the state of a key whose last session is locked keeps its number alone."""

    def __init__(self, limit: int):
        self.limit = limit * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "last long, session long, locked boolean")

    def _timer(self, last: int) -> int:
        return -(-(last + self.limit) // 1000)  # milliseconds; never before the end of the session

    @staticmethod
    def _frame(rows: list[tuple[str, int, str, int]]) -> pd.DataFrame:
        return pd.DataFrame([(k, s, e, pd.Timestamp(at, unit="us")) for k, s, e, at in rows], columns=["key", "session", "event", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, session, locked = self.now.get() if self.now.exists() else (None, 0, True)
        before, out = (None if locked else last), []
        for at in sorted(int(x) for frame in rows for x, poll in zip(frame["micros"], frame["poll"]) if not poll):
            if not locked and at - last >= self.limit:
                out.append((str(key[0]), session, "lock", last + self.limit))
                locked = True
            if locked:
                session, locked, last = session + 1, False, at
                out.append((str(key[0]), session, "start", at))
            last = max(last, at)
        if last is not None and last != before and not locked:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(last))
            self.now.update((last, session, locked))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, session, locked = self.now.get()
        if locked or self._timer(last) > expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame([])
            return
        self.now.update((last, session, True))
        yield self._frame([(str(key[0]), session, "lock", last + self.limit)])

    def close(self) -> None:
        pass


def session_locks(activity: DataFrame, key: str, ts: str, limit: int = DEFAULT, poll=None, late: str = "1 hour") -> DataFrame:
    """A stream of ``key, session, event, at``: when sessions start, and when they lock for want of activity.

    A lock comes once the watermark (the latest time seen less ``late``) has passed
    it. Polls do not prolong a session. Needs a state store with timers (RocksDB).
    """
    rows = activity.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("micros"), F.coalesce(poll if poll is not None else F.lit(False), F.lit(False)).alias("poll"))
    return rows.groupBy("key").transformWithStateInPandas(IdleLockTimer(limit), SESSION_EVENTS, "Append", "EventTime")


class Trust(StatefulProcessor):
    """The trust state of a contact after each event, in the order of their numbers."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, previous int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, previous = self.now.get() if self.now.exists() else ("seen", 0)
        out = []
        for seq, action in sorted((int(s), a) for frame in rows for s, a in zip(frame["seq"], frame["action"])):
            refused = (state == "revoked" and action != "revoke") or (action == "replace" and previous >= self.most)
            if not refused:
                state = {"verify": "verified", "unverify": "seen", "revoke": "revoked", "replace": "changed"}[action]
                previous += action == "replace"
            out.append((str(key[0]), seq, state, previous, refused))
        self.now.update((state, int(previous)))
        yield pd.DataFrame(out, columns=["key", "seq", "state", "previous", "refused"])

    def close(self) -> None:
        pass


def trust_states(events: DataFrame, key: str, most: int = 64) -> DataFrame:
    """A stream of trust states from a stream of (key, seq, action)."""
    rows = events.select(F.col(key).cast("string").alias("key"), "seq", "action").where(F.col("action").isin("verify", "unverify", "revoke", "replace"))
    return rows.groupBy("key").transformWithStateInPandas(Trust(most), TRUST_STATES, "Append", "None")
