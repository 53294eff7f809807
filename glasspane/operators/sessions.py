"""Idle sessions: a session ends when the time since the last activity reaches the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Limits to choose from, in seconds (0: never), and the default.
LIMITS, DEFAULT = (60, 300, 900, 1800, 3600, 0), 900


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def idle_sessions(activity: DataFrame, key: str, ts: str, limit: int = DEFAULT, polls: Column | None = None) -> DataFrame:
    """``key, session, started, ended, n`` of each session, numbered from 1.

    An event exactly ``limit`` seconds after the last one opens a new session;
    rows for which ``polls`` holds ask for the state and do not prolong it. The
    running sum needs one key's events in order, so they meet in one task.
    """
    rows = activity.where(F.col(ts).isNotNull())
    if polls is not None:
        rows = rows.where(~F.coalesce(polls, F.lit(False)))
    order = W.partitionBy(key).orderBy(ts)
    gap = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(order)
    opens = F.when(gap.isNull() | (F.lit(limit > 0) & (gap >= limit * 1_000_000)), 1).otherwise(0)
    numbered = rows.select(key, ts, opens.alias("o")).withColumn("session", F.sum("o").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def remaining(last: Column, now: Column, limit: int = DEFAULT) -> Column:
    """Whole seconds until the lock, never below 0."""
    left = limit * 1_000_000 - (micros(now) - micros(last))
    return F.greatest(F.lit(0).cast("long"), F.floor(left / 1_000_000).cast("long"))


def lock_states(activity: DataFrame, key: str, ts: str, now: Column, limit: int = DEFAULT) -> DataFrame:
    """Last activity of each key, seconds left at ``now`` and whether it is locked."""
    last = activity.groupBy(key).agg(F.max(ts).alias("last"))
    idle = micros(now) - micros(F.col("last"))
    return last.select(key, "last", remaining(F.col("last"), now, limit).alias("remaining"), (idle >= limit * 1_000_000).alias("locked"))
