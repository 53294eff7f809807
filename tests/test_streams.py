"""Timers and metrics on streams, with a watermark that moves step by step."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from glasspane.operators import inspect
from glasspane.streaming import sessions
from tests.test_files import FILES, frame

MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE  # a watermark begins at the epoch, and what is not behind it is late


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def test_locks_come_without_a_further_activity(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = "k string, us long, poll boolean"
    steps = [
        [("u", 0, False), ("v", 5 * MINUTE, False)],
        [("u", 10 * MINUTE, False), ("v", 18 * MINUTE, True)],  # a poll does not prolong
        [("w", 40 * MINUTE, False)],  # only another key goes on: u and v lock
        [("u", 1 * MINUTE, False), ("u", 41 * MINUTE, False)],  # the first is behind the watermark
        [("x", 90 * MINUTE, False)],
    ]
    activity = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_micros("us"))
    q = None
    for i, rows in enumerate(steps):
        rows = [(k, us + DAY, poll) for k, us, poll in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events = sessions.session_locks(activity, "k", "ts", limit=15 * 60, poll=F.col("poll"), late="5 minutes")
        q = events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        if i == 3:
            assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1
    got = sorted((r.key, r.session, r.event, (r.us - DAY) // MINUTE) for r in spark.read.parquet(str(tmp_path / "out")).select("*", F.unix_micros("at").alias("us")).collect())
    assert got == [
        ("u", 1, "lock", 25), ("u", 1, "start", 0), ("u", 2, "lock", 56), ("u", 2, "start", 41), ("v", 1, "lock", 20), ("v", 1, "start", 5), ("w", 1, "lock", 55), ("w", 1, "start", 40), ("x", 1, "start", 90),
    ]


def test_metrics_of_a_batch(spark, tmp_path):
    seen = Observation("files")
    inspect.progress(inspect.inspected(frame(spark, FILES)), seen).write.parquet(str(tmp_path / "out"))
    m = seen.get
    assert (m["files"], m["bytes"], m["largest"], m["faults"]) == (len(FILES), sum(map(len, FILES.values())), max(map(len, FILES.values())), 0)
    assert (m["confirmed"], m["warning"], m["no_statement"], m["error"]) == (0, 4, 4, 0) and m["findings"] > 4
