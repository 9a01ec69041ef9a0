"""Incremental coverage and windows on Structured Streaming; every function also takes a static table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by tumbling or sliding windows; rows later than ``late`` behind the watermark go."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that a gap closes."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_hits(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """The first hit of each key within the watermark: each row is new coverage."""
    return hits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["frame", "level", "key"])


class _Keys(StatefulProcessor):
    """The keys of one group, each an entry of its own, and their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "hit boolean")
        self.number = handle.getValueState("number", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = n = self.number.get()[0] if self.number.exists() else 0
        for pdf in rows:
            for k in pdf["key"].dropna().unique():
                if not self.seen.containsKey((k,)):
                    self.seen.updateValue((k,), (True,))
                    n += 1
        if n > before:
            self.number.update((n,))
            yield pd.DataFrame({"frame": [key[0]], "level": [key[1]], "covered": [n]})

    def close(self) -> None:
        pass


def running_coverage(hits: DataFrame) -> DataFrame:
    """frame, level, covered, emitted whenever new keys arrive: a stateful count of keys by frame and level.

    hits: frame bigint, level string, key string; null keys are left out. A batch touches the state of its own keys only. The session's state store must hold
    maps (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    return hits.groupBy("frame", "level").transformWithStateInPandas(_Keys(), "frame bigint, level string, covered bigint", "update", "none")
