"""Structured Streaming over event files: deduplication, running counts, alerts by window.

An addition for live use: watermarks bound the state, and greedy windows keep one open
window for each scenario.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each event key that arrives within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and largest value by event type in fixed windows; late rows beyond the delay go."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), "event_type", "n", "top")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def greedy_windows(events: DataFrame, seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Windows anchored at the first event that no earlier window holds, by scenario.

    ``events``: scenario, ts, score. A window is emitted when an event or the watermark
    passes its end; each scenario's state is one open window (start, last, n, best)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, best = state.get if state.exists else (None, None, 0, None)
        closed = []
        if state.hasTimedOut:
            closed.append((key[0], start, last, n, best))
            state.remove()
            start = None
        else:
            rows = pd.concat([f[["ts", "score"]] for f in frames]).sort_values("ts")
            for t, s in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["score"]):
                t = int(t)
                if start is not None and t - start > seconds * 1_000_000:
                    closed.append((key[0], start, last, n, best))
                    start = None
                if start is None:
                    start, n, best = t, 0, float(s)
                last, n, best = max(t, last or t) if n else t, n + 1, max(best, float(s))
            if start is not None:
                state.update((start, last, n, best))
                state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1) + 1)
        yield pd.DataFrame(closed, columns=["scenario", "start_us", "last_us", "n", "best"]).astype({"scenario": "str", "start_us": "int64", "last_us": "int64", "n": "int64", "best": "float64"})

    return (
        events.withWatermark("ts", delay)
        .groupBy("scenario")
        .applyInPandasWithState(step, "scenario string, start_us bigint, last_us bigint, n bigint, best double", "start bigint, last bigint, n bigint, best double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def node_memory(edges: DataFrame, half_life: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """Decayed activity of each node, updated after every micro-batch.

    ``edges``: node, ts, weight. A node's state is its last time and its activity, which
    halves every ``half_life`` seconds; a batch emits each touched node once. State of nodes
    that stay silent for a hundred half-lives goes."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, level = state.get if state.exists else (None, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([f[["ts", "weight"]] for f in frames]).sort_values("ts")
        for t, w in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["weight"]):
            if last is not None:
                level *= 0.5 ** (max(0, int(t) - last) / 1e6 / half_life)
            last, level = max(int(t), last or int(t)), level + float(w)
        state.update((last, level))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + int(half_life * 100_000))
        yield pd.DataFrame({"node": [key[0]], "last_us": [last], "activity": [level]})

    return edges.withWatermark("ts", delay).groupBy("node").applyInPandasWithState(step, "node bigint, last_us bigint, activity double", "last bigint, level double", "update", GroupStateTimeout.EventTimeTimeout)
