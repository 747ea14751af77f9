"""Alerts: time windows over high scores, connected components in them, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import persisted, ranked
from .scores import EVENT, dedupe_events, precision_at, select_high

WINDOW = 3600
QUANTILE = 0.99
MIN_EVENTS = 3
EVIDENCE = 200


def greedy_windows(events: DataFrame, width: int = WINDOW) -> DataFrame:
    """Adds ``window_start`` and ``window_no`` (1-based in the scenario).

    A window opens at the first event that no earlier window holds and lasts up to and
    including ``start + width``. One task a scenario steps from window to window over the
    distinct seconds of its events (8 bytes each, 250 MB a year, however many events); events
    then find their window by an equi-join on stretches of ``width``.
    """

    def opened(times: pa.Table) -> pa.Table:
        t = np.sort(times["t"].to_numpy())
        starts, at = [], 0
        while at < len(t):
            starts.append(t[at])
            at = np.searchsorted(t, t[at] + width, "right")
        return pa.table({"scenario": pa.array([times["scenario"][0].as_py()] * len(starts), pa.string()), "window_start": pa.array(starts, pa.int64()), "window_no": pa.array(range(1, len(starts) + 1), pa.int32())})

    times = events.select(F.col("scenario").cast("string"), F.col("t").cast("bigint")).distinct()
    windows = times.groupBy("scenario").applyInArrow(opened, "scenario string, window_start bigint, window_no int")
    step = max(1, width)
    stretch = F.floor(F.col("window_start") / step)
    spread = windows.select(F.col("scenario").alias("_scenario"), "window_start", "window_no", F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    same = F.col("scenario").eqNullSafe(F.col("_scenario")) & (F.floor(F.col("t") / step) == F.col("_stretch"))
    held = (F.col("t") >= F.col("window_start")) & (F.col("t") <= F.col("window_start") + width)
    return events.join(spread, same & held).drop("_scenario", "_stretch")


def components(edges: DataFrame, group: list[str]) -> DataFrame:
    """group columns, node, component: the least node that src-dst edges of the group reach.

    Labels move along edges and then to their label's own label until nothing changes;
    each round is checkpointed."""
    ends = edges.select(*group, F.col("src").alias("a"), F.col("dst").alias("b"))
    both = persisted(ends.unionByName(ends.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = persisted(both.groupBy(*group, "a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        step = both.join(labels.withColumnRenamed("node", "b"), [*group, "b"]).groupBy(*group, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(step, [*group, "node"]).withColumn("next", F.least("component", "near"))
        jump = labels.select(*group, F.col("node").alias("next"), F.col("component").alias("far"))
        moved = persisted(met.join(jump, [*group, "next"], "left").select(*group, "node", F.col("component").alias("old"), F.least("next", "far").alias("component")))
        labels = moved.drop("old")
        if moved.where("old <> component").isEmpty():
            return labels


def alert_events(scores: DataFrame, width: int = WINDOW, quantile: float = QUANTILE, top_k: int | None = None, min_events: int = MIN_EVENTS) -> DataFrame:
    """Events of alerts: deduplicated, high, with window, component and ``alert_id``.

    Components with fewer than ``min_events`` events are no alerts. Ids count from 1 in the
    order of scenario, window and the component's first edge (by time, then score)."""
    return events_of_high(persisted(select_high(persisted(dedupe_events(scores)), quantile, top_k)), width, min_events)


def events_of_high(high: DataFrame, width: int, min_events: int) -> DataFrame:
    """``alert_events`` of events that are selected already."""
    placed = persisted(greedy_windows(high, width))
    labels = components(placed, ["scenario", "window_no"])
    group = ["scenario", "window_no", "component"]
    grouped = persisted(placed.join(labels.withColumnRenamed("node", "src"), ["scenario", "window_no", "src"]))
    firsts = grouped.groupBy(*group).agg(F.count("*").alias("_n"), F.min(F.struct(F.col("t"), (-F.col("score")).alias("s"), F.col("row_seq"))).alias("first")).where(F.col("_n") >= min_events)
    numbered = ranked(firsts, [], [F.col("scenario"), F.col("window_no"), F.col("first")], "alert_id").select(*group, (F.col("alert_id") + 1).cast("int").alias("alert_id"))
    return grouped.join(numbered, group)


def alerts(scores: DataFrame, width: int = WINDOW, quantile: float = QUANTILE, top_k: int | None = None, min_events: int = MIN_EVENTS, evidence: int = EVIDENCE) -> DataFrame:
    """One row for each alert: times, counts, best score, indicator hits, nodes, evidence."""
    events = alert_events(scores, width, quantile, top_k, min_events)
    item = F.struct((F.col("t")).alias("t"), (-F.col("score")).alias("neg"), "row_seq", "etype", "src", "dst", "score", "is_ioc")
    order = Window.partitionBy("alert_id").orderBy("t", F.desc("score"), "row_seq")
    marked = events.withColumn("_n", F.row_number().over(order))
    out = marked.groupBy("scenario", "alert_id").agg(
        F.min("t").alias("t_start"),
        F.max("t").alias("t_end"),
        F.count("*").alias("num_events"),
        F.max("score").alias("max_score"),
        F.sum("is_ioc").cast("bigint").alias("ioc_hits"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set("src"), F.collect_set("dst")))).alias("nodes"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= evidence, item))).alias("_evidence"),
    )
    shown = F.transform("_evidence", lambda e: F.struct(e["t"].alias("t"), e["etype"].alias("etype"), e["src"].alias("src"), e["dst"].alias("dst"), e["score"].alias("score"), e["is_ioc"].alias("is_ioc")))
    return out.withColumn("num_nodes", F.size("nodes")).withColumn("evidence", shown).drop("_evidence")


def alert_rows(scores: DataFrame, **how) -> DataFrame:
    """Source rows (the last of each event) of every alert."""
    from .scores import latest_rows

    return latest_rows(scores).join(alert_events(scores, **how).select(*EVENT, "alert_id"), list(EVENT))


def tail_metrics(scores: DataFrame, ks=(10, 50, 100, 500), width: int = WINDOW, quantile: float = QUANTILE, min_events: int = MIN_EVENTS) -> DataFrame:
    """One row: deduplicated, flagged and alert counts, their rates, precision at each k."""
    events = persisted(dedupe_events(scores))
    base = events.agg(F.count("*").alias("num_tail_deduped"))
    high = persisted(select_high(events, quantile))
    flagged = high.agg(F.count("*").alias("num_flagged"), F.coalesce(F.sum("is_ioc"), F.lit(0)).cast("bigint").alias("flagged_ioc"))
    number = events_of_high(high, width, min_events).agg(F.count_distinct("alert_id").alias("num_alerts"))
    p = precision_at(scores, ks).groupBy().pivot("k", list(ks)).agg(F.first("precision"))
    p = p.select(*[F.col(str(k)).alias(f"p_at_{k}") for k in ks])
    one = base.crossJoin(flagged).crossJoin(number).crossJoin(p)  # single rows
    at_least_1 = lambda c: F.greatest(F.lit(1), F.col(c)).cast("double")
    return one.select(
        "*",
        (F.col("num_flagged") / at_least_1("num_tail_deduped")).alias("flagged_rate"),
        (F.col("num_alerts") / at_least_1("num_tail_deduped")).alias("alerts_per_tail_event"),
        (F.col("flagged_ioc") / at_least_1("num_flagged")).alias("precision_in_flagged"),
    )
