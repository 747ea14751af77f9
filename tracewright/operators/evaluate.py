"""One way to score and judge a method on a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learned, recon, scores, telemetry

METHODS: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    "freq_rarity": lambda s, share: scores.rarity(s, share),
    "path_lof": lambda s, share: scores.path_outlier(s, share),
    "random": lambda s, share: scores.random_scores(s, share),
    "graphsage": lambda s, share: learned.graph_scores(s, share),
    "rgcn": lambda s, share: learned.graph_scores(s, share, by_relation=True),
    "temporal": lambda s, share: learned.link_scores(s, share),
}


def latency(run: Callable[[], object], edges: int, repeats: int = 3, warm_up: int = 1) -> float:
    """Median milliseconds for a thousand scored edges."""
    for _ in range(warm_up):
        run()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return scores.scaled_latency(took, edges)


def score_tail(stream: DataFrame, method: str, family: str = "full", share: float = 0.7) -> DataFrame:
    """Scores of the tail. The split comes after the telemetry filter."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](telemetry.only_family(stream, family), share)


def judge(scored: DataFrame, observed: Iterable[str], lines: DataFrame | None = None, ks: Sequence[int] = (10, 50, 100, 500)) -> DataFrame:
    """One row: detection metrics, counts, and stage recall of the 500 best."""
    found = scores.detection_metrics(scored, [500])
    stages = recon.evaluate_top_k(scored, observed, [500], lines=lines).select(F.col("stage_recall").alias("stage_recall_500"), F.col("ordered_stage_recall_lcs").alias("lcs_recall_500"))
    n = scored.agg(F.count("*").alias("n_tail"), F.coalesce(F.sum("is_ioc"), F.lit(0)).alias("n_ioc_tail"))
    return found.crossJoin(F.broadcast(stages)).crossJoin(F.broadcast(n))  # one row each


def compare(stream: DataFrame, methods: Sequence[str], observed: Iterable[str], family: str = "full", share: float = 0.7) -> DataFrame:
    """A row for each method."""
    out = None
    for m in methods:
        row = judge(score_tail(stream, m, family, share), observed).withColumn("method", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out
