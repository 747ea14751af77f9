"""Scored edges: split, rarity, deduplication, selection, ranking metrics.

Rows of ``scores`` have scenario, t, etype, src, dst, score, is_ioc, source_file, row_idx,
ioc_type, and row_seq, a unique number in input order that decides ties everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .ranges import joined, nth_rows, ranked, running

EVENT = ("scenario", "t", "etype", "src", "dst")
PAIR = ("scenario", "etype", "src", "dst")


def ranking(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy(F.desc("score"), F.asc("row_seq"))


def split_point(n: Column, share: float) -> Column:
    """How many rows train: floor(share * n), at least 1 and at most n - 1; 0 for n <= 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(share) * n)))).cast("bigint")


def stream_order() -> list[Column]:
    return [F.col(c) for c in ("t", "etype", "src", "dst", "row_seq")]


def with_split(stream: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``pos`` (0-based place in the scenario's stream) and ``is_tail``."""
    sizes = stream.groupBy("scenario").agg(F.count("*").alias("_size"))
    placed = joined(ranked(stream, ["scenario"], stream_order()), sizes, ["scenario"])
    return placed.withColumn("is_tail", F.col("pos") >= split_point(F.col("_size"), share)).drop("_size")


def with_tail(stream: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``is_tail`` only: rows are compared with the scenario's first tail row, not sorted."""
    first = nth_rows(stream, ["scenario"], stream_order(), lambda n: split_point(n, share)).select("scenario", F.col("key").alias("_first"))
    marked = joined(stream, first, ["scenario"])
    own = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(stream_order())])
    return marked.withColumn("is_tail", own >= F.col("_first")).drop("_first")


def rarity(stream: DataFrame, share: float = 0.7, keys: Sequence[str] = ("etype", "src", "dst")) -> DataFrame:
    """Tail rows with score -ln((c + 1) / (n + 1)): c is how often the pattern occurs among the
    scenario's n training rows. Patterns are counted before they are shuffled, so a frequent one
    costs no more than others."""
    split = with_tail(stream, share)
    train = split.where("NOT is_tail")
    patterns = train.groupBy("scenario", *keys).agg(F.count("*").alias("_c")).withColumnsRenamed({c: f"_{c}_" for c in ("scenario", *keys)})
    sizes = stream.groupBy("scenario").agg(split_point(F.count("*"), share).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in ("scenario", *keys)])
    counted = joined(split.where("is_tail").join(patterns, same, "left").select(*stream.columns, "_c"), sizes, ["scenario"])
    score = -F.log((F.coalesce("_c", F.lit(0)) + 1) / (F.greatest(F.col("_n"), F.lit(1)) + 1).cast("double"))
    return counted.select(*[c for c in stream.columns if c != "score"], score.alias("score"))


def path_outlier(stream: DataFrame, share: float = 0.7) -> DataFrame:
    """The path-outlier baseline, which is the rarity score."""
    return rarity(stream, share)


def random_scores(stream: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Tail rows with a score in [0, 1) that depends on the seed and the row only."""
    drawn = S.draw(F.lit(seed), "scenario", "row_seq")
    return with_tail(stream, share).where("is_tail").withColumn("score", drawn / F.lit(float(1 << 52))).drop("is_tail")


def dedupe_events(scores: DataFrame) -> DataFrame:
    """One row for each event: largest score, any indicator, first place."""
    return scores.groupBy(*EVENT).agg(F.max("score").alias("score"), F.max("is_ioc").alias("is_ioc"), F.min("row_seq").alias("row_seq"))


def dedupe_pairs(scores: DataFrame) -> DataFrame:
    """The best row for each pair of end points: score, then indicator, then place."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc("score"), F.desc("is_ioc"), F.asc("row_seq"))
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pair_dedupe_counts(scores: DataFrame) -> DataFrame:
    n, kept = F.count("*"), F.count_distinct(F.struct(*PAIR))
    return scores.agg(n.alias("n_input_rows"), kept.alias("n_pair_deduped_rows"), (n - kept).alias("n_collapsed_rows"))


def select_high(events: DataFrame, quantile: float = 0.99, top_k: int | None = None) -> DataFrame:
    """High scores of each scenario: the top_k, or all at or over the nearest-rank quantile.

    The rank is round-half-even((n - 1) * quantile); equal scores all stay."""
    if top_k:
        return events.withColumn("_n", F.row_number().over(ranking("scenario"))).where(F.col("_n") <= top_k).drop("_n")
    at = lambda n: F.bround((n - 1) * F.lit(float(quantile))).cast("bigint")
    cuts = nth_rows(events, ["scenario"], [F.col("score"), F.col("row_seq")], at).select("scenario", F.col("key.k0").alias("_cut"))
    return joined(events, cuts, ["scenario"]).where("score >= _cut").drop("_cut")


def latest_rows(scores: DataFrame) -> DataFrame:
    """The last row of each event; its score may be smaller than the event's largest."""
    order = Window.partitionBy(*EVENT).orderBy(F.desc("row_seq"))
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_k(scores: DataFrame, k: int, by_pair: bool = False) -> DataFrame:
    """The k best edges with their rank, over all scenarios.

    By event: ranked by the event's largest score, shown as its last row. By pair: the
    pair's best row."""
    if by_pair:
        best = dedupe_pairs(scores).orderBy(F.desc("score"), "row_seq").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_seq")))
    events = dedupe_events(scores).orderBy(F.desc("score"), "row_seq").limit(k)
    ranked = events.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_seq")))
    return latest_rows(scores).join(F.broadcast(ranked.select(*EVENT, "rank")), list(EVENT))


def top_k_ioc(scores: DataFrame, k: int, by_pair: bool = False) -> DataFrame:
    return top_k(scores.where("is_ioc = 1"), k, by_pair)


def pool(scores: DataFrame, by_pair: bool = True, without_etypes: Sequence[int] = ()) -> DataFrame:
    """Candidates of the constrained selections: one row for each event key, the best first."""
    rows = dedupe_pairs(scores) if by_pair else scores
    if without_etypes:
        rows = rows.where(F.col("etype").isNotNull() & ~F.col("etype").isin(list(without_etypes)))
    first = Window.partitionBy(*EVENT).orderBy(F.desc("score"), "row_seq")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def top_k_source_quota(scores: DataFrame, k: int, quotas: dict[str, int], by_pair: bool = True, without_etypes: Sequence[int] = ()) -> DataFrame:
    """First each source's quota from its best edges, sources in the order given and while
    places last; then the best of the rest. Adds ``rank`` and ``by_quota``."""
    rows = pool(scores, by_pair, without_etypes)
    source = F.trim(F.coalesce("source_file", F.lit("")))
    wanted = {s.strip(): n for s, n in quotas.items() if s.strip() and n > 0}
    place = F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(wanted)], F.lit(len(wanted)))
    quota = F.coalesce(*[F.when(source == s, F.lit(n)) for s, n in wanted.items()], F.lit(0))
    marked = rows.withColumn("_place", place).withColumn("_quota", quota)
    # only the listed sources are ranked, and only up to the largest quota
    own = Window.partitionBy("_place").orderBy(F.desc("score"), "row_seq")
    listed = marked.where(F.col("_place") < len(wanted)).withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= max(wanted.values(), default=0))
    chosen = listed.where(F.col("_own") <= F.col("_quota")).drop("_own").withColumn("by_quota", F.lit(True))
    # of the others no more than the k best can be chosen, so the k + quotas best are enough
    rest = marked.orderBy(F.desc("score"), "row_seq").limit(k + sum(wanted.values())).join(F.broadcast(chosen.select("row_seq")), "row_seq", "left_anti").withColumn("by_quota", F.lit(False))
    few = chosen.unionByName(rest)
    order = Window.orderBy(F.desc("by_quota"), F.when(F.col("by_quota"), F.col("_place")).otherwise(0), F.desc("score"), "row_seq")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_place", "_quota")


GROUPS = {"etype_dst": ("etype", "dst"), "etype_src": ("etype", "src"), "etype_dst_port": ("etype", "dst", "dst_port"), "etype_src_port": ("etype", "src", "src_port")}


def with_ports(rows: DataFrame, key: str) -> DataFrame:
    """Ports that the rows lack count as -1."""
    for c in GROUPS[key]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(-1))
    return rows


def top_k_group_cap(scores: DataFrame, k: int, key: str = "etype_dst", cap: int = 5, by_pair: bool = True) -> DataFrame:
    """The k best edges, at most ``cap`` of a group. Adds ``rank``."""
    group = Window.partitionBy(*GROUPS[key]).orderBy(F.desc("score"), "row_seq")
    kept = with_ports(pool(scores, by_pair), key).withColumn("_n", F.row_number().over(group)).where(F.col("_n") <= max(1, cap)).drop("_n")
    best = kept.orderBy(F.desc("score"), "row_seq").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_seq")))


def top_k_group_cap_adaptive(scores: DataFrame, k: int, key: str = "etype_src", probe: int = 5, hot: int = 20, cap: int = 10, by_pair: bool = True) -> DataFrame:
    """Like ``top_k_group_cap``, but only groups with ``hot`` or more of the best k * probe
    edges are capped. Adds ``rank``."""
    rows = with_ports(pool(scores, by_pair), key)
    # the head counts rows before events are made unique
    head = with_ports(dedupe_pairs(scores) if by_pair else scores, key).orderBy(F.desc("score"), "row_seq").limit(k * max(1, probe))
    names = list(GROUPS[key])
    busy = head.groupBy(*names).agg(F.count("*").alias("_c")).where(F.col("_c") >= max(1, hot)).select(*names, F.lit(True).alias("_hot"))
    group = Window.partitionBy(*names).orderBy(F.desc("score"), "row_seq")
    # at most k * probe / hot groups are hot
    marked = rows.join(F.broadcast(busy), names, "left").withColumn("_n", F.row_number().over(group))
    kept = marked.where(F.col("_hot").isNull() | (F.col("_n") <= max(1, cap))).drop("_hot", "_n")
    best = kept.orderBy(F.desc("score"), "row_seq").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_seq")))


def parse_ks(text: str) -> list[int]:
    """Positive numbers of a comma list, each once, ascending."""
    return sorted({int(x) for x in text.split(",") if x.strip() and int(x) > 0})


def precision_at(scores: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, hits and precision of the best k rows of all scenarios; of fewer rows all count."""
    spark = scores.sparkSession
    best = scores.orderBy(F.desc("score"), "row_seq").limit(max(ks)).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("score"), "row_seq")))
    wanted = spark.createDataFrame([(k,) for k in ks], "k int")
    met = F.broadcast(wanted).join(best, F.col("_n") <= F.col("k"), "left")
    return met.groupBy("k").agg(F.sum("is_ioc").cast("bigint").alias("hits"), F.avg(F.col("is_ioc").cast("double")).alias("precision"))


def curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``tp`` and ``fp``: positives and negatives up to each row of the ranking (of each
    group). The ranking is dealt into ranges of score and place, so ties are split too."""
    return running(scores, list(by), [-F.col("score"), F.col("row_seq")], {"tp": F.col("is_ioc"), "fp": 1 - F.col("is_ioc")})


def curve_areas(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc and pr_auc, null where a class is missing. Ties keep their order.

    Area under the step curve: each negative adds the share of positives before it. Average
    precision: each positive adds the precision at its place."""
    c = curve(scores, by)
    tp, fp, y = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("is_ioc")
    out = c.groupBy(*by) if by else c.groupBy()
    out = out.agg(
        F.sum(y).cast("bigint").alias("positives"),
        F.sum(1 - y).cast("bigint").alias("negatives"),
        F.sum(F.when(y == 0, tp)).alias("_a"),
        F.sum(F.when(y == 1, tp / (tp + fp))).alias("_b"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return out.withColumn("roc_auc", F.when((p > 0) & (n > 0), F.col("_a") / (p * n))).withColumn("pr_auc", F.when(p > 0, F.col("_b") / p)).drop("_a", "_b")


def detection_metrics(scores: DataFrame, ks: Sequence[int] = (10, 50, 100, 500)) -> DataFrame:
    """One row: areas under the curves and precision at each k."""
    wide = precision_at(scores, ks).groupBy().pivot("k", list(ks)).agg(F.first("precision"))
    wide = wide.select(*[F.col(str(k)).alias(f"p_at_{k}") for k in ks])
    return curve_areas(scores).crossJoin(F.broadcast(wide))  # one row each


def scaled_latency(seconds: Sequence[float], edges: int) -> float:
    """Median milliseconds for a thousand edges."""
    s = sorted(seconds)
    if not s or edges <= 0:
        return math.nan
    mid = len(s) // 2
    median = s[mid] if len(s) % 2 else (s[mid - 1] + s[mid]) / 2
    return median * 1e6 / edges
