"""Training data: labels, supervision, balance, negative edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import NETWORK_IOC_TYPES
from ..functions import scalars as S
from .ranges import joined, ranked
from .scores import with_tail


def supervision_label(mode: str) -> Column:
    """0/1 label by mode: off, ioc, ioc_line, rule, rule_high."""
    columns = {"ioc": "y_ioc", "ioc_line": "y_ioc_line", "rule": "y_rule", "rule_high": "y_rule_high"}
    if mode == "off":
        return F.lit(0)
    if mode not in columns:
        raise ValueError(f"unknown supervision {mode!r}")
    return (F.coalesce(F.col(columns[mode]), F.lit(0)) > 0).cast("int")


def stage_eligible(ioc_type: Column) -> Column:
    return (F.trim(ioc_type) != "") & ~F.trim(ioc_type).isin(list(NETWORK_IOC_TYPES))


def stage_label(mode: str = "gt_ioc") -> Column:
    """Stage class of an edge, 0 for none. gt_ioc takes the true type; rule and rule_high the
    rules' type of edges that they hit, but no network types."""
    if mode == "gt_ioc":
        return S.stage_index(S.stage_of_type(F.trim(F.coalesce("ioc_type", F.lit("")))))
    if mode not in ("rule", "rule_high"):
        raise ValueError(f"unknown stage supervision {mode!r}")
    t = F.trim(F.coalesce("rule_ioc_type", F.lit("")))
    hit = F.coalesce(F.col(f"y_{mode}"), F.lit(0)) > 0
    return F.when(hit & stage_eligible(t), S.stage_index(S.stage_of_type(t))).otherwise(0)


def stage_label_counts(stream: DataFrame, mode: str) -> DataFrame:
    return stream.groupBy("scenario").agg(F.count_if(stage_label(mode) > 0).alias("n_eligible"))


def supervision_diagnosis(stream: DataFrame, modes: Sequence[str] = ("rule_high", "rule")) -> DataFrame:
    """scenario, mode, n_eligible: edges that each mode could learn stages from."""
    found = [stage_label_counts(stream, m).select("scenario", F.lit(m).alias("mode"), "n_eligible") for m in modes]
    return reduce(lambda a, b: a.unionByName(b), found)


def balance_report(stream: DataFrame, labels: Sequence[str] = ("y_ioc", "y_rule", "y_rule_high"), share: float = 0.7) -> DataFrame:
    """``label_balance`` of every label the stream has, under ``label``."""
    found = [label_balance(stream, c, share).withColumn("label", F.lit(c)) for c in labels if c in stream.columns]
    return reduce(lambda a, b: a.unionByName(b), found)


def resolve_stage_supervision(stream: DataFrame, mode: str) -> tuple[str, bool]:
    """(mode, whether stages can be learnt). Rule modes need labels in every scenario;
    otherwise rule_high falls back to rule where any scenario has some."""
    if mode not in ("rule", "rule_high"):
        return mode, True
    row = stage_label_counts(stream, mode).agg(F.min("n_eligible")).first()
    if row[0] is not None and row[0] > 0:
        return mode, True
    if mode == "rule_high" and (stage_label_counts(stream, "rule").agg(F.max("n_eligible")).first()[0] or 0) > 0:
        return "rule", True
    return mode, False


def benign_only(stream: DataFrame) -> DataFrame:
    return stream.where("y_ioc = 0")


def label_balance(stream: DataFrame, label: str = "y_ioc", share: float = 0.7) -> DataFrame:
    """scenario, part (full, prefix, tail), n, pos, rate: one pass by grouping sets."""
    split = with_tail(stream, share).withColumn("part", F.when(F.col("is_tail"), "tail").otherwise("prefix"))
    split = split.withColumn("y", (F.col(label) > 0).cast("int")).select("scenario", "part", "y")
    sets = split.groupingSets([["scenario"], ["scenario", "part"]], "scenario", "part").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("pos"))
    return sets.select("scenario", F.coalesce("part", F.lit("full")).alias("part"), "n", "pos", (F.col("pos") / F.col("n").cast("double")).alias("rate"))


def unique_tail(stream: DataFrame, share: float = 0.7) -> DataFrame:
    """scenario, unique tail edges, and how many of them any indicator touches."""
    tail = with_tail(stream, share).where("is_tail")
    once = tail.groupBy("scenario", "t", "etype", "src", "dst").agg(F.max("y_ioc").alias("y"))
    return once.groupBy("scenario").agg(F.count("*").alias("n_unique"), F.count_if(F.col("y") > 0).alias("n_unique_ioc"))


def window_candidates(tail: DataFrame, prefix: DataFrame, width: int) -> DataFrame:
    """Pairs (row_seq, candidate destination) of a tail edge and the prefix edges of its type
    at most ``width`` away in time.

    An interval join as an equi-join: prefix edges lie in buckets of ``width``, and a tail
    edge looks into its own bucket and the two beside it."""
    left = tail.select("row_seq", "scenario", "etype", "t", "src", "dst", F.explode(F.array(*[F.floor(F.col("t") / width) + d for d in (-1, 0, 1)])).alias("b"))
    right = prefix.select("scenario", "etype", F.col("t").alias("ct"), F.col("dst").alias("candidate"), F.col("row_seq").alias("candidate_seq"), F.floor(F.col("t") / width).alias("b"))
    met = left.join(right, ["scenario", "etype", "b"]).where(F.abs(F.col("t") - F.col("ct")) <= width)
    return met.select("row_seq", "candidate", "candidate_seq")


def stretches(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``_b``, the row's stretch of ``width``."""
    return rows.withColumn("_b", F.floor(F.col("t") / width))


def window_candidate_counts(stream: DataFrame, width: int, share: float = 0.7) -> DataFrame:
    """How many prefix edges of its type lie within ``width`` of each tail edge.

    By running counts over the distinct times of a stretch and its neighbours (RANGE frames), so
    neither a busy window nor a long scenario lies in one task: prefix edges are counted by
    time first."""
    split = with_tail(stream, share)
    tail = stretches(split.where("is_tail").select("row_seq", "scenario", "etype", "t"), width)
    counts = stretches(split.where("NOT is_tail").groupBy("scenario", "etype", "t").agg(F.count("*").alias("n")), width)
    near = counts.withColumn("_b", F.explode(F.array(*[F.col("_b") + d for d in (-1, 0, 1)])))
    asked = tail.select("scenario", "etype", "t", "_b").distinct().withColumn("n", F.lit(0)).withColumn("_asked", F.lit(True))
    frame = Window.partitionBy("scenario", "etype", "_b").orderBy("t").rangeBetween(-width, width)
    summed = near.withColumn("_asked", F.lit(False)).unionByName(asked).withColumn("n_candidates", F.sum("n").over(frame)).where("_asked").select("scenario", "etype", "t", "n_candidates")
    return tail.join(summed, ["scenario", "etype", "t"]).select("row_seq", "scenario", "etype", "t", "n_candidates")


def sampled_negatives(stream: DataFrame, mode: str = "pool", share: float = 0.7, seed: int = 42, width: int = 3600, max_cands: int | None = None) -> DataFrame:
    """A wrong destination for each tail edge: ``negative``, never the edge's own, null where
    there is no other. Modes: random (any destination of the scenario's training part), pool (of
    the edge's type), inbatch (of another tail edge), window (of its type within ``width``,
    of the ``max_cands`` latest if given; of its type at any time where the window has none).
    The choice depends on seed and row only.

    Distinct destinations are numbered and each edge draws a number: an equi-join, no cross
    join. An edge that draws its own destination takes the next number."""
    split = with_tail(stream, share)
    tail = split.where("is_tail")
    if mode == "window":
        return window_negatives(split, seed, width, max_cands)
    keys = ["scenario", "etype"] if mode == "pool" else ["scenario"]
    source = tail if mode == "inbatch" else split.where("NOT is_tail")
    return drawn_negatives(tail, source, keys, seed)


def drawn_negatives(edges: DataFrame, source: DataFrame, keys: list[str], seed: int) -> DataFrame:
    pool = ranked(source.select(*keys, F.col("dst").alias("negative")).distinct(), keys, [F.col("negative")], "_i")
    size = pool.groupBy(*keys).agg(F.count("*").alias("_size"))
    names = [f"_{c}_" for c in keys]
    other = size.withColumnsRenamed(dict(zip(keys, names)))
    drawn = edges.join(F.broadcast(other), reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(keys, names)]), "left").drop(*names)
    drawn = drawn.withColumn("_first", F.pmod(S.draw(F.lit(seed), "row_seq"), F.col("_size")))
    # both the drawn number and the next: where the first is the edge's own, the second counts
    tries = drawn.select("row_seq", *keys, F.col("dst").alias("_own"), F.posexplode(F.array(F.col("_first"), F.pmod(F.col("_first") + 1, F.col("_size")))).alias("_try", "_i"))
    found = tries.join(pool, [*keys, "_i"]).where(~F.col("negative").eqNullSafe(F.col("_own"))).groupBy("row_seq").agg(F.min_by("negative", "_try").alias("negative"))
    return edges.join(found, "row_seq", "left")


def window_negatives(split: DataFrame, seed: int, width: int, max_cands: int | None) -> DataFrame:
    """Negatives within ``width`` by rank: a tail edge's candidates are a run of the prefix edges
    of its type in time order, whose ends come from running counts, so it draws one number in
    the run and no pairs are made."""
    order = [F.col("t"), F.col("row_seq")]
    prefix = ranked(split.where("NOT is_tail").select("scenario", "etype", "t", "row_seq", "dst"), ["scenario", "etype"], order, "_i")
    ends = prefix.groupBy("scenario", "etype", "t").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    near = stretches(ends, width).withColumn("_b", F.explode(F.array(*[F.col("_b") + d for d in (-1, 0, 1)])))
    tail = split.where("is_tail")
    asked = stretches(tail.select("scenario", "etype", "t").distinct(), width).withColumns({"_lo": F.lit(None).cast("bigint"), "_hi": F.lit(None).cast("bigint"), "_asked": F.lit(True)})
    frame = Window.partitionBy("scenario", "etype", "_b").orderBy("t").rangeBetween(-width, width)
    runs = near.withColumn("_asked", F.lit(False)).unionByName(asked).withColumns({"_a": F.min("_lo").over(frame), "_z": F.max("_hi").over(frame)}).where("_asked").select("scenario", "etype", "t", "_a", "_z")
    placed = tail.join(runs, ["scenario", "etype", "t"])
    if max_cands:
        placed = placed.withColumn("_a", F.greatest("_a", F.col("_z") - (max_cands - 1)))
    size = F.col("_z") - F.col("_a") + 1
    placed = placed.withColumn("_first", F.pmod(S.draw(F.lit(seed), "row_seq"), size)).withColumn("_size", size)
    tries = placed.select("row_seq", "scenario", "etype", F.col("dst").alias("_own"), F.posexplode(F.array(*[F.col("_a") + F.pmod(F.col("_first") + d, F.col("_size")) for d in range(WINDOW_TRIES)])).alias("_try", "_i"))
    met = tries.join(prefix.select("scenario", "etype", "_i", F.col("dst").alias("negative")), ["scenario", "etype", "_i"]).where(~F.col("negative").eqNullSafe(F.col("_own")))
    found = met.groupBy("row_seq").agg(F.min_by("negative", "_try").alias("_in"))
    any_time = drawn_negatives(tail, split.where("NOT is_tail"), ["scenario", "etype"], seed)
    return any_time.join(found, "row_seq", "left").withColumn("negative", F.coalesce("_in", "negative")).drop("_in")


#: Draws in a window before the whole of the type is drawn from.
WINDOW_TRIES = 4


def unseen_negatives(edges: DataFrame, seed: int = 42, tries: int = 8) -> DataFrame:
    """For each edge a triple that no edge of its scenario has and that is no self-loop: the
    first of ``tries`` seeded draws among the scenario's nodes; null if all fail."""
    node = ranked(edges.select("scenario", F.explode(F.array("src", "dst")).alias("negative")).distinct(), ["scenario"], [F.col("negative")], "_i")
    size = node.groupBy("scenario").agg(F.count("*").alias("_size"))
    drawn = joined(edges, size, ["scenario"]).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    drawn = drawn.withColumn("_i", F.pmod(S.draw(F.lit(seed), "row_seq", "_try"), F.col("_size")))
    named = drawn.join(node, ["scenario", "_i"]).where("negative <> src")
    seen = edges.select("scenario", "src", "etype", F.col("dst").alias("negative")).distinct()
    fresh = named.join(seen, ["scenario", "src", "etype", "negative"], "left_anti")
    best = fresh.groupBy("row_seq").agg(F.min_by("negative", "_try").alias("negative"))
    return edges.join(best, "row_seq", "left")


def best_epoch(history: Sequence[dict], metric: str = "p_at_100", patience: int = 0) -> dict | None:
    """The epoch of the largest metric (the first of equals; nulls never win), reading on
    until ``patience`` epochs brought nothing better (0: to the end)."""
    best, idle = None, 0
    for epoch in history:
        value = epoch.get(metric)
        if value is not None and value == value and (best is None or value > best[metric]):
            best, idle = epoch, 0
        else:
            idle += 1
            if patience and idle >= patience:
                break
    return best
