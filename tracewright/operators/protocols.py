"""Evaluation protocols: leave one scenario out, jointly, by scenario, by telemetry family."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import evaluate, learned, scores, telemetry
from .graph import offset_streams
from .ranges import persisted, ranked
from .reports import not_nan

METRICS = ("roc_auc", "pr_auc", "p_at_10", "p_at_100")


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def by_holdout(scored: DataFrame, ks: Sequence[int] = (10, 100)) -> DataFrame:
    """A row for each scenario of the scored tails: areas under the curves, precision at each k."""
    areas = scores.curve_areas(scored, ["scenario"])
    best = ranked(scored, ["scenario"], [-F.col("score"), F.col("row_seq")], "_i")
    hits = best.groupBy("scenario").agg(*[F.avg(F.when(F.col("_i") < k, F.col("is_ioc").cast("double"))).alias(f"p_at_{k}") for k in ks])
    return areas.join(hits, "scenario").withColumnRenamed("scenario", "holdout")


def fold_means(folds: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row: the mean of each metric over the folds that have it, and their number."""
    return folds.agg(F.count("*").alias("n_folds"), *[F.avg(not_nan(F.col(m).cast("double"))).alias(m) for m in metrics])


def leave_one_out(stream: DataFrame, method: str | None = None, share: float = 0.7, scenarios: Sequence[str] | None = None) -> DataFrame:
    """A row for each scenario left out (``by_holdout``). Learned scores come from a model of the
    other scenarios, fitted once for each of ``scenarios`` (all that the stream has); a method by
    name learns nothing across scenarios, so all tails are scored at once."""
    if method is not None:
        return by_holdout(evaluate.score_tail(stream, method, "full", share))
    scenarios = scenarios or sorted(r[0] for r in stream.select("scenario").distinct().collect())  # a row a scenario
    vectors = persisted(learned.link_features(stream, share))  # every fold reads them
    return by_holdout(persisted(union(learned.leave_one_out_scores(stream, sc, share, vectors=vectors).select("scenario", "row_seq", "is_ioc", "score") for sc in scenarios)))


def by_scenario(stream: DataFrame, scenario: str, share: float = 0.7, **how) -> DataFrame:
    """Tail scores of one scenario by a model of its own training part only."""
    return learned.link_scores(stream.where(F.col("scenario") == scenario), share, **how)


def joint(stream: DataFrame, score: Callable[[DataFrame, float], DataFrame] | None = None, share: float = 0.7) -> DataFrame:
    """Tail scores of all scenarios as one graph: node ids don't meet, and one model learns from
    all training parts."""
    return (score or learned.link_scores)(offset_streams(stream), share)


def ablation(stream: DataFrame, method: str = "freq_rarity", families: Sequence[str] = ("full", "audit", "zeek", "eve"), share: float = 0.7) -> DataFrame:
    """Detection metrics of each telemetry family alone; the split comes after the filter."""
    found = [scores.curve_areas(evaluate.score_tail(stream, method, f, share)).withColumn("family", F.lit(telemetry.normalize(f))) for f in families]
    return union(found)


def rank_pairs(scored: DataFrame, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Each indicator edge with a seeded benign edge of its scenario: <column> and other_<column>."""
    benign = ranked(scored.where("is_ioc = 0"), ["scenario"], [F.col("row_seq")], "_i").select("scenario", "_i", *[F.col(c).alias(f"other_{c}") for c in columns])
    size = benign.groupBy(F.col("scenario").alias("_sc")).agg(F.count("*").alias("_size"))
    drawn = scored.where("is_ioc = 1").join(F.broadcast(size), F.col("scenario") == F.col("_sc")).withColumn("_i", F.pmod(S.draw(F.lit(seed), "row_seq"), F.col("_size")))
    return drawn.join(benign, ["scenario", "_i"]).select("scenario", "row_seq", *columns, *[f"other_{c}" for c in columns])


def rank_margin(scored: DataFrame, margin: float = 1.0, seed: int = 42) -> DataFrame:
    """scenario, n, loss: the mean of max(0, margin - (score - benign score)) over indicator edges,
    each with a drawn benign edge."""
    pairs = rank_pairs(scored, ["score"], seed)
    return pairs.groupBy("scenario").agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (F.col("score") - F.col("other_score")))).alias("loss"))


def rank_scores(stream: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Tail rows with a score that puts indicator edges before benign ones by a margin: a linear
    model with hinge loss over differences of ``learned.FEATURES`` of pairs of the training part.
    Without any pair all scores are 0."""
    split = learned.history(scores.with_split(stream.drop("score"), share))
    x = [F.col(c).cast("double") for c in learned.FEATURES]
    pairs = rank_pairs(split.where("NOT is_tail").withColumn("x", F.array(*x)), ["x"], seed)
    apart = lambda a, b: array_to_vector(F.zip_with(a, b, lambda p, q: p - q))
    learn = pairs.select(F.lit(1.0).alias("y"), apart("x", "other_x").alias("features")).unionByName(pairs.select(F.lit(0.0).alias("y"), apart("other_x", "x").alias("features")))
    tail = split.where("is_tail")
    if pairs.isEmpty():
        return tail.select(*stream.drop("score").columns, F.lit(0.0).alias("score"))
    fitted = LinearSVC(labelCol="y", fitIntercept=False, regParam=1e-3, maxIter=50).fit(learn)
    ready = fitted.transform(tail.withColumn("features", array_to_vector(F.array(*x))))
    return ready.select(*stream.drop("score").columns, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"))
