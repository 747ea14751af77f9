"""Learned edge scores on pyspark.ml: temporal and neighbourhood features, link probability.

The capability, not the numbers, of a graph network: a model tells real training edges from
sampled wrong ones, and a tail edge's anomaly score is -ln of its probability.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import STAGES
from .graph import both_ways, degrees, neighbour_means
from .ranges import persisted
from .scores import with_split, with_tail
from .training import sampled_negatives, stage_label

FEATURES = ["log_src", "log_dst", "log_pair", "log_triple", "log_dst_etype", "log_idle"]


def history(split: DataFrame) -> DataFrame:
    """Node memory as windows: what the training part had seen of an edge's ends before it."""
    before = lambda *keys: Window.partitionBy("scenario", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = (~F.col("known")).cast("int") if "known" in split.columns else (~F.col("is_tail")).cast("int")
    count = lambda *keys: F.log1p(F.coalesce(F.sum(seen).over(before(*keys)), F.lit(0)))
    idle = F.col("t") - F.max(F.when(seen == 1, F.col("t"))).over(before("src"))
    return split.withColumns({"log_src": count("src"), "log_dst": count("dst"), "log_pair": count("src", "dst"), "log_triple": count("src", "dst", "etype"), "log_dst_etype": count("dst", "etype"), "log_idle": F.coalesce(F.log1p(F.greatest(idle, F.lit(0))), F.lit(-1.0))})


def link_features(stream: DataFrame, share: float = 0.7, seed: int = 42, benign: bool = False) -> DataFrame:
    """Training edges with sampled wrong ones (y = 1, 0) and the tail, with ``features``.

    Negatives of training edges go through the same features, so both see the same past. With
    ``benign`` training edges that an indicator touches teach nothing (``y`` is null), but
    are part of the past."""
    stream = stream.drop("score")
    split = with_split(stream, share)
    train = split.where("NOT is_tail").drop("is_tail", "pos")
    wrong = sampled_negatives(train, "random", 0.0, seed).where("negative IS NOT NULL")
    wrong = wrong.withColumn("dst", F.col("negative")).select(*train.columns)
    marked = split.withColumn("known", F.col("is_tail")).withColumn("y", F.lit(1.0))
    at = split.select("scenario", "row_seq", "pos")
    fake = wrong.join(at, ["scenario", "row_seq"]).withColumn("is_tail", F.lit(False)).withColumn("known", F.lit(True)).withColumn("y", F.lit(0.0))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(history(marked.unionByName(fake)))
    return ready.withColumn("y", F.when((F.col("y_ioc") == 0) | F.col("is_tail"), F.col("y"))) if benign else ready


def fit_link(learn: DataFrame, model: str = "logistic", seed: int = 42):
    """A fitted classifier of real edges (``y`` = 1); has ``write()`` and can be loaded again."""
    learn = learn.where("y IS NOT NULL")
    if model == "mlp":
        return MultilayerPerceptronClassifier(layers=[len(FEATURES), 16, 2], seed=seed, maxIter=60, labelCol="y").fit(learn)
    return LogisticRegression(labelCol="y", maxIter=50, regParam=1e-4).fit(learn)


def anomaly(scored: DataFrame, columns: list[str]) -> DataFrame:
    """``score``: -ln(max(p, 1e-12)) of the link probability p."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*columns, (-F.log(F.greatest(p, F.lit(1e-12)))).alias("score"))


def link_scores(stream: DataFrame, share: float = 0.7, model: str = "logistic", seed: int = 42, fitted=None, benign: bool = False) -> DataFrame:
    """Tail rows with an anomaly score, by ``fitted`` or a model of the training part (of its
    benign edges only with ``benign``)."""
    stream = stream.drop("score")
    vectors = link_features(stream, share, seed, benign)
    fitted = fitted or fit_link(vectors.where("NOT is_tail"), model, seed)
    return anomaly(fitted.transform(vectors.where("is_tail")), [*stream.columns, "pos"])


def leave_one_out_scores(stream: DataFrame, holdout: str, share: float = 0.7, model: str = "logistic", seed: int = 42, vectors: DataFrame | None = None) -> DataFrame:
    """Tail scores of one scenario by a model of the other scenarios' training parts; the
    scenario's own prefix only warms up the history. ``vectors``: ``link_features`` of the
    stream, where several scenarios are left out in turn."""
    stream = stream.drop("score")
    vectors = link_features(stream, share, seed) if vectors is None else vectors
    fitted = fit_link(vectors.where((F.col("scenario") != holdout) & ~F.col("is_tail")), model, seed)
    return anomaly(fitted.transform(vectors.where((F.col("scenario") == holdout) & F.col("is_tail"))), [*stream.columns, "pos"])


def stage_scores(stream: DataFrame, mode: str = "rule_high", share: float = 0.7) -> DataFrame:
    """Tail rows with pred_stage and pred_stage_prob, learnt from the stage labels of the
    training part (class 0 is "none"). Without any label every stage is "none"."""
    stream = stream.drop("pred_stage", "pred_stage_prob")
    split = history(with_split(stream, share)).withColumn("y", stage_label(mode).cast("double"))
    etypes = (split.agg(F.max("etype")).first()[0] or 0) + 1
    kind = [(F.col("etype") == k).cast("double") for k in range(etypes)]
    ready = split.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in FEATURES], *kind)))
    learn = ready.where("NOT is_tail")
    if learn.where("y > 0").isEmpty():
        return ready.where("is_tail").select(*stream.columns, F.lit("none").alias("pred_stage"), F.lit(1.0).alias("pred_stage_prob"))
    fitted = LogisticRegression(labelCol="y", family="multinomial", maxIter=50, regParam=1e-3).fit(learn)
    stage, p = stage_prediction(vector_to_array("probability"), ["none", *STAGES][: fitted.numClasses])
    return fitted.transform(ready.where("is_tail")).select(*stream.columns, stage.alias("pred_stage"), p.alias("pred_stage_prob"))


def graph_scores(stream: DataFrame, share: float = 0.7, layers: int = 2, by_relation: bool = False, seed: int = 42, attributes: DataFrame | None = None) -> DataFrame:
    """Tail rows with ``score``, from a static graph of the training part.

    Node features (degrees, shares of edge types, and the ``attributes`` of ``node_features``,
    if given: scenario, node, x) are averaged over in-neighbours, layer by
    layer (for each edge type with ``by_relation``), and a logistic model tells training
    edges from sampled ones by the features of both ends and their products."""
    stream = stream.drop("score")
    split = with_tail(stream, share)
    train = split.where("NOT is_tail").drop("is_tail")
    etypes = (train.agg(F.max("etype")).first()[0] or 0) + 1
    d = degrees(train, etypes)
    names = [c for c in d.columns if c not in ("scenario", "node")]
    x = d.select("scenario", "node", F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    width = len(names)
    if attributes is not None:
        more = attributes.select("scenario", "node", F.col("x").alias("_more"))
        extra = len(more.first()["_more"])
        x = x.join(more, ["scenario", "node"], "left").select("scenario", "node", F.concat("x", F.coalesce("_more", F.array(*[F.lit(0.0)] * extra))).alias("x"))
        width += extra
    edges = both_ways(train.select("scenario", "src", "dst", "etype"), etypes)
    for _ in range(layers):
        mean = neighbour_means(edges, x, width, by_relation)
        if by_relation:  # relations of a node, averaged
            mean = mean.groupBy("scenario", "node").agg(F.array(*[F.avg(F.get("mean", F.lit(i))) for i in range(width)]).alias("mean"))
        zero = F.array(*[F.lit(0.0)] * width)
        x = x.join(mean, ["scenario", "node"], "left").select("scenario", "node", F.zip_with("x", F.coalesce("mean", zero), lambda a, b: (a + b) / 2).alias("x"))
    x = persisted(x)  # both ends of every edge read it
    wrong = sampled_negatives(train, "random", 0.0, seed).where("negative IS NOT NULL")
    wrong = wrong.withColumn("dst", F.col("negative")).select(*train.columns)
    every = split.withColumn("y", F.lit(1.0)).unionByName(wrong.withColumn("is_tail", F.lit(False)).withColumn("y", F.lit(0.0)))
    zero = F.array(*[F.lit(0.0)] * width)
    end = lambda side: x.select("scenario", F.col("node").alias(side), F.col("x").alias(f"x_{side}"))
    joined = every.join(end("src"), ["scenario", "src"], "left").join(end("dst"), ["scenario", "dst"], "left")
    joined = joined.withColumn("x_src", F.coalesce("x_src", zero)).withColumn("x_dst", F.coalesce("x_dst", zero))
    kind = F.array(*[(F.col("etype") == k).cast("double") for k in range(etypes)])
    vector = F.concat("x_src", "x_dst", F.zip_with("x_src", "x_dst", lambda a, b: a * b), kind)
    ready = joined.withColumn("features", array_to_vector(vector))
    fitted = LogisticRegression(labelCol="y", maxIter=50, regParam=1e-3).fit(ready.where("NOT is_tail"))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return fitted.transform(ready.where("is_tail")).select(*stream.columns, (-F.log(F.greatest(p, F.lit(1e-12)))).alias("score"))


def stage_prediction(probability: Column, stages: list[str]) -> tuple[Column, Column]:
    """(most probable stage, its probability) of an array of class probabilities."""
    best = F.array_max(probability)
    at = F.array_position(probability, best)
    return F.element_at(F.array(*[F.lit(s) for s in stages]), at.cast("int")), best


def encode_columns(df: DataFrame, text: list[str] = (), number: list[str] = (), category: list[str] = (), width: int = 64) -> DataFrame:
    """Encoders of a node table: hashed words for text, the value for numbers, one-hot codes
    for categories; adds ``x_<column>``."""
    for c in text:
        words = Tokenizer(inputCol=c, outputCol=f"_w_{c}").transform(df.withColumn(c, F.coalesce(c, F.lit(""))))
        df = HashingTF(inputCol=f"_w_{c}", outputCol=f"x_{c}", numFeatures=width).transform(words).drop(f"_w_{c}")
    for c in number:
        df = df.withColumn(f"x_{c}", F.array(F.col(c).cast("double")))
    for c in category:
        coded = StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
        df = OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"x_{c}", dropLast=False).fit(coded).transform(coded).drop(f"_i_{c}")
    return df
