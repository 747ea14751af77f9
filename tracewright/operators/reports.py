"""Reports over runs: summaries from JSON files, averages, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def run_files(spark: SparkSession, path: str, name: str = "run_summary.json") -> DataFrame:
    """path, run (folder), scenario and text of every such file below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", "true").text(path)
    at = F.col("_metadata.file_path")
    return files.select(at.alias("path"), F.element_at(F.split(at, "/"), -2).alias("run"), S.scenario_of_path(F.element_at(F.split(at, "/"), -2)).alias("scenario"), F.col("value").alias("json"))


def fields(runs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds columns from JSON paths, as text; absent ones are null."""
    return runs.select("*", *[F.get_json_object("json", p).alias(c) for c, p in wanted.items()])


def summaries(spark: SparkSession, path: str, wanted: dict[str, tuple[str, str]], name: str = "run_summary.json") -> DataFrame:
    """``run_files`` with typed columns: name -> (JSON path, type); null where absent or no such value."""
    runs = fields(run_files(spark, path, name), {c: p for c, (p, _) in wanted.items()})
    return runs.select("path", "run", "scenario", *[F.col(c).try_cast(kind).alias(c) for c, (_, kind) in wanted.items()])


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def macro_average(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over rows that have it, and how many haven't."""
    value = {m: not_nan(F.col(m).cast("double")) for m in metrics}
    return rows.groupBy(*by).agg(*[F.avg(v).alias(m) for m, v in value.items()], *[F.count_if(v.isNull()).alias(f"n_na_{m}") for m, v in value.items()])


def flattened(df: DataFrame, column: str) -> DataFrame:
    """A struct column's fields as columns ``<column>_<field>``."""
    inner = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in inner])


def compared_runs(before: DataFrame, after: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two runs by scenario with both values and the difference of each metric."""
    joined = before.select("scenario", *[F.col(m).cast("double").alias(f"{m}_before") for m in metrics]).join(after.select("scenario", *[F.col(m).cast("double").alias(f"{m}_after") for m in metrics]), "scenario", "full")
    return joined.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics])


def stream_consistency(streams: DataFrame, graphs: DataFrame) -> DataFrame:
    """Stream lengths against the edges of stored graphs, by scenario."""
    n = streams.groupBy("scenario").agg(F.count("*").alias("n_stream"))
    e = graphs.where("kind = 'edge'").groupBy("scenario").agg(F.sum("n").alias("n_graph"))
    joined = n.join(e, "scenario", "full")
    return joined.withColumn("consistent", F.coalesce(F.col("n_stream") == F.col("n_graph"), F.lit(False)))


def latex_table(rows: DataFrame, name: str, metrics: Sequence[str], caption: str = "") -> str:
    """A small result (one row a method) as a LaTeX table."""
    lines = [r"\begin{tabular}{l" + "r" * len(metrics) + "}", " & ".join(["Method", *metrics]) + r" \\", r"\hline"]
    for r in rows.orderBy(name).collect():
        lines.append(" & ".join([str(r[name]), *("--" if r[m] is None else f"{r[m]:.4f}" for m in metrics)]) + r" \\")
    lines.append(r"\end{tabular}")
    return "\n".join(lines) if not caption else "\n".join([r"\begin{table}", *lines, rf"\caption{{{caption}}}", r"\end{table}"])
