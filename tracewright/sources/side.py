"""Side inputs: indicators, rules, stage maps, layers, catalogues, stored artifacts; sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import RULES, SCENARIO_FILES
from ..functions import scalars as S

SCORES = "scenario string, t bigint, etype int, src bigint, dst bigint, score double, is_ioc int, source_file string, row_idx bigint, ioc_type string, pred_stage string, pred_stage_prob double"


def known_scenarios() -> dict:
    """Source catalogue of the known scenarios."""
    name = lambda f: f.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return {sc: {name(f): {"filename": f, "log_type": name(f), "has_ioc": True} for f in files} for sc, files in SCENARIO_FILES.items()}


def catalog(scenarios: dict[str, dict[str, bool]]) -> dict:
    """Source catalogue from scenario -> log -> has_ioc."""
    return {sc: {log: {"filename": "eve.json" if log == "eve" else f"{log}.csv", "log_type": log, "has_ioc": ioc} for log, ioc in logs.items()} for sc, logs in scenarios.items()}


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path)


GROUND_TRUTH = "map<string,struct<files:map<string,struct<iocs:array<struct<type:string,value:string,lines:array<bigint>>>>>>>"


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, values): scenario, source_file, line, type, value; and scenario, type, value."""
    doc = whole_text(spark, path).select(F.from_json("value", GROUND_TRUTH).alias("m"))
    files = doc.select(F.explode("m").alias("scenario", "s")).select("scenario", F.explode("s.files").alias("source_file", "f"))
    iocs = files.select("scenario", "source_file", F.explode("f.iocs").alias("i")).select("scenario", "source_file", F.trim("i.type").alias("type"), F.trim("i.value").alias("value"), "i.lines")
    iocs = iocs.where(F.col("type").isNotNull() & (F.col("type") != ""))
    lines = iocs.select("scenario", "source_file", F.explode("lines").alias("line"), "type", "value")
    return lines, iocs.where("value <> ''").select("scenario", "type", "value").distinct()


def line_types(lines: DataFrame) -> DataFrame:
    """scenario, source_file, line, ioc_type: the primary type of each line."""
    return lines.groupBy("scenario", "source_file", "line").agg(S.primary_type(F.collect_set("type")).alias("ioc_type"))


_rules: dict[str, dict] = {}


def rules(spark: SparkSession | None = None, path: str | None = None) -> dict:
    """A rule file, read once; the default rules without a path."""
    if not path:
        return RULES
    if path not in _rules:
        _rules[path] = json.loads(whole_text(spark, path).first()[0])
    return _rules[path]


def layers(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """scenario, technique, tactic of every technique in the layer files below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(path)
    doc = files.select(S.scenario_of_path(F.col("_metadata.file_path")).alias("scenario"), F.from_json("value", "techniques array<struct<techniqueID:string,tactic:string>>").alias("j"))
    return doc.select("scenario", F.explode("j.techniques").alias("x")).select("scenario", F.col("x.techniqueID").alias("technique"), F.col("x.tactic").alias("tactic"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table from CSV with its rows numbered in file order (``row_seq``)."""
    from .logs import numbered

    raw = spark.read.option("header", "true").schema(SCORES.replace("t bigint", "t double")).csv(path)
    keep = raw.select(*[F.col(c).alias("log_row" if c == "row_idx" else c) for c in raw.columns], "_metadata")
    out = numbered(keep).drop("_metadata").withColumnRenamed("row_idx", "row_seq").withColumnRenamed("log_row", "row_idx")
    return out.withColumn("t", F.col("t").cast("bigint"))


def scores_path(spark: SparkSession, run: str, split: str = "tail") -> str | None:
    """The run's score table: that of the split, else the unnamed one, else all edges'."""
    from .logs import exists

    for name in (f"edge_scores_{split}.csv", "edge_scores.csv", "edge_scores_all.csv"):
        if exists(spark, f"{run}/{name}"):
            return f"{run}/{name}"
    return None


def write_scores(df: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in SCORES.split(", ")]
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]).write.mode("overwrite").option("header", "true").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "scenario") -> None:
    """Graphs, streams and other artifacts: Parquet by scenario, replaced where written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_stream(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("scenario", "src", "dst", "t", "etype")) -> DataFrame:
    """A stored stream; an error says which of the ``wanted`` columns it lacks."""
    found = spark.read.parquet(path)
    missing = [c for c in wanted if c not in found.columns]
    if missing:
        raise ValueError(f"{path} is no stream: it lacks {', '.join(missing)}")
    return found


def ensure_stream(spark: SparkSession, events: str, path: str, regenerate: bool = False, precision: str = "double") -> DataFrame:
    """The stored stream, made from stored events first where it is missing (or ``regenerate``)."""
    from ..operators.graph import edge_stream
    from .logs import exists

    if regenerate or not exists(spark, path):
        write_partitioned(edge_stream(spark.read.parquet(events), precision), path)
    return read_stream(spark, path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of a stored graph."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("nodes", "edges", "counts"))


def write_graph(events: DataFrame, path: str, attributes: list[str] = ()) -> None:
    """Nodes with their latest attributes, edges and counts by type, each by scenario."""
    from ..operators.graph import edge_stream, graph_counts, nodes

    for part, table in (("nodes", nodes(events, attributes)), ("edges", edge_stream(events)), ("counts", graph_counts(events))):
        write_partitioned(table, f"{path}/{part}")


def decode_meta(events: DataFrame) -> DataFrame:
    """What decodes a stream: scenario, kind ('node' or 'edge'), type, first id and number of a node
    type, number of an edge type (by name)."""
    from ..operators.graph import nodes

    n = nodes(events).groupBy("scenario", F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.min("global_id").alias("first"), F.count("*").alias("n"))
    kinds = events.select("scenario", F.concat_ws(">", "src_type", "edge_type", "dst_type").alias("type")).groupBy("scenario", "type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("scenario").orderBy("type")  # one row for each kind of edge
    return n.unionByName(kinds.select("scenario", F.lit("edge").alias("kind"), "type", (F.row_number().over(order) - 1).cast("bigint").alias("first"), "n"))


def patch_latency(spark: SparkSession, path: str, milliseconds: float, out: str) -> None:
    """A stored JSON result with its latency set, written to ``out``."""
    spark.read.json(path).withColumn("latency_ms_per_1k", F.lit(float(milliseconds))).write.mode("overwrite").json(out)


def stage_maps(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """A stage-map file: ``stages``, and maps from indicator types and tactics to them."""
    found = json.loads(whole_text(spark, path).first()[0])
    known = set(found.get("stages", []))
    for name in ("ioc_type_to_stage", "tactic_to_stage"):
        unknown = {s for s in found.get(name, {}).values()} - known
        if unknown:
            raise ValueError(f"{name} names unknown stages: {', '.join(sorted(unknown))}")
    return found


def write_text(rows: DataFrame, folder: str, name: str) -> None:
    """The one text row as the file ``name`` in ``folder``."""
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/{name}")
    out = path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(rows.first()[0].encode("utf-8")))
    finally:
        out.close()


def write_summary(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_run(metrics: DataFrame, run: str, config: dict) -> None:
    """``run_summary.json`` of a run: its settings and the one row of metrics."""
    row = metrics.select(F.to_json(F.struct(F.lit(json.dumps(config)).alias("config"), F.struct("*").alias("best"))).alias("value"))
    write_text(row, run, "run_summary.json")


def write_stage_truth(report: DataFrame, path: str) -> None:
    """Stage truth as JSON: one folder a scenario, and a summary of stage numbers beside them."""
    write_json_by(report, f"{path}/scenarios")
    write_json(report.select("scenario", F.size("semantic.stages").alias("n_semantic"), F.size("observable.stages").alias("n_observable")), f"{path}/_summary")


def write_json_by(df: DataFrame, path: str, by: str = "scenario") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_alerts(df: DataFrame, path: str) -> None:
    """Alerts as JSON lines, and a CSV summary without nested columns."""
    df.write.mode("overwrite").json(f"{path}/alerts_json")
    df.drop("nodes", "evidence").write.mode("overwrite").option("header", "true").csv(f"{path}/alerts_csv")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def graphml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Nodes (``node``) or edges (``edge``) of a GraphML file: their attributes and a map of data."""
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").load(path)
    have = [c for c in ("_id", "_source", "_target") if c in rows.columns]
    out = rows.select(*[F.col(c).cast("string").alias(c.strip("_")) for c in have], *(["data"] if "data" in rows.columns else []))
    if "data" not in out.columns:
        return out
    item = out.schema["data"].dataType
    items = F.col("data") if item.typeName() == "array" else F.array("data")
    return out.withColumn("data", F.map_from_arrays(F.transform(items, lambda d: d["_key"].cast("string")), F.transform(items, lambda d: d["_VALUE"].cast("string"))))


def with_dense_ids(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with 0-based node numbers in place of keys."""
    from ..operators.ranges import ranked

    ids = ranked(nodes.select(F.col(key)).distinct(), [], [F.col(key)], "n")
    return edges.join(ids.select(F.col(key).alias("source"), F.col("n").alias("src")), "source").join(ids.select(F.col(key).alias("target"), F.col("n").alias("dst")), "target")
