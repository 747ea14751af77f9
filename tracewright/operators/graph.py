"""Graphs of events: causal edges, node numbers, the edge stream, features, static graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import scalars as S
from .ranges import joined, persisted, ranked

WINDOW = 50.0
MOST_FOR_PROCESS = 1000


def with_time(events: DataFrame, precision: str = "double") -> DataFrame:
    return events.withColumn("t", S.event_time(F.col("ts"), F.col("ord"), precision))


def causal_edges(events: DataFrame, mode: str = "level0", window: float = WINDOW, most: int = MOST_FOR_PROCESS) -> DataFrame:
    """Edges from each event to the next of the same process within ``window``; the first
    ``most`` of a process. ``level1`` adds those between events of a process on the same
    network or file object. Columns as in events, with delta_t, cause_rule, confidence and
    ``ord`` counting on from the largest of the scenario."""
    timed = with_time(events).where("src_type = 'PROC'")
    place = ["t", "ord", "edge_type", "src_key", "dst_key", "event_seq"]
    largest = events.groupBy("scenario").agg(F.max("ord").alias("_last"))
    firsts = timed.groupBy(F.col("scenario").alias("_scenario"), F.col("src_key").alias("_src")).agg(F.min(F.struct(*place)).alias("_first"))
    base = timed.join(firsts, F.col("scenario").eqNullSafe(F.col("_scenario")) & F.col("src_key").eqNullSafe(F.col("_src"))).drop("_scenario", "_src")

    def linked(rows: DataFrame, keys: list[str], rule: str, confidence: float) -> DataFrame:
        order = Window.partitionBy("scenario", *keys).orderBy(*place)
        step = rows.withColumn("delta_t", F.col("t") - F.lag("t").over(order))
        return step.where((F.col("delta_t") >= 0) & (F.col("delta_t") <= window)).withColumn("cause_rule", F.lit(rule)).withColumn("confidence", F.lit(confidence))

    level0 = linked(base, ["src_key"], "next_event_same_proc", 1.0)
    own = Window.partitionBy("scenario", "src_key").orderBy(*place)
    level0 = level0.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).withColumn("_level", F.lit(0))
    edges = level0
    if mode == "level1":
        touching = base.where(F.col("dst_type").isin("NET", "FILE"))
        edges = level0.unionByName(linked(touching, ["src_key", "dst_type", "dst_key"], "shared_object_bridge", 0.8).withColumn("_n", F.lit(0)).withColumn("_level", F.lit(1)))
    # level 0 follows processes by first appearance, level 1 the order of events
    rank = [F.col("_level"), F.when(F.col("_level") == 0, F.col("_first")), *[F.col(c) for c in place]]
    numbered = joined(ranked(edges, ["scenario"], rank, "_at").withColumn("_at", F.col("_at") + 1), largest, ["scenario"])
    return numbered.select("scenario", F.lit("CAUSE").alias("edge_type"), F.lit("PROC").alias("src_type"), "src_key", F.lit("PROC").alias("dst_type"), F.col("src_key").alias("dst_key"), "ts", (F.col("_last") + F.col("_at")).alias("ord"), "delta_t", "cause_rule", "confidence")


def augmented(events: DataFrame, mode: str = "level0", **how) -> DataFrame:
    """Events and their causal edges; nothing is added with mode ``off``."""
    return events if mode == "off" else events.unionByName(causal_edges(events, mode, **how), allowMissingColumns=True)


def with_defaults(events: DataFrame) -> DataFrame:
    """Canonical attributes that an edge type has and an event lacks take their defaults;
    other columns stay as they are."""
    every: dict[str, list[str]] = {}
    for edge, attrs in K.EDGE_DEFAULTS.items():
        for a in attrs:
            every.setdefault(a, []).append(edge)
    filled = {}
    for a, edges in every.items():
        value = K.EDGE_DEFAULTS[edges[0]][a]
        own = F.col(a) if a in events.columns else F.lit(None).cast({str: "string", int: "bigint", float: "double"}[type(value)])
        filled[a] = F.coalesce(own, F.when(F.col("edge_type").isin(edges), F.lit(value)))
    return events.withColumns(filled)


def mismatched(events: DataFrame) -> DataFrame:
    """Events whose node types aren't those of their edge type."""
    ends = F.create_map(*[F.lit(x) for e, (a, b) in K.EDGE_ENDS.items() for x in (e, f"{a}>{b}")])
    return events.where(~F.coalesce(F.element_at(ends, F.col("edge_type")) == F.concat_ws(">", "src_type", "dst_type"), F.lit(False)))


def nodes(events: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """scenario, node_type, key, local_id (dense, by first appearance, source before target),
    global_id (types in order of name), and the latest non-null of each attribute."""
    ends = F.explode(F.array(F.struct(F.col("src_type").alias("node_type"), F.col("src_key").alias("key"), F.lit(0).alias("role")), F.struct(F.col("dst_type").alias("node_type"), F.col("dst_key").alias("key"), F.lit(1).alias("role")))).alias("n")
    seen = events.select("scenario", "event_seq", ends, *attributes).select("scenario", "n.*", (F.col("event_seq") * 2 + F.col("n.role")).alias("at"), *attributes)
    latest = [F.max_by(F.when(F.col("role") == 1, F.col(a)), F.when((F.col("role") == 1) & F.col(a).isNotNull(), F.col("at"))).alias(a) for a in attributes]
    found = persisted(seen.groupBy("scenario", "node_type", "key").agg(F.min("at").alias("first_at"), *latest))  # counted and numbered
    offset = found.groupBy("scenario", "node_type").agg(F.count("*").alias("n"))
    before = Window.partitionBy("scenario").orderBy("node_type").rowsBetween(Window.unboundedPreceding, -1)
    offset = offset.select("scenario", "node_type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = joined(ranked(found, ["scenario", "node_type"], [F.col("first_at")], "local_id"), offset, ["scenario", "node_type"])
    return numbered.withColumn("global_id", F.col("local_id") + F.col("offset")).drop("offset", "first_at")


def graph_counts(events: DataFrame) -> DataFrame:
    """kind ('node' or 'edge'), type, n for each scenario."""
    n = nodes(events).groupBy("scenario", F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    return n.unionByName(events.groupBy("scenario", F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


def edge_features(events: DataFrame, buckets: int = K.FEATURE_BUCKETS) -> Column:
    """Feature vector of an edge: numbers, direction (in, out, other), flags, and how many
    categories fall into each hash bucket. Columns that events lack count as absent."""
    have = set(events.columns)
    numbers = [S.safe_double(F.col(c)) if c in have else F.lit(0.0) for c in K.FEATURE_NUMBERS]
    direction = F.lower(F.trim(F.coalesce(F.col("direction"), F.lit("")))) if "direction" in have else F.lit("")
    inward, outward = direction.isin("in", "inbound"), direction.isin("out", "outbound")
    hot = [inward.cast("double"), outward.cast("double"), (~inward & ~outward).cast("double")]
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double") if c in have else F.lit(0.0) for c in K.FEATURE_FLAGS]
    cats = [F.when(F.trim(F.col(c).cast("string")) != "", S.bucket(F.concat_ws("=", F.lit(c), F.col(c).cast("string")), buckets)) for c in K.FEATURE_CATEGORIES if c in have]
    counts = [reduce(lambda a, b: a + b, [F.coalesce((c == i).cast("double"), F.lit(0.0)) for c in cats], F.lit(0.0)) for i in range(buckets)]
    return F.array(*numbers, *hot, *flags, *counts)


def edge_stream(events: DataFrame, precision: str = "double", features: bool = True) -> DataFrame:
    """Edges by global node ids in time order: scenario, stream_idx, src, dst, t, etype (rank
    among the scenario's triplets), etype_global, msg, and the labels that events have."""
    numbered = nodes(events).select("scenario", "node_type", "key", "global_id")
    end = lambda side: numbered.select("scenario", *[F.col(a).alias(b) for a, b in (("node_type", f"{side}_type"), ("key", f"{side}_key"), ("global_id", side))])
    timed = with_time(events, precision).withColumn("t", F.col("t").cast("bigint") if precision == "double" else F.floor("t"))
    timed = timed.withColumn("_exact", S.event_time(F.col("ts"), F.col("ord"), precision))
    met = timed.join(end("src"), ["scenario", "src_type", "src_key"]).join(end("dst"), ["scenario", "dst_type", "dst_key"])
    kinds = events.select("scenario", "src_type", "edge_type", "dst_type").distinct()
    rank = Window.partitionBy("scenario").orderBy("src_type", "edge_type", "dst_type")
    kinds = kinds.withColumn("etype", (F.row_number().over(rank) - 1).cast("int"))
    met = met.join(F.broadcast(kinds), ["scenario", "src_type", "edge_type", "dst_type"])
    every = sorted((a, e, b) for e, (a, b) in K.EDGE_ENDS.items())
    where = F.create_map(*[F.lit(x) for i, (_, e, _) in enumerate(every) for x in (e, i)])
    order = [F.col(c) for c in ("_exact", "etype", "src", "dst", "event_seq")]
    labels = [c for c in ("is_ioc", "is_ioc_line", "is_rule_hit", "is_rule_hit_high", "row_idx", "source_file", "ioc_type", "rule_ioc_type") if c in events.columns]
    more = [edge_features(events).alias("msg")] if features else []
    return ranked(met, ["scenario"], order, "stream_idx").select("scenario", "stream_idx", "src", "dst", "t", "etype", F.element_at(where, F.col("edge_type")).alias("etype_global"), *more, *labels)


def offset_streams(stream: DataFrame) -> DataFrame:
    """Node ids that don't meet across scenarios: each scenario's start after the last's."""
    sizes = stream.groupBy("scenario").agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n"))
    before = Window.orderBy("scenario").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("scenario", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return stream.join(F.broadcast(base), "scenario").withColumn("src", F.col("src") + F.col("base")).withColumn("dst", F.col("dst") + F.col("base")).drop("base")


def degrees(edges: DataFrame, etypes: int) -> DataFrame:
    """scenario, node, log1p of in- and out-degree, and the share of each edge type among the
    edges that the node is the source of (all 0 for a node without)."""
    ends = edges.select("scenario", "etype", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    flat = ends.select("scenario", "etype", "e.*")
    kinds = [F.sum(F.when(F.col("etype") == k, F.col("o")).otherwise(0).cast("double")).alias(f"k{k}") for k in range(etypes)]
    sums = flat.groupBy("scenario", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), *kinds)
    total = F.greatest(F.lit(1.0), reduce(lambda a, b: a + b, [F.col(f"k{k}") for k in range(etypes)]))
    return sums.select("scenario", "node", F.log1p("n_in").alias("log_in"), F.log1p("n_out").alias("log_out"), *[(F.col(f"k{k}") / total).alias(f"share_{k}") for k in range(etypes)])


def both_ways(edges: DataFrame, etypes: int) -> DataFrame:
    """Edges and their reverses; a reverse has its edge type plus ``etypes``."""
    back = edges.select(*[c for c in edges.columns if c not in ("src", "dst", "etype")], F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("etype") + etypes).alias("etype"))
    return edges.unionByName(back)


def neighbour_means(edges: DataFrame, features: DataFrame, width: int, by_relation: bool = False) -> DataFrame:
    """Mean feature vector of a node's in-neighbours (for each edge type): one message pass."""
    x = features.select("scenario", F.col("node").alias("src"), "x")
    keys = ["scenario", "dst", "etype"] if by_relation else ["scenario", "dst"]
    means = [F.avg(F.get("x", F.lit(i))) for i in range(width)]
    return edges.join(x, ["scenario", "src"]).groupBy(*keys).agg(F.array(*means).alias("mean")).withColumnRenamed("dst", "node")


def node_features(found: DataFrame) -> DataFrame:
    """scenario, node, x: one-hot type and six attribute numbers (0 where absent)."""
    hot = [(F.col("node_type") == t).cast("double") for t in K.NODE_TYPES]
    have = set(found.columns)
    names = ("is_lolbin", "path_sensitivity", "parent_depth", "port_sensitivity", "is_system_path", "is_temp_path")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in names]
    return found.select("scenario", F.col("global_id").alias("node"), F.array(*hot, *numbers).alias("x"))
