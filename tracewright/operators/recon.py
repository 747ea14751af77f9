"""Attack reconstruction: stages of edges, votes, recall against the truth, chain segments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import STAGES
from ..functions import scalars as S
from . import alerts as A
from . import scores as R


def with_stage(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Adds ``stage``: of the type that the truth gives the row's line, else the next line,
    else the row's own type; '' for none. ``lines``: source_file, line, ioc_type, one row
    a line; joined twice on both keys."""
    own = F.trim(F.coalesce("ioc_type", F.lit("")))
    if lines is None:
        return rows.withColumn("stage", S.stage_of_type(own))
    at = lines.select("source_file", F.col("line").cast("bigint").alias("row_idx"), F.col("ioc_type").alias("_here"))
    after = lines.select("source_file", (F.col("line") - 1).cast("bigint").alias("row_idx"), F.col("ioc_type").alias("_next"))
    joined = rows.join(at, ["source_file", "row_idx"], "left").join(after, ["source_file", "row_idx"], "left")
    valid = F.col("row_idx") >= 0
    line_type = F.coalesce(F.when(valid & (F.col("_here") != ""), F.col("_here")), F.when(valid & (F.col("_next") != ""), F.col("_next")))
    return joined.withColumn("stage", S.stage_of_type(F.coalesce(line_type, own))).drop("_here", "_next")


def predicted_stage(least: float = 0.0) -> Column:
    """The model's stage where it is one and probable enough, else ''."""
    s = F.trim(F.coalesce("pred_stage", F.lit("")))
    sure = F.coalesce(F.col("pred_stage_prob").cast("double"), F.lit(0.0)) >= least if least > 0 else F.lit(True)
    return F.when(s.isin(list(STAGES)) & sure, s).otherwise("")


def has_predictions(scores: DataFrame, rows: int | None = None) -> bool:
    """Whether a row (one of the first ``rows``, if given) has a predicted stage."""
    s = F.trim(F.coalesce("pred_stage", F.lit("")))
    looked = scores if rows is None else scores.where(F.col("row_seq") < rows)
    return not looked.where((s != "") & (s != "none")).isEmpty()


def votes(rows: DataFrame, least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """stage, n: stages with at least ``least`` edges (in each group)."""
    counted = rows.where("stage <> ''").groupBy(*by, "stage").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= max(1, least))


def stage_set(voted: DataFrame) -> DataFrame:
    """One row: the stages, sorted by name."""
    return voted.agg(F.array_sort(F.collect_set("stage")).alias("predicted_stages"))


def recon_scores(predicted: DataFrame, observed: Iterable[str]) -> DataFrame:
    """Adds recall, precision and ordered recall of ``predicted_stages`` (0 without truth or
    prediction)."""
    truth = [s for s in STAGES if s in set(observed)]
    known = F.array(*[F.lit(s) for s in truth]).cast("array<string>")
    p = F.col("predicted_stages")
    both = F.size(F.array_intersect(p, known))
    lcs = S.lcs_of_ordered(S.ordered_stages(p), known)
    return predicted.select(
        "*",
        (both / F.lit(float(max(1, len(truth))))).alias("stage_recall"),
        (both / F.greatest(F.lit(1), F.size(p)).cast("double")).alias("stage_precision"),
        lcs.alias("lcs_length"),
        (lcs / F.lit(float(max(1, len(truth))))).alias("ordered_stage_recall_lcs"),
    )


def chain_segments(rows: DataFrame) -> DataFrame:
    """Runs of equal stages in time: segment, stage, t_min, t_max, n_edges.

    Rows need ``stage``, ``t`` and ``rank``, which decides ties of time. Meant for the few
    rows of a top-k."""
    order = Window.orderBy("t", "rank")
    marked = rows.where("stage <> ''").withColumn("_new", F.coalesce((F.lag("stage").over(order) != F.col("stage")).cast("int"), F.lit(1)))
    numbered = marked.withColumn("segment", F.sum("_new").over(order))
    return numbered.groupBy("segment", "stage").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count("*").alias("n_edges"))


def only_ioc_logs(rows: DataFrame, files: Iterable[str]) -> DataFrame:
    return rows.where(F.trim(F.coalesce("source_file", F.lit(""))).isin(sorted(files)))


def pool_counts(rows: DataFrame, files: Iterable[str]) -> DataFrame:
    inside = F.trim(F.coalesce("source_file", F.lit(""))).isin(sorted(files))
    return rows.agg(F.count("*").alias("n_rows_total"), F.count_if(inside).alias("n_rows_candidate"), F.count_if(~inside).alias("n_rows_excluded"))


SELECTIONS = {
    "global": lambda s, k, o: R.top_k(s, k),
    "pair_dedupe": lambda s, k, o: R.top_k(s, k, by_pair=True),
    "ioc_pool": lambda s, k, o: R.top_k_ioc(s, k),
    "source_quota": lambda s, k, o: R.top_k_source_quota(s, k, o.get("quotas", {}), o.get("by_pair", True), o.get("without_etypes", ())),
    "group_cap": lambda s, k, o: R.top_k_group_cap(s, k, o.get("key", "etype_dst"), o.get("cap", 5), o.get("by_pair", True)),
    "group_cap_adaptive": lambda s, k, o: R.top_k_group_cap_adaptive(s, k, o.get("key", "etype_src"), o.get("probe", 5), o.get("hot", 20), o.get("cap", 10), o.get("by_pair", True)),
}


def evaluate_top_k(scores: DataFrame, observed: Iterable[str], ks: Sequence[int] = (10, 50, 100), mode: str = "global", lines: DataFrame | None = None, predicted: bool = False, least_prob: float = 0.0, least: int = 1, **options) -> DataFrame:
    """One row for each k: stages of the selected edges and their recall.

    Modes: ``global``, ``pair_dedupe``, ``ioc_pool``, ``source_quota``, ``group_cap``,
    ``group_cap_adaptive``. Unless ``predicted``, only indicator edges vote."""
    out = None
    for k in ks:
        chosen = SELECTIONS[mode](scores, k, options)
        staged = chosen.withColumn("stage", predicted_stage(least_prob)) if predicted else with_stage(chosen.where("is_ioc = 1"), lines)
        one = recon_scores(stage_set(votes(staged, least)), observed).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_alerts(scores: DataFrame, observed: Iterable[str], lines: DataFrame | None = None, predicted: bool = False, least_prob: float = 0.0, least: int = 1, **how) -> DataFrame:
    """One row: stages that have enough edges in any alert, and their recall."""
    rows = A.alert_rows(scores, **how)
    staged = rows.withColumn("stage", predicted_stage(least_prob)) if predicted else with_stage(rows, lines)
    number = rows.agg(F.count_distinct("alert_id").alias("num_alerts"))
    return recon_scores(stage_set(votes(staged, least, ["alert_id"])), observed).crossJoin(F.broadcast(number))  # one row each


def only_scenario(scores: DataFrame, scenario: str) -> DataFrame:
    """The rows of one scenario; an error where there are none."""
    found = scores.where(F.trim("scenario") == scenario.strip())
    if found.isEmpty():
        raise ValueError(f"no scores of scenario {scenario!r}")
    return found


def alert_stages(scores: DataFrame, lines: DataFrame | None = None, most: int = 50, **how) -> DataFrame:
    """alert_id, n_edges, stages (sorted) and their numbers of edges, of the first ``most`` alerts."""
    rows = with_stage(A.alert_rows(scores, **how).where(F.col("alert_id") <= most), lines)
    counted = rows.groupBy("alert_id", "stage").agg(F.count("*").alias("n"))
    known = F.array_sort(F.collect_list(F.when(F.col("stage") != "", F.struct("stage", "n"))))
    out = counted.groupBy("alert_id").agg(F.sum("n").alias("n_edges"), known.alias("_k"))
    return out.select("alert_id", "n_edges", F.transform("_k", lambda x: x["stage"]).alias("stages"), F.transform("_k", lambda x: x["n"]).alias("stage_edges"))


def evaluate(scores: DataFrame, observed: Iterable[str], ks: Sequence[int] = (10, 50, 100), lines: DataFrame | None = None, ioc_files: Iterable[str] | None = None, quotas: dict[str, int] | None = None, group_cap: dict | None = None, adaptive: dict | None = None, upper_bound: bool = True, alert: dict | None = None, least_prob: float = 0.0, least: int = 1) -> DataFrame:
    """All reconstructions in one table, one row for each mode and k (k is null for alerts).

    A mode with options is left out where they are None; empty ones mean its defaults."""
    parts = [("by_k", evaluate_top_k(scores, observed, ks, "global", lines)), ("by_k_pair_dedupe", evaluate_top_k(scores, observed, ks, "pair_dedupe", lines, least=least))]
    if ioc_files is not None:
        parts.append(("by_k_ioc_log_sources", evaluate_top_k(only_ioc_logs(scores, ioc_files), observed, ks, "global", lines, least=least)))
    if quotas is not None:
        parts.append(("by_k_source_quota", evaluate_top_k(scores, observed, ks, "source_quota", lines, quotas=quotas)))
    if group_cap is not None:
        parts.append(("by_k_group_cap", evaluate_top_k(scores, observed, ks, "group_cap", lines, **group_cap)))
    if adaptive is not None:
        parts.append(("by_k_group_cap_adaptive", evaluate_top_k(scores, observed, ks, "group_cap_adaptive", lines, **adaptive)))
    if upper_bound:
        parts.append(("by_k_ioc_pool_upper_bound", evaluate_top_k(scores, observed, ks, "ioc_pool", lines, least=least)))
    if "pred_stage" in scores.columns and has_predictions(scores):
        parts.append(("by_k_pred_stage", evaluate_top_k(scores, observed, ks, "global", lines, True, least_prob, least)))
    for name, predicted in (("by_alert_rule", False), ("by_alert_pred_stage", True)):
        if alert is not None and (not predicted or "pred_stage" in scores.columns):
            parts.append((name, evaluate_alerts(scores, observed, lines, predicted, least_prob, least, **alert).drop("num_alerts").withColumn("k", F.lit(None).cast("int"))))
    out = None
    for name, df in parts:
        df = df.withColumn("mode", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def stage_truth(layers: DataFrame, lines: DataFrame) -> DataFrame:
    """scenario, semantic (stages of the layers' tactics), observable (stages of indicator
    types), unobserved. ``layers``: scenario, tactic. ``lines``: scenario, ioc_type."""
    semantic = layers.withColumn("s", S.stage_of_tactic(F.col("tactic"))).where("s <> ''").groupBy("scenario").agg(S.ordered_stages(F.collect_set("s")).alias("semantic"))
    seen = lines.withColumn("s", S.stage_of_type(F.trim("ioc_type"))).where("s <> ''").groupBy("scenario").agg(S.ordered_stages(F.collect_set("s")).alias("observable"))
    none = F.array().cast("array<string>")
    both = semantic.join(seen, "scenario", "full").select("scenario", F.coalesce("semantic", none).alias("semantic"), F.coalesce("observable", none).alias("observable"))
    return both.withColumn("unobserved", F.array_sort(F.array_except("semantic", "observable")))


def stage_truth_report(layers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a scenario: semantic (stages, techniques, layer_files) and observable (stages,
    ioc_counts_by_stage) as structs, as they are stored. ``layers``: scenario, technique, tactic,
    layer_file."""
    of_layers = layers.withColumn("s", S.stage_of_tactic(F.col("tactic"))).groupBy("scenario").agg(
        F.array_sort(F.collect_set(F.when(F.col("s") != "", F.col("s")))).alias("stages"), F.array_sort(F.collect_set("technique")).alias("techniques"), F.array_sort(F.collect_set("layer_file")).alias("layer_files")
    )
    counts = ioc_counts_by_stage(lines).groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("stage", "n"))).alias("c"))
    none = F.array().cast("array<string>")
    both = of_layers.join(counts, "scenario", "full")
    semantic = F.struct(*[F.coalesce(c, none).alias(c) for c in ("stages", "techniques", "layer_files")])
    pairs = F.coalesce("c", F.array().cast("array<struct<stage:string,n:bigint>>"))
    observable = F.struct(F.transform(pairs, lambda x: x["stage"]).alias("stages"), F.map_from_entries(pairs).alias("ioc_counts_by_stage"))
    return both.select("scenario", semantic.alias("semantic"), observable.alias("observable"))


def ioc_counts_by_stage(lines: DataFrame) -> DataFrame:
    return lines.withColumn("stage", S.stage_of_type(F.trim("ioc_type"))).where("stage <> ''").groupBy("scenario", "stage").agg(F.count("*").alias("n"))
