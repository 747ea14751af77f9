"""Command line: python -m tracewright events|stream|score|alerts|recon|balance."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import session
from .operators import alerts, evaluate, graph, recon, scores, telemetry, training
from .sources import logs, side


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("events", help="logs of scenarios to labelled events")
    e.add_argument("--root", required=True)
    e.add_argument("--scenario", action="append", help="may repeat; all known ones by default")
    e.add_argument("--truth", help="ground-truth JSON")
    e.add_argument("--rules", help="weak-rule JSON")
    e.add_argument("--family", default="full")
    e.add_argument("--all-logs", action="store_true", help="also logs without indicators")
    e.add_argument("--limit", type=int)
    e.add_argument("--causal", choices=["off", "level0", "level1"], default="off")
    e.add_argument("--causal-window", type=float, default=graph.WINDOW)
    s = sub.add_parser("stream", help="events to edge streams")
    s.add_argument("--events", required=True)
    s.add_argument("--time", choices=["double", "float32"], default="double")
    c = sub.add_parser("score", help="streams to tail scores")
    c.add_argument("--stream", required=True)
    c.add_argument("--method", choices=sorted(evaluate.METHODS), default="freq_rarity")
    c.add_argument("--family", default="full")
    c.add_argument("--share", type=float, default=0.7)
    a = sub.add_parser("alerts", help="scores to alerts")
    r = sub.add_parser("recon", help="scores to reconstructed stages")
    for p in (a, r):
        p.add_argument("--scores", required=True)
        p.add_argument("--window", type=int, default=alerts.WINDOW)
        p.add_argument("--quantile", type=float, default=alerts.QUANTILE)
        p.add_argument("--min-events", type=int, default=alerts.MIN_EVENTS)
        p.add_argument("--top", type=int, help="events of each scenario, instead of a quantile")
    r.add_argument("--scenario", help="only its rows")
    r.add_argument("--observed", required=True, help="comma list of stages")
    r.add_argument("--top-k", default="10,50,100")
    r.add_argument("--quotas", help="JSON object: source file to least number of edges")
    b = sub.add_parser("balance", help="labels in streams and their tails")
    b.add_argument("--stream", required=True)
    for p in (e, s, c, a, r, b):
        p.add_argument("--out", required=True)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    o = arguments(argv)
    spark = session.build()
    if o.command == "events":
        known = side.known_scenarios()
        for sc in o.scenario or sorted(known):
            found = logs.load_annotated(spark, o.root, known, sc, o.truth, side.rules(spark, o.rules), family=telemetry.normalize(o.family), only_ioc_logs=not o.all_logs, limit=o.limit)
            if found is not None:
                side.write_partitioned(graph.augmented(found, o.causal, **({} if o.causal == "off" else {"window": o.causal_window})), o.out)
    elif o.command == "stream":
        labels = {"is_ioc": "y_ioc", "is_ioc_line": "y_ioc_line", "is_rule_hit": "y_rule", "is_rule_hit_high": "y_rule_high"}
        found = graph.edge_stream(spark.read.parquet(o.events).where("event_seq IS NOT NULL"), o.time)
        for old, new in labels.items():
            if old in found.columns:
                found = found.withColumn(new, F.coalesce(F.col(old), F.lit(False)).cast("int"))
        side.write_partitioned(found.withColumn("is_ioc", F.coalesce(F.col("is_ioc"), F.lit(False)).cast("int") if "is_ioc" in found.columns else F.lit(0)).withColumn("row_seq", F.col("stream_idx")), o.out)
    elif o.command == "score":
        side.write_scores(evaluate.score_tail(spark.read.parquet(o.stream), o.method, o.family, o.share), o.out)
    elif o.command == "alerts":
        side.write_alerts(alerts.alerts(side.scores(spark, o.scores), o.window, o.quantile, o.top, o.min_events), o.out)
    elif o.command == "recon":
        how = {"width": o.window, "quantile": o.quantile, "top_k": o.top, "min_events": o.min_events}
        found = side.scores(spark, o.scores)
        found = recon.only_scenario(found, o.scenario) if o.scenario else found
        side.write_json(recon.evaluate(found, o.observed.split(","), scores.parse_ks(o.top_k), quotas=json.loads(o.quotas) if o.quotas else None, alert=how), o.out)
    else:
        side.write_json(training.balance_report(side.read_stream(spark, o.stream)), o.out)
    spark.stop()


if __name__ == "__main__":
    main()
