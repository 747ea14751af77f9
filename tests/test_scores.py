"""Deduplication, selection, windows, components and metrics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import alerts as A
from tracewright.operators import recon as C
from tracewright.operators import scores as R

COLUMNS = "scenario string, t bigint, etype int, src bigint, dst bigint, score double, is_ioc int, source_file string, row_idx bigint, ioc_type string, pred_stage string, pred_stage_prob double, row_seq bigint"


def table(spark, rows):
    """rows: (scenario, t, etype, src, dst, score, is_ioc) and, if more is needed, a dict."""
    full = []
    for i, r in enumerate(rows):
        more = r[7] if len(r) > 7 else {}
        full.append((*r[:7], more.get("source_file", ""), more.get("row_idx", -1), more.get("ioc_type", ""), more.get("pred_stage", ""), more.get("prob", 0.0), i))
    return spark.createDataFrame(full, COLUMNS)


def some(n, seed, ties=True):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 1)}", rng.randint(0, 400), rng.randint(0, 2), rng.randint(0, 9), rng.randint(10, 15), round(rng.random(), 1 if ties else 9), int(rng.random() < 0.2)) for _ in range(n)]


def test_event_dedupe(spark):
    (row,) = R.dedupe_events(table(spark, [("s", 1, 0, 1, 2, 0.5, 0), ("s", 1, 0, 1, 2, 1.0, 1)])).collect()
    assert (row.score, row.is_ioc, row.row_seq) == (1.0, 1, 0)


def test_precision(spark):
    rows = table(spark, [("s", 1, 0, 1, 2, 2.0, 1), ("s", 2, 0, 1, 3, 1.0, 0), ("s", 3, 0, 1, 4, 0.5, 0)])
    assert {r.k: r.precision for r in R.precision_at(rows, [1, 2, 9]).collect()} == {1: 1.0, 2: 0.5, 9: pytest.approx(1 / 3)}
    (m,) = A.tail_metrics(rows, (2,)).collect()
    assert m.p_at_2 == 0.5 and m.num_tail_deduped == 3
    (none,) = R.precision_at(rows.where("false"), [5]).collect()
    assert none.precision is None


def test_pair_dedupe(spark):
    rows = table(spark, [("s", 1, 2, 298, 227, 1.5, 0), ("s", 2, 2, 298, 227, 3.0, 1), ("s", 3, 2, 298, 211, 2.0, 0)])
    found = R.top_k(rows, 5, by_pair=True).orderBy("rank").collect()
    assert [(r.dst, r.score) for r in found] == [(227, 3.0), (211, 2.0)]


def test_stage_coverage_needs_pair_dedupe(spark):
    rows = [("s", i, 0, 298, 227, 5 - 0.001 * i, 0) for i in range(200)]
    rows.append(("s", 300, 0, 1, 2, 0.5, 1, {"source_file": "azure_syslog.csv", "row_idx": 10, "ioc_type": "execution"}))
    found = {r["mode"]: r.predicted_stages for r in C.evaluate(table(spark, rows), ["execution"], [50], alert={"quantile": 0.0, "min_events": 1}).collect()}
    assert found["by_k"] == [] and found["by_k_pair_dedupe"] == ["execution"]
    assert found["by_k_ioc_pool_upper_bound"] == ["execution"] and found["by_alert_rule"] == ["execution"]


def test_predicted_stages(spark):
    rows = [("s", 1, 0, 1, 2, 2.0, 0, {"pred_stage": "command_and_control", "prob": 0.95}), ("s", 2, 0, 3, 4, 1.0, 0, {"pred_stage": "execution", "prob": 0.9})]
    (one,) = C.evaluate_top_k(table(spark, rows), ["execution"], [2], predicted=True, least_prob=0.5).collect()
    assert one.predicted_stages == ["command_and_control", "execution"] and one.stage_recall == 1.0 and one.stage_precision == 0.5
    (none,) = C.evaluate_top_k(table(spark, rows), ["execution"], [2]).collect()
    assert none.predicted_stages == [] and none.stage_precision == 0.0


def test_alert_predicted_stages(spark):
    rows = [("s", 100 + i, 0, 1, 2 + i, 5.0, 0, {"pred_stage": "command_and_control"}) for i in range(4)] + [("s", 200, 0, 9, 10, 0.1, 0, {"pred_stage": "execution"})]
    (one,) = C.evaluate_alerts(table(spark, rows), [], predicted=True, quantile=0.5, min_events=3).collect()
    assert one.predicted_stages == ["command_and_control"] and one.num_alerts == 1


def test_line_truth_goes_first(spark):
    rows = table(spark, [("s", 1, 0, 1, 2, 1.0, 1, {"source_file": "zeek_conn.csv", "row_idx": 2061, "ioc_type": "attack_ip"}), ("s", 2, 0, 1, 2, 1.0, 1, {"source_file": "zeek_conn.csv", "row_idx": 5, "ioc_type": "attack_ip"})])
    lines = spark.createDataFrame([("zeek_conn.csv", 2062, "data_exfiltration")], "source_file string, line bigint, ioc_type string")
    assert {r.row_idx: r.stage for r in C.with_stage(rows, lines).collect()} == {2061: "exfiltration_impact", 5: "command_and_control"}


@pytest.mark.parametrize("width", [0, 7, 40])
def test_windows_equal_a_fold(spark, width):
    rows = some(120, width)
    found = {r.row_seq: (r.window_start, r.window_no) for r in A.greedy_windows(table(spark, rows), width).collect()}
    for sc in ("s0", "s1"):
        start, no = None, 0
        for i, r in sorted(((i, r) for i, r in enumerate(rows) if r[0] == sc), key=lambda x: x[1][1]):
            if start is None or r[1] - start > width:
                start, no = r[1], no + 1
            assert found[i] == (start, no)


def test_window_boundary(spark):
    rows = table(spark, [("s", 0, 0, 1, 2, 1.0, 0), ("s", 10, 0, 1, 2, 1.0, 0), ("s", 11, 0, 1, 2, 1.0, 0)])
    assert [r.window_no for r in A.greedy_windows(rows, 10).orderBy("t").collect()] == [1, 1, 2]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [("g", rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = {x: x for _, a, b in edges for x in (a, b)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r.node: r.component for r in A.components(spark.createDataFrame(edges, "g string, src bigint, dst bigint"), ["g"]).collect()}
    assert found == {x: min(y for y in parent if find(y) == find(x)) for x in parent}


def test_quantile_is_nearest_rank_half_even(spark):
    for n in (2, 4, 6):
        rows = [("s", i, 0, i, 100 + i, float(i), 0) for i in range(n)]
        kept = R.select_high(R.dedupe_events(table(spark, rows)), 0.5).count()
        assert kept == n - round((n - 1) * 0.5)


def areas(rows):
    order = sorted(range(len(rows)), key=lambda i: -rows[i][5])
    p = sum(r[6] for r in rows)
    n, tp, area, ap, seen = len(rows) - p, 0, 0.0, 0.0, 0
    for i in order:
        seen += 1
        if rows[i][6]:
            tp += 1
            ap += tp / seen
        else:
            area += tp
    return (area / (p * n) if p and n else None), (ap / p if p else None)


def test_areas_with_ties(spark):
    rows = some(300, 9)
    (one,) = R.curve_areas(table(spark, rows)).collect()
    roc, pr = areas(rows)
    assert one.roc_auc == pytest.approx(roc) and one.pr_auc == pytest.approx(pr)
    (single,) = R.curve_areas(table(spark, [r[:6] + (0,) for r in rows[:5]])).collect()
    assert single.roc_auc is None and single.pr_auc is None


def pairs_of(rows):
    best = {}
    for i, r in enumerate(rows):
        key = (r[0], r[2], r[3], r[4])
        if key not in best or (-r[5], -r[6], i) < best[key][0]:
            best[key] = ((-r[5], -r[6], i), i, r)
    return [(i, r) for _, i, r in sorted(best.values(), key=lambda b: (-b[2][5], b[1]))]


def test_group_caps(spark):
    rows = some(250, 3)
    pool = pairs_of(rows)
    used, wanted = {}, []
    for i, r in pool:
        if used.get((r[2], r[4]), 0) < 2 and len(wanted) < 15:
            used[(r[2], r[4])] = used.get((r[2], r[4]), 0) + 1
            wanted.append(i)
    assert [r.row_seq for r in R.top_k_group_cap(table(spark, rows), 15, cap=2).orderBy("rank").collect()] == wanted
    head, counts = pool[:30], {}
    for _, r in head:
        counts[(r[2], r[3])] = counts.get((r[2], r[3]), 0) + 1
    hot = {g for g, c in counts.items() if c >= 3}
    used, wanted = {}, []
    for i, r in pool:
        g = (r[2], r[3])
        if len(wanted) < 15 and not (g in hot and used.get(g, 0) >= 1):
            used[g] = used.get(g, 0) + 1
            wanted.append(i)
    found = R.top_k_group_cap_adaptive(table(spark, rows), 15, probe=2, hot=3, cap=1).orderBy("rank").collect()
    assert [r.row_seq for r in found] == wanted


def test_source_quota_starves_later_sources(spark):
    rows = [("s", i, 0, i, 100 + i, float(100 - i), 0, {"source_file": "abc"[i % 3]}) for i in range(30)]
    found = R.top_k_source_quota(table(spark, rows), 5, {"c": 4, "b": 4}).orderBy("rank").collect()
    assert [r.row_seq for r in found] == [2, 5, 8, 11, 1]
    found = R.top_k_source_quota(table(spark, rows), 5, {"c": 2}).orderBy("rank").collect()
    assert [r.row_seq for r in found] == [2, 5, 0, 1, 3]


def test_segments(spark):
    stages = ["execution", "execution", "", "discovery_collection", "execution"]
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate(stages)], "t bigint, rank int, stage string")
    found = [(r.stage, r.t_min, r.t_max, r.n_edges) for r in C.chain_segments(rows).orderBy("segment").collect()]
    assert found == [("execution", 0, 1, 2), ("discovery_collection", 3, 3, 1), ("execution", 4, 4, 1)]


def test_split(spark):
    rows = [("a", i, 0, 1, 2, 0.0, 0) for i in range(10)] + [("b", 1, 0, 1, 2, 0.0, 0)] + [("c", i, 0, 1, 2, 0.0, 0) for i in range(2)]
    found = R.with_split(table(spark, rows)).groupBy("scenario").agg(F.count_if(~F.col("is_tail")).alias("n")).collect()
    assert {r.scenario: r.n for r in found} == {"a": 7, "b": 0, "c": 1}


def test_ks():
    assert R.parse_ks("10, 5,,5,0") == [5, 10]
    assert R.scaled_latency([2.0, 1.0, 3.0], 1000) == 2000.0
