"""Orders and running sums dealt into ranges equal those of one window; no task holds a group."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.operators import alerts, graph, ranges, scores, training


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 40)
    monkeypatch.setattr(ranges, "APART", 5)


def stream(spark, n=900, hot=600):
    """Most rows in one scenario; a third of its scores and times tied."""
    rng = random.Random(3)
    rows = [("hot" if i < hot else rng.choice(["a", None]), rng.choice([7, rng.randint(0, 400)]), rng.randint(0, 2), rng.randint(0, 5), rng.randint(10, 14), rng.choice([0.5, rng.random()]), rng.randint(0, 1), i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "scenario string, t bigint, etype int, src bigint, dst bigint, score double, is_ioc int, row_seq bigint").repartition(5)


def held(df, by):
    """Rows of the largest (group, range)."""
    ranged, several = ranges.with_ranges(df, by, [F.col("score"), F.col("row_seq")])
    return ranged.groupBy(*by, "_range").count().agg(F.max("count")).first()[0], several


@pytest.mark.parametrize("by", [["scenario"], []])
def test_ranges_hold_a_part(spark, small, by):
    most, several = held(stream(spark), by)
    assert several and most <= 200
    assert held(spark.createDataFrame([], stream(spark).schema), by)[1] is False


@pytest.mark.parametrize("by", [["scenario"], []])
def test_running_equals_a_window(spark, small, by):
    df = stream(spark)
    order = [-F.col("score"), F.col("row_seq")]
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = {r.row_seq: (r.p, r.q) for r in df.withColumns({"p": F.sum("is_ioc").over(run), "q": F.row_number().over(run)}).collect()}
    found = ranges.running(df, by, order, {"p": F.col("is_ioc"), "q": F.lit(1)})
    assert found.columns == [*df.columns, "p", "q"] and {r.row_seq: (r.p, r.q) for r in found.collect()} == wanted


def test_nth_rows(spark, small):
    df = stream(spark)
    of = {}
    for r in df.collect():
        of.setdefault(r.scenario, []).append((r.score, r.row_seq))
    found = ranges.nth_rows(df, ["scenario"], [F.col("score"), F.col("row_seq")], lambda n: F.floor(n / 3)).collect()
    assert {r.scenario: (r.n, tuple(r.key)) for r in found} == {s: (len(v), sorted(v)[len(v) // 3]) for s, v in of.items()}
    assert ranges.nth_rows(df, ["scenario"], [F.col("row_seq")], lambda n: n).count() == 0


def test_scores_do_not_depend_on_ranges(spark, monkeypatch):
    df = stream(spark)
    events = df.withColumns({"edge_type": F.lit("CONNECT"), "src_type": F.lit("PROC"), "dst_type": F.lit("NET"), "src_key": F.col("src").cast("string"), "dst_key": F.col("dst").cast("string"), "ts": F.col("t").cast("double"), "ord": F.col("row_seq"), "event_seq": F.col("row_seq")}).where("scenario IS NOT NULL").drop("src", "dst", "etype", "t")

    def every():
        tables = [
            scores.with_split(df), scores.with_tail(df), scores.rarity(df), scores.select_high(df, 0.9), scores.curve(df, ["scenario"]), scores.curve(df), scores.curve_areas(df), graph.causal_edges(events, "level1"), graph.nodes(events),
            graph.edge_stream(events, features=False), training.label_balance(df.withColumn("y_ioc", F.col("is_ioc"))), training.unseen_negatives(df.where("scenario IS NOT NULL")),
            *[training.sampled_negatives(df.where("scenario IS NOT NULL"), mode, width=30) for mode in ("random", "pool", "inbatch", "window")],
        ]
        return [sorted((tuple(r[c] for c in sorted(t.columns)) for r in t.collect()), key=repr) for t in tables]

    before = every()
    monkeypatch.setattr(ranges, "RANGE", 40)
    monkeypatch.setattr(ranges, "APART", 5)
    assert every() == before


def test_windows_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(s, rng.randint(0, 3000), i) for i, s in enumerate(rng.choices(["a", "b", None], k=300))]
    found = alerts.greedy_windows(spark.createDataFrame(rows, "scenario string, t bigint, i bigint"), 50).collect()
    wanted = {}
    for s in ("a", "b", None):
        start, no = None, 0
        for t, i in sorted((t, i) for x, t, i in rows if x == s):
            if start is None or t - start > 50:
                start, no = t, no + 1
            wanted[i] = (start, no)
    assert {r.i: (r.window_start, r.window_no) for r in found} == wanted
    assert alerts.greedy_windows(spark.createDataFrame([], "scenario string, t bigint"), 50).count() == 0


def test_negatives_are_never_the_target(spark):
    df = stream(spark).where("scenario IS NOT NULL")
    prefix = {}
    for r in scores.with_tail(df).where("NOT is_tail").collect():
        prefix.setdefault((r.scenario, r.etype), []).append((r.t, r.row_seq, r.dst))
    for mode in ("random", "pool", "inbatch", "window"):
        found = training.sampled_negatives(df, mode, width=30).collect()
        assert len(found) == scores.with_tail(df).where("is_tail").count() and all(r.negative != r.dst for r in found)
    near = {r.row_seq: r for r in training.sampled_negatives(df, "window", width=30).collect()}
    for r in near.values():
        inside = {d for t, _, d in prefix[r.scenario, r.etype] if abs(t - r.t) <= 30} - {r.dst}
        assert len(inside) < 3 or r.negative in inside or r.negative in {d for _, _, d in prefix[r.scenario, r.etype]}
    for r in training.sampled_negatives(df, "window", width=30, max_cands=1).collect():
        last = sorted((t, i, d) for t, i, d in prefix[r.scenario, r.etype] if abs(t - r.t) <= 30)
        if last and last[-1][2] != r.dst:
            assert r.negative == last[-1][2]
