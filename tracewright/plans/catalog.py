"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions import text as X
from ..operators import alerts as A
from ..operators import annotate as N
from ..operators import graph as G
from ..operators import learned as L
from ..operators import recon as C
from ..operators import reports as P
from ..operators import scores as R
from ..operators import telemetry as T
from ..operators import training as D
from ..session import tune
from ..sources import logs as Z
from . import adapters as I

DAY = 86_400
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL equivalent."""

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tune(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


# --- pieces of SQL -----------------------------------------------------------------------
SPLIT = f"""WITH {I.SQL_SCORES},
split AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY t, etype, src, dst, row_seq) - 1 AS pos, count(*) OVER (PARTITION BY scenario) AS n FROM scores),
parts AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE greatest(1, least(n - 1, CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT))) END AS cut FROM split),
tail AS (SELECT * FROM parts WHERE pos >= cut), prefix AS (SELECT * FROM parts WHERE pos < cut)"""
RARITY = f"""{SPLIT},
counts AS (SELECT scenario, etype, src, dst, count(*) AS c FROM prefix GROUP BY ALL),
rare AS (SELECT t.* EXCLUDE (score), -ln((coalesce(c, 0) + 1) / CAST(greatest(cut, 1) + 1 AS DOUBLE)) AS score FROM tail t LEFT JOIN counts USING (scenario, etype, src, dst))"""
DEDUPED = "deduped AS (SELECT scenario, t, etype, src, dst, max(score) AS score, max(is_ioc) AS is_ioc, min(row_seq) AS row_seq FROM {0} GROUP BY scenario, t, etype, src, dst)"
HIGH = """high AS (SELECT * FROM (SELECT *, max(CASE WHEN rn = nth THEN score END) OVER (PARTITION BY scenario) AS cut_score FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score, row_seq) AS rn, CAST(round_even((count(*) OVER (PARTITION BY scenario) - 1) * CAST({0} AS DOUBLE), 0) AS BIGINT) + 1 AS nth FROM deduped)) WHERE score >= cut_score)"""
WINDOWS = f"""times AS (SELECT DISTINCT scenario, t FROM high),
hops AS (SELECT scenario, t, min(t) OVER (PARTITION BY scenario ORDER BY t RANGE BETWEEN {DAY + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM times),
starts AS (SELECT scenario, min(t) AS t, CAST(1 AS BIGINT) AS window_no FROM times GROUP BY scenario UNION ALL SELECT s.scenario, h.nx, s.window_no + 1 FROM starts s JOIN hops h ON h.scenario = s.scenario AND h.t = s.t WHERE h.nx IS NOT NULL),
placed AS (SELECT h.*, max(s.t) AS window_start, max(s.window_no) AS window_no FROM high h JOIN starts s ON s.scenario = h.scenario AND s.t <= h.t GROUP BY ALL)"""
REACH = """ends AS (SELECT DISTINCT scenario, window_no, src AS a, dst AS b FROM placed UNION SELECT DISTINCT scenario, window_no, dst, src FROM placed),
reach AS (SELECT DISTINCT scenario, window_no, a AS node, a AS to_node FROM ends UNION SELECT r.scenario, r.window_no, r.node, e.b FROM reach r JOIN ends e ON e.scenario = r.scenario AND e.window_no = r.window_no AND e.a = r.to_node),
labels AS (SELECT scenario, window_no, node, min(to_node) AS component FROM reach GROUP BY scenario, window_no, node)"""
ALERTS = f"""{RARITY.replace("WITH ", "WITH RECURSIVE ", 1)}, {DEDUPED.format("rare")}, {HIGH.format("0.99")}, {WINDOWS}, {REACH},
clustered AS (SELECT p.*, l.component, count(*) OVER (PARTITION BY p.scenario, p.window_no, l.component) AS size FROM placed p JOIN labels l ON l.scenario = p.scenario AND l.window_no = p.window_no AND l.node = p.src),
big AS (SELECT * FROM clustered WHERE size >= 3),
firsts AS (SELECT scenario, window_no, component, row_number() OVER (ORDER BY scenario, window_no, ft, fs, fr) AS alert_id FROM (
  SELECT scenario, window_no, component, arg_min(t, (t, -score, row_seq)) AS ft, arg_min(-score, (t, -score, row_seq)) AS fs, arg_min(row_seq, (t, -score, row_seq)) AS fr FROM big GROUP BY ALL)),
alerted AS (SELECT b.*, f.alert_id FROM big b JOIN firsts f USING (scenario, window_no, component))"""
BASE = f"WITH {I.SQL_SCORES}"
PAIRS = "pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, etype, src, dst ORDER BY score DESC, is_ioc DESC, row_seq) AS pn FROM scores) WHERE pn = 1)"
SHOWN = "rank, row_seq, scenario, t, etype, src, dst, score, is_ioc"
STAGE = "CASE ioc_type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in K.IOC_STAGE.items()) + " ELSE '' END"
TOP100 = f"{BASE}, {DEDUPED.format('scores')}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM deduped) WHERE rank <= 100), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, t, etype, src, dst ORDER BY row_seq DESC) AS ln FROM scores) WHERE ln = 1), top AS (SELECT l.*, r.rank FROM latest l JOIN ranked r USING (scenario, t, etype, src, dst))"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN.split(", "))


# --- scores ------------------------------------------------------------------------------
@query(f"{SPLIT} SELECT scenario, row_seq, pos, CASE WHEN pos >= cut THEN 1 ELSE 0 END AS is_tail FROM parts")
def stream_split(spark, sf_dir):
    return R.with_split(I.scores(spark, sf_dir)).select("scenario", "row_seq", "pos", F.col("is_tail").cast("int").alias("is_tail"))


@query(f"{RARITY} SELECT scenario, row_seq, t, etype, src, dst, round(score, 6) AS score FROM rare")
def rarity_scores(spark, sf_dir):
    return R.rarity(I.scores(spark, sf_dir)).select("scenario", "row_seq", "t", "etype", "src", "dst", F.round("score", 6).alias("score"))


@query(f"{RARITY} SELECT scenario, row_seq, round(score, 6) AS score FROM rare")
def path_outlier_scores(spark, sf_dir):
    return R.path_outlier(I.scores(spark, sf_dir)).select("scenario", "row_seq", F.round("score", 6).alias("score"))


def drawn(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13) AS BIGINT)"


@query(f"{SPLIT} SELECT scenario, row_seq, {drawn('42', 'scenario', 'row_seq')} / CAST({1 << 52} AS DOUBLE) AS score FROM tail")
def random_scores(spark, sf_dir):
    return R.random_scores(I.scores(spark, sf_dir)).select("scenario", "row_seq", "score")


@query(f"{BASE}, {DEDUPED.format('scores')} SELECT * FROM deduped")
def dedupe_events(spark, sf_dir):
    return R.dedupe_events(I.scores(spark, sf_dir))


@query(f"{BASE}, {PAIRS} SELECT scenario, etype, src, dst, t, score, is_ioc, row_seq FROM pairs")
def pair_dedupe(spark, sf_dir):
    return R.dedupe_pairs(I.scores(spark, sf_dir)).select("scenario", "etype", "src", "dst", "t", "score", "is_ioc", "row_seq")


@query(f"{BASE} SELECT count(*) AS n_input_rows, count(DISTINCT (scenario, etype, src, dst)) AS n_pair_deduped_rows, count(*) - count(DISTINCT (scenario, etype, src, dst)) AS n_collapsed_rows FROM scores")
def pair_dedupe_counts(spark, sf_dir):
    return R.pair_dedupe_counts(I.scores(spark, sf_dir))


@query(f"{BASE}, {DEDUPED.format('scores')}, {HIGH.format('0.99')} SELECT scenario, t, etype, src, dst, score, is_ioc, row_seq FROM high")
def high_score_quantile(spark, sf_dir):
    return R.select_high(R.dedupe_events(I.scores(spark, sf_dir)), 0.99)


@query(f"{BASE}, {DEDUPED.format('scores')} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, row_seq) AS rn FROM deduped) WHERE rn <= 50")
def high_score_top_k(spark, sf_dir):
    return R.select_high(R.dedupe_events(I.scores(spark, sf_dir)), top_k=50)


@query(f"{TOP100} SELECT {SHOWN} FROM top")
def topk_global(spark, sf_dir):
    return shown(R.top_k(I.scores(spark, sf_dir), 100))


@query(f"{BASE}, {PAIRS} SELECT {SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM pairs) WHERE rank <= 100")
def topk_pairs(spark, sf_dir):
    return shown(R.top_k(I.scores(spark, sf_dir), 100, by_pair=True))


@query(f"{TOP100.replace('FROM scores GROUP BY', 'FROM scores WHERE is_ioc = 1 GROUP BY').replace('AS ln FROM scores)', 'AS ln FROM scores WHERE is_ioc = 1)')} SELECT {SHOWN} FROM top")
def topk_ioc(spark, sf_dir):
    return shown(R.top_k_ioc(I.scores(spark, sf_dir), 100))


QUOTAS = {"eve.json": 30, "zeek_conn.csv": 20}


@query(f"""{BASE}, {PAIRS}, pool AS (SELECT *, CASE source_file WHEN 'eve.json' THEN 0 WHEN 'zeek_conn.csv' THEN 1 ELSE 2 END AS place FROM pairs WHERE etype NOT IN (4)),
own AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, row_seq) <= CASE place WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 0 END AS by_quota FROM pool)
SELECT {SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY by_quota DESC, CASE WHEN by_quota THEN place ELSE 0 END, score DESC, row_seq) AS rank FROM own) WHERE rank <= 100""")
def topk_source_quota(spark, sf_dir):
    return shown(R.top_k_source_quota(I.scores(spark, sf_dir), 100, QUOTAS, without_etypes=[4]))


@query(f"{BASE}, {PAIRS}, capped AS (SELECT *, row_number() OVER (PARTITION BY etype, dst ORDER BY score DESC, row_seq) AS gn FROM pairs) SELECT {SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM capped WHERE gn <= 5) WHERE rank <= 100")
def topk_group_cap(spark, sf_dir):
    return shown(R.top_k_group_cap(I.scores(spark, sf_dir), 100))


PORTED = "ported AS (SELECT *, CASE WHEN dst % 3 = 0 THEN 443 ELSE 4444 END AS dst_port, src % 2 AS src_port FROM pairs)"
CAPPED = " UNION ALL ".join(f"SELECT '{name}' AS key, {SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY score DESC, row_seq) AS gn FROM ported) WHERE gn <= 2) WHERE rank <= 50" for name, by in R.GROUPS.items())


@query(f"{BASE}, {PAIRS}, {PORTED} {CAPPED}")
def topk_group_cap_keys(spark, sf_dir):
    s = I.scores(spark, sf_dir).withColumns({"dst_port": F.when(F.col("dst") % 3 == 0, 443).otherwise(4444), "src_port": F.col("src") % 2})
    found = [R.top_k_group_cap(s, 50, key, 2).select(F.lit(key).alias("key"), *SHOWN.split(", ")) for key in R.GROUPS]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""{BASE}, {PAIRS}, hot AS (SELECT etype, src FROM (SELECT * FROM pairs ORDER BY score DESC, row_seq LIMIT 500) GROUP BY etype, src HAVING count(*) >= 4),
capped AS (SELECT p.*, row_number() OVER (PARTITION BY p.etype, p.src ORDER BY score DESC, row_seq) AS gn, h.etype IS NOT NULL AS is_hot FROM pairs p LEFT JOIN hot h ON h.etype = p.etype AND h.src = p.src)
SELECT {SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM capped WHERE NOT is_hot OR gn <= 2) WHERE rank <= 100""")
def topk_group_cap_adaptive(spark, sf_dir):
    return shown(R.top_k_group_cap_adaptive(I.scores(spark, sf_dir), 100, hot=4, cap=2))


@query(f"{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {DEDUPED.format('scores')}, {HIGH.format('0.9')}, {WINDOWS} SELECT scenario, row_seq, window_start, window_no FROM placed")
def time_windows(spark, sf_dir):
    return A.greedy_windows(R.select_high(R.dedupe_events(I.scores(spark, sf_dir)), 0.9), DAY).select("scenario", "row_seq", "window_start", "window_no")


@query(f"{ALERTS} SELECT scenario, window_no, component, alert_id, row_seq, round(score, 6) AS score FROM alerted")
def alerts_components(spark, sf_dir):
    return A.alert_events(R.rarity(I.scores(spark, sf_dir)), DAY).select("scenario", "window_no", "component", "alert_id", "row_seq", F.round("score", 6).alias("score"))


@query(f"""{ALERTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY t, score DESC, row_seq) AS en FROM alerted),
nodes AS (SELECT alert_id, count(*) AS num_nodes, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM (SELECT alert_id, src AS node FROM alerted UNION SELECT alert_id, dst FROM alerted) GROUP BY alert_id)
SELECT scenario, o.alert_id, min(t) AS t_start, max(t) AS t_end, count(*) AS num_events, round(max(score), 6) AS max_score, CAST(sum(is_ioc) AS BIGINT) AS ioc_hits, any_value(num_nodes) AS num_nodes, any_value(nodes) AS nodes,
string_agg(CASE WHEN en <= 200 THEN t || ':' || etype || ':' || src || ':' || dst END, ',' ORDER BY en) AS evidence FROM ordered o JOIN nodes USING (alert_id) GROUP BY scenario, o.alert_id""")
def alerts_summary(spark, sf_dir):
    found = A.alerts(R.rarity(I.scores(spark, sf_dir)), DAY)
    text = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["t"], e["etype"], e["src"], e["dst"])), ",")
    return found.select("scenario", "alert_id", "t_start", "t_end", "num_events", F.round("max_score", 6).alias("max_score"), "ioc_hits", F.col("num_nodes").cast("bigint").alias("num_nodes"), F.array_join("nodes", ",").alias("nodes"), text.alias("evidence"))


@query(f"""{ALERTS}, p AS (SELECT avg(CASE WHEN rn <= 10 THEN CAST(is_ioc AS DOUBLE) END) AS p_at_10, avg(CASE WHEN rn <= 100 THEN CAST(is_ioc AS DOUBLE) END) AS p_at_100 FROM (SELECT is_ioc, row_number() OVER (ORDER BY score DESC, row_seq) AS rn FROM rare)),
n AS (SELECT (SELECT count(*) FROM deduped) AS a, (SELECT count(*) FROM high) AS b, (SELECT coalesce(sum(is_ioc), 0) FROM high) AS c, (SELECT count(DISTINCT alert_id) FROM alerted) AS d)
SELECT a AS num_tail_deduped, b AS num_flagged, d AS num_alerts, round(p_at_10, 6) AS p_at_10, round(p_at_100, 6) AS p_at_100, round(b / CAST(greatest(1, a) AS DOUBLE), 6) AS flagged_rate, round(d / CAST(greatest(1, a) AS DOUBLE), 6) AS alerts_per_tail_event, round(c / CAST(greatest(1, b) AS DOUBLE), 6) AS precision_in_flagged FROM n, p""")
def tail_alert_metrics(spark, sf_dir):
    m = A.tail_metrics(R.rarity(I.scores(spark, sf_dir)), (10, 100), DAY)
    return m.select("num_tail_deduped", "num_flagged", "num_alerts", *[F.round(c, 6).alias(c) for c in ("p_at_10", "p_at_100", "flagged_rate", "alerts_per_tail_event", "precision_in_flagged")])


@query(f"{BASE}, r AS (SELECT is_ioc, row_number() OVER (ORDER BY score DESC, row_seq) AS rn FROM scores), ks AS (SELECT unnest([10, 50, 100, 500]) AS k) SELECT k, CAST(sum(is_ioc) AS BIGINT) AS hits, round(avg(CAST(is_ioc AS DOUBLE)), 6) AS precision FROM ks JOIN r ON rn <= k GROUP BY k")
def precision_at_k(spark, sf_dir):
    return R.precision_at(I.scores(spark, sf_dir), [10, 50, 100, 500]).select("k", "hits", F.round("precision", 6).alias("precision"))


AREAS = """c AS (SELECT *, sum(is_ioc) OVER w AS tp, sum(1 - is_ioc) OVER w AS fp FROM {0} WINDOW w AS ({1} ORDER BY score DESC, row_seq ROWS UNBOUNDED PRECEDING))
SELECT {2} CAST(sum(is_ioc) AS BIGINT) AS positives, CAST(sum(1 - is_ioc) AS BIGINT) AS negatives, round(sum(CASE WHEN is_ioc = 0 THEN CAST(tp AS DOUBLE) END) / nullif(CAST(sum(is_ioc) AS DOUBLE) * sum(1 - is_ioc), 0), 6) AS roc_auc,
round(sum(CASE WHEN is_ioc = 1 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END) / nullif(sum(is_ioc), 0), 6) AS pr_auc FROM c"""


@query(f"{BASE}, {AREAS.format('scores', '', '')}")
def curve_areas(spark, sf_dir):
    return R.curve_areas(I.scores(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 6)).withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"{BASE}, {AREAS.format('scores', 'PARTITION BY scenario', 'scenario,')} GROUP BY scenario")
def curve_areas_by_scenario(spark, sf_dir):
    return R.curve_areas(I.scores(spark, sf_dir), ["scenario"]).withColumn("roc_auc", F.round("roc_auc", 6)).withColumn("pr_auc", F.round("pr_auc", 6))


KS = (10, 50, 100, 500)


@query(f"""{RARITY}, {AREAS.format("rare", "", "").replace("SELECT  CAST", "SELECT CAST", 1).replace("))" + chr(10) + "SELECT", ")), a AS (SELECT", 1)}),
p AS (SELECT {", ".join(f"round(avg(CASE WHEN rn <= {k} THEN CAST(is_ioc AS DOUBLE) END), 6) AS p_at_{k}" for k in KS)} FROM (SELECT is_ioc, row_number() OVER (ORDER BY score DESC, row_seq) AS rn FROM rare)) SELECT * FROM a, p""")
def detection_metrics(spark, sf_dir):
    m = R.detection_metrics(R.rarity(I.scores(spark, sf_dir)), KS)
    return m.select("positives", "negatives", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("positives", "negatives")])


# --- reconstruction ----------------------------------------------------------------------
OBSERVED = ["initial_access_delivery", "execution", "command_and_control", "exfiltration_impact"]


@query(f"{TOP100} SELECT stage, count(*) AS n FROM (SELECT {STAGE} AS stage FROM top WHERE is_ioc = 1) WHERE stage <> '' GROUP BY stage")
def stage_votes(spark, sf_dir):
    return C.votes(C.with_stage(R.top_k(I.scores(spark, sf_dir), 100).where("is_ioc = 1")))


@query(f"""{TOP100}, p AS (SELECT DISTINCT {STAGE} AS stage FROM top WHERE is_ioc = 1), q AS (SELECT count(*) AS n, count(*) FILTER (stage IN ({", ".join(f"'{s}'" for s in OBSERVED)})) AS m, string_agg(stage, ',' ORDER BY stage) AS s FROM p WHERE stage <> '')
SELECT coalesce(s, '') AS predicted_stages, round(m / 4.0, 6) AS stage_recall, round(m / CAST(greatest(1, n) AS DOUBLE), 6) AS stage_precision, m AS lcs_length, round(m / 4.0, 6) AS ordered_stage_recall_lcs FROM q""")
def stage_recon(spark, sf_dir):
    one = C.evaluate_top_k(I.scores(spark, sf_dir), OBSERVED, [100])
    return one.select(F.array_join("predicted_stages", ",").alias("predicted_stages"), *[F.round(c, 6).alias(c) for c in ("stage_recall", "stage_precision", "ordered_stage_recall_lcs")], F.col("lcs_length").cast("bigint").alias("lcs_length"))


@query(f"""{TOP100}, s AS (SELECT *, {STAGE} AS stage FROM top WHERE is_ioc = 1), m AS (SELECT *, CASE WHEN lag(stage) OVER (ORDER BY t, rank) = stage THEN 0 ELSE 1 END AS is_new FROM s WHERE stage <> ''),
g AS (SELECT *, sum(is_new) OVER (ORDER BY t, rank ROWS UNBOUNDED PRECEDING) AS segment FROM m) SELECT CAST(segment AS BIGINT) AS segment, stage, min(t) AS t_min, max(t) AS t_max, count(*) AS n_edges FROM g GROUP BY segment, stage""")
def chain_segments(spark, sf_dir):
    return C.chain_segments(C.with_stage(R.top_k(I.scores(spark, sf_dir), 100).where("is_ioc = 1")))


def truth_lines(spark, sf_dir) -> DataFrame:
    s = I.scores(spark, sf_dir)
    return s.where("row_idx % 11 = 0").select("source_file", (F.col("row_idx") + F.col("row_idx") % 2).alias("line"), F.lit("data_exfiltration").alias("ioc_type")).distinct()


@query(f"""{BASE}, lines AS (SELECT DISTINCT source_file, row_idx + row_idx % 2 AS line FROM scores WHERE row_idx % 11 = 0)
SELECT s.row_seq, CASE WHEN a.line IS NOT NULL OR b.line IS NOT NULL THEN 'exfiltration_impact' ELSE {STAGE} END AS stage FROM scores s LEFT JOIN lines a ON a.source_file = s.source_file AND a.line = s.row_idx LEFT JOIN lines b ON b.source_file = s.source_file AND b.line = s.row_idx + 1""")
def line_truth_stage(spark, sf_dir):
    return C.with_stage(I.scores(spark, sf_dir), truth_lines(spark, sf_dir)).select("row_seq", "stage")


def top_sql(name: str, source: str) -> str:
    """``name`` (row_seq, rank): the best events of ``source``, shown as their last rows."""
    return f"""{name} AS (SELECT l.row_seq, row_number() OVER (ORDER BY d.score DESC, d.row_seq) AS rank FROM (SELECT scenario, t, etype, src, dst, max(score) AS score, min(row_seq) AS row_seq FROM {source} GROUP BY ALL) d
JOIN (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY scenario, t, etype, src, dst ORDER BY row_seq DESC) = 1) l USING (scenario, t, etype, src, dst))"""


def adaptive_sql(k: int) -> str:
    return f"""hot{k} AS (SELECT etype, src FROM (SELECT * FROM pairs ORDER BY score DESC, row_seq LIMIT {5 * k}) GROUP BY etype, src HAVING count(*) >= 4),
adaptive{k} AS (SELECT row_seq, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM (SELECT p.*, row_number() OVER (PARTITION BY p.etype, p.src ORDER BY score DESC, row_seq) AS gn, h.etype IS NOT NULL AS is_hot FROM pairs p LEFT JOIN hot{k} h ON h.etype = p.etype AND h.src = p.src) WHERE NOT is_hot OR gn <= 2)"""


def recon_sql() -> str:
    modes = {"by_k": "best", "by_k_pair_dedupe": "paired", "by_k_ioc_log_sources": "of_logs", "by_k_source_quota": "quota", "by_k_group_cap": "capped", "by_k_group_cap_adaptive": "adaptive{k}", "by_k_ioc_pool_upper_bound": "of_iocs", "by_k_pred_stage": "best"}
    parts = [f"SELECT '{m}' AS mode, {k} AS k, stage FROM staged JOIN {t.format(k=k)} USING (row_seq) WHERE rank <= {k} AND {'TRUE' if m.endswith('pred_stage') else 'is_ioc = 1'}".replace(" AS k, stage", " AS k, pred AS stage" if m.endswith("pred_stage") else " AS k, stage") for m, t in modes.items() for k in (10, 100)]
    parts += [f"SELECT '{m}', NULL, {c} FROM staged JOIN shown_alerts USING (row_seq)" for m, c in (("by_alert_rule", "stage"), ("by_alert_pred_stage", "pred"))]
    every = " UNION ALL ".join([f"SELECT '{m}' AS mode, {k} AS k" for m in modes for k in (10, 100)] + [f"SELECT '{m}', NULL" for m in ("by_alert_rule", "by_alert_pred_stage")])
    return f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, lines AS (SELECT DISTINCT source_file, row_idx + row_idx % 2 AS line FROM scores WHERE row_idx % 11 = 0),
staged AS (SELECT s.*, {STAGE} AS pred, CASE WHEN a.line IS NOT NULL OR b.line IS NOT NULL THEN 'exfiltration_impact' ELSE {STAGE} END AS stage FROM scores s LEFT JOIN lines a ON a.source_file = s.source_file AND a.line = s.row_idx LEFT JOIN lines b ON b.source_file = s.source_file AND b.line = s.row_idx + 1),
{PAIRS}, {top_sql("best", "scores")}, in_logs AS (SELECT * FROM scores WHERE source_file = 'eve.json'), {top_sql("of_logs", "in_logs")}, iocs AS (SELECT * FROM scores WHERE is_ioc = 1), {top_sql("of_iocs", "iocs")},
paired AS (SELECT row_seq, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM pairs),
placed_sources AS (SELECT *, CASE source_file WHEN 'eve.json' THEN 0 WHEN 'zeek_conn.csv' THEN 1 ELSE 2 END AS place FROM pairs), own AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, row_seq) <= CASE place WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 0 END AS by_quota FROM placed_sources),
quota AS (SELECT row_seq, row_number() OVER (ORDER BY by_quota DESC, CASE WHEN by_quota THEN place ELSE 0 END, score DESC, row_seq) AS rank FROM own),
capped AS (SELECT row_seq, row_number() OVER (ORDER BY score DESC, row_seq) AS rank FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY etype, dst ORDER BY score DESC, row_seq) <= 5)), {adaptive_sql(10)}, {adaptive_sql(100)},
{DEDUPED.format("scores")}, {HIGH.format("0.99")}, {WINDOWS}, {REACH}, clustered AS (SELECT p.*, count(*) OVER (PARTITION BY p.scenario, p.window_no, l.component) AS size FROM placed p JOIN labels l ON l.scenario = p.scenario AND l.window_no = p.window_no AND l.node = p.src),
shown_alerts AS (SELECT l.row_seq FROM clustered c JOIN (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY scenario, t, etype, src, dst ORDER BY row_seq DESC) = 1) l USING (scenario, t, etype, src, dst) WHERE size >= 3),
chosen AS ({" UNION ALL ".join(parts)}), every_mode AS ({every}),
p AS (SELECT mode, k, count(*) AS n, count(*) FILTER (stage IN ({", ".join(f"'{x}'" for x in OBSERVED)})) AS m, string_agg(stage, ',' ORDER BY stage) AS s FROM (SELECT DISTINCT mode, k, stage FROM chosen WHERE stage <> '') GROUP BY mode, k)
SELECT e.mode, e.k, coalesce(s, '') AS predicted_stages, round(coalesce(m, 0) / 4.0, 6) AS stage_recall, round(coalesce(m, 0) / CAST(greatest(1, coalesce(n, 0)) AS DOUBLE), 6) AS stage_precision, coalesce(m, 0) AS lcs_length, round(coalesce(m, 0) / 4.0, 6) AS ordered_stage_recall_lcs FROM every_mode e LEFT JOIN p ON p.mode = e.mode AND p.k IS NOT DISTINCT FROM e.k"""


@query(recon_sql())
def recon_all_modes(spark, sf_dir):
    s = I.scores(spark, sf_dir).withColumn("pred_stage", S.stage_of_type(F.col("ioc_type"))).withColumn("pred_stage_prob", F.lit(0.9))
    found = C.evaluate(s, OBSERVED, (10, 100), truth_lines(spark, sf_dir), ["eve.json"], QUOTAS, {}, {"hot": 4, "cap": 2}, True, {"width": DAY})
    return found.select("mode", "k", F.array_join("predicted_stages", ",").alias("predicted_stages"), F.col("lcs_length").cast("bigint").alias("lcs_length"), *[F.round(c, 6).alias(c) for c in ("stage_recall", "stage_precision", "ordered_stage_recall_lcs")])


@query(f"{BASE} SELECT count(*) AS n_rows_total, count(*) FILTER (source_file IN ('eve.json', 'zeek_conn.csv')) AS n_rows_candidate, count(*) FILTER (source_file NOT IN ('eve.json', 'zeek_conn.csv')) AS n_rows_excluded FROM scores")
def ioc_log_pool(spark, sf_dir):
    return C.pool_counts(I.scores(spark, sf_dir), ["eve.json", "zeek_conn.csv"])


@query(f"{BASE} SELECT CASE source_file WHEN 'eve.json' THEN 'eve' WHEN 'zeek_conn.csv' THEN 'zeek' ELSE 'audit' END AS family, count(*) AS n FROM scores GROUP BY 1")
def telemetry_family(spark, sf_dir):
    return I.scores(spark, sf_dir).groupBy(T.family_of(F.col("source_file")).alias("family")).agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT row_seq, scenario, source_file FROM scores WHERE source_file = 'zeek_conn.csv'")
def telemetry_filter(spark, sf_dir):
    return T.only_family(I.scores(spark, sf_dir), "zeek").select("row_seq", "scenario", "source_file")


@query(f"{BASE} SELECT scenario, {STAGE} AS stage, count(*) AS n FROM scores WHERE is_ioc = 1 GROUP BY 1, 2")
def ioc_counts_by_stage(spark, sf_dir):
    return C.ioc_counts_by_stage(I.scores(spark, sf_dir).where("is_ioc = 1"))


ORDERED = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(K.STAGES)) + " END"
TACTICS = sorted(K.TACTIC_STAGE)


@query(f"""{BASE}, seen AS (SELECT DISTINCT scenario, {STAGE} AS stage FROM scores WHERE is_ioc = 1 AND ioc_type <> 'data_exfiltration'),
sem AS (SELECT DISTINCT scenario, CASE etype {" ".join(f"WHEN {i} THEN '{K.TACTIC_STAGE[t]}'" for i, t in enumerate(TACTICS[:5]))} END AS stage FROM scores),
o AS (SELECT scenario, string_agg(stage, ',' ORDER BY {ORDERED}) AS observable FROM seen WHERE stage <> '' GROUP BY scenario), m AS (SELECT scenario, string_agg(stage, ',' ORDER BY {ORDERED}) AS semantic FROM sem GROUP BY scenario),
u AS (SELECT s.scenario, string_agg(s.stage, ',' ORDER BY s.stage) AS unobserved FROM sem s LEFT JOIN seen x ON x.scenario = s.scenario AND x.stage = s.stage WHERE x.stage IS NULL GROUP BY s.scenario)
SELECT m.scenario, semantic, coalesce(observable, '') AS observable, coalesce(unobserved, '') AS unobserved FROM m LEFT JOIN o ON o.scenario = m.scenario LEFT JOIN u ON u.scenario = m.scenario""")
def stage_truth(spark, sf_dir):
    s = I.scores(spark, sf_dir)
    tactic = F.element_at(F.array(*[F.lit(t.replace("-", "_").upper()) for t in TACTICS[:5]]), F.col("etype") + 1)
    truth = C.stage_truth(s.select("scenario", tactic.alias("tactic")), s.where("is_ioc = 1 AND ioc_type <> 'data_exfiltration'"))
    return truth.select("scenario", F.array_join("semantic", ",").alias("semantic"), F.array_join("observable", ",").alias("observable"), F.array_join("unobserved", ",").alias("unobserved"))


# --- events and graphs -------------------------------------------------------------------
CANON = f"WITH {I.SQL_CANON}"
TIMED = f"{CANON}, timed AS (SELECT *, coalesce(ts, CAST(ord AS DOUBLE)) AS et FROM canon)"
PLACE = "et, ord, edge_type, src_key, dst_key, event_seq"


CAUSAL = f"""{TIMED}, d0 AS (SELECT *, 0 AS lvl, et - lag(et) OVER (PARTITION BY scenario, src_key ORDER BY {PLACE}) AS delta_t FROM timed),
d1 AS (SELECT *, 1 AS lvl, et - lag(et) OVER (PARTITION BY scenario, src_key, dst_type, dst_key ORDER BY {PLACE}) AS delta_t FROM timed),
f AS (SELECT scenario, src_key, row_number() OVER (PARTITION BY scenario ORDER BY {PLACE}) AS fp FROM timed QUALIFY row_number() OVER (PARTITION BY scenario, src_key ORDER BY {PLACE}) = 1),
c0 AS (SELECT * FROM d0 WHERE delta_t BETWEEN 0 AND 5000 QUALIFY row_number() OVER (PARTITION BY scenario, src_key ORDER BY {PLACE}) <= {{0}}),
u AS (SELECT * FROM c0 UNION ALL SELECT * FROM d1 WHERE {{1}} AND delta_t BETWEEN 0 AND 5000),
r AS (SELECT u.*, row_number() OVER (PARTITION BY u.scenario ORDER BY lvl, CASE WHEN lvl = 0 THEN fp END, {PLACE.replace("src_key", "u.src_key")}) AS nth, (SELECT max(ord) FROM canon c WHERE c.scenario = u.scenario) AS last_ord FROM u JOIN f ON f.scenario = u.scenario AND f.src_key = u.src_key)
SELECT scenario, src_key, ts, last_ord + nth AS ord, delta_t, CASE lvl WHEN 0 THEN 'next_event_same_proc' ELSE 'shared_object_bridge' END AS cause_rule, CASE lvl WHEN 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence FROM r"""
LINKED = ("scenario", "src_key", "ts", "ord", "delta_t", "cause_rule", "confidence")


@query(CAUSAL.format(1000, "FALSE"))
def causal_level0(spark, sf_dir):
    return G.causal_edges(I.canon(spark, sf_dir), "level0", 5000.0).select(*LINKED)


@query(CAUSAL.format(1000, "TRUE"))
def causal_level1(spark, sf_dir):
    return G.causal_edges(I.canon(spark, sf_dir), "level1", 5000.0).select(*LINKED)


NODES = f"""{CANON}, ends AS (SELECT scenario, src_type AS node_type, src_key AS key, event_seq * 2 AS place FROM canon UNION ALL SELECT scenario, dst_type, dst_key, event_seq * 2 + 1 FROM canon),
f AS (SELECT scenario, node_type, key, min(place) AS place FROM ends GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY scenario, node_type ORDER BY place) - 1 AS local_id FROM f),
nodes AS (SELECT scenario, node_type, key, local_id, row_number() OVER (PARTITION BY scenario ORDER BY node_type, place) - 1 AS global_id FROM l)"""


@query(f"{NODES} SELECT * FROM nodes")
def node_ids(spark, sf_dir):
    return G.nodes(I.canon(spark, sf_dir))


@query(f"{NODES} SELECT scenario, 'node' AS kind, node_type AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT scenario, 'edge', edge_type, count(*) FROM canon GROUP BY ALL")
def graph_counts(spark, sf_dir):
    return G.graph_counts(I.canon(spark, sf_dir))


STREAM = f"""{NODES}, j AS (SELECT c.*, coalesce(ts, CAST(ord AS DOUBLE)) AS et, a.global_id AS src, b.global_id AS dst, CASE edge_type WHEN 'CONNECT' THEN 0 ELSE 1 END AS e0 FROM canon c
JOIN nodes a ON a.scenario = c.scenario AND a.node_type = src_type AND a.key = src_key JOIN nodes b ON b.scenario = c.scenario AND b.node_type = dst_type AND b.key = dst_key),
stream AS (SELECT scenario, row_number() OVER (PARTITION BY scenario ORDER BY {{0}}, e0, src, dst, event_seq) - 1 AS stream_idx, src, dst, CAST({{0}} AS BIGINT) AS t, e0 AS etype FROM j)"""


@query(STREAM.format("et") + " SELECT * FROM stream")
def edge_stream(spark, sf_dir):
    return G.edge_stream(I.canon(spark, sf_dir), features=False).select("scenario", "stream_idx", "src", "dst", "t", "etype")


@query(STREAM.format("CAST(CAST(et AS FLOAT) AS DOUBLE)") + " SELECT * FROM stream")
def edge_stream_float32(spark, sf_dir):
    return G.edge_stream(I.canon(spark, sf_dir), "float32", features=False).select("scenario", "stream_idx", "src", "dst", "t", "etype")


@query(f"""{BASE}, s AS (SELECT scenario, greatest(max(src), max(dst)) + 1 AS n FROM scores GROUP BY scenario), b AS (SELECT scenario, coalesce(sum(n) OVER (ORDER BY scenario ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT row_seq, scenario, CAST(src + base AS BIGINT) AS src, CAST(dst + base AS BIGINT) AS dst FROM scores JOIN b USING (scenario)""")
def joint_offsets(spark, sf_dir):
    return G.offset_streams(I.scores(spark, sf_dir)).select("row_seq", "scenario", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def hashed(c: str) -> str:
    return f"CAST('0x' || substr(md5('{c}=' || {c}), 1, 7) AS BIGINT) % 8"


FLAG_SQL = " || '|' || ".join(f"CAST(CAST(regexp_matches(lower(cmdline), '{p}') AS INT) AS VARCHAR)" for p in (K.COMMAND_FLAGS[f] for f in K.FEATURE_FLAGS[:8]))


@query(f"""{CANON}, v AS (SELECT *, {hashed('proto')} AS h1, {hashed('service')} AS h2, lower(trim(coalesce(direction, ''))) AS d FROM canon)
SELECT event_seq, CAST(coalesce(bytes_sent, 0) AS VARCHAR) || '|' || CAST(coalesce(bytes_sent, 0) * 2 AS VARCHAR) || '|' || CAST(event_seq % 5 AS VARCHAR) || '|' || CAST(event_seq % 3 AS VARCHAR) || '|' || CASE WHEN d IN ('in', 'inbound') THEN '1|0|0' WHEN d IN ('out', 'outbound') THEN '0|1|0' ELSE '0|0|1' END || '|' || {FLAG_SQL} || '|' || CAST(event_seq % 2 AS VARCHAR) || '|0|0|' || CAST(CAST(event_seq % 7 = 0 AS INT) AS VARCHAR) || '|' || {" || '|' || ".join(f"CAST(coalesce(CAST(h1 = {i} AS INT), 0) + coalesce(CAST(h2 = {i} AS INT), 0) AS VARCHAR)" for i in range(8))} AS features FROM v""")
def edge_features(spark, sf_dir):
    e = I.canon(spark, sf_dir)
    e = e.withColumns({"bytes_recv": F.col("bytes_sent") * 2, "bytes": F.col("event_seq") % 5, "delta_t": F.col("event_seq") % 3, **X.command_flags(F.col("cmdline")), "has_jwt": F.col("event_seq") % 2 == 1, "has_known_registry_domain": F.when(F.col("event_seq") % 7 == 0, True)})
    return e.select("event_seq", F.array_join(F.transform(G.edge_features(e), lambda x: x.cast("bigint").cast("string")), "|").alias("features"))


@query(f"""{SPLIT}, ends AS (SELECT scenario, etype, src AS node, 1 AS o, 0 AS i FROM prefix UNION ALL SELECT scenario, etype, dst, 0, 1 FROM prefix)
SELECT scenario, node, round(ln(1 + sum(i)), 6) AS log_in, round(ln(1 + sum(o)), 6) AS log_out, {", ".join(f"round(sum(CASE WHEN etype = {k} THEN o ELSE 0 END) / CAST(greatest(1, sum(o)) AS DOUBLE), 6) AS share_{k}" for k in range(5))} FROM ends GROUP BY scenario, node""")
def degree_shares(spark, sf_dir):
    prefix = R.with_tail(I.scores(spark, sf_dir)).where("NOT is_tail")
    d = G.degrees(prefix, 5)
    return d.select("scenario", "node", *[F.round(c, 6).alias(c) for c in d.columns[2:]])


@query(f"{BASE} SELECT scenario, row_seq, src, dst, etype FROM scores UNION ALL SELECT scenario, row_seq, dst, src, etype + 5 FROM scores")
def both_ways(spark, sf_dir):
    return G.both_ways(I.scores(spark, sf_dir).select("scenario", "row_seq", "src", "dst", "etype"), 5)


@query(f"""{BASE}, deg AS (SELECT scenario, src AS node, CAST(count(*) AS DOUBLE) AS x FROM scores GROUP BY ALL)
SELECT s.scenario, s.dst AS node, s.etype, round(avg(x), 6) AS mean FROM scores s JOIN deg d ON d.scenario = s.scenario AND d.node = s.src GROUP BY ALL""")
def neighbour_means(spark, sf_dir):
    s = I.scores(spark, sf_dir)
    x = s.groupBy("scenario", F.col("src").alias("node")).agg(F.array(F.count("*").cast("double")).alias("x"))
    return G.neighbour_means(s, x, 1, by_relation=True).select("scenario", "node", "etype", F.round(F.get("mean", F.lit(0)), 6).alias("mean"))


# --- labels and training data ------------------------------------------------------------
FLAGS = {"has_bitsadmin": r"\bbitsadmin(\.exe)?\b", "has_certutil": r"\bcertutil(\.exe)?\b", "has_base64_flag": r"(-enc|-encodedcommand)\b", "has_invoke_expression": r"\binvoke-expression\b|\biex\b", "has_invoke_webrequest": r"\binvoke-webrequest\b", "has_curl": r"\bcurl\b", "has_wget": r"\bwget\b"}
RULED = f"""{CANON}, f AS (SELECT *, {", ".join(f"regexp_matches(lower(cmdline), '{p}') AS {n}" for n, p in FLAGS.items())}, lower(trim(cmdline || ' ' || evidence)) AS txt FROM canon),
h AS (SELECT *, source_file = 'eve.json' OR contains(lower(cmdline || ' ' || evidence), 'et ') AND contains(txt, 'et ') OR contains(txt, 'suricata') OR contains(txt, 'alert') AS r1, edge_type = 'CONNECT' AND dst_key LIKE '%:4444' AS r2,
 has_certutil OR has_bitsadmin OR has_base64_flag OR has_invoke_expression AS strong_flag, CAST(has_invoke_webrequest AS INT) + CAST(has_curl AS INT) + CAST(has_wget AS INT) AS n_download,
 regexp_matches(trim(cmdline), '(?i)(curl|wget)\\s+[^|]+\\|\\s*(ba)?sh') AS r8 FROM f),
t AS (SELECT *, [x FOR x IN [CASE WHEN r1 THEN 'suricata_alert' END, CASE WHEN r2 THEN 'suspicious_port' END, CASE WHEN has_bitsadmin THEN 'lolbin_bitsadmin' END, CASE WHEN has_certutil THEN 'lolbin_certutil' END, CASE WHEN has_base64_flag OR has_invoke_expression THEN 'lolbin_encoded_ps' END, CASE WHEN n_download > 0 THEN 'lolbin_download_cradle' END, CASE WHEN r8 THEN 'tier2_pipe_to_shell' END] IF x IS NOT NULL] AS types FROM h),
ruled AS (SELECT *, CASE WHEN len(types) = 0 THEN '' WHEN (r1 OR r8 OR has_base64_flag OR has_invoke_expression OR len(types) >= 2) AND source_file IN ('eve.json', 'azure_events.csv') AND (r1 OR r8 OR strong_flag OR n_download >= 2) THEN 'high' ELSE 'medium' END AS confidence FROM t)"""


def ruled(spark, sf_dir) -> DataFrame:
    e = I.canon(spark, sf_dir)
    return N.annotate_rules(e.withColumns(X.command_flags(F.col("cmdline"))), ["eve.json", "azure_events.csv"])


@query(f"{RULED} SELECT event_seq, array_to_string(types, ',') AS rule_types, confidence AS rule_confidence FROM ruled")
def weak_rules(spark, sf_dir):
    return ruled(spark, sf_dir).select("event_seq", F.array_join("rule_types", ",").alias("rule_types"), "rule_confidence")


@query(f"{RULED} SELECT scenario, count(*) AS n_events, count(*) FILTER (len(types) > 0) AS n_rule_hit, count(*) FILTER (confidence = 'high') AS n_rule_high, count(*) FILTER (list_contains(types, 'tier2_pipe_to_shell')) AS n_new_rule FROM ruled GROUP BY scenario")
def rule_coverage(spark, sf_dir):
    return N.rule_coverage(ruled(spark, sf_dir), "tier2_pipe_to_shell")


@query(f"""{RULED}, more AS (SELECT *, regexp_matches(txt, '\\becho\\b') AS e, len(types) + CAST(regexp_matches(txt, '\\becho\\b') AS INT) AS n FROM ruled),
x AS (SELECT *, CASE WHEN n = 0 THEN '' WHEN (r1 OR r8 OR has_base64_flag OR has_invoke_expression OR n >= 2) AND source_file IN ('eve.json', 'azure_events.csv') AND (r1 OR r8 OR strong_flag OR n_download >= 2) THEN 'high' ELSE 'medium' END AS confidence2 FROM more),
g AS (SELECT scenario, count(*) AS n_events_before, count(*) FILTER (len(types) > 0) AS n_rule_hit_before, count(*) FILTER (confidence = 'high') AS n_rule_high_before, CAST(0 AS BIGINT) AS n_new_rule_before, count(*) AS n_events, count(*) FILTER (n > 0) AS n_rule_hit, count(*) FILTER (confidence2 = 'high') AS n_rule_high, count(*) FILTER (e) AS n_new_rule FROM x GROUP BY scenario)
SELECT *, n_rule_hit - n_rule_hit_before AS delta_rule_hit, n_rule_high - n_rule_high_before AS delta_rule_high FROM g""")
def rule_coverage_delta(spark, sf_dir):
    more = K.RULES | {"tier2_cmdline_patterns": [*K.RULES["tier2_cmdline_patterns"], {"id": "echo", "pattern": r"(?i)\becho\b", "confidence": "medium"}]}
    e = I.canon(spark, sf_dir).withColumns(X.command_flags(F.col("cmdline")))
    files = ["eve.json", "azure_events.csv"]
    return N.coverage_delta(N.rule_coverage(N.annotate_rules(e, files), "echo"), N.rule_coverage(N.annotate_rules(e, files, more), "echo"))


IOC_VALUES = ["10.0.0.4", "/tmp/f3", "echo hello"]


@query(f"""{CANON}, lines AS (SELECT unnest([7, 50, 900]) AS line)
SELECT event_seq, CASE WHEN a.line IS NOT NULL OR b.line IS NOT NULL THEN 1 ELSE 0 END AS is_ioc_line,
CASE WHEN a.line IS NOT NULL OR b.line IS NOT NULL OR dst_key IN ('10.0.0.4:443', '10.0.0.4:4444', '/tmp/f3') OR cmdline = 'echo hello' THEN 1 ELSE 0 END AS is_ioc,
CASE WHEN a.line IS NOT NULL OR b.line IS NOT NULL THEN 'data_exfiltration' WHEN cmdline = 'echo hello' THEN 'execution' WHEN dst_key = '/tmp/f3' THEN 'file_artifact' WHEN dst_key LIKE '10.0.0.4:%' THEN 'attack_ip' ELSE '' END AS ioc_type
FROM canon c LEFT JOIN lines a ON a.line = row_idx AND source_file = 'eve.json' LEFT JOIN lines b ON b.line = row_idx + 1 AND source_file = 'eve.json'""")
def ioc_match(spark, sf_dir):
    lines = spark.createDataFrame([("eve.json", n, "data_exfiltration", "x") for n in (7, 50, 900)], "source_file string, line bigint, type string, value string")
    values = spark.createDataFrame(list(zip(("attack_ip", "file_artifact", "execution"), IOC_VALUES)), "type string, value string")
    found = N.annotate_iocs(I.canon(spark, sf_dir), lines, values)
    return found.select("event_seq", F.col("is_ioc_line").cast("int").alias("is_ioc_line"), F.col("is_ioc").cast("int").alias("is_ioc"), "ioc_type")


@query(f"""{SPLIT}, x AS (SELECT scenario, CASE WHEN pos >= cut THEN 'tail' ELSE 'prefix' END AS part, y_ioc AS y FROM parts)
SELECT scenario, coalesce(part, 'full') AS part, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, round(sum(y) / CAST(count(*) AS DOUBLE), 6) AS rate FROM x GROUP BY GROUPING SETS ((scenario), (scenario, part))""")
def label_balance(spark, sf_dir):
    return D.label_balance(I.scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"{SPLIT}, u AS (SELECT scenario, t, etype, src, dst, max(y_ioc) AS y FROM tail GROUP BY ALL) SELECT scenario, count(*) AS n_unique, count(*) FILTER (y > 0) AS n_unique_ioc FROM u GROUP BY scenario")
def unique_tail(spark, sf_dir):
    return D.unique_tail(I.scores(spark, sf_dir))


STAGE_NUMBER = "CASE {0} " + " ".join(f"WHEN '{t}' THEN {K.STAGES.index(s) + 1}" for t, s in K.IOC_STAGE.items()) + " ELSE 0 END"
NETWORK = ", ".join(f"'{t}'" for t in K.NETWORK_IOC_TYPES)


@query(f"{BASE} SELECT row_seq, {STAGE_NUMBER.format('ioc_type')} AS gt, CASE WHEN y_rule = 1 AND rule_ioc_type NOT IN ({NETWORK}) THEN {STAGE_NUMBER.format('rule_ioc_type')} ELSE 0 END AS rule, CASE WHEN y_rule_high = 1 AND rule_ioc_type NOT IN ({NETWORK}) THEN {STAGE_NUMBER.format('rule_ioc_type')} ELSE 0 END AS rule_high FROM scores")
def stage_labels(spark, sf_dir):
    return I.scores(spark, sf_dir).select("row_seq", D.stage_label("gt_ioc").alias("gt"), D.stage_label("rule").alias("rule"), D.stage_label("rule_high").alias("rule_high"))


@query(f"{BASE} SELECT scenario, count(*) FILTER (y_rule = 1 AND rule_ioc_type NOT IN ({NETWORK})) AS n_eligible FROM scores GROUP BY scenario")
def stage_label_counts(spark, sf_dir):
    return D.stage_label_counts(I.scores(spark, sf_dir), "rule")


@query(f"{SPLIT} SELECT t.row_seq, t.scenario, t.etype, t.t, (SELECT count(*) FROM prefix p WHERE p.scenario = t.scenario AND p.etype = t.etype AND p.t BETWEEN t.t - {DAY} AND t.t + {DAY}) AS n_candidates FROM tail t")
def neg_window_candidates(spark, sf_dir):
    return D.window_candidate_counts(I.scores(spark, sf_dir), DAY)


@query(f"{SPLIT} SELECT t.row_seq, p.row_seq AS candidate_seq, p.dst AS candidate FROM tail t JOIN prefix p ON p.scenario = t.scenario AND p.etype = t.etype AND abs(p.t - t.t) <= 3600")
def neg_window_pairs(spark, sf_dir):
    split = R.with_tail(I.scores(spark, sf_dir))
    return D.window_candidates(split.where("is_tail"), split.where("NOT is_tail"), 3600).select("row_seq", "candidate_seq", "candidate")


def pooled(keys: str, source: str = "prefix") -> str:
    """Draws from the numbered distinct destinations of ``keys``: the first that isn't the edge's own."""
    by = " AND ".join(f"p.{c} = t.{c}" for c in keys.split(", "))
    n = " AND ".join(f"n.{c} = t.{c}" for c in keys.split(", "))
    return f"""pool AS (SELECT {keys}, dst, row_number() OVER (PARTITION BY {keys} ORDER BY dst) - 1 AS i FROM (SELECT DISTINCT {keys}, dst FROM {source})), sizes AS (SELECT {keys}, count(*) AS size FROM pool GROUP BY {keys}),
tries AS (SELECT t.row_seq, x.d, p.dst AS negative FROM tail t JOIN sizes n ON {n} CROSS JOIN (VALUES (0), (1)) x(d) JOIN pool p ON {by} AND p.i = ({drawn('42', 't.row_seq')} % n.size + x.d) % n.size WHERE p.dst <> t.dst),
drawn AS (SELECT row_seq, arg_min(negative, d) AS negative FROM tries GROUP BY row_seq)"""


@query(f"{SPLIT}, {pooled('scenario, etype')} SELECT row_seq, scenario, etype, src, dst, negative FROM tail LEFT JOIN drawn USING (row_seq)")
def sampled_negatives(spark, sf_dir):
    return D.sampled_negatives(I.scores(spark, sf_dir), "pool").select("row_seq", "scenario", "etype", "src", "dst", "negative")


@query(f"{SPLIT}, {pooled('scenario')} SELECT row_seq, negative FROM tail LEFT JOIN drawn USING (row_seq)")
def random_negatives(spark, sf_dir):
    return D.sampled_negatives(I.scores(spark, sf_dir), "random").select("row_seq", "negative")


@query(f"{SPLIT}, {pooled('scenario', 'tail')} SELECT row_seq, negative FROM tail LEFT JOIN drawn USING (row_seq)")
def inbatch_negatives(spark, sf_dir):
    return D.sampled_negatives(I.scores(spark, sf_dir), "inbatch").select("row_seq", "negative")


@query(f"""{SPLIT}, {pooled('scenario, etype')}, numbered AS (SELECT *, row_number() OVER (PARTITION BY scenario, etype ORDER BY t, row_seq) - 1 AS i FROM prefix),
runs AS (SELECT t.row_seq, t.scenario, t.etype, t.dst, greatest(min(p.i), max(p.i) - 49) AS a, max(p.i) AS z FROM tail t JOIN numbered p ON p.scenario = t.scenario AND p.etype = t.etype AND p.t BETWEEN t.t - {DAY} AND t.t + {DAY} GROUP BY ALL),
near AS (SELECT r.row_seq, arg_min(p.dst, x.d) AS negative FROM runs r CROSS JOIN (VALUES (0), (1), (2), (3)) x(d) JOIN numbered p ON p.scenario = r.scenario AND p.etype = r.etype AND p.i = a + ({drawn('42', 'r.row_seq')} % (z - a + 1) + x.d) % (z - a + 1) WHERE p.dst <> r.dst GROUP BY r.row_seq)
SELECT row_seq, coalesce(n.negative, d.negative) AS negative FROM tail LEFT JOIN near n USING (row_seq) LEFT JOIN drawn d USING (row_seq)""")
def window_negatives(spark, sf_dir):
    return D.sampled_negatives(I.scores(spark, sf_dir), "window", width=DAY, max_cands=50).select("row_seq", "negative")


@query(f"""{BASE}, node AS (SELECT scenario, n, row_number() OVER (PARTITION BY scenario ORDER BY n) - 1 AS i FROM (SELECT scenario, src AS n FROM scores UNION SELECT scenario, dst FROM scores)), sizes AS (SELECT scenario, count(*) AS size FROM node GROUP BY scenario),
seen AS (SELECT DISTINCT scenario, src, etype, dst FROM scores), tries AS (SELECT s.row_seq, x.d, n.n AS negative FROM scores s JOIN sizes z USING (scenario) CROSS JOIN (SELECT unnest(range(8)) AS d) x JOIN node n ON n.scenario = s.scenario AND n.i = {drawn('42', 's.row_seq', 'x.d')} % z.size
LEFT JOIN seen e ON e.scenario = s.scenario AND e.src = s.src AND e.etype = s.etype AND e.dst = n.n WHERE n.n <> s.src AND e.dst IS NULL), first AS (SELECT row_seq, arg_min(negative, d) AS negative FROM tries GROUP BY row_seq)
SELECT row_seq, scenario, etype, src, negative FROM scores LEFT JOIN first USING (row_seq)""")
def unseen_negatives(spark, sf_dir):
    return D.unseen_negatives(I.scores(spark, sf_dir)).select("row_seq", "scenario", "etype", "src", "negative")


@query(f"""{SPLIT}, w AS (SELECT *, CASE WHEN pos < cut THEN 1 ELSE 0 END AS seen FROM parts)
SELECT scenario, row_seq, {", ".join(f"round(ln(1 + coalesce(sum(seen) OVER (PARTITION BY scenario, {by} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS {name}" for name, by in (("log_src", "src"), ("log_dst", "dst"), ("log_pair", "src, dst"), ("log_triple", "src, dst, etype"), ("log_dst_etype", "dst, etype")))},
round(coalesce(ln(1 + greatest(0, t - max(CASE WHEN seen = 1 THEN t END) OVER (PARTITION BY scenario, src ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), -1), 6) AS log_idle FROM w""")
def link_history(spark, sf_dir):
    """What the learned scores know of an edge's ends."""
    return L.history(R.with_split(I.scores(spark, sf_dir))).select("scenario", "row_seq", *[F.round(c, 6).alias(c) for c in L.FEATURES])


@query(f"{BASE} SELECT row_seq, {', '.join(f'CAST({c} > 0 AS INT) AS {n}' for n, c in (('ioc', 'y_ioc'), ('rule', 'y_rule'), ('rule_high', 'y_rule_high')))}, 0 AS off, CASE WHEN y_ioc = 0 THEN 1 ELSE 0 END AS benign FROM scores")
def supervision_labels(spark, sf_dir):
    s = I.scores(spark, sf_dir)
    benign = D.benign_only(s).select("row_seq", F.lit(1).alias("benign"))
    return s.join(benign, "row_seq", "left").select("row_seq", *[D.supervision_label(m).alias(m) for m in ("ioc", "rule", "rule_high", "off")], F.coalesce("benign", F.lit(0)).alias("benign"))


@query()
def learned_link_scores(spark, sf_dir):
    return L.link_scores(I.scores(spark, sf_dir).drop("score")).select("scenario", "row_seq", "score")


@query()
def graph_link_scores(spark, sf_dir):
    return L.graph_scores(I.scores(spark, sf_dir)).select("scenario", "row_seq", "score")


@query()
def leave_one_out_scores(spark, sf_dir):
    return L.leave_one_out_scores(I.scores(spark, sf_dir), "sc3").select("scenario", "row_seq", "score")


@query()
def stage_predictions(spark, sf_dir):
    return L.stage_scores(I.scores(spark, sf_dir), "rule").select("scenario", "row_seq", "pred_stage", "pred_stage_prob")


# --- text and logs -----------------------------------------------------------------------
def plain(text: str) -> str:
    """A text in which DuckDB's word boundaries, which are those of ASCII, lie where Unicode's do:
    other letters and digits become an x, all else a blank."""
    return f"regexp_replace(regexp_replace(coalesce({text}, ''), '[^\\x00-\\x7F\\pL\\pM\\pN]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')"


QUOTED = lambda p: p.replace("'", "''")
URL_SQL = QUOTED(K.URL).replace("\\s", "\\s\\x0B")
TLDS = "[s.e FOR s IN list_sort([{'n': -len([x FOR x IN ends IF x = e]), 'e': e} FOR e IN list_distinct(ends)])]"
SIGNALS_SQL = rf"""WITH p AS (SELECT page_id, html AS raw, {plain('html')} AS t FROM pages), m AS (SELECT *, list_distinct(regexp_extract_all(t, '(?i){K.DOMAIN}')) AS domains FROM p),
e AS (SELECT *, [lower(split_part(d, '.', -1)) FOR d IN domains] AS ends FROM m), r AS (SELECT *, {TLDS} AS tops FROM e)
SELECT page_id, len(list_distinct(regexp_extract_all(raw, '(?i){URL_SQL}'))) AS n_urls, len(domains) AS n_domains, {", ".join(f"len(list_distinct(regexp_extract_all(t, '(?i){p}'))) AS {n}" for n, p in (("n_md5", K.MD5), ("n_sha1", K.SHA1), ("n_sha256", K.SHA256)))},
CAST(len([d FOR d IN domains IF lower(d) IN ({", ".join(f"'{r}'" for r in K.REGISTRIES)})]) > 0 AS INT) AS has_known_registry_domain, {", ".join(f"coalesce(tops[{i}], '') AS top_tld_{i}" for i in (1, 2, 3))},
{", ".join(f"CAST(regexp_matches(t, '{f}{p}') AS INT) AS {n}" for n, p, f in (("has_jwt", K.JWT, ""), ("has_base64_blob", K.BASE64, ""), ("has_azure_secret_hint", K.CLOUD_SECRET, "(?i)")))} FROM r"""


@query(SIGNALS_SQL)
def text_signals(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = lambda n: "string" if n.startswith("top_") else "int" if n.startswith("has_") else "bigint"
    return p.select("page_id", *[c.cast(kind(n)).alias(n) for n, c in X.signals(F.col("html")).items()])


@query(f"SELECT doc_id, len(list_distinct(regexp_extract_all({plain('text')}, '{K.IP}'))) AS n_ips FROM documents")
def address_extract(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(X.addresses(F.col("text"))).cast("bigint").alias("n_ips"))


@query(f"{CANON} SELECT event_seq, {', '.join(f'CAST(regexp_matches(lower(cmdline), {chr(39)}{p}{chr(39)}) AS INT) AS {n}' for n, p in FLAGS.items())} FROM canon")
def command_flags(spark, sf_dir):
    flags = X.command_flags(F.col("cmdline"))
    return I.canon(spark, sf_dir).select("event_seq", *[flags[n].cast("int").alias(n) for n in FLAGS])


@query(f"{CANON} SELECT event_seq, CASE WHEN dst_key LIKE '%:4444' THEN 4444 WHEN dst_key LIKE '%:443' THEN 443 END AS port FROM canon")
def ports_of_keys(spark, sf_dir):
    return I.canon(spark, sf_dir).select("event_seq", S.port_of_key(F.col("dst_key")).alias("port"))


#: Formats of a timestamp's text, and what is added to the whole seconds.
STAMPS = {"yyyy-MM-dd HH:mm:ss": 0, "yyyy-MM-dd'T'HH:mm:ss": 0, "yyyy-MM-dd HH:mm:ss.'125'": 0.125, "yyyy-MM-dd'T'HH:mm:ss.'250000Z'": 0.25, "yyyy-MM-dd'T'HH:mm:ss'-0500'": 18000, "yyyy-MM-dd'T'HH:mm:ss.'500+01:00'": -3599.5, "dd/MM/yyyy, HH:mm:ss": 0, "dd/MM/yyyy, HH:mm:ss.'125'": 0.125, "dd/MM/yyyy, hh:mm:ss a": 0, "dd/MM/yyyy HH:mm:ss": 0, "dd/MM/yyyy HH:mm:ss.'750'": 0.75}
STAMP_NAMES = [f"t{i}" for i in range(len(STAMPS))]


@query(f"""WITH {I.SQL_FIRST} SELECT event_id, {", ".join(f"CAST(tsec + {more} AS DOUBLE) AS {n}" for n, more in zip(STAMP_NAMES, STAMPS.values()))}, CAST(tsec - tsec % 86400 AS DOUBLE) AS day, CAST(tsec AS DOUBLE) AS epoch, CAST(NULL AS DOUBLE) AS bad FROM first_step""")
def timestamps(spark, sf_dir):
    e = I.first_step(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.timestamp_seconds("tsec"))
    text = lambda f: F.date_format("ts", f)
    bad = F.element_at(F.array(*[F.lit(x) for x in ("", " ", "nan", "NaN", "no time", "1765728640", "2025-13-45", "45/13/2025")]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", *[S.unix_seconds(text(f)).alias(n) for n, f in zip(STAMP_NAMES, STAMPS)], S.unix_seconds(text("dd/MM/yyyy")).alias("day"), S.unix_seconds(F.col("tsec").cast("string"), True).alias("epoch"), S.unix_seconds(bad).alias("bad"))


KEYS = "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '10.0.0.' || CAST(s_suppkey % 9 AS VARCHAR(9)) END"


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_name || '|' || ({KEYS}) || ':' || CAST(s_suppkey % 4 AS VARCHAR) WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 > 0 THEN ({KEYS}) || ':' || CAST(s_suppkey % 4 AS VARCHAR) WHEN s_suppkey % 5 <> 0 THEN {KEYS} ELSE 'UNKNOWN_NET' END AS net,
CASE WHEN s_suppkey % 2 = 0 THEN 'sc1::' || s_name WHEN s_suppkey % 5 <> 0 THEN 'sc1::ip::' || ({KEYS}) ELSE 'sc1::host::UNKNOWN' END || '::proc::HOST' AS host FROM supplier""")
def key_builders(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("ip", F.expr(KEYS))
    name3, name2 = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    return s.select("s_suppkey", S.net_key(F.col("ip"), (F.col("s_suppkey") % 4).cast("string"), name3).alias("net"), S.host_proc(F.lit("sc1"), name2, F.col("ip")).alias("host"))


@query("SELECT n_nationkey, n_name || '&1' AS image, CAST(n_regionkey AS VARCHAR) AS pid, 2 AS n_fields FROM nation")
def event_data_map(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.concat(F.lit('<Data Name="Image">old</Data><Data name="Image"> '), F.col("n_name"), F.lit('&amp;1</Data><Data Name="ProcessId">'), F.col("n_regionkey").cast("string"), F.lit("</Data>"))
    m = S.event_data(xml)
    return n.select("n_nationkey", F.element_at(m, "Image").alias("image"), F.element_at(m, "ProcessId").alias("pid"), F.size(m).alias("n_fields"))


def raw_zeek(spark, sf_dir) -> DataFrame:
    """Events as rows of a network sensor's log, all fields text."""
    e = I.first_step(spark.read.parquet(f"{sf_dir}/events.parquet"))
    text = lambda c: F.col(c).cast("string")
    return e.select(
        F.concat(F.lit("sc"), (F.col("user_id") % 7 + 1).cast("string")).alias("scenario"), F.lit("zeek_http.csv").alias("source_file"), F.col("event_id").alias("row_idx"), F.concat(F.lit("10.1.0."), (F.col("user_id") % 50).cast("string")).alias("id.orig_h"),
        F.concat(F.lit("10.2.0."), (F.col("k") % 10).cast("string")).alias("id.resp_h"), (F.col("k") % 4 * 100).cast("string").alias("id.resp_p"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("h"), text("k"))).alias("host"), (F.lit(200) + F.col("k") % 5 * 50).cast("string").alias("status_code"),
        F.col("event_type").alias("method"), F.lit("/").alias("uri"), F.concat(F.lit("h"), text("k"), F.lit(".org")).alias("query"), F.when(F.col("k") % 4 == 0, "1.1.1.1, ,2.2.2.2").when(F.col("k") % 4 == 1, "3.3.3.3").alias("answers"), F.lit(None).cast("string").alias("ts"), text("event_id").alias("uid"),
    )


@query(f"""WITH {I.SQL_FIRST}, x AS (SELECT 'sc' || CAST(user_id % 7 + 1 AS VARCHAR) AS scenario, event_id AS row_idx, user_id % 50 AS u, k, 200 + k % 5 * 50 AS st, CASE WHEN k % 3 = 0 THEN 'h' || CAST(k AS VARCHAR) || '|10.2.0.' || CAST(k % 10 AS VARCHAR) || ':' || CAST(k % 4 * 100 AS VARCHAR) WHEN k % 4 = 0 THEN '10.2.0.' || CAST(k % 10 AS VARCHAR) ELSE '10.2.0.' || CAST(k % 10 AS VARCHAR) || ':' || CAST(k % 4 * 100 AS VARCHAR) END AS dst FROM first_step)
SELECT row_idx, 'CONNECT' AS edge_type, scenario || '::ip::10.1.0.' || CAST(u AS VARCHAR) || '::proc::HOST' AS src_key, dst AS dst_key, st AS status FROM x UNION ALL SELECT row_idx, 'REDIRECT', dst, dst, st FROM x WHERE st >= 300 AND st < 400""")
def parse_http(spark, sf_dir):
    e = Z.zeek_http(raw_zeek(spark, sf_dir))
    return e.select("row_idx", "edge_type", "src_key", "dst_key", F.coalesce("status_code", "http_status").alias("status"))


@query(f"""WITH {I.SQL_FIRST} SELECT event_id AS row_idx, 'DNS_QUERY' AS edge_type, 'h' || CAST(k AS VARCHAR) || '.org' AS dst_key FROM first_step
UNION ALL SELECT event_id, 'RESOLVE', '3.3.3.3' FROM first_step WHERE k % 4 = 1 UNION ALL SELECT event_id, 'RESOLVE', '1.1.1.1' FROM first_step WHERE k % 4 = 0 UNION ALL SELECT event_id, 'RESOLVE', '2.2.2.2' FROM first_step WHERE k % 4 = 0""")
def parse_dns(spark, sf_dir):
    return Z.zeek_dns(raw_zeek(spark, sf_dir)).select("row_idx", "edge_type", "dst_key")


# --- reports -----------------------------------------------------------------------------
@query(f"{BASE}, m AS (SELECT source_file, scenario, avg(score) AS a, CASE WHEN scenario <> 'sc3' THEN avg(is_ioc) END AS b FROM scores GROUP BY source_file, scenario) SELECT source_file, round(avg(a), 6) AS a, round(avg(b), 6) AS b, count(*) FILTER (a IS NULL) AS n_na_a, count(*) FILTER (b IS NULL) AS n_na_b FROM m GROUP BY source_file")
def macro_average(spark, sf_dir):
    s = I.scores(spark, sf_dir).groupBy("source_file", "scenario").agg(F.avg("score").alias("a"), F.avg("is_ioc").alias("b"))
    s = s.withColumn("b", F.when(F.col("scenario") != "sc3", F.col("b")).otherwise(F.lit(float("nan"))))
    return P.macro_average(s, ["source_file"], ["a", "b"]).withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))
