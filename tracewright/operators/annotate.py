"""Labels of events: indicators of compromise, and weak rules.

Events are flat rows: edge_type, src_key, dst_key, source_file, row_idx, event_seq (unique),
cmdline, evidence, the command flags (absent ones count as false), and src_type (weak rules
read a port from the source's key unless this is PROC).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RULES
from ..functions import scalars as S
from ..functions import text as T

STRINGS = "array<string>"


def tokens() -> Column:
    """Lower-case strings of an event that may equal an indicator, each once, in order: both
    keys, their parts, the texts, and up to ten addresses and paths in the texts."""
    keys = F.filter(F.transform(F.array("src_key", "dst_key"), lambda k: F.lower(F.trim(k))), lambda k: k.isNotNull() & (k != ""))

    def parts(k: Column) -> Column:
        by = [F.when(k.contains(sep), F.split(k, pattern)).otherwise(F.array().cast(STRINGS)) for sep, pattern in (("|", r"\|"), (":", ":"), ("/", "/"), ("\\", r"\\"))]
        return F.concat(*by)

    text = F.concat_ws(" ", F.coalesce("cmdline", F.lit("")), F.coalesce("evidence", F.lit("")))
    every = F.concat(keys, F.flatten(F.transform(keys, parts)), F.array("cmdline", "evidence"), F.slice(T.addresses(text), 1, 10), F.slice(T.paths(text), 1, 10))
    clean = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def annotate_iocs(events: DataFrame, lines: DataFrame, values: DataFrame, most: int = 5) -> DataFrame:
    """Adds is_ioc, is_ioc_line, ioc_types, ioc_values, ioc_type.

    ``lines``: source_file, line, type, value. ``values``: type, value. The row's own line
    counts first, then the next one; values are tried only for events without a line, in
    the order of their tokens, the first ``most`` of them.
    """
    listed = lines.groupBy("source_file", F.col("line").cast("bigint").alias("line")).agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("hits"))
    at = listed.select("source_file", F.col("line").alias("row_idx"), F.col("hits").alias("_at"))
    after = listed.select("source_file", (F.col("line") - 1).alias("row_idx"), F.col("hits").alias("_after"))
    lined = events.join(at, ["source_file", "row_idx"], "left").join(after, ["source_file", "row_idx"], "left").withColumn("_line", F.coalesce("_at", "_after")).drop("_at", "_after")
    known = values.groupBy(F.lower(F.trim("value")).alias("token")).agg(F.array_sort(F.collect_set("type")).alias("types"))
    asked = lined.where("_line IS NULL").select("event_seq", F.posexplode(tokens()).alias("pos", "token"))
    met = asked.join(known, "token").groupBy("event_seq").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "token", "types"))), 1, most).alias("_value"))
    both = lined.join(met, "event_seq", "left")
    line_types, line_values = F.transform("_line", lambda h: h["type"]), F.transform("_line", lambda h: h["value"])
    value_types, value_values = F.flatten(F.transform("_value", lambda h: h["types"])), F.transform("_value", lambda h: h["token"])
    none = F.array().cast(STRINGS)
    types = F.array_sort(F.array_distinct(F.coalesce(line_types, value_types, none)))
    out = both.withColumn("is_ioc_line", F.col("_line").isNotNull()).withColumn("is_ioc", F.col("_line").isNotNull() | F.col("_value").isNotNull())
    out = out.withColumn("ioc_types", types).withColumn("ioc_values", F.slice(F.array_distinct(F.coalesce(line_values, value_values, none)), 1, most))
    return out.withColumn("ioc_type", S.primary_type(F.col("ioc_types"))).drop("_line", "_value")


def rule_columns(rules: dict | None, names: set[str], ioc_log: Column) -> dict[str, Column]:
    """rule_types (in a fixed order) and rule_confidence ('high', 'medium', '')."""
    rules = rules or RULES
    one, policy = rules.get("tier1") or {}, rules.get("rank_policy") or {}
    excluded = set(policy.get("exclude_rule_types") or []) | {e["id"] for e in rules.get("tier2_benign_adjacent_disabled") or [] if e.get("id")}
    text = F.trim(F.concat_ws(" ", F.coalesce("cmdline", F.lit("")), F.coalesce("evidence", F.lit(""))))
    low, file = F.lower(text), F.lower(F.coalesce("source_file", F.lit("")))
    either = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    hits: list[tuple[Column, str, Column]] = []  # condition, rule type, strength (1 or 2)
    two, weak = F.lit(2), F.lit(1)
    ids = either([file.endswith(s.lower()) for s in one.get("suricata_source_suffixes", [])]) | either([low.contains(m.lower()) for m in one.get("suricata_cmdline_markers", [])])
    hits.append((ids, "suricata_alert", two))
    hits.append((F.col("edge_type").isin(one.get("inject_edge_types") or []), "inject_edge", two))
    ports = [int(p) for p in one.get("suspicious_ports") or []]
    # these edges end at a network node but may start at a process, whose key ends in its id, no port
    network = F.coalesce(F.col("src_type") != "PROC", F.lit(True)) if "src_type" in names else F.lit(True)
    suspicious = F.coalesce(S.port_of_key(F.col("dst_key")).isin(ports), F.lit(False)) | (network & F.coalesce(S.port_of_key(F.col("src_key")).isin(ports), F.lit(False)))
    hits.append((F.col("edge_type").isin(one.get("connect_edge_types") or []) & suspicious, "suspicious_port", weak))
    lolbin = one.get("lolbin_flags") or {}
    pair = set(one.get("lolbin_requires_second_flag_for_high") or [])
    flag = {f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) if f in names else F.lit(False) for f in lolbin}
    number = reduce(lambda a, b: a + b, [flag[f].cast("int") for f in lolbin], F.lit(0))
    strong_flags = either([flag[f] for f in lolbin if f not in pair])
    strength = F.when(strong_flags | (number >= 2), two).otherwise(weak)
    for f, rule in lolbin.items():
        # an excluded rule leaves no hit, yet its flag still counts towards the strength
        hits.append((flag[f], rule if rule not in excluded else "", strength))
    for p in rules.get("tier2_cmdline_patterns") or []:
        rule = (p.get("id") or "").strip()
        if rule and p.get("pattern") and rule not in excluded and p.get("rank_eligible", True) is not False:
            hits.append(((text != "") & text.rlike("(?U)" + p["pattern"]), rule, two if (p.get("confidence") or "medium").lower() == "high" else weak))
    types = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(r)) for c, r, _ in hits]), lambda x: x.isNotNull() & (x != "")))
    level = F.greatest(*[F.when(c, s).otherwise(F.lit(0)) for c, _, s in hits])
    active = F.filter(types, lambda x: ~x.isin(sorted(excluded))) if excluded else types
    strong = F.arrays_overlap(active, F.array(*[F.lit(x) for x in policy.get("strong_rule_types_single_hit") or [""]]))
    high = strong | (F.size(active) >= max(1, int(policy.get("min_rule_types_for_high") or 2)))
    if policy.get("require_ioc_log_source_for_high"):
        high = high & ioc_log
    confidence = F.when(F.size(active) == 0, "").when(high & (level >= 2), "high").otherwise("medium")
    return {"rule_types": F.when(F.size(active) == 0, F.array().cast(STRINGS)).otherwise(types), "rule_confidence": confidence}


def annotate_rules(events: DataFrame, ioc_files: list[str], rules: dict | None = None) -> DataFrame:
    """Adds rule_types, rule_confidence, rule_ioc_types, is_rule_hit, is_rule_hit_high and
    rule_ioc_type. ``ioc_files``: logs that carry indicators."""
    known = (rules or RULES).get("rule_type_to_ioc_type") or {}
    ioc_log = F.coalesce(F.col("source_file"), F.lit("")).isin(list(ioc_files) or [""])
    out = events.withColumns(rule_columns(rules, set(events.columns), ioc_log))
    mapped = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    types = F.filter(F.transform("rule_types", lambda r: F.element_at(mapped, r)), lambda x: x.isNotNull() & (x != ""))
    out = out.withColumn("rule_ioc_types", types)
    return out.withColumn("is_rule_hit", F.size("rule_types") > 0).withColumn("is_rule_hit_high", F.col("rule_confidence") == "high").withColumn("rule_ioc_type", S.primary_type(F.col("rule_ioc_types")))


def rule_coverage(events: DataFrame, rule: str | None = None) -> DataFrame:
    """scenario, events, hits, high hits and hits of one rule."""
    own = F.count_if(F.array_contains("rule_types", rule)) if rule else F.lit(0).cast("bigint")
    return events.groupBy("scenario").agg(F.count("*").alias("n_events"), F.count_if("is_rule_hit").alias("n_rule_hit"), F.count_if("is_rule_hit_high").alias("n_rule_high"), own.alias("n_new_rule"))


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Coverage of two rule sets side by side with differences. Events without a scenario have a row too."""
    b = before.select(F.col("scenario").alias("_scenario"), *[F.col(c).alias(f"{c}_before") for c in before.columns if c != "scenario"])
    joined = b.join(after, F.col("_scenario").eqNullSafe(F.col("scenario"))).select("scenario", *b.columns[1:], *[c for c in after.columns if c != "scenario"])
    return joined.withColumn("delta_rule_hit", F.col("n_rule_hit") - F.col("n_rule_hit_before")).withColumn("delta_rule_high", F.col("n_rule_high") - F.col("n_rule_high_before"))
