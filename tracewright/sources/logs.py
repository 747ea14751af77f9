"""Logs to events: host and network logs as flat typed edges.

Every raw field is read as text and normalised here. A parser takes rows with ``row_idx``
(0-based number of the data row) and gives zero or more events for each, as columns of
``EVENT_COLUMNS`` and whatever attributes the log has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import COMMAND_FLAGS
from ..functions import scalars as S
from ..functions import text as X

EVENT_COLUMNS = ("scenario", "log", "source_file", "row_idx", "part", "edge_type", "src_type", "src_key", "dst_type", "dst_key", "ts", "ord")

#: Columns that the parsers read, by log.
COLUMNS = {
    "azure_conn": ["TimeGenerated [UTC]", "TimeGenerated", "Computer", "Machine", "Process", "ProcessName", "SourceIp", "DestinationIp", "DestinationPort", "BytesSent", "BytesReceived", "Direction", "Protocol"],
    "azure_process": ["TimeGenerated [UTC]", "TimeGenerated", "Computer", "Machine", "Process", "ExecutableName", "DisplayName", "ProcessName", "CommandLine"],
    "azure_events": ["TimeGenerated [UTC]", "TimeGenerated", "Computer", "EventData", "RenderedDescription", "Message"],
    "azure_syslog": ["TimeGenerated [UTC]", "EventTime [UTC]", "Computer", "HostName", "HostIP", "ProcessName", "SyslogMessage"],
    "zeek_conn": ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "orig_bytes", "resp_bytes", "proto", "service", "duration", "uid"],
    "zeek_dns": ["ts", "id.orig_h", "query", "answers", "uid"],
    "zeek_http": ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "host", "status_code", "request_body_len", "response_body_len", "method", "uri", "uid"],
    "zeek_files": ["ts", "id.orig_h", "filename", "mime_type", "sha256", "md5", "total_bytes", "fuid", "uid"],
    "zeek_ssl": ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "server_name", "version", "cipher", "validation_status", "uid"],
}

EVE_SCHEMA = (
    "event_type string, timestamp string, src_ip string, dest_ip string, dest_port string, flow_id string, "
    "http struct<status:string,length:string,http_method:string,url:string,http_user_agent:string>, "
    "fileinfo struct<filename:string,size:string>, alert struct<signature:string>"
)


def column(df: DataFrame, *names: str) -> Column:
    """The first of the columns that isn't blank; null where the log has none of them."""
    have = [S.blank_to_null(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def text(df: DataFrame, *names: str) -> Column:
    return F.coalesce(column(df, *names), F.lit(""))


def event(df: DataFrame, log: str, edge: str, src: Column, dst: Column, ts: Column, src_type: str = "PROC", dst_type: str = "NET", part: int = 0, **attrs: Column) -> DataFrame:
    """Rows of ``df`` (scenario, source_file, row_idx) as events with attributes."""
    return df.select(
        "scenario", F.lit(log).alias("log"), "source_file", "row_idx", F.lit(part).alias("part"), F.lit(edge).alias("edge_type"),
        F.lit(src_type).alias("src_type"), src.alias("src_key"), F.lit(dst_type).alias("dst_type"), dst.alias("dst_key"),
        ts.alias("ts"), F.col("row_idx").alias("ord"), *[c.alias(k) for k, c in attrs.items()],
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def azure_conn(df: DataFrame) -> DataFrame:
    prefix = S.host_prefix(F.col("scenario"), column(df, "Computer", "Machine"), column(df, "SourceIp"))
    port = S.safe_long(column(df, "DestinationPort"))
    return event(
        df, "azure_conn", "CONNECT", S.proc_key(prefix, column(df, "Process"), column(df, "ProcessName")), S.net_key(column(df, "DestinationIp"), port), S.unix_seconds(column(df, "TimeGenerated [UTC]", "TimeGenerated")),
        bytes_sent=S.safe_long(column(df, "BytesSent")), bytes_recv=S.safe_long(column(df, "BytesReceived")), direction=F.lower(text(df, "Direction")), protocol=F.lower(text(df, "Protocol")), dst_port=port,
    )


def azure_process(df: DataFrame) -> DataFrame:
    prefix = S.host_prefix(F.col("scenario"), column(df, "Computer", "Machine"))
    command = text(df, "CommandLine")
    child = S.proc_key(prefix, column(df, "Process"), column(df, "ExecutableName", "DisplayName", "ProcessName"))
    return event(df, "azure_process", "EXEC", F.concat(prefix, F.lit("::proc::HOST")), child, S.unix_seconds(column(df, "TimeGenerated [UTC]", "TimeGenerated")), dst_type="PROC", cmdline=command, **X.command_flags(command), **X.signals(command))


def azure_syslog(df: DataFrame) -> DataFrame:
    prefix = S.host_prefix(F.col("scenario"), column(df, "Computer", "HostName"), column(df, "HostIP"))
    message = text(df, "SyslogMessage")
    return event(df, "azure_syslog", "EXEC", F.concat(prefix, F.lit("::proc::HOST")), S.proc_key(prefix, None, column(df, "ProcessName")), S.unix_seconds(column(df, "TimeGenerated [UTC]", "EventTime [UTC]")), dst_type="PROC", cmdline=message, **X.command_flags(message), **X.signals(message))


def azure_events(df: DataFrame) -> DataFrame:
    """EXEC and WRITE of the image, CONNECT to the destination, and for up to five addresses
    and five paths of the message a CONNECT or WRITE; one row explodes into its events."""
    f = df.select(
        "scenario", "source_file", "row_idx", S.unix_seconds(column(df, "TimeGenerated [UTC]", "TimeGenerated")).alias("ts"),
        S.host_prefix(F.col("scenario"), column(df, "Computer")).alias("prefix"), S.event_data(text(df, "EventData")).alias("m"), text(df, "RenderedDescription", "Message").alias("msg"),
    )
    field = lambda *names: F.coalesce(*[S.blank_to_null(F.try_element_at("m", F.lit(n))) for n in names])
    # a generator is evaluated once for a row; columns would be for each use of the map
    f = f.select("scenario", "source_file", "row_idx", "ts", "prefix", F.explode(F.array("m")).alias("m"), "msg")
    f = f.select(
        *[c for c in f.columns if c != "m"], field("Image", "TargetImage").alias("img"), field("ParentImage").alias("pimg"), field("ProcessId", "ProcessID").alias("pid"), field("ParentProcessId", "ParentProcessID").alias("ppid"),
        F.coalesce(field("CommandLine", "Commandline"), F.lit("")).alias("cmd"), field("DestinationIp").alias("dip"), field("DestinationPort", "DestinationPortName").alias("dport"), field("DestinationHostname").alias("dhost"),
        F.when(F.lower(field("Initiated")) == "true", "outbound").otherwise("unknown").alias("dir"), F.lower(F.coalesce(field("Protocol", "DestinationPortName"), F.lit(""))).alias("proto_"),
    )
    either = F.when(F.col("cmd") != "", F.col("cmd")).otherwise(F.col("msg"))
    f = f.select("*", F.substring(either, 1, 500).alias("shown"), F.substring("msg", 1, 500).alias("message"), F.concat(F.col("prefix"), F.lit("::proc::HOST")).alias("host_proc"), X.addresses(F.col("msg")).alias("ips"), X.paths(F.col("msg")).alias("paths"))
    f = f.withColumn("child", F.when(F.col("img").isNotNull(), S.proc_key(F.col("prefix"), F.col("pid"), F.col("img"))))
    f = f.withColumn("actor", F.coalesce("child", "host_proc"))
    parent = F.when(F.col("pimg").isNotNull() & (F.lower("pimg") != F.lower("img")), S.proc_key(F.col("prefix"), F.col("ppid"), F.col("pimg"))).otherwise(F.col("host_proc"))
    none = F.lit(None)

    def made(edge, src, dst, dst_type, cmdline=none, evidence=none, size=none, sent=none, direction=none, protocol=none):
        return F.struct(
            F.lit(edge).alias("edge_type"), src.alias("src_key"), dst.alias("dst_key"), F.lit(dst_type).alias("dst_type"), cmdline.cast("string").alias("cmdline"), evidence.cast("string").alias("evidence"),
            size.cast("bigint").alias("bytes"), sent.cast("bigint").alias("bytes_sent"), sent.cast("bigint").alias("bytes_recv"), direction.cast("string").alias("direction"), protocol.cast("string").alias("protocol"),
        )

    zero, actor = F.lit(0), F.col("actor")
    image = F.col("img").isNotNull()
    one = F.array(
        F.when(image, made("EXEC", parent, F.col("child"), "PROC", cmdline=F.when(F.col("cmd") != "", F.col("cmd")).otherwise(F.col("shown")))),
        F.when(image, made("WRITE", F.col("child"), S.file_key(F.col("img")), "FILE", evidence=F.col("shown"), size=zero)),
        F.when(F.col("dip").isNotNull(), made("CONNECT", actor, S.net_key(F.col("dip"), F.col("dport"), F.col("dhost")), "NET", evidence=F.col("shown"), sent=zero, direction=F.col("dir"), protocol=F.col("proto_"))),
    )
    found = F.concat(
        F.filter(one, lambda e: e.isNotNull()),
        F.transform(F.slice("ips", 1, 5), lambda ip: made("CONNECT", actor, ip, "NET", evidence=F.col("message"), sent=zero, direction=F.lit("unknown"))),
        F.transform(F.slice("paths", 1, 5), lambda p: made("WRITE", actor, p, "FILE", evidence=F.col("message"), size=zero)),
    )
    words = F.trim(F.concat_ws(" ", "cmd", "msg"))
    rows = f.select("*", *[c.alias(k) for k, c in {**X.command_flags(either), **X.signals(words)}.items()], found.alias("_made"))
    rows = rows.select("*", F.posexplode("_made").alias("part", "e"))
    more = [*COMMAND_FLAGS, *X.signals(words)]
    return rows.select("scenario", F.lit("azure_events").alias("log"), "source_file", "row_idx", "part", "e.edge_type", F.lit("PROC").alias("src_type"), "e.src_key", "e.dst_type", "e.dst_key", "ts", F.col("row_idx").alias("ord"), "e.cmdline", "e.evidence", "e.bytes", "e.bytes_sent", "e.bytes_recv", "e.direction", "e.protocol", *more)


def _zeek(df: DataFrame) -> tuple[Column, Column, Column]:
    return S.host_proc(F.col("scenario"), ip=column(df, "id.orig_h")), S.unix_seconds(column(df, "ts")), S.safe_long(column(df, "id.resp_p"))


def zeek_conn(df: DataFrame) -> DataFrame:
    src, ts, port = _zeek(df)
    return event(
        df, "zeek_conn", "CONNECT", src, S.net_key(column(df, "id.resp_h"), port), ts, bytes_sent=S.safe_long(column(df, "orig_bytes")), bytes_recv=S.safe_long(column(df, "resp_bytes")),
        direction=F.lit("out"), proto=text(df, "proto"), service=text(df, "service"), duration=S.safe_double(column(df, "duration")), dst_port=port, uid=column(df, "uid"),
    )


def zeek_dns(df: DataFrame) -> DataFrame:
    src, ts, _ = _zeek(df)
    name = S.net_key(None, domain=column(df, "query"))
    asked = event(df, "zeek_dns", "DNS_QUERY", src, name, ts, query_domain=text(df, "query"), uid=column(df, "uid"))
    rows = df.select("*", F.posexplode(S.csv_list(column(df, "answers"))).alias("_at", "_answer"))
    given = event(rows, "zeek_dns", "RESOLVE", name, S.net_key(F.col("_answer")), ts, src_type="NET", resolved_ip=F.col("_answer"), uid=column(df, "uid"), answer_no=F.col("_at") + 1)
    return union(asked, given.withColumn("part", F.col("answer_no")).drop("answer_no"))


def zeek_http(df: DataFrame) -> DataFrame:
    src, ts, port = _zeek(df)
    dst, status = S.net_key(column(df, "id.resp_h"), port, column(df, "host")), S.safe_long(column(df, "status_code"))
    sent = event(
        df, "zeek_http", "CONNECT", src, dst, ts, bytes_sent=S.safe_long(column(df, "request_body_len")), bytes_recv=S.safe_long(column(df, "response_body_len")), direction=F.lit("out"),
        method=text(df, "method"), uri=text(df, "uri"), status_code=status, dst_port=port, uid=column(df, "uid"),
    )
    moved = event(df.where((status >= 300) & (status < 400)), "zeek_http", "REDIRECT", dst, dst, ts, src_type="NET", part=1, http_status=status, uid=column(df, "uid"))
    return union(sent, moved)


def zeek_files(df: DataFrame) -> DataFrame:
    src, ts, _ = _zeek(df)
    unnamed = F.concat_ws("::", "scenario", F.lit("file"), F.coalesce(column(df, "fuid"), F.lit("UNKNOWN")))
    return event(
        df, "zeek_files", "WRITE", src, F.coalesce(column(df, "filename"), unnamed), ts, dst_type="FILE", bytes=S.safe_long(column(df, "total_bytes")), mime_type=text(df, "mime_type"),
        sha256=F.lower(text(df, "sha256")), md5=F.lower(text(df, "md5")), file_type=text(df, "mime_type"), uid=column(df, "uid"), fuid=column(df, "fuid"),
    )


def zeek_ssl(df: DataFrame) -> DataFrame:
    src, ts, port = _zeek(df)
    return event(
        df, "zeek_ssl", "CONNECT", src, S.net_key(column(df, "id.resp_h"), port, column(df, "server_name")), ts, bytes_sent=F.lit(0).cast("bigint"), bytes_recv=F.lit(0).cast("bigint"), direction=F.lit("out"),
        tls_version=text(df, "version"), tls_cipher=text(df, "cipher"), sni=text(df, "server_name"), validation_status=text(df, "validation_status"), dst_port=port, uid=column(df, "uid"),
    )


def eve(df: DataFrame) -> DataFrame:
    """Parsed lines of an IDS log: http, fileinfo and alert records; others give no event."""
    c = F.col
    src = S.host_proc(c("scenario"), ip=c("src_ip"))
    port = S.safe_long(c("dest_port"))
    dst, ts, flow = S.net_key(c("dest_ip"), port), S.unix_seconds(c("timestamp")), c("flow_id")
    status = S.safe_long(c("http.status"))
    empty = lambda name: F.coalesce(c(name), F.lit(""))
    http = df.where("event_type = 'http'")
    asked = event(
        http, "eve", "CONNECT", src, dst, ts, bytes_sent=F.lit(0).cast("bigint"), bytes_recv=S.safe_long(c("http.length")), direction=F.lit("out"), method=empty("http.http_method"), uri=empty("http.url"),
        status_code=status, user_agent=empty("http.http_user_agent"), dst_port=port, flow_id=flow,
    )
    moved = event(http.where((status >= 300) & (status < 400)), "eve", "REDIRECT", dst, dst, ts, src_type="NET", part=1, http_status=status, flow_id=flow)
    files = event(df.where("event_type = 'fileinfo'"), "eve", "WRITE", src, S.file_key(c("fileinfo.filename")), ts, dst_type="FILE", bytes=S.safe_long(c("fileinfo.size")), flow_id=flow)
    told = event(df.where("event_type = 'alert'"), "eve", "EXEC", src, F.concat(c("scenario"), F.lit("::proc::ALERT")), ts, dst_type="PROC", cmdline=empty("alert.signature"), flow_id=flow)
    return union(asked, moved, files, told)


PARSERS = {"azure_conn": azure_conn, "azure_process": azure_process, "azure_events": azure_events, "azure_syslog": azure_syslog, "zeek_conn": zeek_conn, "zeek_dns": zeek_dns, "zeek_http": zeek_http, "zeek_files": zeek_files, "zeek_ssl": zeek_ssl, "eve": eve}


def numbered(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``row_idx``: 0-based, dense, in the order of each file's rows.

    A file's block starts order its partitions; partition sizes are counted first, so no
    task sorts a whole file."""
    keyed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    within = Window.partitionBy("_file", "_p").orderBy("_m")
    counted = keyed.groupBy("_file", "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    start = counted.select("_file", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    out = keyed.withColumn("_n", F.row_number().over(within)).join(start, ["_file", "_p"])  # a row for each part of a file: not broadcast
    out = out.withColumn("row_idx", (F.col("_start") + F.col("_n") - 1).cast("bigint")).drop("_file", "_p", "_m", "_c", "_n", "_start")
    return out if limit is None else out.where(F.col("row_idx") < limit)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system of the path has it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_log(spark: SparkSession, path: str, log: str, scenario: str, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """Raw rows of a log, all fields text, with scenario, source_file and row_idx.

    A Parquet file beside a CSV file is preferred. With ``multi_line`` fields may hold line breaks
    and one task reads a CSV file; without, files are split. IDS lines that are blank or no JSON are
    skipped before rows are numbered."""
    name = path.rsplit("/", 1)[-1]
    if log == "eve":
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.from_json("value", EVE_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"), F.try_parse_json("value").alias("v"), F.col("_metadata"))
        rows = numbered(rows.where(F.col("v").isNotNull()), limit).select("j.*", "row_idx")
    else:
        twin = path.rsplit(".", 1)[0] + ".parquet"
        if not path.endswith(".parquet") and exists(spark, twin):
            path = twin
        if path.endswith(".parquet"):
            raw = spark.read.parquet(path)
        else:
            raw = spark.read.option("header", "true").option("multiLine", multi_line).option("escape", '"').csv(path)
        have = [c for c in raw.columns if c in COLUMNS[log]]
        rows = numbered(raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in have], "_metadata"), limit).drop("_metadata")
    return rows.withColumn("scenario", F.lit(scenario)).withColumn("source_file", F.lit(name))


def with_sequence(events: DataFrame, logs: list[str]) -> DataFrame:
    """Adds ``event_seq``, unique and ordered by log (as configured), row (up to 2^34) and part (up
    to 2^20, as many answers as a DNS row may have)."""
    place = F.coalesce(*[F.when(F.col("log") == log, F.lit(i)) for i, log in enumerate(logs)], F.lit(len(logs)))
    return events.withColumn("event_seq", F.shiftleft(place.cast("bigint"), 54) + F.shiftleft(F.col("row_idx"), 20) + F.col("part"))


def load_scenario(spark: SparkSession, root: str, catalog: dict, scenario: str, family: str = "full", only_ioc_logs: bool = True, limit: int | None = None) -> DataFrame | None:
    """Events of all configured logs of a scenario that exist, or None without any."""
    from ..operators.telemetry import logs_to_read

    logs = logs_to_read(catalog, scenario, family, only_ioc_logs)
    parts = []
    for log, spec in logs.items():
        path = f"{root}/{scenario}/{spec['filename']}"
        if exists(spark, path) or exists(spark, path.rsplit(".", 1)[0] + ".parquet"):
            kind = spec.get("log_type", log)
            parts.append(PARSERS[kind](read_log(spark, path, kind, scenario, limit)))
    return with_sequence(union(*parts), [s.get("log_type", k) for k, s in logs.items()]) if parts else None


def missing_logs(spark: SparkSession, root: str, catalog: dict) -> list[tuple[str, str]]:
    """(scenario, file) of configured logs that aren't there."""
    paths = [(sc, spec["filename"]) for sc, logs in catalog.items() for spec in logs.values()]
    return [(sc, f) for sc, f in paths if not exists(spark, f"{root}/{sc}/{f}") and not exists(spark, f"{root}/{sc}/{f}".rsplit(".", 1)[0] + ".parquet")]


def load_annotated(spark: SparkSession, root: str, catalog: dict, scenario: str, truth: str | None = None, rules: dict | None = None, **how) -> DataFrame | None:
    """Events of a scenario with indicator labels (from a ground-truth file, if given) and
    weak-rule labels."""
    from ..operators.annotate import annotate_iocs, annotate_rules
    from ..operators.telemetry import ioc_files
    from .side import ground_truth

    events = load_scenario(spark, root, catalog, scenario, **how)
    if events is None:
        return None
    for c in ("cmdline", "evidence"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    if truth:
        lines, values = (t.where(F.col("scenario") == scenario).drop("scenario") for t in ground_truth(spark, truth))
        events = annotate_iocs(events, lines, values)
    files = [f.rsplit("/", 1)[-1] for f in ioc_files(catalog, [scenario])]
    return annotate_rules(events, files, rules)
