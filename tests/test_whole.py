"""Queries over all of their input, where an equivalent in SQL covers a part only."""

import os
import re

import pytest

from tracewright import constants as K
from tracewright.operators import graph
from tracewright.plans import adapters, catalog

SF = "/root/testdata/sf0.001"
TEXTS = ["at 10.0.0.1 and 10.0.0.1, 10.0.0.2", "dépôt à 10.1.2.3 près de 10.1.2.4", "é10.0.0.1 10.0.0.2ü 10.0.0.3", "größe: 255.255.255.255\n«1.2.3.4»", "256.1.1.1 ñ", None, "", "nada más"]


def test_addresses_of_all_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.n_ips for r in catalog.QUERIES["address_extract"](spark, str(tmp_path)).collect()}
    assert found == {i: len(set(re.findall(K.IP, t or ""))) for i, t in enumerate(TEXTS)}
    assert found[1] == 2 and found[2] == 1 and found[5] == 0


def test_causal_links_of_busy_processes(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    found = catalog.QUERIES["causal_level0"](spark, SF)
    assert found.count() == graph.causal_edges(adapters.canon(spark, SF), "level0", 5000.0, 10**9).count()
    assert found.groupBy("scenario", "src_key").count().where("count > 3").count() > 0
    few = graph.causal_edges(adapters.canon(spark, SF), "level0", 5000.0, 3)
    assert few.groupBy("scenario", "src_key").count().where("count > 3").count() == 0


def test_all_modes_are_there(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    modes = {r["mode"] for r in catalog.QUERIES["recon_all_modes"](spark, SF).select("mode").distinct().collect()}
    by_k = {f"by_k{m}" for m in ("", "_pair_dedupe", "_ioc_log_sources", "_source_quota", "_group_cap", "_group_cap_adaptive", "_ioc_pool_upper_bound", "_pred_stage")}
    assert modes == by_k | {"by_alert_rule", "by_alert_pred_stage"}
