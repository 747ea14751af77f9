"""The corpus pipeline on the smallest tables: stages, rows, columns."""

import os

import pytest

import corpus_pipeline
from tracewright.llm import language, neardup, secrets, toxicity

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "neardup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.schema == docs.schema
        rows = {r.doc_id: r.text for r in after.collect()}
        assert set(rows) <= set(before)
        if name == "language":
            found = {r.doc_id for r in language.identify(docs).where("lang_pred <> 'und' AND score >= 0.5").collect()}
            assert set(rows) == found
        elif name == "toxicity":
            found = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()
            assert set(rows) == {r.doc_id for r in found}
        elif name == "neardup":
            assert set(rows) == {r.class_id for r in neardup.classes(docs).collect()}
        else:
            assert set(rows) == set(before) and not any(secrets.base_spans(t) for t in rows.values() if t)
        docs = spark.createDataFrame(after.collect(), after.schema)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    english = ["the house is by the water and the trees are green", "a long road leads over the hills to the old town", "she reads a book under the tree near the river"]
    german = ["das haus liegt am wasser und die wiese ist gruen", "der alte mann geht durch den wald nach hause", "sie liest ein buch unter dem baum am fluss"]
    rows = [(i, t, "en" if i % 2 == 0 else "de", None, len(t)) for i, t in enumerate(x for pair in zip(english * 8, german * 8) for x in pair)]
    odd = [(None, english[0] + " once more", "en", "s", None), (100, None, None, None, None), (101, "", None, None, 0), (102, "123 !!!", None, None, 7), (103, english[1] + " token='abcdefgh'", "en", None, 3), (103, english[1] + " token='abcdefgh'", "en", None, 3), (104, english[2] + " and so on " * 20_000, None, None, None)]
    sf = tables(spark, tmp_path, rows + odd, [(0, 1, 0), (1, 1, 0), (None, 0, 1), (2, None, None), (100, 0, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.schema == docs.schema
        docs = spark.createDataFrame(after.collect(), after.schema)
        counts.append(docs.count())
    # texts without letters go; every text stays once; secrets go
    texts = sorted(r.text for r in docs.collect())
    assert counts[0] == len(rows) + 4 and len(texts) == len(set(texts)) == counts[-1] and any(t.endswith("[secret]'") for t in texts)
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()} and sum(p.start == 0 for p in pieces) == len(texts)


def test_empty_tables_through_all_stages(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_extra_columns_stay(spark, tmp_path):
    sf = tables(spark, tmp_path, [(i, f"the {w} is by the water", "en", None, 1) for i, w in enumerate(["house", "tree", "road", "house"])], [(0, 1, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id AS key", "'x' AS score", "1 AS held_out", "text AS row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.schema == docs.schema and after.where("score = 'x' AND key = doc_id").count() == after.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2]
