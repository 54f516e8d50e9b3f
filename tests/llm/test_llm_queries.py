"""The queries and the pipeline on the smallest tables: held-out accuracy, SQL twins, stages."""

import os

import pytest

import __spark_entry__ as entry

pytest.importorskip("sparkhece.llm")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op10_decontamination"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    show = lambda f: sorted(map(str, f[sorted(f.columns)].astype(str).values.tolist()))
    assert show(entry.queries()[name](spark, SF).toPandas()) == show(c.execute(entry.oracle_sql()[name]).fetchdf())


def test_held_out_accuracy(spark):
    q = entry.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lang = q["op6_langid"](spark, SF).where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id")
    assert lang.where("lang = lang_pred").count() / lang.count() > 0.9
    good = q["op3_quality"](spark, SF).where("held_out").join(labels, "doc_id")
    assert good.where("quality = predicted").count() / good.count() > 0.8


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, cur, n = docs.columns, docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = corpus_pipeline.materialize(stage(spark, cur, SF), name)
        assert cur.columns == columns and 0 < cur.count() <= n
        n = cur.count()
    last = corpus_pipeline.STAGES[-1][1](spark, cur, SF)
    assert last.count() == n and "rate" in last.columns
    assert len(corpus_pipeline.STAGES) == 5
