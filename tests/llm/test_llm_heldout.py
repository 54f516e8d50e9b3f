"""Held-out accuracy of the classifiers on the test tables; the folds are those of the queries."""

import os

import pytest
from pyspark.sql import functions as F

from sparkhece.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def held_out(spark, name, truth, table):
    out = QUERIES[name](spark, SF).where("held_out")
    told = spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", F.col(truth).alias("truth")).where("truth IS NOT NULL")
    return out.join(told, "doc_id")


def test_quality_held_out(spark):
    got = held_out(spark, "op3_quality", "quality", "labels").agg(F.avg((F.col("predicted") == F.col("truth")).cast("int")), F.count("*")).first()
    assert got[0] >= 0.98 and got[1] > 500


def test_toxicity_held_out(spark):
    got = held_out(spark, "op9_toxicity", "toxic", "labels").groupBy("truth").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    rate = {r.truth: r.p for r in got}
    assert rate[1] >= 0.65 and rate[0] <= 0.005


def test_language_held_out(spark):
    got = held_out(spark, "op6_langid", "lang", "documents").agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int"))).first()
    assert got[0] >= 0.97


def test_mixing_domains_held_out(spark):
    """The domains of rows that are not in the labelled quarter."""
    from sparkhece.llm.common import fold

    out = QUERIES["op5_mixing"](spark, SF).where(fold(F.col("doc_id"), 4) != 0)
    told = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")).where("lang IS NOT NULL AND n >= 40")
    got = out.join(told, "doc_id").agg(F.avg((F.col("domain") == F.col("lang")).cast("int")), F.max(F.abs(F.col("target_share") - F.col("reached_share"))), F.min("converged")).first()
    assert got[0] >= 0.95 and got[1] < 0.001 and got[2]
