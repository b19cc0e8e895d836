"""Reads by owner: one bucket, no exchange, nothing of anyone else; corrected types and refused fields."""

import pytest
from pyspark.sql import functions as F

from corrobora.operators.owned import Owned
from corrobora.plans import evidence, extraction, intake


@pytest.fixture(scope="module")
def tables(spark):
    apps = spark.range(400).select((F.col("id") % 37).alias("owner"), F.col("id").alias("application"), F.timestamp_seconds(F.col("id") % 5).alias("at"))
    docs = spark.range(1_200).select((F.col("id") % 400 % 37).alias("owner"), (F.col("id") % 400).alias("application"), F.col("id").alias("document"))
    out = Owned.store(apps, "owner", "t_apps", 8), Owned.store(docs, "owner", "t_docs", 8)
    yield out
    for x in out:
        x.drop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_owners_meet_without_an_exchange(spark, tables):
    apps, docs = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = apps.beside(docs, "application")
        per = joined.groupBy("owner").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(per) and "Exchange" not in plan(apps.per_owner(F.count("*").alias("n")))
        assert joined.count() == 1_200 and {r["n"] for r in per.collect()} <= {30, 33}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_bucket_is_read(tables):
    apps, _ = tables
    scanned = lambda df: sum(len(p.files()) for p in df._jdf.queryExecution().executedPlan().collectLeaves().head().inputRDDs().head().partitions())
    assert scanned(apps.of(5)) == 1 and scanned(apps.spark.table(apps.name)) == 8
    assert {r["application"] for r in apps.of(5).collect()} == {i for i in range(400) if i % 37 == 5}
    assert [r["application"] for r in apps.newest(36, "at", "application").collect()] == sorted((i for i in range(400) if i % 37 == 36), key=lambda i: (-(i % 5), i))
    assert apps.of(5, F.col("application") > 100).count() == 8 and apps.of(99).collect() == []


def test_no_row_without_its_owner(spark, tables):
    apps, docs = tables
    asked = spark.createDataFrame([(5, 5), (5, 42), (6, 5), (None, 5), (5, 5)], "owner long, application long")
    assert sorted(r["application"] for r in apps.named(asked, "application").collect()) == [5, 42]
    with pytest.raises(ValueError):
        apps.of(None)
    with pytest.raises(ValueError):
        apps.beside(Owned(spark, docs.name, "other"))
    with pytest.raises(Exception, match="has no owner"):
        Owned.store(spark.createDataFrame([(None, 1)], "owner long, x int"), "owner", "t_bad", 2)


def test_a_corrected_type_outranks_the_one_read(spark):
    docs = spark.createDataFrame([("a", "pan", 1), ("b", "pan", 2), ("c", None, 3), ("d", "voter", 4)], "document_id string, doc_type string, x int")
    said = spark.createDataFrame([("a", "document_type", "passport", 1), ("a", "document_type", "voter", 0), ("b", "document_type", " ", 1), ("c", "document_type", "aadhaar", 1), ("d", "gender", "F", 1), ("z", "document_type", "pan", 1)], "document_id string, field string, value string, at int")
    got = {r["document_id"]: (r["doc_type"], r["type_source"], r["x"]) for r in intake.typed(docs, said).collect()}
    assert got == {"a": ("passport", "holder", 1), "b": ("pan", "reading", 2), "c": ("aadhaar", "holder", 3), "d": ("voter", "reading", 4)}
    assert {r["doc_type"] for r in intake.typed(docs, said.drop("at").limit(0)).collect()} == {"pan", None, "voter"}


def test_refusals_are_listed(spark):
    none = None
    rows = [(1, "pan", "front", "gender", "F", none, none, none, "vision"), (1, "pan", "front", "father_name", "RAM", none, "nothing to see on this page but a name and some more words", none, "vision"), (1, "pan", "front", "holder_name", "ASHA DEVI", "Name: ASHA DEVI", none, none, "vision"), (1, "pan", "front", "dob", none, none, none, none, "vision"), (2, "voter", "front", "dob", none, none, none, none, "vision")]
    df = spark.createDataFrame(rows, "doc int, doc_type string, page_role string, field string, value string, evidence string, page_text string, mrz string, source string")
    got = {r["doc"]: r for r in extraction.refusals(extraction.gate(df, evidence.registry(spark), 26), "doc").collect()}
    assert [tuple(x) for x in got[1]["rejected"]] == [("gender", "F", "field_impossible_for_document", "pan", "front")]
    assert [(x["field"], x["value"]) for x in got[1]["unsupported"]] == [("father_name", "RAM")] and got[2]["rejected"] == got[2]["unsupported"] == []
