"""What is kept and refreshed equals what a full run says, and the rest is not touched."""

import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from corrobora import service_queries, shared
from corrobora.plans import evidence, maintain, reconcile

SF = "/root/testdata/sf0.001"

READING = "application_id long, field string, document_id string, logical_id string, ord int, doc_type string, page_role string, value string, source string, status string, raw_value string"


def readings(spark, n):
    rows = []
    for app in range(n):
        names = ["ASHA DEVI", "ASHA DEVI", "ASHA DEVO" if app % 2 else "ASHA DEVI"]
        for i, (kind, name) in enumerate(zip(("aadhaar", "passport", "voter"), names)):
            for field, value in (("holder_name", name), ("dob", f"199{app % 10}-01-02")):
                rows.append((app, field, f"{app}-{i}", f"{app}-{i}", i, kind, "front", value, "vision", "present_verified", None))
    return spark.createDataFrame(rows, READING)


def files(path):
    return {f"{at}/{f}": os.stat(f"{at}/{f}").st_mtime_ns for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_what_changed_is_compared_again(spark, tmp_path):
    where, at, pivot = str(tmp_path / "readings"), str(tmp_path / "clusters"), 26
    registry, rows = evidence.registry(spark), readings(spark, 60)
    maintain.keep(rows, where, 8)
    maintain.keep(reconcile.compare(rows, registry, pivot), at, 8)
    found = spark.read.parquet(at)
    decided = reconcile.decide(found, documents=rows.select("application_id", F.lit("ready").alias("status")))
    latest = maintain.latest(found, decided, F.lit("c1"))
    assert {r["application_id"]: r["verdict"] for r in latest.collect()} == {a: "likely_match_needs_confirmation" if a % 2 else "verified_match" for a in range(60)}
    ask = lambda i, app, field="holder_name", cid="c1", said="same_person": (i, app, cid, field, said)
    asked = spark.createDataFrame([ask(1, 7), ask(2, 7), ask(3, 8), ask(4, 9, cid="c0"), ask(5, 11, "dob"), ask(6, 13, said="other"), ask(7, 21)], "request_id long, application_id long, comparison_id string, field string, decision string")
    maintain.confirmations(asked, latest, found).write.parquet(str(tmp_path / "said"))
    confirmed = spark.read.parquet(str(tmp_path / "said"))
    assert sorted((r["application_id"], sorted(r["values"])) for r in confirmed.collect()) == [(7, ["ASHA DEVI", "ASHA DEVO"]), (21, ["ASHA DEVI", "ASHA DEVO"])]
    changed = confirmed.select("application_id").distinct()
    before, untouched = files(at), maintain.partition_of(F.col("application_id"), 8)
    touched = {r[0] for r in changed.select(untouched).collect()}
    for _ in range(2):  # twice does no harm
        maintain.refresh(where, at, confirmed, changed, registry, pivot, 8)
    after = files(at)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if int(f.split("partition=")[1].split("/")[0]) in touched} and len(touched) < 8
    now, full = spark.read.schema(found.schema).parquet(at).drop("partition"), reconcile.compare(rows, registry, pivot, confirmed)
    assert sorted(map(str, now.collect())) == sorted(map(str, full.select(now.columns).collect()))
    assert {r["application_id"] for r in now.where("confirmed > 0").collect()} == {7, 21}
    verdicts = {r["application_id"]: r["decision"] for r in reconcile.decide(now, documents=rows.select("application_id", F.lit("ready").alias("status"))).collect()}
    assert verdicts[7] == verdicts[21] == "verified_match" and verdicts[9] == "likely_match_needs_confirmation"


def test_the_scan_is_pruned(spark, tmp_path):
    rows = readings(spark, 40)
    maintain.keep(rows, str(tmp_path / "r"), 8)
    changed = spark.createDataFrame([(3,), (4,)], "application_id long")
    scan = maintain.of_changed(maintain.kept(spark, str(tmp_path / "r"), changed, 8), changed)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*partition#", plan) and re.search(r"PushedFilters: \[.*In\(application_id, \[3,4\]\)", plan), plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {r["application_id"] for r in scan.collect()} == {3, 4}
    scanned = lambda df: sum(len(p.files()) for p in df._jdf.queryExecution().executedPlan().collectLeaves().head().inputRDDs().head().partitions())
    assert scanned(maintain.kept(spark, str(tmp_path / "r"), changed, 8)) <= 2
    none = changed.limit(0)
    assert maintain.of_changed(maintain.kept(spark, str(tmp_path / "r"), none, 8), none).collect() == []
    before = files(tmp_path / "r")
    maintain.refresh(str(tmp_path / "r"), str(tmp_path / "r"), none, none, evidence.registry(spark), 26, 8)
    assert files(tmp_path / "r") == before


@pytest.mark.parametrize("name", ["recompared_decisions", "recompared_clusters"])
def test_only_lines_are_dealt(spark, monkeypatch, name):
    """lines meet their part and their application; readings, clusters and confirmations stay where they lie."""
    wrote, dealt = [], lambda df: set(re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString()))
    for how in ("saveAsTable", "insertInto", "parquet"):
        monkeypatch.setattr(DataFrameWriter, how, lambda self, *a, plain=getattr(DataFrameWriter, how), **k: wrote.append(dealt(self._df)) or plain(self, *a, **k))
    monkeypatch.setattr(shared, "PARTITION_ROWS", 1_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = dealt(getattr(service_queries, name)(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = {"l_partkey", "p_partkey", "l_orderkey", "o_orderkey"}
    assert len(wrote) == 4 and "l_orderkey" in wrote[0] and all(w <= lines for w in [*wrote, last]), (wrote, last)
    assert not wrote[1] and not wrote[3]


def test_buckets_grow_with_the_rows():
    for parts in (1, 8, 64, 65, 360, 2_160):
        partitions, buckets = maintain.layout(parts)
        assert partitions <= maintain.PARTITIONS and buckets % partitions == 0 and parts <= buckets < parts + partitions


def test_a_bucket_is_in_one_partition(spark, tmp_path):
    at = str(tmp_path / "it's")
    maintain.keep(readings(spark, 60), at, 4, 12)
    assert len(files(at)) <= 12
    once = sorted(map(str, maintain.table(spark, at).collect()))
    spark.sql(f"DROP TABLE {maintain._name(at)}")
    maintain.attach(spark, at, 12)
    assert sorted(map(str, maintain.table(spark, at).collect())) == once and len(once) == 360
    assert "Exchange hash" not in maintain.table(spark, at).groupBy("application_id").count()._jdf.queryExecution().executedPlan().toString()
