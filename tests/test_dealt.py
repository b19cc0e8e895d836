"""Documents are dealt by application once, in partitions of a bounded size, however the joins before and after are done."""

import re

from pyspark.sql import functions as F

from corrobora import queries, shared
from corrobora.sources import page_text

SF = "/root/testdata/sf0.001"


def test_documents_lie_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTITION_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    docs = queries.documents(spark, SF)
    assert docs.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-lines // 500)) > 4


def test_readings_are_not_dealt_again(spark):
    """field_clusters, which decisions and verdicts share."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.clusters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(l_orderkey" in plan
    assert not re.search(r"Exchange hashpartitioning\(application_id", plan)


def test_each_row_of_a_part_counts(spark, tmp_path):
    """A part's key that comes twice makes two readings of one document, of the same place."""
    for name in ("lineitem", "orders", "part"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.unionByName(rows.where("p_partkey % 3 = 0")) if name == "part" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = queries.documents(spark, str(tmp_path)).where("doc_status = 'ready'")
    want = docs.join(spark.read.parquet(str(tmp_path / "part.parquet")).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").count()
    got = queries.cluster_readings(spark, str(tmp_path)).where("field = 'dob'")
    assert got.count() == want and got.select("document_id").distinct().count() < want


def test_pages_are_cut_into_lines_once(spark):
    """page_fields and page_text_fields: rows are dealt over all cores, and a page is not cut anew for each label."""
    for name in ("page_fields", "page_text_fields"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution()
        assert f"{4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan.executedPlan().toString()
        labelled = max(plan.optimizedPlan().toString().split("\n"), key=lambda x: x.count("zip_with"))
        assert labelled.count("zip_with") <= 2 and labelled.count("split(") <= 10, (name, labelled.count("zip_with"), labelled.count("split("))


def test_zones_of_any_case(spark):
    """Lines that become a zone in capitals, and such that another character keeps from being one."""
    one, two = "P<INDdevi<<asha".ljust(44, "<"), "K1234567<8IND9001011F3001012".ljust(44, "<")
    short = "ﬃ" * 14
    rows = [(0, f"{one}\n{two}"), (1, f"{one}.\n{two}"), (2, f"x\n{short}\n «{two} "), (3, None)]
    got = spark.createDataFrame(rows, "id int, text string").select("id", page_text.mrz(F.col("text"), 26).alias("m")).collect()
    found = {r["id"]: r["m"] and (r["m"]["surname"], r["m"]["given"]) for r in got}
    assert found[0] == ("DEVI", "ASHA") and found[1] is None and found[2] is not None and found[3] is None
