"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import decontam, neardup, packing, secretscan, toxicity
from corrobora.llm._shared import discard, intermediates, materialize, remainder, small, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score of 0.5 or more).

    Null and empty texts have the bias's score alone and stay. Rows are judged one by one, so repeated rows go or stay
    together. Columns of any name are carried along. Empty input: no rows.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return docs.where(toxicity.toxicity_of(model, F.col("text")) < 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (five words, 0.8): one with the smallest doc_id.

    Rows without an id or without words (null and empty texts) all stay. Of rows repeated with one id and text, one
    stays; rows of one id with different texts are documents of their own. Ties go to the smaller hash of the text.
    Columns of any name are carried along. Empty input: no rows.
    """
    grouped = neardup.grouped(docs, size=5, percent=80, exact=True).where("`group` IS NOT NULL AND doc_id IS NOT NULL")
    rows = materialize(grouped.groupBy("group", "component_id", "doc_id", "look").agg(F.count("*").alias("n")), "groups")
    best = rows.where("doc_id = component_id").groupBy("group").agg(F.min("look").alias("best"))
    odd = rows.where("doc_id <> component_id OR n > 1").select("doc_id", "look").unionByName(rows.where("doc_id = component_id").join(best, "group").where("look <> best").select("doc_id", "look")).distinct()
    once = rows.where("doc_id = component_id AND n > 1").join(best, "group").where("look = best").select("doc_id", "look")
    odd, once = (small(materialize(x, "keys"), neardup.BROADCAST_ROWS) for x in (odd, once))
    discard(rows)
    # Texts stay where they are, as long as the keys can be broadcast.
    key = [F.col("doc_id").cast("long").alias("__id"), F.expr(neardup.LOOK).alias("__look")]
    same = [F.col("__id") == F.col("doc_id"), F.col("__look") == F.col("look")]
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), *key)
    twice = keyed.join(once, same, "left_semi").dropDuplicates(["__id", "__look"])
    return keyed.join(odd, same, "left_anti").unionByName(twice).select("__row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window.

    Null and wordless texts hold none and stay; items without an id count. Repeated rows go or stay together. Columns of
    any name are carried along. Empty input: no rows; empty benchmark: all stay.
    """
    hit = unused(docs, "__hit")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark"), into=hit).where(~F.col(f"{hit}.contaminated")).drop(hit)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document is dropped.

    Null texts stay null, texts without secrets stay as they are; rows are read one by one. Columns of any name are
    carried along; n_chars stays that of the text as it came. Empty input: no rows.
    """
    into = unused(docs, "__secrets")
    return secretscan.scan(docs, secretscan.default_forest(spark), into=into).withColumn("text", F.col(f"{into}.redacted")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of every row (packing.pack); null and empty texts have their end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Classifiers and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, as on a cluster. What a stage wrote on its way goes
    when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediates() as kept:
            before, docs = docs, kept(materialize(stage(spark, docs, sf_dir), name))
            discard(before)
    return docs
