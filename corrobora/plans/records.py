"""Consensus records: fingerprint, deduplication, scoped sharing, signing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import fields
from corrobora.functions.canonical import canonical


def fingerprint(name_key: Column, iso: Column, gender: Column) -> Column:
    """Digest of sorted name, birth date and gender; null without a name and a date."""
    has = (F.coalesce(name_key, F.lit("")) != "") & (F.coalesce(iso, F.lit("")) != "")
    return F.when(has, F.sha2(F.concat_ws("|", name_key, iso, F.coalesce(gender, F.lit(""))), 256))


def display(field: Column, value: Column, pivot: int) -> Column:
    """A value as it stands on a record: in normal form, or as it came where it has none."""
    v = F.coalesce(value, F.lit(""))
    kind = (
        F.when(field == "dob", fields.date(v, pivot)["iso"])
        .when(field == "gender", fields.gender(v))
        .when(field == "address", fields.address(v)["text"])
        .when(field.endswith("name"), fields.name(v)["ordered"])
    )
    return F.when(v == "", F.lit("")).otherwise(F.coalesce(F.nullif(kind, F.lit("")), v))


def consensus(clusters: DataFrame, pivot: int) -> DataFrame:
    """(application_id, fields map): what the documents agree on, with its provenance, for the fields of a record.

    A value that only the holder gave is on it as unverified; fields without either are left out.
    """
    ordered = lambda c: F.array_sort(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda v: v != ""))
    types = F.array_sort(F.transform(F.filter(F.split("dissenting", ","), lambda v: F.contains(v, F.lit("="))), lambda v: F.split(v, "=")[0]))
    known, none = F.col("value") != "", F.array().cast("array<string>")
    entry = F.struct(
        display(F.col("field"), F.when(known, F.col("value")).otherwise(F.col("asserted")), pivot).alias("value"), F.when(known, ordered(F.col("agreeing"))).otherwise(none).alias("sources"), F.when(known, types).otherwise(none).alias("dissenting"),
        F.when(known, ordered(F.col("sources"))).otherwise(none).alias("evidence"), (known & F.col("strong")).alias("evidence_strong"), F.when(known, F.col("confidence")).otherwise(0.0).alias("confidence"),
        ordered(F.col("unreadable")).alias("unreadable"), ordered(F.col("abstained")).alias("abstained"), F.when(known, F.lit("verified")).otherwise(F.lit("unverified")).alias("verification"), F.when(known, F.lit("documents")).otherwise(F.lit("applicant_supplied")).alias("provenance"),
    )
    rows = clusters.where(F.col("field").isin(*C.RECORD_FIELDS) & (known | (F.coalesce("asserted", F.lit("")) != "")))
    return rows.groupBy("application_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", entry.alias("entry"))))).alias("fields"))


def summary(fields_: Column) -> Column:
    """Name, birth date and gender of a record's fields, '' where one is missing."""
    return F.struct(*[F.coalesce(F.try_element_at(fields_, F.lit(f))["value"], F.lit("")).alias(f) for f in ("holder_name", "dob", "gender")])


def record_hash(fields_: Column, pivot: int) -> Column:
    """The fingerprint of a record; values that no document verified take no part."""
    own = lambda f: F.when(F.try_element_at(fields_, F.lit(f))["verification"] == "verified", F.try_element_at(fields_, F.lit(f))["value"])
    return fingerprint(fields.name(own("holder_name"))["sorted"], fields.date(own("dob"), pivot)["iso"], fields.gender(own("gender")))


def probe(new: DataFrame, live: DataFrame, numbers: DataFrame) -> DataFrame:
    """The live record a new one belongs to: by fingerprint first, else by any document number. Revoked records never match."""
    ok = live.where("revoked = 0").select("gid", "dedup_hash")
    by_hash = ok.where("dedup_hash IS NOT NULL").groupBy("dedup_hash").agg(F.min("gid").alias("by_hash"))
    by_number = numbers.join(ok.select("gid"), "gid").groupBy("number").agg(F.min("gid").alias("by_number"))
    return new.join(by_hash, "dedup_hash", "left").join(by_number, "number", "left").withColumn("existing", F.coalesce("by_hash", "by_number")).drop("by_hash", "by_number")


def fingerprinted(consensus_: DataFrame, pivot: int) -> DataFrame:
    """Consensus records with dedup_hash; write them where several steps read them."""
    return consensus_ if "dedup_hash" in consensus_.columns else consensus_.withColumn("dedup_hash", record_hash(F.col("fields"), pivot))


def issue(consensus_: DataFrame, decisions: DataFrame, documents: DataFrame, live: DataFrame, linked: DataFrame, pivot: int, salt: str, enabled: bool = True) -> DataFrame:
    """(application_id, gid, issued, reason, summary, documents): a record for each application whose decision allows one.

    ``documents`` (application_id, doc_type, number, valid): only their last four characters go on a record. An identity
    that has a live record, by fingerprint or by a linked number (``linked``: number, gid), gets that one; equal fingerprints
    of one batch share a new one, which the first application gets issued. Refused applications have no gid, and the
    reason: not_issuable, or issuance_disabled. The consensus is read once.
    """
    cards = documents.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("doc_type", F.right(F.coalesce("number", F.lit("")), F.lit(4)).alias("suffix"), "valid"))).alias("documents"))
    ok = live.where("revoked = 0").select("gid", "dedup_hash")
    by_hash = ok.where("dedup_hash IS NOT NULL").groupBy("dedup_hash").agg(F.min("gid").alias("by_hash"))
    by_number = documents.where("number <> ''").select("application_id", "number").join(linked.join(ok.select("gid"), "gid"), "number").groupBy("application_id").agg(F.min("gid").alias("by_number"))
    rows = fingerprinted(consensus_, pivot).join(decisions.select("application_id", "issuable"), "application_id").join(cards, "application_id", "left").join(by_number, "application_id", "left").join(by_hash, "dedup_hash", "left")
    asked, existing = F.col("issuable") & F.lit(enabled), F.coalesce("by_hash", "by_number")
    person = F.coalesce("dedup_hash", F.col("application_id").cast("string"))
    rows = rows.withColumn("__first", F.row_number().over(Window.partitionBy(asked, person).orderBy("application_id")) == 1)
    own = F.concat(F.lit("GID-"), F.upper(F.left(F.sha2(F.concat_ws("|", person, F.lit(salt)), 256), F.lit(12))))
    minted = asked & existing.isNull() & F.col("__first")
    reason = (
        F.when(~F.col("issuable"), F.lit("not_issuable")).when(~F.lit(enabled), F.lit("issuance_disabled")).when(F.col("by_hash").isNotNull(), F.lit("same_identity"))
        .when(F.col("by_number").isNotNull(), F.lit("same_document_number")).when(minted, F.lit("new")).otherwise(F.lit("same_identity"))
    )
    return rows.select("application_id", F.when(asked, F.coalesce(existing, own)).alias("gid"), minted.alias("issued"), reason.alias("reason"), summary(F.col("fields")).alias("summary"), "documents")


def links(issued: DataFrame, documents: DataFrame, have: DataFrame) -> DataFrame:
    """(number, doc_type, gid) of newly issued records' documents; a number that is linked already keeps its record."""
    new = issued.where("issued").select("application_id", "gid").join(documents.where("number <> ''"), "application_id").groupBy("number", "doc_type").agg(F.min("gid").alias("gid"))
    return have.select("number", "doc_type", "gid").unionByName(new.join(have.select("number", "doc_type"), ["number", "doc_type"], "left_anti"))


def share(requests: DataFrame, live: DataFrame, now: Column, seconds: int, salt: str) -> DataFrame:
    """Tokens for ``requests`` (request_id, gid, scope, single_use) with error: not_found, revoked, invalid_scope or ''.

    Without a scope a token shows name, birth date and gender; what no record has is dropped from it.
    """
    asked = F.when(F.coalesce(F.size("scope"), F.lit(0)) > 0, F.col("scope")).otherwise(F.array(*map(F.lit, C.SHARE_FIELDS[:3])))
    out = requests.join(live.select("gid", F.col("revoked").alias("__revoked")), "gid", "left").withColumn("scope", F.filter(asked, lambda s: s.isin(*C.SHARE_FIELDS)))
    error = F.when(F.col("__revoked").isNull(), F.lit("not_found")).when(F.col("__revoked") == 1, F.lit("revoked")).when(F.size("scope") == 0, F.lit("invalid_scope")).otherwise(F.lit(""))
    token = F.left(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), F.lit(salt)), 256), F.lit(32))
    return out.withColumn("error", error).select("request_id", "gid", "scope", "single_use", "error", F.when(error == "", token).alias("token"), F.when(error == "", F.timestamp_seconds(F.unix_timestamp(now) + seconds)).alias("expires_at"))


def token_state(now: Column, expires: Column, single_use: Column, used: Column, revoked: Column) -> Column:
    return F.when(now > expires, F.lit("expired")).when(single_use & used.isNotNull(), F.lit("used")).when(revoked.isNull(), F.lit("missing")).when(revoked == 1, F.lit("revoked")).otherwise(F.lit("valid"))


def project(fields: Column, scope: Column) -> Column:
    """A map of fields cut down to those in scope."""
    return F.map_filter(fields, lambda k, _: F.array_contains(scope, k))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, numbers as a browser prints them."""
    return canonical(value)


class Signer:
    """Ed25519 through the JVM's own provider; runs on the driver."""

    def __init__(self, spark: SparkSession, keys=None):
        self.jvm = spark.sparkContext._jvm
        self.keys = keys or self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()

    def sign(self, record: dict) -> str:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self.keys.getPrivate())
        s.update(bytearray(canonical_json(record).encode()))
        return bytes(s.sign()).hex()

    def verify(self, record: dict, signature: str) -> bool:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(self.keys.getPublic())
        s.update(bytearray(canonical_json(record).encode()))
        return bool(s.verify(bytearray(bytes.fromhex(signature))))
