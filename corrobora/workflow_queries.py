"""Queries for reading, gating, intake, records and shares over the supplied tables, and the SQL that says the same.

Inputs are derived from rows by rule; the SQL states for the same rule what has to come out.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import responses, text
from corrobora.operators import faces as face_ops
from corrobora.operators import relational as rel
from corrobora.plans import evidence, extraction, intake, pages, reconcile, records
from corrobora.queries import LINE_ORDER, PIVOT, query, t, with_part
from corrobora.shared import spread, written
from corrobora.sources import page_text, readers, uploads


def cases(at: Column, *values) -> Column:
    """The value for each number from 0 on."""
    out = F
    for i, v in enumerate(values):
        out = out.when(at == i, v if isinstance(v, Column) else F.lit(v))
    return out


def events(spark, d) -> DataFrame:
    return t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")


K = F.col


# --- what models and services answer


@query("""
    SELECT event_id, ['', '', '', '', '', 'not_an_object', 'not_json', 'empty'][1 + event_id % 8] AS error,
        CASE WHEN event_id % 8 < 5 THEN event_type END AS holder_name, CASE WHEN event_id % 8 < 5 THEN 'M' END AS gender FROM events""")
def model_answers(spark, d):
    body = lambda q, end="": F.concat(F.lit(f"{{{q[0]}holder_name{q[1]}: {q[0] or '\"'}"), "event_type", F.lit(f"{q[1] or '\"'}, {q[0]}sex{q[1]}: {q[0] or '\"'}M{q[1] or '\"'}{end}}}"))
    plain = body('""')
    said = cases(K("event_id") % 8, plain, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n``` done")), F.concat(F.lit("Sure "), body('""', ","), F.lit(" thanks")), body(["", ""]), body("“”"), "[1, 2]", "no object here", "  ")
    a = responses.answer(said)
    value = lambda k: responses.plain(F.try_element_at(F.col("a.fields"), F.lit(k)))
    return events(spark, d).withColumn("a", a).select("event_id", "a.error", value("holder_name").alias("holder_name"), value("sex").alias("gender"))


@query("""
    WITH e AS (SELECT event_id, event_type, ['pan', 'unknown', 'voter', 'birth_certificate', 'unknown'][1 + event_id % 5] AS claimed FROM events),
    r AS (
        SELECT event_id, claimed, 'holder_name' AS field, CASE event_id % 4 WHEN 0 THEN 'A ' || event_type WHEN 2 THEN 'A, ' || event_type WHEN 3 THEN event_type END AS value, CASE WHEN event_id % 3 = 0 THEN 'Name: ' || event_type END AS evidence FROM e
        UNION ALL SELECT event_id, claimed, 'gender', CASE event_id % 3 WHEN 0 THEN 'M' WHEN 2 THEN '12' END, NULL FROM e
    )
    SELECT * FROM r WHERE value IS NOT NULL""")
def model_readings(spark, d):
    kind = cases(K("event_id") % 5, "PAN Card", "Aadhaar|PAN", "voter-id", "Birth Certificate", "xyz")
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    name = cases(K("event_id") % 4, F.concat(F.lit('"  A   '), "event_type", F.lit(' "')), F.lit('"n/a"'), F.concat(F.lit('["A", null, '), quoted, F.lit("]")), F.concat(F.lit('{"value": '), quoted, F.lit("}")))
    flag = cases(K("event_id") % 3, '"M"', "true", "12")
    proof = F.when(K("event_id") % 3 == 0, F.concat(F.lit(', "evidence": {"Name": "Name:  '), "event_type", F.lit('"}'))).otherwise(F.lit(""))
    said = F.concat(F.lit('{"document_type": "'), kind, F.lit('", " Name ": '), name, F.lit(', "sex": '), flag, proof, F.lit("}"))
    return extraction.readings(events(spark, d).select("event_id", said.alias("response"))).where("value IS NOT NULL").select("event_id", "claimed", "field", "value", "evidence")


@query("""
    SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE event_type END AS said FROM events""")
def reply_texts(spark, d):
    e = F.concat(F.lit('"'), "event_type", F.lit('"'))
    wrap = lambda a, b: F.concat(F.lit(a), e, F.lit(b))
    payload = cases(K("event_id") % 6, wrap('{"result": {"result": {"answer": ', "}}}"), wrap('{"result": {"response": ', "}}"), wrap('{"choices": [{"message": {"content": ', "}}]}"), wrap('{"result": {"choices": [{"text": ', "}]}}"), wrap('{"result": ', "}"), '{"result": {}}')
    model = cases(K("event_id") % 6, "moondream-2", "llama-3.2-vision", "other", "other", "moondream-2", "moondream-2")
    return events(spark, d).select("event_id", responses.reply_text(payload, model).alias("said"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN ['xml', 'secure'][1 + c_custkey % 3] END AS version, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 < 2 THEN '1990-01-02' END AS dob,
        CASE c_custkey % 3 WHEN 0 THEN 'H1, KA, 560001' WHEN 1 THEN 'H1, Town, KA, 560001' END AS address, CASE c_custkey % 3 WHEN 0 THEN '9012' WHEN 1 THEN '1234' END AS last_four FROM customer""")
def code_payloads(spark, d):
    @F.pandas_udf("string")
    def packed(names: pd.Series) -> pd.Series:
        def one(name: str) -> str:
            parts = ["2", "123420240101", name, "1990-01-02", "F", "", "", "", "H1", "Town", "560001", "", "KA", "", "", ""]
            squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
            return str(int.from_bytes(squeeze.compress(b"".join(p.encode() + b"\xff" for p in parts) + b"photo") + squeeze.flush(), "big"))

        return names.map(one)

    xml = F.concat(F.lit('<PrintLetterBarcodeData uid="123456789012" name="'), "c_name", F.lit('" yob="" dob="1990-01-02" house="H1" state="KA" pc="560001"/>'))
    return spread(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").withColumn("q", responses.code_payload(cases(K("c_custkey") % 3, xml, packed("c_name"), "nothing"))).select("c_custkey", "q.version", "q.name", "q.dob", "q.address", "q.last_four")


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'text/plain' ELSE 'image/png' END AS mime, event_type AS body FROM events")
def data_uris(spark, d):
    plain = F.concat(F.lit("data:text/plain,"), F.url_encode("event_type"))
    coded = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("event_type", "UTF-8")))
    return events(spark, d).withColumn("u", uploads.data_uri(cases(K("event_id") % 2, plain, coded))).select("event_id", "u.mime", F.decode("u.bytes", "UTF-8").alias("body"))


@query("SELECT p_partkey, p_name AS holder_name, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN ''''|| 's Name' ELSE 'of ' || p_brand END AS father_name FROM part")
def labelled_values(spark, d):
    page = F.concat(F.lit("GOVERNMENT\nName: "), "p_name", cases(K("p_partkey") % 3, F.concat(F.lit("\nFather's Name\n"), "p_type"), F.lit("\nFather's Name\n12"), F.concat(F.lit("\n12\nthe father - of "), "p_brand")))
    father = page_text.labelled(page, ["father'?s? name", "father"])
    return t(spark, d, "part").select("p_partkey", page_text.labelled(page, [r"\bname\b(?! of father)"]).alias("holder_name"), father.alias("father_name"))


@query("""
    SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS symbol, c_name AS name FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 3 <> 2""")
def card_codes(spark, d):
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<PrintLetterBarcodeData name="'), "c_name", F.lit('"/>'))
    row = lambda n, kind, x: F.struct(F.lit(n).alias("symbol"), kind.alias("format"), x.alias("payload"))
    none, qr = F.lit("x"), F.when(k % 4 == 3, F.lit("PDF417")).otherwise(F.lit("QRCode"))
    symbols = F.array(row(0, F.lit("Code128"), xml), row(1, qr, F.when(k % 3 == 0, xml).otherwise(none)), row(2, qr, F.when(k % 3 != 2, xml).otherwise(none)), row(3, F.lit("Aztec"), xml), row(4, F.lit("QRCode"), xml))
    codes = spread(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select(k.alias("doc_id"), F.explode(symbols).alias("s")).select("doc_id", "s.*")
    return readers.card_code(codes).select("doc_id", "symbol", "name")


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS variant, CASE WHEN event_id % 3 = 0 THEN '  x  y ' ELSE event_type END AS text FROM events")
def richest_texts(spark, d):
    e = events(spark, d)
    texts = e.select(F.col("event_id").alias("doc_id"), F.lit("a").alias("variant"), F.lit("  x  y ").alias("text")).unionByName(e.select(F.col("event_id").alias("doc_id"), F.lit("b").alias("variant"), F.when(F.col("event_id") % 3 == 0, F.lit("z w")).otherwise(F.col("event_type")).alias("text")))
    return readers.richest(texts)


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS response, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'timeout' END AS error FROM events")
def model_replies(spark, d):
    k = F.col("event_id")
    payload = F.concat(F.lit('{"result": {"response": "'), "event_type", F.lit('"}}'))
    replies = events(spark, d).select(k.alias("doc_id"), F.lit("llama-vision").alias("model"), payload.alias("payload"), F.when(k % 2 == 1, F.lit("timeout")).alias("error"))
    return readers.answers(replies).select("doc_id", "response", "error")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Ready' WHEN 'view' THEN 'Removed' WHEN 'purchase' THEN 'Needs a new photo' ELSE 'Working' END AS label FROM events")
def status_labels(spark, d):
    status = F.when(F.col("event_type") == "click", F.lit("ready")).when(F.col("event_type") == "view", F.lit("removed_by_user")).when(F.col("event_type") == "purchase", F.lit("retake_required")).otherwise(F.lit("pending"))
    return events(spark, d).select("event_id", intake.status_label(status).alias("label"))


# --- gates

_KINDS, _FIELDS = ["pan", "aadhaar", "voter", "unknown"], ["gender", "father_name", "holder_name", "document_number", "mother_name"]
_VALUES = ["Female", "RAM DEVI", "ASHA DEVI", "ABCDE1234F", "SITA DEVI"]
_SHOWN = ["Sex: Female", "Father: RAM DEVI", "ASHA DEVI", "ABCDE1234F", "Mother: SITA DEVI"]
_PAGES = [None, "Father RAM DEVI and Mother SITA DEVI of ASHA DEVI who is Female", "nothing to see on this page but a name and some words"]


def _gate_rows(spark, d) -> DataFrame:
    k = K("event_id")
    return events(spark, d).select("event_id", cases(k % 4, *_KINDS).alias("doc_type"), F.lit("front").alias("page_role"), cases(k % 5, *_FIELDS).alias("field"), F.when(k % 11 != 0, cases(k % 5, *_VALUES)).alias("value"), F.when(k % 2 == 0, cases(k % 5, *_SHOWN)).alias("evidence"), cases(F.floor(k / 4).cast("int") % 3, *_PAGES).alias("page_text"), F.lit(None).cast("string").alias("mrz"), F.lit("vision").alias("source"))


#: (status, reason) of a row for a type in SQL; the rules of a conditional field hold only when it is read first.
_GATE = """
    f AS (SELECT event_id, ['pan', 'aadhaar', 'voter', 'unknown'][1 + event_id % 4] AS kind, ['gender', 'father_name', 'holder_name', 'document_number', 'mother_name'][1 + event_id % 5] AS field, event_id % 11 <> 0 AS given, event_id % 2 = 0 AS ev, (event_id // 4) % 3 AS page FROM events),
    g AS (SELECT *, field IN ('gender', 'holder_name', 'document_number') AS own, page = 1 AND field <> 'document_number' AS on_page, field IN ('gender', 'holder_name', 'document_number') OR ev OR page = 1 AS label, page > 0 AS witness,
        (kind = 'pan' AND field = 'gender') OR (kind = 'aadhaar' AND field = 'mother_name') AS never, kind <> 'unknown' AND field IN ('holder_name', 'document_number') AS required, kind = 'pan' AND field = 'document_number' AS number FROM f)"""


def _assessed(number: str, required: str) -> str:
    return f"""CASE WHEN {number} THEN 'present_verified:format_and_checksum_valid' WHEN on_page AND label THEN 'present_verified:corroborated_by_page_text'
        WHEN ev AND label AND witness AND NOT on_page AND NOT own THEN 'present_uncertain:evidence_not_found_in_page_text' WHEN ev AND label THEN 'present_verified:evidence_supports_value'
        WHEN {required} AND own THEN 'present_verified:required_field_read_from_document' WHEN NOT label AND NOT witness THEN 'present_uncertain:no_local_corroboration_available' WHEN NOT label THEN 'not_present:no_label_for_field_on_page' ELSE 'present_uncertain:value_without_supporting_evidence' END"""


@query(f"""
    WITH {_GATE}, s AS (SELECT *, CASE WHEN NOT given THEN 'not_present:no_value_returned' WHEN never THEN 'invalid:field_impossible_for_document' WHEN kind = 'aadhaar' AND field = 'father_name' AND NOT ev AND page <> 1 THEN 'invalid:conditional_evidence_missing' ELSE {_assessed('number', 'required')} END AS s FROM g)
    SELECT event_id, split_part(s, ':', 1) AS status, split_part(s, ':', 2) AS reason, CASE WHEN NOT given OR s LIKE 'invalid%' THEN 0.0 WHEN s LIKE 'present_verified%' THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence, s LIKE 'present_verified%' AS comparable FROM s""")
def extraction_gates(spark, d):
    return extraction.gate(_gate_rows(spark, d), evidence.registry(spark), PIVOT).select("event_id", "status", "reason", "confidence", F.col("normalized_value").isNotNull().alias("comparable"))


@query(f"""
    WITH {_GATE}, a AS (SELECT *, CASE WHEN NOT given THEN 'not_present:no_value_returned' ELSE {_assessed('false', 'false')} END AS first FROM g),
    s AS (SELECT *, CASE WHEN NOT given OR kind = 'unknown' THEN first WHEN never THEN 'invalid:field_impossible_for_document' WHEN first LIKE 'present_verified%' THEN first ELSE {_assessed('number', 'required')} END AS s FROM a)
    SELECT event_id, split_part(s, ':', 1) AS status, split_part(s, ':', 2) AS reason FROM s""")
def reassessed_gates(spark, d):
    known, reg = _gate_rows(spark, d), evidence.registry(spark)
    first = extraction.gate(known.withColumn("kind", F.col("doc_type")).withColumn("doc_type", F.lit("unknown")), reg, PIVOT)
    return extraction.reassess(first.withColumn("doc_type", F.col("kind")), reg, PIVOT).select("event_id", "status", "reason")


@query("""
    WITH a AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS v, CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 2 = 0 THEN 'present_verified' ELSE 'present_uncertain' END AS s FROM events WHERE value > 10),
    b AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE ' ' || upper(event_type) END AS v, CASE WHEN event_id % 17 = 0 THEN 'invalid' WHEN event_id % 5 = 0 THEN 'present_verified' ELSE 'present_uncertain' END AS s FROM events WHERE event_type <> 'view'),
    m AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, a.v AS av, b.v AS bv, coalesce(a.s, '') AS sa, coalesce(b.s, '') AS sb, upper(trim(a.v)) = upper(trim(b.v)) AS same FROM a FULL JOIN b ON a.event_id = b.event_id),
    x AS (SELECT *, CASE WHEN sa = 'invalid' THEN 1 WHEN sb = 'invalid' THEN 2 WHEN av IS NOT NULL AND bv IS NOT NULL AND same THEN 3 WHEN av IS NOT NULL AND bv IS NOT NULL AND sa = 'present_verified' AND sb <> sa THEN 4 WHEN av IS NOT NULL AND bv IS NOT NULL AND sb = 'present_verified' AND sb <> sa THEN 5 WHEN av IS NOT NULL AND bv IS NOT NULL THEN 6 WHEN av IS NOT NULL THEN 7 WHEN bv IS NOT NULL THEN 8 ELSE 9 END AS c FROM m)
    SELECT event_id, CASE WHEN c IN (1, 3, 4, 6, 7) THEN av WHEN c IN (2, 5, 8) THEN bv END AS value, CASE c WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'present_verified' WHEN 4 THEN sa WHEN 5 THEN sb WHEN 6 THEN 'present_uncertain' WHEN 7 THEN sa WHEN 8 THEN sb ELSE sa END AS status,
        CASE c WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.95 WHEN 4 THEN 0.6 WHEN 5 THEN 0.6 WHEN 6 THEN 0.3 WHEN 7 THEN CASE WHEN sa = 'present_verified' THEN 0.8 ELSE 0.3 END WHEN 8 THEN CASE WHEN sb = 'present_verified' THEN 0.8 ELSE 0.3 END ELSE 0.0 END::DOUBLE AS confidence,
        CASE c WHEN 3 THEN 'high' WHEN 4 THEN 'medium' WHEN 5 THEN 'medium' WHEN 6 THEN 'low' WHEN 7 THEN CASE WHEN sa = 'present_verified' THEN 'medium' ELSE 'low' END WHEN 8 THEN CASE WHEN sb = 'present_verified' THEN 'medium' ELSE 'low' END ELSE 'none' END AS level, CASE WHEN c IN (4, 5, 6) THEN av || '|' || bv END AS candidates FROM x""")
def merged_envelopes(spark, d):
    e, k = events(spark, d), K("event_id")
    status = lambda bad, good: F.when(k % bad == 0, F.lit("invalid")).when(k % good == 0, F.lit("present_verified")).otherwise(F.lit("present_uncertain"))
    a = e.where("value > 10").select("event_id", F.when(k % 13 != 0, F.col("event_type")).alias("value"), status(11, 2).alias("status"), F.lit("r").alias("reason"))
    b = e.where("event_type <> 'view'").select("event_id", F.when(k % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("value"), status(17, 5).alias("status"), F.lit("r").alias("reason"))
    return extraction.merge(a, b, ["event_id"]).select("event_id", "value", "status", "confidence", "level", F.array_join("candidates", "|").alias("candidates"))


@query("""
    SELECT event_id, CASE WHEN value > 80 THEN 'MRZ' WHEN value > 50 THEN 'code' ELSE event_type END AS value, CASE WHEN value > 50 THEN 'present_verified' ELSE 'present_uncertain' END AS status,
        CASE WHEN value > 80 THEN 'self_evident_source:mrz' WHEN value > 50 THEN 'self_evident_source:barcode' ELSE 'r' END AS reason, CASE WHEN value > 50 THEN 0.99 ELSE 0.3 END::DOUBLE AS confidence FROM events""")
def machine_readable_overlay(spark, d):
    e = events(spark, d)
    own = e.select("event_id", F.col("event_type").alias("value"), F.lit("present_uncertain").alias("status"), F.lit("r").alias("reason"), F.lit(0.3).alias("confidence"), F.lit("vision").alias("source"))
    exact = e.where("value > 50").select("event_id", F.lit("code").alias("value"), F.lit("barcode").alias("source")).unionByName(e.select("event_id", F.when(F.col("value") > 80, F.lit("MRZ")).otherwise(F.lit(" ")).alias("value"), F.lit("mrz").alias("source")))
    return extraction.overwrite(own, exact, ["event_id"]).select("event_id", "value", "status", "reason", "confidence")


@query("""
    WITH h AS (SELECT event_id, event_id % 7 = 0 AS sure, list_filter([CASE WHEN event_id % 2 = 0 THEN 'a' END, CASE WHEN event_id % 3 = 0 THEN 'b' END, CASE WHEN value > 50 THEN 'c' END], lambda x: x IS NOT NULL) AS v FROM events)
    SELECT event_id, CASE WHEN sure OR len(v) >= 2 THEN 'present_verified' ELSE 'present_uncertain' END AS status, CASE WHEN NOT sure AND len(v) >= 2 THEN 'verified_by_ocr_consensus' ELSE 'r' END AS reason, CASE WHEN sure OR len(v) < 2 THEN 0.3 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN NOT sure AND len(v) >= 2 THEN array_to_string(v, ',') END AS variants FROM h""")
def ocr_consensus(spark, d):
    e, k = events(spark, d), K("event_id")
    own = e.select(k.alias("doc_id"), F.lit("holder_name").alias("field"), F.concat("event_type", F.lit(" person")).alias("value"), F.when(k % 7 == 0, F.lit("present_verified")).otherwise(F.lit("present_uncertain")).alias("status"), F.lit("r").alias("reason"), F.lit(0.3).alias("confidence"))
    shown = lambda c: F.when(c, F.concat(F.lit("card of "), "event_type", F.lit(" Person"))).otherwise(F.lit("smudge"))
    texts = e.select(k.alias("doc_id"), F.explode(F.create_map(F.lit("a"), shown(k % 2 == 0), F.lit("b"), shown(k % 3 == 0), F.lit("c"), shown(F.col("value") > 50))).alias("variant", "text"))
    return extraction.ocr_consensus(own, texts, PIVOT).select(F.col("doc_id").alias("event_id"), "status", "reason", "confidence", F.array_join("variants", ",").alias("variants"))


@query("""
    WITH f AS (SELECT event_id, unnest(['holder_name', 'dob', 'gender', 'document_number']) AS field FROM events),
    x AS (SELECT *, CASE field WHEN 'holder_name' THEN event_id % 2 = 0 WHEN 'dob' THEN event_id % 3 = 0 WHEN 'gender' THEN event_id % 5 = 0 ELSE false END AS ok, field <> 'document_number' AND (field <> 'dob' OR event_id % 7 = 0) AS near FROM f)
    SELECT event_id, field, CASE WHEN ok THEN 'present_verified' ELSE 'present_uncertain' END AS status, CASE WHEN ok THEN 'verified_by_field_reread' WHEN near THEN 'field_area_found_but_unreadable' ELSE 'r' END AS reason FROM x""")
def field_rereads(spark, d):
    e, k = events(spark, d), K("event_id")
    given = {"holder_name": "ASHA DEVI", "dob": "1990-01-02", "gender": "F", "document_number": "X1"}
    own = e.select(k.alias("doc_id"), F.explode(F.create_map(*[F.lit(x) for p in given.items() for x in p])).alias("field", "value")).select("*", F.lit("present_uncertain").alias("status"), F.lit("r").alias("reason"), F.lit(0.3).alias("confidence"))
    said = {"holder_name": F.when(k % 2 == 0, F.lit("ASHA DEVI")).otherwise(F.lit("RAM")), "dob": F.when(k % 3 == 0, F.lit("02/01/1990")).otherwise(F.lit("")), "gender": F.when(k % 5 == 0, F.lit("F")).otherwise(F.lit("M")), "document_number": F.lit("X1")}
    again = e.select(k.alias("doc_id"), F.explode(F.create_map(*[x for f, v in said.items() for x in (F.lit(f), v)])).alias("field", "answer"))
    page = e.select(k.alias("doc_id"), F.when(k % 7 == 0, F.lit("DOB smudge")).alias("page_text"))
    return extraction.reread(own, again, page, PIVOT).select(F.col("doc_id").alias("event_id"), "field", "status", "reason")


@query("""
    WITH z AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS p, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS q FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'ABCDE' || p || 'F' WHEN 1 THEN 'ABCDE' || p || 'F' WHEN 2 THEN 'XX' WHEN 3 THEN 'K' || q WHEN 4 THEN 'B1' WHEN 5 THEN 'DL5' END AS value, o_orderkey % 7 IN (0, 1, 3) AS valid,
        CASE o_orderkey % 7 WHEN 2 THEN 'wrong_length' WHEN 4 THEN 'not_validated' WHEN 5 THEN 'unknown_document_type' WHEN 6 THEN 'empty' ELSE '' END AS reason, o_orderkey % 7 = 1 AND contains(p, '0') AS repaired,
        CAST(CASE WHEN o_orderkey % 7 = 1 THEN length(p) - length(replace(p, '0', '')) ELSE 0 END AS INTEGER) AS changes, o_orderkey % 7 IN (2, 4, 5) AS needs_manual_entry FROM z""")
def validated_numbers(spark, d):
    k = K("o_orderkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    pan = lambda v: F.concat(F.lit("ABCDE"), v, F.lit("F"))
    kind = cases(k % 7, "pan", "pan", "voter", "passport", "birth_certificate", "driving_licence", "pan")
    x = cases(k % 7, pan(pad(4)), pan(F.translate(pad(4), "0", "O")), "xx", F.concat(F.lit("k "), pad(7)), "b 1", "DL-5", " ")
    return t(spark, d, "orders").withColumn("n", extraction.validated_number(kind, x)).select("o_orderkey", "n.*")


@query("""
    WITH a AS (SELECT user_id, count(CASE WHEN value >= 5 THEN 1 END) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(CASE WHEN value >= 5 THEN 1 END) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN coalesce(b.n, -1) >= coalesce(a.n, -1) THEN 'focused' ELSE 'identify' END AS read FROM a FULL JOIN b ON a.user_id = b.user_id""")
def focused_reads(spark, d):
    rows = events(spark, d).select(K("user_id").alias("doc_id"), "event_type", F.lit("v").alias("value"), F.when(F.col("value") < 5, F.lit("invalid")).otherwise(F.lit("present_uncertain")).alias("status"))
    return extraction.keep_focused(rows.where("event_type = 'click'"), rows.where("event_type = 'view'")).select(F.col("doc_id").alias("user_id"), "read")


@query("SELECT event_id, event_id % 10 = 0 OR event_id % 2 = 0 OR event_id % 3 = 0 OR value < 20 AS second FROM events")
def second_model_gate(spark, d):
    k = K("event_id")
    status = lambda n: F.when(k % n == 0, F.lit("present_uncertain")).otherwise(F.lit("present_verified"))
    return events(spark, d).select("event_id", extraction.needs_second_model(F.when(k % 10 == 0, F.lit("always")).otherwise(F.lit("auto")), status(2), status(3), F.col("value") >= 20).alias("second"))


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value < 50 THEN 'unreadable' ELSE 'present_verified' END AS status, CASE WHEN event_type = 'click' AND value < 50 THEN NULL ELSE event_type END AS value FROM events")
def quality_gate(spark, d):
    e = events(spark, d)
    own = e.select(K("event_id").alias("doc_id"), F.lit("holder_name").alias("field"), F.col("event_type").alias("value"), F.lit("present_verified").alias("status"), F.lit("r").alias("reason"))
    quality = e.where("event_type <> 'view'").select(K("event_id").alias("doc_id"), (F.col("event_type") == "click").alias("assessed"), (F.col("value") >= 50).alias("usable"))
    return extraction.quality_gate(own, quality).select(F.col("doc_id").alias("event_id"), "status", "value")


@query("""
    WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity < 25 AS soft, l_discount > 0.07 AS uneven, l_suppkey % 2 = 0 AS narrow FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(['gray-normalize', CASE WHEN uneven THEN 'clahe' END, CASE WHEN soft THEN 'sharpen' END, CASE WHEN narrow AND soft THEN 'upscale2x' END], lambda x: x IS NOT NULL)[1:3], ',') AS variants FROM q""")
def enhancement_variants(spark, d):
    made = extraction.enhancements(F.when(F.col("l_quantity") < 25, F.lit(40)), F.lit(30), F.when(F.col("l_discount") > 0.07, F.lit(0.2)).otherwise(F.lit(0.0)), F.lit(None).cast("double"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(800)).otherwise(F.lit(2000)))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(made, ",").alias("variants"))


def _asked() -> str:
    rows = []
    for kind in sorted({k for k, _ in C.CAPABILITIES}):
        for page in ("front", "back"):
            allowed, required, impossible, conditional = C.CAPABILITIES.get((kind, page), C.CAPABILITIES["unknown", "front"])
            never = sorted(set(impossible.split()) & set(C.FIELDS))
            may = sorted(f for f in C.FIELDS if f not in never and (f in allowed.split() or f in required.split() or f in conditional))
            rows.append((kind, page, len(may), len(required.split()), len(never)))
    return ", ".join(f"('{a}', '{b}', {x}, {y}, {z})" for a, b, x, y, z in rows)


@query(f"""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 6 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'passport' WHEN 3 THEN 'voter' WHEN 4 THEN 'birth_certificate' ELSE 'unknown' END AS doc_type, CASE WHEN l_suppkey % 3 = 0 THEN 'back' ELSE 'front' END AS page_role FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, doc_type, page_role, CAST(may AS INTEGER) AS may, CAST(must AS INTEGER) AS must, CAST(never AS INTEGER) AS never FROM l JOIN (VALUES {_asked()}) AS x(doc_type, page_role, may, must, never) USING (doc_type, page_role)""")
def reading_requests(spark, d):
    """What a model is asked about each page, by the page's type and side."""
    many = lambda head: F.when(F.contains("prompt", F.lit(head)), F.size(F.split(F.regexp_extract("prompt", rf"{head}([^.]*)\.", 1), ", "))).otherwise(F.lit(0)).cast("int")
    pages_ = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cases(F.col("l_linenumber") % 6, "pan", "aadhaar", "passport", "voter", "birth_certificate", "unknown").alias("doc_type"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("back")).otherwise(F.lit("front")).alias("page_role"))
    asked = extraction.requests(spark).select("doc_type", "page_role", many("Fields: ").alias("may"), many("Expected on every such page: ").alias("must"), many("Never printed there: ").alias("never"))
    return pages_.join(F.broadcast(asked), ["doc_type", "page_role"])


@query("""
    WITH e AS (SELECT *, ['present_verified', 'present_uncertain', 'invalid', 'unreadable', NULL][1 + event_id % 5] AS s FROM events)
    SELECT event_id, CASE WHEN s = 'present_verified' THEN CASE WHEN event_id % 2 = 0 THEN 'N' ELSE event_type END END AS comparable, CASE WHEN s = 'invalid' THEN NULL ELSE event_type END AS as_read, coalesce(s, 'not_present') AS status, coalesce(s = 'present_verified', false) AS verified FROM e""")
def envelope_views(spark, d):
    k, raw = K("event_id"), F.col("event_type")
    s = cases(k % 5, "present_verified", "present_uncertain", "invalid", "unreadable")
    state = extraction.state(s, s == "present_verified", F.lit(None).cast("string"), raw, F.lit("vision"), F.lit(None).cast("string"))
    return events(spark, d).select("event_id", extraction.comparable(s, F.when(k % 2 == 0, F.lit("N")), raw).alias("comparable"), extraction.as_read(s, raw).alias("as_read"), state["status"].alias("status"), state["verified"].alias("verified"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unreadable' WHEN event_id % 5 = 0 THEN 'retake_required' WHEN event_type = 'view' THEN 'unreadable' ELSE 'ready' END AS status FROM events")
def document_statuses(spark, d):
    k = K("event_id")
    return events(spark, d).select("event_id", extraction.document_status(k % 3 == 0, F.when(k % 5 == 0, F.lit(True)), F.when(F.col("event_type") != "view", F.lit("pan"))).alias("status"))


# --- pages, intake

ORD = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)"


def _lines(spark, d) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *LINE_ORDER)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))).withColumn("document_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("ord").cast("string")))


@query(f"""
    WITH l AS (SELECT l_orderkey, {ORD} AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'pan' ELSE 'aadhaar' END AS kind, l_partkey % 3 AS number, CASE WHEN l_suppkey % 2 = 0 THEN 'back' ELSE 'front' END AS role FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind, number, role ORDER BY ord) AS k FROM l),
    g AS (SELECT *, min(ord) OVER (PARTITION BY l_orderkey, kind, number, k) AS head, count(*) OVER (PARTITION BY l_orderkey, kind, number, k) AS n FROM r)
    SELECT l_orderkey AS application_id, l_orderkey || '-' || ord AS document_id, l_orderkey || '-' || head AS logical_id, role AS page_role, CASE WHEN n = 2 THEN 'same_document_number' ELSE 'single_page' END AS signal FROM g""")
def page_groups(spark, d):
    values = F.when(F.col("l_suppkey") % 2 == 0, F.create_map(F.lit("address"), F.lit("x"), F.lit("dob"), F.lit(" "))).otherwise(F.create_map(F.lit("dob"), F.lit("x"), F.lit("address"), F.lit("y")))
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("application_id"), "document_id", "ord", F.when(F.col("l_linenumber") % 2 == 0, F.lit("pan")).otherwise(F.lit("aadhaar")).alias("doc_type"), F.lit(None).cast("string").alias("page_role"), F.concat(F.lit("n - "), F.col("l_partkey") % 3).alias("document_number"), F.lit("").alias("holder_name"), F.lit("").alias("relative_path"), values.alias("fields"))
    return pages.grouped(rows)


_ROUTES = """
    f AS (SELECT o_custkey, o_orderkey, 'h' || (o_orderkey % 5) AS h, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey) AS n, c_nationkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate_in_upload' WHEN h = 'h0' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'retry' ELSE 'duplicate_of_active_document' END WHEN h = 'h1' THEN 'reactivate' WHEN h = 'h2' THEN CASE WHEN c_acctbal > 0 THEN 'retry' ELSE 'duplicate_still_processing' END ELSE 'fresh' END AS route FROM f)"""


def _upload(spark, d) -> tuple[DataFrame, DataFrame, Column]:
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    have = t(spark, d, "customer").select(F.col("c_custkey").alias("application_id"), F.explode(F.array(*[F.struct(F.lit(h).alias("hash"), F.lit(s).alias("status"), F.lit(y).alias("y")) for h, s, y in (("h0", "ready", 2020), ("h0", "removed_by_user", 2024), ("h1", "removed_by_user", 2020), ("h2", "pending", 2020))])).alias("x"), "c_nationkey", "c_acctbal")
    at = F.when((F.col("x.hash") == "h2") & (F.col("c_acctbal") <= 0), now - F.expr("INTERVAL 5 MINUTES")).when(F.col("x.hash") == "h2", now - F.expr("INTERVAL 11 MINUTES"))
    docs = have.select("application_id", F.concat_ws("-", F.col("application_id").cast("string"), "x.hash", "x.status").alias("document_id"), "x.hash", "x.status", F.make_timestamp("x.y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), at.alias("updated_at"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("old")).otherwise(F.lit("new")).alias("extraction_key"))
    files = t(spark, d, "orders").select(F.col("o_custkey").alias("application_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("h"), F.col("o_orderkey") % 5).alias("hash"))
    return files, docs, now


@query(f"WITH {_ROUTES} SELECT o_custkey AS application_id, o_orderkey AS ord, route, CASE WHEN route IN ('fresh', 'duplicate_in_upload') THEN NULL ELSE o_custkey || '-' || h || CASE h WHEN 'h0' THEN '-ready' WHEN 'h1' THEN '-removed_by_user' ELSE '-pending' END END AS document_id FROM r")
def ingest_routes(spark, d):
    files, docs, now = _upload(spark, d)
    return intake.routes(files, docs, F.lit("new"), now).select("application_id", "ord", "route", "document_id")


@query(f"WITH {_ROUTES} SELECT o_custkey AS application_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 1 AS accepted FROM r WHERE route = 'fresh'")
def upload_room(spark, d):
    files, docs, now = _upload(spark, d)
    fresh = intake.routes(files, docs, F.lit("new"), now).where("route = 'fresh'").select("application_id", "ord")
    return intake.within_room(fresh, docs, most=3)


@query(f"""
    WITH l AS (SELECT l_orderkey, l_orderkey || '-' || {ORD} AS id, {ORD} AS ord, l_quantity <= 10 AS removed FROM lineitem),
    q AS (SELECT l_orderkey, list(id ORDER BY id) AS ids, list(id ORDER BY id) FILTER (WHERE removed) AS gone FROM l GROUP BY 1),
    x AS (SELECT *, l_orderkey % 7 = 0 AS none, l_orderkey % 4 = 0 AS twice, l_orderkey % 5 = 0 AS alien FROM q)
    SELECT l_orderkey AS request_id, CASE WHEN none THEN 'document_ids_required' WHEN twice THEN 'duplicate_document_ids' WHEN NOT alien AND gone IS NOT NULL THEN 'removed_document_selected' ELSE '' END AS error,
        CASE WHEN none THEN '' WHEN twice THEN l_orderkey || '-1' WHEN NOT alien AND gone IS NOT NULL THEN array_to_string(gone, ',') ELSE '' END AS ids, CASE WHEN alien AND NOT none THEN 'x-1' ELSE '' END AS foreign_ids FROM x""")
def selection_errors(spark, d):
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("application_id"), "document_id", "ord", F.when(F.col("l_quantity") <= 10, F.lit("removed_by_user")).otherwise(F.lit("ready")).alias("status"))
    k = F.col("application_id")
    none = F.array().cast("array<string>")
    asked = lines.groupBy("application_id").agg(F.sort_array(F.collect_list("document_id")).alias("ids"))
    ids = F.concat("ids", F.when(k % 4 == 0, F.array(F.concat(k.cast("string"), F.lit("-1")))).otherwise(none), F.when(k % 5 == 0, F.array(F.lit("x-1"))).otherwise(none))
    requests = asked.select(k.alias("request_id"), "application_id", F.when(k % 7 == 0, none).otherwise(ids).alias("document_ids"))
    return intake.selection_errors(requests, lines).select("request_id", "error", F.array_join("ids", ",").alias("ids"), F.array_join("foreign", ",").alias("foreign_ids"))


@query("""
    WITH s AS (SELECT event_id, event_type, CASE WHEN value > 50 THEN 'present_verified' ELSE 'present_uncertain' END AS st FROM events WHERE event_type <> 'view'), c AS (SELECT event_id FROM events WHERE value > 30 AND event_type <> 'click'),
    j AS (SELECT coalesce(s.event_id, c.event_id) AS event_id, event_type, st, c.event_id IS NOT NULL AS typed FROM s FULL JOIN c ON s.event_id = c.event_id)
    SELECT event_id, CASE WHEN typed AND st = 'present_verified' THEN st WHEN typed THEN 'holder_asserted' ELSE st END AS status, CASE WHEN typed THEN 'typed' ELSE event_type END AS value, CASE WHEN typed AND st = 'present_verified' THEN 'user_correction' WHEN typed THEN 'user' ELSE 'vision' END AS source,
        CASE WHEN typed THEN coalesce(st, 'not_present') END AS document_status, CASE WHEN typed THEN event_type END AS document_value FROM j""")
def hydrated_fields(spark, d):
    e = events(spark, d)
    states = e.where("event_type <> 'view'").select(F.col("event_id").alias("document_id"), F.lit("holder_name").alias("field"), F.when(F.col("value") > 50, F.lit("present_verified")).otherwise(F.lit("present_uncertain")).alias("status"), F.col("event_type").alias("value"), F.lit("vision").alias("source"), F.lit("r").alias("reason"))
    typed = e.where("value > 30 AND event_type <> 'click'").select(F.col("event_id").alias("document_id"), F.lit("holder_name").alias("field"), F.lit("typed").alias("value"))
    return intake.hydrated(states, typed).select(F.col("document_id").alias("event_id"), "status", "value", "source", "document_status", "document_value")


@query("SELECT user_id, string_agg(field || '=' || v, ',' ORDER BY field) AS corrections FROM (SELECT user_id, event_type AS field, CAST(count(*) AS VARCHAR) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def corrections_map(spark, d):
    fixed = events(spark, d).groupBy(F.col("user_id").alias("document_id"), F.col("event_type").alias("field")).agg(F.count("*").cast("string").alias("value"))
    return intake.corrections_map(fixed).select(F.col("document_id").alias("user_id"), F.array_join(F.transform(F.map_entries("corrections"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("corrections"))


@query("""
    WITH e AS (SELECT *, ['none', 'png', 'exe', 'text', 'pdf', 'raw'][1 + event_id % 6] AS kind FROM events), a AS (SELECT *, CASE WHEN kind IN ('png', 'text') THEN row_number() OVER (PARTITION BY user_id, kind IN ('png', 'text') ORDER BY event_id) END AS n FROM e)
    SELECT user_id AS upload_id, event_id AS ord, CASE kind WHEN 'png' THEN 'image/png' WHEN 'text' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' WHEN 'none' THEN 'text/plain' END AS mime, CASE WHEN kind = 'none' THEN 'empty_file' WHEN kind = 'exe' THEN 'executable' WHEN kind = 'pdf' THEN 'pdf_not_rendered' WHEN kind = 'raw' THEN 'unsupported_type' WHEN n > 20 THEN 'max_files' ELSE '' END AS reason FROM a""")
def discovered_files(spark, d):
    body = cases(F.col("event_id") % 6, "", "89504E470D0A1A0A00", "4D5A9000", F.hex(F.col("event_type")), "255044462D312E37", "FF00FE01")
    files = events(spark, d).select(F.col("user_id").alias("upload_id"), F.col("event_id").alias("ord"), F.lit("f").alias("name"), F.unhex(body).alias("content"))
    return uploads.discover(files, uploads.LIMITS | {"files": 20}).select("upload_id", "ord", "mime", "reason")


@query("SELECT event_id, ['text/plain', 'image/jpeg', NULL, 'application/zip', NULL][1 + event_id % 5] AS mime, ['', '', 'executable', '', 'unsupported_type'][1 + event_id % 5] AS reason FROM events")
def sniffed_types(spark, d):
    body = cases(F.col("event_id") % 5, F.hex(F.col("event_type")), "FFD8FFE000104A46", "7F454C4602", "504B03041400", "00010203")
    return events(spark, d).withColumn("s", uploads.sniff(F.unhex(body))).select("event_id", "s.mime", "s.reason")


@query("SELECT event_type AS person, 'f' || event_id || '.jpg' AS image FROM events WHERE value > 50")
def labelled_folders(spark, d):
    path = F.when(F.col("value") > 50, F.concat(F.lit("/faces/"), "event_type", F.lit("/f"), F.col("event_id").cast("string"), F.lit(".jpg"))).otherwise(F.lit("readme.txt"))
    return face_ops.labelled(events(spark, d).select(path.alias("path"))).select("person", "image")


@query("SELECT c_custkey, ['phone', 'email', '', 'phone', ''][1 + c_custkey % 5] AS kind FROM customer")
def identifier_kinds(spark, d):
    k = F.col("c_custkey").cast("string")
    x = cases(F.col("c_custkey") % 5, F.concat(F.lit(" +91 98765-4"), F.lpad(k, 6, "0")), F.concat(F.lit("U"), k, F.lit("@Example.com")), k, F.concat(F.lit("9"), F.lpad(k, 9, "0")), F.concat(F.lit("u @x."), k))
    return t(spark, d, "customer").select("c_custkey", intake.identifier_kind(x).alias("kind"))


@query("""
    SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 MINUTE AS session_over, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE AS upload_over,
        CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE THEN 'expired' WHEN event_id % 8 >= 5 THEN 'too_many_attempts' WHEN event_id % 3 = 0 THEN 'signed_in' ELSE 'wrong_code' END AS challenge
    FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def expiry_sweeps(spark, d):
    now, at = F.lit("2024-01-15 00:00:00").cast("timestamp"), F.col("ts")
    return events(spark, d).select("event_id", intake.expired(at, now, C.SESSION_SECONDS).alias("session_over"), intake.expired(at, now, C.UPLOAD_SECONDS).alias("upload_over"), intake.challenge_state(at, now, F.col("event_id") % 8, F.col("event_id") % 3 == 0).alias("challenge"))


# --- stores


def _notes(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id, NULL, 'again' FROM events WHERE value > 50")
def append_only_log(spark, d):
    e = events(spark, d)
    return rel.append(_notes(spark, d), e.where("value > 50").select("event_id", F.lit("again").alias("event_type")))


@query("SELECT CAST(7 + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS id, event_id FROM events UNION ALL SELECT 7, -1")
def audit_log(spark, d):
    have = spark.sql("SELECT 7L AS id, -1L AS event_id")
    return rel.audit(have, events(spark, d).select("ts", "event_id"), "ts", "event_id")


@query("SELECT sha256(text) AS hash, CAST(length(text) AS INTEGER) AS n FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def blob_store(spark, d):
    docs = t(spark, d, "documents").where("text IS NOT NULL")
    have = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("hash"), F.col("text").alias("content")).distinct()
    return rel.blobs(have, docs.select(F.col("text").alias("content"))).select("hash", F.length("content").alias("n"))


@query("SELECT c_custkey AS gid, CASE WHEN c_nationkey < 12 OR c_custkey % 4 = 0 THEN 1 ELSE 0 END AS revoked, CASE WHEN c_custkey % 4 = 0 THEN 'old' WHEN c_nationkey < 12 THEN 'asked' END AS revoke_reason FROM customer")
def revoked_records(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    have = c.select(k.alias("gid"), (k % 4 == 0).cast("int").alias("revoked"), F.lit(None).cast("timestamp").alias("revoked_at"), F.when(k % 4 == 0, F.lit("old")).alias("revoke_reason"))
    asked = c.where("c_nationkey < 12").select(k.alias("gid"), F.lit("asked").alias("reason"))
    return rel.revoke(have, asked.unionByName(asked), "gid", F.lit("2026-01-01").cast("timestamp")).select("gid", "revoked", "revoke_reason")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value <= 50 THEN 'removed_by_user' WHEN event_type = 'click' THEN 'pending' ELSE 'ready' END AS status FROM events")
def reactivated_documents(spark, d):
    e = events(spark, d)
    have = e.select("event_id", F.when(F.col("event_type") == "click", F.lit("removed_by_user")).otherwise(F.lit("ready")).alias("status"), F.lit("2025-01-01").cast("timestamp").alias("removed_at"))
    return rel.reactivate(have, e.where("value > 50"), ["event_id"], F.lit("pending")).select("event_id", "status")


# --- records


def _agreed(spark, d) -> DataFrame:
    """Clusters of name, date and gender for each order."""
    o = with_part(spark, d, "o_orderkey")
    n = F.col("o_orderkey")
    row = lambda field, value, asserted: F.struct(F.lit(field).alias("field"), value.alias("value"), asserted.alias("asserted"))
    no = F.lit("")
    each = F.array(row("holder_name", F.upper("p_name"), no), row("dob", F.when(n % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(no), no), row("gender", F.when(n % 3 == 0, F.lit("F")).otherwise(no), F.when(n % 3 == 1, F.lit("male")).otherwise(no)))
    same = {"agreeing": "voter,pan", "dissenting": "passport=X,aadhaar=Y", "sources": "vision,ocr", "unreadable": "", "abstained": "pan"}
    return o.select(n.alias("application_id"), F.explode(each).alias("x")).select("application_id", "x.*", *[F.lit(v).alias(c) for c, v in same.items()], F.lit(0.75).alias("confidence"), F.lit(False).alias("strong"))


_AGREED = "a AS (SELECT o_orderkey, upper(p_name) AS name, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') ELSE '' END AS dob, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS gender, o_custkey FROM orders JOIN part ON p_partkey = 1 + o_orderkey % (SELECT max(p_partkey) FROM part)), h AS (SELECT *, CASE WHEN dob <> '' THEN sha256(array_to_string(list_sort(string_split(name, ' ')), ' ') || '|' || dob || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE '' END) END AS hash FROM a)"


@query(f"WITH {_AGREED} SELECT o_orderkey AS application_id, name AS holder_name, dob, gender, hash, 'pan,voter' AS sources, 'aadhaar,passport' AS dissenting, CASE o_orderkey % 3 WHEN 1 THEN 'unverified' WHEN 0 THEN 'verified' END AS gender_state FROM h")
def consensus_records(spark, d):
    made = records.consensus(_agreed(spark, d), PIVOT)
    name = F.col("fields")["holder_name"]
    return made.withColumn("s", records.summary(F.col("fields"))).select("application_id", "s.*", records.record_hash(F.col("fields"), PIVOT).alias("hash"), F.array_join(name["sources"], ",").alias("sources"), F.array_join(name["dissenting"], ",").alias("dissenting"), F.try_element_at("fields", F.lit("gender"))["verification"].alias("gender_state"))


_LIVE = "live AS (SELECT hash, min('G' || o_orderkey) AS gid FROM h WHERE o_orderkey % 10 = 1 AND hash IS NOT NULL GROUP BY 1), num AS (SELECT o_custkey, min('G' || o_orderkey) AS gid FROM h WHERE o_orderkey % 10 = 1 GROUP BY 1)"


def _issued(spark, d) -> tuple[DataFrame, DataFrame]:
    agreed = written(records.fingerprinted(records.consensus(_agreed(spark, d), PIVOT), PIVOT), "consensus")  # read three times
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("application_id"), "o_custkey")
    old = agreed.where("application_id % 10 = 1").select(F.concat(F.lit("G"), "application_id").alias("gid"), "dedup_hash", F.lit(0).alias("revoked"), "application_id")
    docs = o.select("application_id", F.lit("pan").alias("doc_type"), F.concat(F.lit("N"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("number"), F.lit(True).alias("valid"))
    linked = old.join(docs, "application_id").select("number", "gid")
    decided = o.select("application_id", (F.col("application_id") % 10 != 2).alias("issuable"))
    return records.issue(agreed, decided, docs, old.drop("application_id"), linked, PIVOT, "salt"), docs


@query(f"""
    WITH {_AGREED}, {_LIVE}, x AS (SELECT h.*, live.gid AS by_hash, num.gid AS by_number, row_number() OVER (PARTITION BY coalesce(h.hash, CAST(o_orderkey AS VARCHAR)), o_orderkey % 10 <> 2 AND live.gid IS NULL ORDER BY o_orderkey) AS n0 FROM h LEFT JOIN live USING (hash) LEFT JOIN num ON num.o_custkey = h.o_custkey),
    y AS (SELECT *, row_number() OVER (PARTITION BY coalesce(hash, CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey) AS n FROM x WHERE o_orderkey % 10 <> 2)
    SELECT o_orderkey AS application_id, coalesce(by_hash, by_number, 'GID-' || upper(left(sha256(coalesce(hash, CAST(o_orderkey AS VARCHAR)) || '|salt'), 12))) AS gid, by_hash IS NULL AND by_number IS NULL AND n = 1 AS issued, CASE WHEN by_hash IS NOT NULL THEN 'same_identity' WHEN by_number IS NOT NULL THEN 'same_document_number' WHEN n = 1 THEN 'new' ELSE 'same_identity' END AS reason, right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) AS suffix FROM y
    UNION ALL SELECT o_orderkey, NULL, false, 'not_issuable', right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) FROM h WHERE o_orderkey % 10 = 2""")
def issued_records(spark, d):
    made, _ = _issued(spark, d)
    return made.select("application_id", "gid", "issued", "reason", F.col("documents")[0]["suffix"].alias("suffix"))


@query("SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'not_found' WHEN c_custkey % 4 = 0 THEN 'revoked' WHEN c_custkey % 3 = 0 THEN 'invalid_scope' ELSE '' END AS error, CASE WHEN c_custkey % 3 = 1 THEN 'dob,photo' WHEN c_custkey % 3 = 2 THEN 'holder_name,dob,gender' ELSE '' END AS scope, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 THEN left(sha256(c_custkey || '|salt'), 32) END AS token FROM customer")
def share_tokens(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    scope = cases(k % 3, F.array(F.lit("nothing")), F.array(F.lit("dob"), F.lit("bogus"), F.lit("photo")), F.array().cast("array<string>"))
    asked = c.select(k.alias("request_id"), k.alias("gid"), scope.alias("scope"), F.lit(True).alias("single_use"))
    live = c.where(k % 5 != 0).select(k.alias("gid"), (k % 4 == 0).cast("int").alias("revoked"))
    return records.share(asked, live, F.lit("2026-01-01").cast("timestamp"), 900, "salt").select("request_id", "error", F.array_join("scope", ",").alias("scope"), "token")


@query("SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN 'unsupported_confirmation_decision' WHEN c_custkey % 6 = 0 THEN 'field_required' WHEN c_custkey % 5 = 0 THEN 'no_comparison' WHEN c_custkey % 4 = 0 THEN 'comparison_superseded' WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'field_not_confirmable' ELSE '' END AS error FROM customer")
def confirmation_errors(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    asked = c.select(k.alias("request_id"), k.alias("application_id"), F.when(k % 4 == 0, F.lit("old")).otherwise(F.lit("last")).alias("comparison_id"), F.when(k % 6 != 0, F.lit("dob")).alias("field"), F.when(k % 7 != 0, F.lit("same_person")).otherwise(F.lit("other")).alias("decision"))
    latest = c.where(k % 5 != 0).select(k.alias("application_id"), F.lit("last").alias("comparison_id"), F.when(k % 3 == 0, F.lit("document_conflict")).otherwise(F.lit("likely_match_needs_confirmation")).alias("verdict"), F.array(F.lit("dob")).alias("confirmable"), F.create_map(F.lit("dob"), F.when(k % 2 == 0, F.lit("reject")).otherwise(F.lit("needs_confirmation"))).alias("severities"))
    return reconcile.confirmation_errors(asked, latest).select("request_id", "error")


@query("SELECT c_custkey, replace(replace('{\"name\":\"' || c_name || '\",\"list\":[\"no ' || lpad(CAST(c_custkey AS VARCHAR), 12, '5') || '\"],\"deep\":{\"number\":\"' || lpad(CAST(c_custkey AS VARCHAR), 12, '5') || '\"}}', lpad(CAST(c_custkey AS VARCHAR), 12, '5'), '********' || right(lpad(CAST(c_custkey AS VARCHAR), 12, '5'), 4)), ' ', ' ') AS shown FROM customer")
def deep_redaction(spark, d):
    n = F.lpad(F.col("c_custkey").cast("string"), 12, "5")
    value = F.struct(F.col("c_name").alias("name"), F.array(F.concat(F.lit("no "), n)).alias("list"), F.struct(n.alias("number")).alias("deep"))
    out = text.redact_all(value, "name string, list array<string>, deep struct<number: string>", F.array(n, F.lit("")))
    return t(spark, d, "customer").select("c_custkey", F.to_json(out).alias("shown"))


# --- faces


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN least(l_quantity * 4, 100) < 48 THEN 'face_too_small' END, CASE WHEN l_quantity * 4 * 100 / 1000000.0 < 0.006 THEN 'face_too_small_relative' END, CASE WHEN l_discount * 10 < 0.4 THEN 'low_detection_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem")
def face_quality(spark, d):
    why = face_ops.face_reasons(F.col("l_quantity") * 4, F.lit(100.0), F.lit(1000.0), F.lit(1000.0), F.col("l_discount") * 10)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(why, ",").alias("reasons"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS face FROM events GROUP BY 1")
def strongest_face(spark, d):
    faces = events(spark, d).select("user_id", F.col("event_id").alias("face"), F.col("value").alias("score"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    return face_ops.strongest(faces, "user_id").select("user_id", "face")


@query("SELECT vec_id, label < 5 AS cached, CASE WHEN label < 5 THEN embedding[1] ELSE -embedding[1] END AS first FROM embeddings")
def face_cache(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    new = v.select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return face_ops.embedded(v.select("vec_id"), v.where("label < 5"), new, "vec_id").select("vec_id", "cached", F.col("embedding")[0].alias("first"))
