"""Goldens of functions, rules and stores; every query with SQL is held against DuckDB at the smallest scale."""

import io
import os
import random
import re
import subprocess
import sys
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corrobora import queries, settings
from corrobora.functions import alignment, fields, numbers, responses, text
from corrobora.operators import faces
from corrobora.operators import relational as rel
from corrobora.plans import evidence, extraction, intake, pages, reconcile, records
from corrobora.sources import page_text, readers, uploads
from corrobora.streaming import limits

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select(make(F.col("x")).alias("v"), "i").orderBy("i").collect()]


def test_dates(spark):
    given = ["12/08/1997", "12-08-1997", "12.08.1997", "1997-08-12", "12 Aug 1997", "12-AUG-1997", "21 / 05 / 1990", "05/06/1990", "32/13/1990", "not a date", "", None, "1990", "08/25/1990", "August 12, 1997", "12/08/97", "12/08/12", "30/02/2000"]
    got = values(spark, given, lambda c: fields.date(c, 26))
    assert [g["iso"] for g in got] == ["1997-08-12"] * 6 + ["1990-05-21", "1990-06-05", None, None, None, None, None, "1990-08-25", "1997-08-12", "1997-08-12", "2012-08-12", None]
    assert [i for i, g in enumerate(got) if g["ambiguous"]] == [0, 1, 2, 7, 15, 16]
    assert got[8]["reason"] == "impossible-date" and got[9]["reason"] == "unparsed" and got[11]["reason"] == "empty" and got[12]["reason"] == "year-only"


def test_genders_names_addresses(spark):
    assert values(spark, ["M", "Male", "पुरुष", "पुरुष / MALE", "F", "महिला", "Transgender", "", None, "?x"], fields.gender) == ["M", "M", "M", "M", "F", "F", "O", "", "", "O"]
    n = values(spark, ["Mr. Asha  Devi", "MD SAKIR", "Mr.", None], fields.name)
    assert n[0]["ordered"] == "ASHA DEVI" and "MUHAMMED SAKIR" in n[1]["alternates"] and n[1]["ordered"] == "MD SAKIR" and n[2]["ordered"] == n[3]["ordered"] == ""
    a = values(spark, ["  12 mg road ,, bengaluru  560001 ", None, "0 x, y, Kerala, India"], fields.address)
    assert a[0]["text"] == "12 MG ROAD, BENGALURU 560001" and a[0]["postal_code"] == "560001" and a[0]["house"] == "12 MG ROAD"
    assert a[1]["text"] == "" and a[2]["state"] == "KERALA" and a[2]["country"] == "INDIA" and a[2]["street"] == ""  # parts without digits equal a missing postal code


def test_check_digits(spark):
    assert values(spark, ["L898902C3", "740812", "120415", "a"], numbers.mrz_check) == [6, 2, 9, -1]
    bodies = [f"{n:011d}" for n in (0, 1, 99999999999, 12345678901, 23456789012)]
    digit = values(spark, bodies, numbers.verhoeff_digit)
    good = [b + d for b, d in zip(bodies, digit)]
    assert all(values(spark, good, numbers.verhoeff_valid))
    wrong = [g[:i] + str((int(g[i]) + k) % 10) + g[i + 1 :] for g in good[3:4] for i in range(12) for k in range(1, 10)]
    assert not any(values(spark, wrong, numbers.verhoeff_valid)) and values(spark, ["", None], numbers.verhoeff_valid) == [False, False]
    assert values(spark, ["BQ1PS8241E", "XX"], lambda c: numbers.repair_positional("pan", c)) == ["BQIPS8241E", "XX"]
    assert values(spark, ["", "ABCDE1234F", "ABCDE12345", "AB"], lambda c: numbers.number_reason(F.lit("pan"), c)) == ["empty", "", "pattern_mismatch", "wrong_length"]
    assert values(spark, ["x"], lambda c: numbers.number_reason(F.lit("driving_licence"), c)) == ["unknown_document_type"]


def test_names():
    assert alignment.osa("ASHA", "ASAH") == 1 and alignment.plain_distance("ASHA", "ASAH") == 2 and alignment.osa("CA", "ABC") == 3
    assert alignment.jaro_winkler("ABXXXXXX", "ABYYYYYY") == pytest.approx(0.6) and alignment.jaro_winkler("", "A") == 0
    verdict = lambda a, b: alignment.compare_names(a, b)[0]
    assert verdict("Asha Devi", "ASHA DEVI") == "identical"
    assert verdict("ASHA DEVI", "DEVI ASHA") == verdict("ASHADEVI", "ASHA DEVI") == verdict("MD SAKIR", "MUHAMMED SAKIR") == "safe_variant"
    assert verdict("MUHAMMED SAKIR", "MUHAMMAD SAKIR") == verdict("ASHA DEVI P", "ASHA DEVI PARATHODI") == verdict("", "X") == "needs_confirmation"
    assert verdict("ASHA DEVI", "ROBERT JONES") == "different"
    assert alignment.diff("MUHAMMED", "MUHAMMAD") == "MUHAMM[E→A]D" and alignment.name_diff("K MUHAMMAD SAKIR", "MUHAMMED SAKIR K") == "MUHAMM[A→E]D"


def test_text(spark):
    assert values(spark, ["1234 5678 9012", "1234", None], text.mask) == ["********9012", "****", "****"]
    df = spark.createDataFrame([("a 123456 and 12345678", ["123456", "12345678", ""])], "t string, n array<string>")
    assert df.select(text.redact(F.col("t"), F.col("n"))).first()[0] == "a **3456 and ****5678"
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, c array<double>, d array<double>, z array<double>, s array<double>")
    assert list(v.select(*[text.cosine(F.col("a"), F.col(c)) for c in "bcdzs"]).first()) == [1.0, 0.0, -1.0, None, None]


def test_page_text(spark):
    page = "Name: Asha Devi\nFather's Name\nRam Devi\nDOB: 12/08/1997\nSex: F\nABCDE1234F"
    [got] = values(spark, [page], page_text.page_fields)
    assert got["holder_name"] == "Asha Devi" and got["father_name"] == "Ram Devi" and got["dob"] == "12/08/1997" and got["gender"] == "F" and got["document_number"] == "ABCDE1234F"
    lines = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    good, bad, none = values(spark, [lines, lines.replace("7408122", "7408132"), "x"], lambda c: page_text.mrz(c, 26))
    assert (good["surname"], good["given"], good["dob"], good["sex"], good["expiry"], good["valid"]) == ("ERIKSSON", "ANNA MARIA", "1974-08-12", "F", "2012-04-15", True)
    assert not bad["valid"] and none is None
    assert values(spark, ["born 23/11/2000"], lambda c: fields.evidence_contains("dob", F.lit("2000-11-23"), c, 26)) == [True]


PAGES = ["Name: Asha Devi\nDOB: 12/08/1997\nSex: F\nABCDE1234F", "card 1234 5678 9012 of the holder", "no. K1234567", "XYZ 1234567", "a1234567 the", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10", "t h-e", "", None]


def test_page_queries_read_whole_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    patterns = [r"\b([A-Z]{5}\s?\d{4}\s?[A-Z])\b", r"\b(\d{4}\s?\d{4}\s?\d{4})\b", r"\b([A-Z]{3}\s?\d{7})\b", r"\b([A-Z]\d{7})\b"]
    number = lambda p: next((m[1] for q in patterns if (m := re.search(q, p or ""))), None)
    out = {r["doc_id"]: r for r in queries.page_fields(spark, str(tmp_path)).collect()}
    assert [out[i]["document_number"] for i in range(len(PAGES))] == [number(p) for p in PAGES]
    assert [out[i]["the_seen"] for i in range(len(PAGES))] == ["the" in re.sub("[^a-z0-9]", "", (p or "").lower()) for p in PAGES]
    one = out[0]
    assert (one["holder_name"], one["dob"], one["gender"]) == ("Asha Devi", "12/08/1997", "F") and one["holder_name_seen"] and one["dob_seen"] and one["document_number_seen"] and not one["address_seen"]
    assert out[5]["mrz_surname"] == "ERIKSSON" and out[5]["mrz_valid"] and out[0]["mrz_surname"] is None


def test_pages_declare_their_type(spark):
    aadhaar = "Government of India\nAsha Devi\nMALE\nDOB: 12/08/97\n2345 6789 0123\nAadhaar"
    zone = "Name: Someone Else\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    out = values(spark, [aadhaar, zone, "Certificate of Birth\nMother: Sita Devi", "पिता: रमन\nABCDE1234F", "", None], lambda c: page_text.page_reading(c, 26))
    assert [r["document_type"] for r in out] == ["aadhaar", "passport", "birth_certificate", "pan", "unknown", "unknown"]
    assert (out[0]["holder_name"], out[0]["dob"], out[0]["document_number"]) == ("Asha Devi", "12/08/97", "2345 6789 0123")
    assert (out[1]["holder_name"], out[1]["dob"], out[1]["expiry_date"]) == ("ANNA MARIA ERIKSSON", "1974-08-12", "2012-04-15")
    assert out[2]["mother_name"] == "Sita Devi" and out[3]["father_name"] == "रमन" and out[5]["holder_name"] is None


def test_answers_are_salvaged(spark):
    given = ['{"a": 1}', 'x ```json\n{"a": 1,}\n``` y', "{a: 1}", "“{”", "[1]", "", None, '{"a": [null, 2], "b": {"raw_value": " N/A "}, "c": false}', '{"a": "' + "x" * 50_000 + '"}']
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").withColumn("a", responses.answer(F.col("x")))
    value = lambda k: responses.plain(F.try_element_at("a.fields", F.lit(k)))
    out = df.select("a.error", *[value(k).alias(k) for k in "abc"]).collect()
    assert [r["error"] for r in out] == ["", "", "", "not_json", "not_an_object", "empty", "empty", "", ""]
    assert [r["a"] for r in out[:3]] == ["1"] * 3 and (out[7]["a"], out[7]["b"], out[7]["c"]) == ("2", None, None) and len(out[8]["a"]) == 50_000
    assert values(spark, ["PAN Card", "aadhaar|pan", "Driver's License", None, "EPIC"], responses.document_type) == ["pan", "unknown", "driving_licence", "unknown", "voter"]
    assert values(spark, ["1" * 30, "<?xml x='y'?>", "<PrintLetterBarcodeData uid=\"1\"/>", "12", None], responses.code_payload)[:2] == [None, None]


def test_readings_of_awkward_answers(spark):
    rows = [(1, '{"Sex": null, "gender": "F", "name": "A"}'), (2, "nothing"), (3, '{"other": 1}'), (4, None)]
    out = extraction.readings(spark.createDataFrame(rows, "doc_id int, response string")).collect()
    assert {(r["doc_id"], r["field"], r["value"]) for r in out if r["value"]} == {(1, "gender", "F"), (1, "holder_name", "A")}
    assert {r["doc_id"]: r["error"] for r in out} == {1: "", 2: "not_json", 3: "no_expected_field", 4: "empty"}


def test_uploads_are_discovered(spark):
    def archive(*entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    png, pdf = b"\x89PNG\r\n\x1a\n" + b"x" * 20, b"%PDF-1.7 "
    rows = [(1, 0, "a", png), (1, 1, "z", archive(("p.png", png), ("q.pdf", pdf), ("r.txt", b"hello"))), (1, 2, "b", b""), (1, 3, "c", b"MZ"), (1, 4, "d", pdf), (1, 5, "e", png), (2, 0, "a", png), (2, 1, "n", None)]
    df = spark.createDataFrame(rows, "upload_id long, ord long, name string, content binary")
    out = uploads.discover(df, uploads.LIMITS | {"files": 6}, lambda data: [b"\xff\xd8\xff1", b"\xff\xd8\xff2"]).collect()
    got = sorted((r["upload_id"], r["ord"], r["entry"], r["reason"]) for r in out)
    assert got == [(1, 0, "", ""), (1, 1, "p.png", ""), (1, 1, "q.pdf#page=1", ""), (1, 1, "q.pdf#page=2", ""), (1, 1, "r.txt", ""), (1, 2, "", "empty_file"), (1, 3, "", "executable"), (1, 4, "d#page=1", ""), (1, 4, "d#page=2", "max_files"), (1, 5, "", "max_files"), (2, 0, "", ""), (2, 1, "", "empty_file")]


def test_pages_of_two_people_stay_apart(spark):
    page = lambda i, kind="aadhaar", role=None, number="", name="", path="", fields=None: (1, f"d{i}", i, kind, role, number, name, path, fields or {})
    rows = [page(0, name="ASHA DEVI", fields={"dob": "x"}), page(1, name="DEVI ASHA", fields={"address": "y"}), page(2, name="RAM DEVI", fields={"address": "y"}), page(3, path="f.pdf#page=1", fields={"gender": "F"}), page(4, path="f.pdf#page=2", fields={"address": "z"}), page(5, "pan", number="A 1"), page(6, "pan", "back", number="a-1"), page(7, "pan", "back", number="A2"), page(8, role="front"), page(9, role="back")]
    schema = "application_id long, document_id string, ord int, doc_type string, page_role string, document_number string, holder_name string, relative_path string, fields map<string,string>"
    got = {r["document_id"]: (r["logical_id"], r["page_role"], r["signal"]) for r in pages.grouped(spark.createDataFrame(rows, schema)).collect()}
    assert got["d0"] == ("d0", "front", "same_holder_name") and got["d1"] == ("d0", "back", "same_holder_name") and got["d2"][0] == "d2"
    assert got["d3"] == ("d3", "front", "same_source_file") and got["d4"][0] == "d3" and got["d6"][0] == "d5" and got["d7"][0] == "d7" and got["d8"][0] == "d8" and got["d9"][0] == "d9"


def test_archives():
    def archive(*entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    png = b"\x89PNG\r\n\x1a\n" + b"x" * 20
    got = {n: r for n, _, r in uploads.entries(archive(("a.png", png), ("../b.png", png), ("/c.png", png), ("d.exe", b"MZ123"), ("e.zip", archive(("x", b"y"))), ("big.png", png + b"\0" * 3_000_000), ("__MACOSX/a", b"1")))}
    assert got == {"a.png": "", "../b.png": "path_traversal", "/c.png": "absolute_path", "d.exe": "unsupported_type", "e.zip": "nested_archive", "big.png": "compression_ratio"}
    assert [r for *_, r in uploads.entries(b"no")] == ["not_an_archive"] and uploads.unsafe_path("a\0b") == "null_byte_in_path" and uploads.unsafe_path("C:/x") == "absolute_path"


def reading(field, ord, value, kind="aadhaar", source="vision", status="present_verified", raw=None, app=1):
    return (app, field, f"d{ord}", f"d{ord}", ord, kind, "front", value, source, status, raw)


READING = "application_id long, field string, document_id string, logical_id string, ord int, doc_type string, page_role string, value string, source string, status string, raw_value string"


def test_reconciliation(spark):
    rows = [reading("holder_name", i, v, k) for i, (v, k) in enumerate([("ASHA DEVI", "aadhaar"), ("DEVI ASHA", "pan"), ("ASHA DEWI", "voter")])]
    rows += [reading("dob", 0, "12/08/1997"), reading("dob", 1, "1997-08-12", "pan"), reading("dob", 2, "13/08/1997", "passport"), reading("gender", 0, "F"), reading("gender", 1, "M", "pan"), reading("gender", 3, "", "aadhaar")]
    rows += [reading("dob", 0, "1990-01-01", "aadhaar", "barcode", app=2), reading("dob", 1, "1985-12-31", "pan", app=2), reading("dob", 2, "1985-12-31", "passport", app=2)]
    out = {(r["application_id"], r["field"]): r for r in reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26).collect()}
    n, d, g = out[1, "holder_name"], out[1, "dob"], out[1, "gender"]
    assert n["value"] == "ASHA DEVI" and n["n_agree"] == 2 and n["confirmable"] == 1 and n["support"] == 3 and n["severity"] == "needs_confirmation"
    assert d["value"] == "1997-08-12" and d["corroboration"] == 2 and d["status"] == "disagreement"
    assert g["value"] == "F" and g["status"] == "single_source"  # a pan card prints no gender
    assert out[2, "dob"]["value"] == "1990-01-01" and out[2, "dob"]["n_dissent"] == 2 and out[2, "dob"]["severity"] == "reject"
    decided = {r["application_id"]: r["decision"] for r in reconcile.decide(spark.createDataFrame(list(out.values()), reconcile.CLUSTERS)).collect()}
    assert decided == {1: "likely_match_needs_confirmation", 2: "document_conflict"}


def test_addresses_reconcile(spark):
    texts = ["12 MG Road, Indiranagar, Bengaluru, Karnataka 560038", "12 mg rd,, indiranagar, bengaluru 560038.", "Flat 9, Koramangala 560038", "17 Hill Lane, Kochi, Kerala 682001", "Hill Lane Kochi", "9 Kochi Fort", "", "12 MG"]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string").select(*[fields.address(F.col(c)).alias(c) for c in "ab"])
    for r in df.select("a.text", F.col("b.text").alias("other"), fields.address_relation(F.col("a"), F.col("b"))["relation"].alias("want")).collect():
        assert alignment.address_relation(r["text"], r["other"]) == r["want"], r
    rows = [reading("address", i, v, "birth_certificate") for i, v in enumerate(texts[:3])] + [reading("address", i, v, "birth_certificate", app=2) for i, v in enumerate([texts[0], texts[3]])]
    out = {r["application_id"]: r for r in reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26).collect()}
    assert (out[1]["n_agree"], out[1]["corroboration"], out[1]["confirmable"], out[1]["n_dissent"]) == (2, 2, 1, 0)
    assert (out[2]["n_agree"], out[2]["confirmable"], out[2]["n_dissent"], out[2]["severity"]) == (1, 0, 1, "info")


def test_document_states_decide(spark):
    rows = [reading(f, i, v, k, app=a) for a in (1, 2) for f, v in (("holder_name", "ASHA DEVI"), ("dob", "1997-08-12")) for i, k in enumerate(["aadhaar", "passport"])]
    states = [(1, "ready"), (1, "retake_required"), (3, "retake_required"), (3, "rejected_file"), (4, "rejected_file"), (4, "unreadable"), (5, "unreadable"), (6, None), (7, "ready"), (8, "retake_required")]
    clusters = reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26)
    failed = spark.createDataFrame([(8,), (9,), (8,)], "application_id long")
    out = reconcile.decide(clusters, failed, spark.createDataFrame(states, "application_id long, status string")).collect()
    assert {r["application_id"]: r["decision"] for r in out} == {1: "verified_match", 2: "verified_match", 3: "retake_required", 4: "rejected_invalid_document", 5: "extraction_failed", 6: "extraction_failed", 7: "insufficient_evidence", 8: "blocked_security_integrity", 9: "blocked_security_integrity"}
    assert len(out) == 9 and all(r["issuable"] == (r["application_id"] < 3) and r["needs_review"] == (r["application_id"] > 7) for r in out)
    per = queries.decisions(spark, SF)
    assert per.count() == queries.documents(spark, SF).select("application_id").distinct().count()
    assert {"retake_required", "rejected_invalid_document", "extraction_failed"} < {r[0] for r in per.select("decision").distinct().collect()}


def test_numbers_are_not_compared_and_pools_are(spark):
    rows = [reading("document_number", 0, "ABCDE1234F", "pan"), reading("document_number", 1, "XYZ1234567", "voter"), reading("nationality", 0, "IN", "passport"), reading("age", 0, "30", "voter")]
    rows += [reading("father_name", 0, "RAM DEVI", "pan"), reading("spouse_name", 1, "RAM DEVI", "voter"), reading("father_name", 1, "", "voter"), reading("spouse_name", 0, "NOBODY", "pan")]
    rows += [reading("father_name", 2, "KARL", "birth_certificate", status="present_uncertain", raw="KARL")]
    out = {r["field"]: r for r in reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26).collect()}
    assert set(out) == {"guardian_name"}
    g = out["guardian_name"]
    assert (g["value"], g["agreeing"], g["status"], g["unreadable"], g["severity"]) == ("RAM DEVI", "pan,voter", "agreement", "birth_certificate", "none")


def test_holders_settle_soft_differences_only(spark):
    rows = [reading("holder_name", i, v, k) for i, (v, k) in enumerate([("ASHA DEVI", "aadhaar"), ("ASHA DEVI", "pan"), ("ASHA DEWI", "voter"), ("ROBERT JONES", "passport")])]
    df, reg = spark.createDataFrame(rows, READING), evidence.registry(spark)
    said = spark.createDataFrame([(1, "holder_name", ["asha devi", "Asha Dewi", "Robert Jones"])], "application_id long, field string, values array<string>")
    before, after = reconcile.compare(df, reg, 26).first(), reconcile.compare(df, reg, 26, said).first()
    assert (before["n_agree"], before["confirmable"], before["n_dissent"], before["confirmed"]) == (2, 1, 1, 0)
    assert (after["n_agree"], after["confirmable"], after["n_dissent"], after["confirmed"], after["corroboration"]) == (3, 0, 1, 1, 3)


def test_holders_values_stay_unverified(spark):
    rows = [reading("gender", 0, "F", "pan"), reading("dob", 0, None, "aadhaar", "user", "holder_asserted", "1990-01-02"), reading("dob", 1, "", "passport")]
    out = reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26)
    got = {r["field"]: r for r in out.collect()}
    assert (got["dob"]["status"], got["dob"]["asserted"], got["dob"]["holder"], got["gender"]["status"]) == ("not_extracted", "1990-01-02", True, "not_applicable")
    made = records.consensus(out, 26).first()["fields"]
    assert made["dob"]["verification"] == "unverified" and made["dob"]["value"] == "1990-01-02" and "gender" not in made


def test_unknown_pages_may_carry_anything(spark):
    rows = [reading("gender", 0, "F", "library_card"), reading("gender", 1, "F", "voter")]
    assert reconcile.compare(spark.createDataFrame(rows, READING), evidence.registry(spark), 26).first()["n_agree"] == 2


def slow_osa(a, b):
    if not a or not b:
        return len(a) + len(b)
    best = min(slow_osa(a[1:], b) + 1, slow_osa(a, b[1:]) + 1, slow_osa(a[1:], b[1:]) + (a[0] != b[0]))
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, slow_osa(a[2:], b[2:]) + 1)
    return best


def slow_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach, used, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    m, other = len(mine), [b[j] for j in sorted(used)]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, other)) / 2) / m) / 3
    prefix = next((i for i in range(4) if i >= min(len(a), len(b)) or a[i] != b[i]), 4)
    return jaro + prefix * 0.1 * (1 - jaro)


def test_string_measures_are_their_definitions():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("ABC", k=rng.randrange(1, 7))) for _ in range(2))
        assert alignment.osa(a, b) == slow_osa(a, b) and alignment.jaro_winkler(a, b) == pytest.approx(slow_jaro_winkler(a, b)), (a, b)


NAME_CASES = [
    ("", "", "needs_confirmation"), ("Mr. Asha Devi", "ASHA  DEVI", "identical"), ("MD SAKIR", "MOHAMMED SAKIR", "safe_variant"), ("ASHA D", "ASHA DEVI", "needs_confirmation"), ("ASHA DEVI", "ASHA", "needs_confirmation"),
    ("ASHA DEVI KUMARI", "ASHA DEVI", "identical"), ("K M SAKIR", "SAKIR K M", "safe_variant"), ("SITA RAM", "SITARAM", "safe_variant"), ("ASHA DEVI", "USHA DEVI", "needs_confirmation"), ("RED ROD", "ROX RED", "different"), ("ASHA DEVI", "JOHN SMITH", "different"), ("A", "A", "identical"),
]


@pytest.mark.parametrize(("a", "b", "verdict"), NAME_CASES)
def test_name_verdicts(a, b, verdict):
    assert alignment.compare_names(a, b)[0] == alignment.compare_names(b, a)[0] == verdict


def test_stores(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.createDataFrame([(1, "a"), (2, "b")], "app int, v string").write.partitionBy("app").parquet(path)
    rel.replace_partitions(spark.createDataFrame([(2, "c"), (2, "d")], "app int, v string"), path, "app")
    assert sorted(map(tuple, spark.read.parquet(path).select("app", "v").collect())) == [(1, "a"), (2, "c"), (2, "d")]
    docs = spark.createDataFrame([(1, "d1"), (2, "d2")], "application_id int, document_id string")
    owned, rejected = intake.resolve(spark.createDataFrame([(1, "d1"), (1, "d1"), (1, "d2")], "application_id int, document_id string"), docs)
    assert [tuple(r) for r in owned.collect()] == [(1, "d1")] and [tuple(r) for r in rejected.collect()] == [(1, "d2")]
    two = spark.createDataFrame([("n", "pan", "g1")], "number string, doc_type string, gid string")
    issued = spark.createDataFrame([(1, "g2", True), (2, "g3", False)], "application_id int, gid string, issued boolean")
    cards = spark.createDataFrame([(1, "n", "pan"), (1, "n", "voter"), (1, "", "pan"), (2, "m", "pan")], "application_id int, number string, doc_type string")
    assert sorted(map(tuple, records.links(issued, cards, two).collect())) == [("n", "pan", "g1"), ("n", "voter", "g2")]
    rates = spark.createDataFrame([(0.2, 0.5, 0.0), (0.4, 0.2, 0.1), (0.6, 0.0, 0.4)], "threshold double, far double, frr double")
    assert faces.equal_error(rates).first()[0] == 0.4
    assert values(spark, ["\ufb01", None], fields.nfkc) == ["fi", None]


def test_streams(spark, tmp_path):
    rows = [(1, i, 1_700_000_000 + t) for i, t in enumerate([0, 5, 10, 4_000, 4_001, 8_000])]
    schema = "key long, event_id long, at long"
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = limits.limited_stream(stream, 2, 3_600).writeStream.format("memory").queryName("paused").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    assert [r["allowed"] for r in spark.table("paused").orderBy("event_id").collect()] == [True, True, False, True, True, True]
    twice = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("at")).withColumn("key", F.col("event_id") % 2)
    q = limits.once(twice, "key", "time", "1 day").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    assert spark.table("once").count() == 2


def test_the_package_reaches_the_workers(tmp_path):
    """A driver that alone knows where the package lies: its workers get it from the session."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); from pyspark.sql import SparkSession; from corrobora import queries; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('rows', queries.name_comparisons(s, {SF!r}).where('osa >= 0').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 199" in out.stdout, out.stderr[-2000:]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("\ufeff# note\nA=1\nexport B = 'x y'\nC=\nissuance_enabled=no\nbad line\nD=\"q\n", encoding="utf-8")
    assert settings.load(str(tmp_path / ".env"), {"A": "0"}) == {"A": "0", "B": "x y", "C": "", "issuance_enabled": "no", "D": '"q'}
    assert settings.load(str(tmp_path / "none"), {}) == {}
    assert settings.switch("BULK_UPLOAD", {}) and not settings.switch("ISSUANCE_ENABLED", {}) and settings.switch("ISSUANCE_ENABLED", {"ISSUANCE_ENABLED": " Yes"}) and not settings.switch("BULK_UPLOAD", {"BULK_UPLOAD": "0"})


def test_contracts_are_held(spark):
    with pytest.raises(ValueError, match="ocr_texts lacks text, variant"):
        readers.handed_over(spark.range(1).withColumnRenamed("id", "doc_id"), "ocr_texts")
    got = readers.handed_over(spark.createDataFrame([("x", 1, "t", "v")], "more string, doc_id int, text string, variant string"), "ocr_texts")
    assert got.dtypes == [("doc_id", "bigint"), ("variant", "string"), ("text", "string"), ("more", "string")]


def test_signature_and_json(spark):
    assert records.canonical_json({"a": [3, {"d": 1, "c": 2}]}) == '{"a":[3,{"c":2,"d":1}]}'
    s = records.Signer(spark)
    mark = s.sign({"b": 1, "a": 2})
    assert s.verify({"a": 2, "b": 1}, mark) and not s.verify({"a": 2, "b": 2}, mark)


def test_limiter(spark, tmp_path):
    done, start, used = limits.take([0, 1, 2, 59, 60, 61], None, 0, 2, 60)
    assert [d[0] for d in done] == [True, True, False, False, True, True] and (start, used) == (60, 2)
    rows = [(1, i, 1_700_000_000 + t) for i, t in enumerate([0, 1, 2, 59, 60, 61])] + [(2, 10, 1_700_000_005)]
    df = spark.createDataFrame(rows, "key long, event_id long, at long")
    batch = {(r["event_id"], r["allowed"], r["remaining"]) for r in limits.limited(df, 2, 60).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert {(r["event_id"], r["allowed"], r["remaining"]) for r in spark.table("limited").collect()} == batch


def test_registry(spark):
    r = {(x["doc_type"], x["page_role"], x["field"]): x["carries"] for x in evidence.registry(spark).collect()}
    assert r["pan", "front", "gender"] == "no" and r["aadhaar", "front", "dob"] == "yes" and r["aadhaar", "front", "father_name"] == "partial" and r["voter", "front", "dob"] == "partial"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(", ".join(columns)).fetchall())
