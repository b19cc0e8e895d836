"""Queries over what documents say: refused fields, corrected types, pools, zones, links between pages, faces, reads by owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions import fields, numbers
from corrobora.operators import faces as face_ops
from corrobora.operators.owned import Owned
from corrobora.plans import evidence, extraction, intake, pages, reconcile
from corrobora.queries import DOCUMENTS_SQL, FACES_SQL, PIVOT, _faces, documents, query, t
from corrobora.shared import spread
from corrobora.sources import readers
from corrobora.workflow_queries import _GATE, _assessed, _gate_rows, _lines, cases

# --- what is refused, and what a holder corrects

_GATED = f"{_GATE}, s AS (SELECT *, CASE WHEN NOT given THEN 'not_present:no_value_returned' WHEN never THEN 'invalid:field_impossible_for_document' WHEN kind = 'aadhaar' AND field = 'father_name' AND NOT ev AND page <> 1 THEN 'invalid:conditional_evidence_missing' ELSE {_assessed('number', 'required')} END AS s FROM g)"


@query(f"""
    WITH {_GATED}
    SELECT event_id // 5 AS document_id, coalesce(string_agg(field || '=' || split_part(s, ':', 2) || '@' || kind, ',' ORDER BY field) FILTER (WHERE s LIKE 'invalid%'), '') AS rejected,
        coalesce(string_agg(field || '=' || s, ',' ORDER BY field) FILTER (WHERE given AND s LIKE 'present_uncertain%' OR given AND s LIKE 'not_present%'), '') AS unsupported FROM s GROUP BY 1""")
def refused_fields(spark, d):
    """Five readings a document, through the gates, and what they refuse."""
    rows = extraction.gate(_gate_rows(spark, d), evidence.registry(spark), PIVOT).withColumn("document_id", F.floor(F.col("event_id") / 5))
    found = extraction.refusals(rows, "document_id")
    told = lambda c, f: F.array_join(F.transform(c, f), ",")
    return found.select("document_id", told("rejected", lambda x: F.concat(x["field"], F.lit("="), x["reason"], F.lit("@"), x["doc_type"])).alias("rejected"), told("unsupported", lambda x: F.concat(x["field"], F.lit("="), x["status"], F.lit(":"), x["reason"])).alias("unsupported"))


@query(f"""
    WITH {DOCUMENTS_SQL}, x AS (SELECT application_id, ord, CASE WHEN l_suppkey % 4 = 0 THEN 'passport' ELSE doc_type END AS doc_type, CASE WHEN l_suppkey % 4 = 0 THEN 'holder' ELSE 'reading' END AS type_source FROM docs)
    SELECT application_id, ord, doc_type, type_source, doc_type NOT IN ('pan') AS may_show_gender FROM x""")
def corrected_types(spark, d):
    """Types that holders correct: the last correction counts, and what the page can carry follows from it."""
    docs = documents(spark, d).select("application_id", "ord", F.concat_ws("-", F.col("application_id").cast("string"), F.col("ord").cast("string")).alias("document_id"), "doc_type", "l_suppkey")
    said = docs.where("l_suppkey % 2 = 0").select("document_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(n).alias("at")) for n, (f, v) in enumerate((("document_type", F.when(F.col("l_suppkey") % 4 == 0, "pan").otherwise(" ")), ("document_type", F.when(F.col("l_suppkey") % 4 == 0, "passport").otherwise("")), ("gender", F.lit("voter"))))])).alias("x")).select("document_id", "x.*")
    carried = F.broadcast(evidence.registry(spark).where("field = 'gender' AND page_role = 'front'").select("doc_type", (F.col("carries") != "no").alias("may_show_gender")))
    return intake.typed(docs, said).join(carried, "doc_type").select("application_id", "ord", "doc_type", "type_source", "may_show_gender")


# --- pools, zones, links, faces


@query(f"""
    WITH {DOCUMENTS_SQL}, v AS (SELECT application_id, CASE WHEN l_suppkey % 3 = 0 THEN 'RAM DEVI' ELSE 'SITA KUMAR' END AS name FROM docs),
    n AS (SELECT application_id, name, count(*) AS n FROM v GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY n DESC, name) AS place, sum(n) OVER (PARTITION BY application_id) AS every FROM n)
    SELECT application_id, 'guardian_name' AS field, name AS value, CAST(n AS INTEGER) AS n_agree, CAST(every - n AS INTEGER) AS n_dissent, CASE WHEN every > n THEN 'warn' ELSE 'none' END AS severity FROM r WHERE place = 1""")
def pooled_guardians(spark, d):
    """A father's and a spouse's name are one field: the first that is verified counts; numbers of single cards are not compared."""
    docs = documents(spark, d).withColumn("document_id", F.concat_ws("-", F.col("application_id").cast("string"), F.col("ord").cast("string")))
    third = F.col("l_suppkey") % 3
    row = lambda field, value, status: F.struct(F.lit(field).alias("field"), value.alias("value"), status.alias("status"))
    sure = F.lit("present_verified")
    said = F.array(row("father_name", F.when(third < 2, "Ram Devi"), F.when(third == 0, sure).otherwise("present_uncertain")), row("spouse_name", F.lit("SITA  KUMAR"), sure), row("document_number", F.col("l_suppkey").cast("string"), sure))
    rows = docs.select("application_id", "document_id", F.col("document_id").alias("logical_id"), "ord", F.lit("voter").alias("doc_type"), F.lit("front").alias("page_role"), F.explode(said).alias("x"))
    readings = rows.select("application_id", "x.field", "document_id", "logical_id", "ord", "doc_type", "page_role", "x.value", F.lit("vision").alias("source"), "x.status", F.col("x.value").alias("raw_value"))
    return reconcile.compare(readings, evidence.registry(spark), PIVOT).select("application_id", "field", "value", "n_agree", "n_dissent", "severity")


def _zone(spark, d) -> DataFrame:
    """(c_custkey, text): passports with a machine-readable zone, one in five with a digit wrong, and cards in plain text."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    sum_ = lambda c: numbers.mrz_check(c).cast("string")
    number, born, ends = F.concat(F.lit("K"), pad(k, 8)), F.concat(pad(70 + k % 20, 2), pad(1 + k % 12, 2), pad(1 + k % 28, 2)), F.lit("300101")
    rows = spread(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(k, F.upper("c_mktsegment").alias("surname"), number.alias("number"), born.alias("born"), ends.alias("ends"), F.rpad(F.lit(""), 14, "<").alias("more"))
    marked = lambda c: F.concat(F.col(c), sum_(F.col(c)))
    rows = rows.withColumn("a", marked("number")).withColumn("b", marked("born")).withColumn("c", marked("ends")).withColumn("e", marked("more"))
    two = F.concat("a", F.lit("IND"), "b", F.lit("F"), "c", "e", sum_(F.concat("a", "b", "c", "e")))
    two = F.when(k % 5 == 0, F.concat(F.left(two, F.lit(43)), ((F.right(two, F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(two)
    zone = F.concat(F.lit("PASSPORT\n"), F.rpad(F.concat(F.lit("P<IND"), "surname", F.lit("<<ASHA<MARIA")), 44, "<"), F.lit("\n"), two)
    card = F.concat(F.lit("INCOME TAX DEPARTMENT\nName: Asha Devi\nFather's Name: Ram Devi\nDOB: 02/01/1990\nGender: Female\nABCDE"), pad(k % 10_000, 4), F.lit("F"))
    return rows.select("c_custkey", F.when(k % 2 == 0, F.when(k % 3 == 0, F.translate(zone, "<", "«")).otherwise(zone)).otherwise(card).alias("text"))


@query("""
    WITH c AS (SELECT c_custkey, upper(c_mktsegment) AS surname, 'K' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number, '19' || (70 + c_custkey % 20) || '-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS born FROM customer),
    f AS (
        SELECT c_custkey, unnest([{'f': 'holder_name', 'v': 'ASHA MARIA ' || surname}, {'f': 'dob', 'v': born}, {'f': 'gender', 'v': 'F'}, {'f': 'document_number', 'v': number}, {'f': 'expiry_date', 'v': '2030-01-01'}]) AS x, '' AS bad FROM c WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, unnest([{'f': 'holder_name', 'v': 'Asha Devi'}, {'f': 'father_name', 'v': 'Ram Devi'}, {'f': 'dob', 'v': '02/01/1990'}, {'f': 'gender', 'v': 'Female'}, {'f': 'document_number', 'v': 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F'}]), 'gender' FROM c WHERE c_custkey % 2 = 1
    )
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'passport' ELSE 'pan' END AS doc_type, x.f AS field, x.v AS value, CASE WHEN x.f = bad THEN 'invalid' ELSE 'present_verified' END AS status, CASE WHEN x.f = bad THEN 'field_impossible_for_document' ELSE 'trusted_input' END AS reason FROM f""")
def trusted_texts(spark, d):
    """Uploaded texts, with zones and without: what they say is trusted, but for what their kind of page cannot carry."""
    said = _zone(spark, d).withColumn("r", readers.trusted_text(F.col("text"), PIVOT))
    names = ("holder_name", "father_name", "mother_name", "spouse_name", "dob", "gender", "address", "document_number", "expiry_date")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in names])).alias("x")
    rows = said.select("c_custkey", F.col("r.document_type").alias("doc_type"), F.lit("front").alias("page_role"), "text", each).where("x.value IS NOT NULL")
    rows = rows.select("c_custkey", "doc_type", "page_role", "x.field", "x.value", F.lit(None).cast("string").alias("evidence"), F.col("text").alias("page_text"), F.lit(None).cast("string").alias("mrz"), F.lit("embedded-text").alias("source"))
    return extraction.gate(rows, evidence.registry(spark), PIVOT, trusted=F.lit(True)).select("c_custkey", "doc_type", "field", "value", "status", "reason")


@query("""
    WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'pan' ELSE 'aadhaar' END AS kind, l_partkey % 2 AS who, CASE WHEN l_suppkey % 2 = 0 THEN 'back' ELSE 'front' END AS role, l_orderkey % 4 AS rule FROM lineitem),
    r AS (SELECT *, CASE WHEN rule = 3 THEN ord ELSE who END AS grp FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind, grp, role ORDER BY ord) AS k FROM r),
    g AS (SELECT *, min(ord) OVER (PARTITION BY l_orderkey, kind, grp, k) AS head, count(*) OVER (PARTITION BY l_orderkey, kind, grp, k) AS n FROM k)
    SELECT l_orderkey AS application_id, l_orderkey || '-' || ord AS document_id, l_orderkey || '-' || head AS logical_id, role AS page_role, CASE WHEN n = 2 THEN ['same_document_number', 'same_holder_name', 'same_source_file'][1 + rule] ELSE 'single_page' END AS signal FROM g""")
def page_links(spark, d):
    """Each rule that links pages, on applications of its own; where numbers contradict, no name and no file links."""
    rule, who, none = F.col("application_id") % 4, F.col("l_partkey") % 2, F.lit("")
    name = F.when(who == 0, F.when(F.col("l_suppkey") % 2 == 0, "DEVI ASHA").otherwise("Asha  Devi")).otherwise("RAM KUMAR")
    file = F.concat(F.lit("in/scan"), who.cast("string"), F.lit(".pdf#page="), F.col("ord").cast("string"))
    rows = _lines(spark, d).withColumn("application_id", F.col("l_orderkey")).select(
        "application_id", "document_id", "ord", F.when(F.col("l_linenumber") % 2 == 0, F.lit("pan")).otherwise(F.lit("aadhaar")).alias("doc_type"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("back")).otherwise(F.lit("front")).alias("page_role"),
        F.when(rule == 0, F.concat(F.lit("n-"), who.cast("string"))).when(rule == 3, F.concat(F.lit("x "), F.col("ord").cast("string"))).otherwise(none).alias("document_number"), F.when(rule == 1, name).when(rule == 3, F.lit("ASHA DEVI")).otherwise(none).alias("holder_name"),
        F.when(rule == 2, file).when(rule == 3, F.lit("in/one.pdf#page=1")).otherwise(none).alias("relative_path"), F.create_map(F.lit("dob"), F.lit("")).alias("fields"),
    )
    return pages.grouped(rows)


@query(f"""
    WITH {FACES_SQL}
    SELECT app, 'face' AS field, count(*) || ' photo pair(s) compared' AS value, coalesce(string_agg(a_id || ' ↔ ' || b_id, ',' ORDER BY a_id || ' ↔ ' || b_id) FILTER (WHERE round(s, 4) >= 0.5), '') AS agreeing, CAST(count(*) FILTER (WHERE round(s, 4) < 0.5) AS BIGINT) AS n_dissent, round(avg(CASE WHEN round(s, 4) >= 0.5 THEN 1.0 ELSE 0.0 END), 2) AS confidence,
        CASE WHEN count(*) FILTER (WHERE round(s, 4) < 0.5) > 0 THEN 'disagreement' ELSE 'agreement' END AS status, CASE WHEN count(*) FILTER (WHERE round(s, 4) < 0.5) > 0 THEN 'warn' ELSE 'none' END AS severity FROM q GROUP BY app""")
def face_fields(spark, d):
    """Faces as a field of their application, which warns at most."""
    return reconcile.face_field(face_ops.pairs(_faces(spark, d), "app", "vec_id", "embedding"), "app")


# --- reads by owner


@query("""
    WITH o AS (SELECT o_custkey AS owner, o_orderkey, o_orderdate FROM orders),
    n AS (SELECT owner, count(*) AS applications, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS newest FROM o GROUP BY 1),
    docs AS (SELECT owner, count(*) AS documents, sum(CASE WHEN l_quantity > 7 THEN 1 ELSE 0 END) AS ready FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    seen AS (SELECT owner, count(*) AS shown FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT owner, applications, newest, coalesce(documents, 0) AS documents, CAST(coalesce(ready, 0) AS BIGINT) AS ready, coalesce(shown, 0) AS shown FROM n LEFT JOIN docs USING (owner) LEFT JOIN seen USING (owner)""")
def owned_reads(spark, d):
    """Applications and documents in buckets by owner: what each owner has, and what requests, half of them under another's name, are shown."""
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("application_id"), "o_orderdate")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("application_id"), F.when(F.col("l_quantity") > 7, F.lit("ready")).otherwise(F.lit("unreadable")).alias("status"))
    apps = Owned.store(orders, "owner", "applications")
    docs = Owned.store(lines.join(orders.select("owner", "application_id"), "application_id"), "owner", "documents")
    asked = orders.select(F.when(F.col("application_id") % 2 == 0, F.col("owner")).otherwise(-F.col("owner") - 1).alias("owner"), "application_id")
    newest = F.max_by("application_id", F.struct("o_orderdate", -F.col("application_id"))).alias("newest")
    own = apps.beside(docs, "application_id").groupBy("owner").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"))
    shown = apps.named(asked, "application_id").groupBy("owner").agg(F.count("*").alias("shown"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return apps.per_owner(F.count("*").alias("applications"), newest).join(own, "owner", "left").join(shown, "owner", "left").select("owner", "applications", "newest", zero("documents"), zero("ready"), zero("shown"))


# --- normal forms

_WIDE = "".join(chr(0xFF21 + i) for i in range(26))


@query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN nfc_normalize('Zoe' || chr(776) || ' ' || c_name) WHEN 2 THEN 'Office of ' || c_name WHEN 3 THEN nfc_normalize(chr(4370) || chr(4449) || chr(4523) || ' ' || c_name) ELSE c_name END AS folded,
        CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS gender
    FROM customer""")
def folded_names(spark, d):
    """Names in full width, with ligatures, with marks that join, in letters that make syllables; genders in full width."""
    said = cases(F.col("c_custkey") % 5, F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _WIDE), F.concat(F.lit("Zoe\u0308 "), "c_name"), F.concat(F.lit("O\ufb03ce\u00a0of "), "c_name"), F.concat(F.lit("\u1112\u1161\u11ab "), "c_name"), F.col("c_name"))
    sex = cases(F.col("c_custkey") % 5, "\uff26", "\uff2d\uff41\uff4c\uff45")
    rows = spread(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", fields.nfkc(said).alias("folded"), fields.nfkc(sex).alias("sex"))
    return rows.select("c_custkey", "folded", fields.gender(F.col("sex")).alias("gender"))
