"""Queries over the supplied tables, one for each operator, and the SQL that says the same.

Customers stand for users, orders for applications, lines of an order for documents; a document's readings are derived
from its line by rule (see ``documents`` and ``DOCUMENTS_SQL``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import alignment, fields, numbers, text
from corrobora.operators import faces as face_ops
from corrobora.operators import relational as rel
from corrobora.plans import evidence, intake, reconcile, records
from corrobora.shared import parts_of, spread
from corrobora.ship import ship
from corrobora.sources import page_text
from corrobora.streaming import limits

#: Two-digit years above it belong to the last century; the clock is a parameter, so results don't change with it.
PIVOT = 26
KINDS = ["pan", "aadhaar", "passport", "voter", "birth_certificate"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_part(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Orders, each with the name and brand of a part: that which its ``key`` has, modulo as many parts as there are."""
    parts = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    many = parts.agg(F.max("p_partkey")).first()[0] or 1
    return t(spark, sf_dir, "orders").withColumn("p_partkey", F.col(key) % many + 1).join(parts, "p_partkey")


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def documents(spark: SparkSession, sf_dir: str, *more: str, parts: int | None = None) -> DataFrame:
    """One row a document: application, ord, type, printed date, source, status; ``more``: columns of its part, as ``parts``, an
    array of structs, which is null without one and has one for each row of the part's key.

    Lines are dealt by application once, after the part is joined, into partitions of a bounded size (as many as ``parts`` says, if
    given): what follows by application needs no exchange and no sort that is larger than that.
    """
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *LINE_ORDER)
    many = parts or parts_of(lines)
    if more:
        named = t(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct(*more)).alias("parts"))
        lines = lines.join(named, "l_partkey", "left")
    lines = lines.repartition(many, "l_orderkey")
    lines = lines.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    day = F.to_date("o_orderdate")
    day = F.when(F.col("l_suppkey") % 10 == 0, F.date_add(day, 1)).otherwise(day)
    status = F.when(F.col("l_quantity") <= 3, F.lit("retake_required")).when(F.col("l_quantity") <= 5, F.lit("rejected_file")).when(F.col("l_quantity") <= 7, F.lit("unreadable")).otherwise(F.lit("ready"))
    n = F.col("l_linenumber") % 5
    printed = F.when(n == 0, F.date_format(day, "yyyy-MM-dd")).when(n == 1, F.date_format(day, "dd/MM/yyyy")).when(n == 2, F.date_format(day, "dd-MM-yyyy")).when(n == 3, F.date_format(day, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(day, "dd"), F.lit(" "), pick(C.MONTHS, F.month(day) - 1), F.lit(" "), F.date_format(day, "yyyy")))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("application_id"), "ord", pick(KINDS, n).alias("doc_type"), printed.alias("printed"), F.when(F.col("l_linestatus") == "F", F.lit("barcode")).otherwise(F.lit("vision")).alias("source"), F.when(F.col("l_returnflag") == "A", F.lit("Female")).when(F.col("l_returnflag") == "R", F.lit("MALE")).otherwise(F.lit("")).alias("gender"), "l_partkey", "l_suppkey", "o_custkey", status.alias("doc_status"), *(["parts"] if more else []))


DOCUMENTS_SQL = """
    l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS ord FROM lineitem),
    docs AS (
        SELECT l_orderkey AS application_id, ord, l_partkey, l_suppkey, l_linestatus, l_returnflag, CASE l_linenumber % 5 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'passport' WHEN 3 THEN 'voter' ELSE 'birth_certificate' END AS doc_type,
            strftime(CAST(o_orderdate AS DATE) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') AS iso,
            CASE WHEN l_linestatus = 'F' THEN 'barcode' ELSE 'vision' END AS source, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.6 END AS weight
        FROM l JOIN orders ON l_orderkey = o_orderkey
    )"""


def dob_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the birth date that the documents of each application agree on, read from five printed forms."""
    docs = documents(spark, sf_dir).withColumn("tidy", fields.tidy_date(F.col("printed"))).withColumn("key", fields.iso_date(F.col("tidy"), PIVOT))
    carried = F.broadcast(evidence.registry(spark).where("field = 'dob' AND page_role = 'front' AND carries <> 'no'").select("doc_type"))
    readings = docs.join(carried, "doc_type", "left_semi").select("application_id", F.col("ord").alias("logical_id"), "ord", "key", reconcile.weight(F.col("source")).alias("weight"), "source")
    return reconcile.consensus_by_key(readings)


def cluster_readings(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """What the documents that are ready say of each field; the others count in the decision only."""
    rows = documents(spark, sf_dir, "p_name", parts=parts).where("doc_status = 'ready'").withColumn("part", F.explode("parts")).withColumn("p_name", F.col("part.p_name"))
    first = F.first("p_name").over(Window.partitionBy("application_id").orderBy("ord"))
    words = F.split(F.col("p"), " ")
    name = F.when(F.col("l_suppkey") % 7 == 0, F.array_join(F.reverse(words), " ")).when(F.col("l_suppkey") % 7 == 1, F.concat(F.left("p", F.length("p") - 1), F.lit("x"))).otherwise(F.col("p"))
    spelt, house = F.col("l_suppkey") % 7, F.col("o_custkey").cast("string")
    address = F.when(spelt == 0, F.concat(house, F.lit(" mg rd,, indiranagar, bengaluru 560038."))).when(spelt == 1, F.lit("Flat 9, Koramangala 560038")).when(spelt == 2, F.lit("17 Hill Lane, Kochi, Kerala 682001")).otherwise(F.concat(house, F.lit(" MG Road, Indiranagar, Bengaluru, Karnataka 560038")))
    rows = rows.withColumn("p", first).select("*", F.explode(F.create_map(F.lit("holder_name"), name, F.lit("dob"), F.col("printed"), F.lit("gender"), F.col("gender"), F.lit("address"), address)).alias("field", "value"))
    doc = F.concat_ws("-", F.col("application_id").cast("string"), F.col("ord").cast("string"))
    return rows.select("application_id", "field", doc.alias("document_id"), doc.alias("logical_id"), "ord", "doc_type", F.lit("front").alias("page_role"), "value", "source", F.lit("present_verified").alias("status"), F.lit(None).cast("string").alias("raw_value"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.compare(cluster_readings(spark, sf_dir), evidence.registry(spark), PIVOT)


def _event_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store and rows that come in: all events, those of one type in both."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    return e.where("event_type <> 'purchase'"), e.where("event_type IN ('purchase', 'view')").withColumn("value", F.round(F.col("value") + 1, 6))


def _card(key: str) -> Column:
    """A twelve digit number made of a key, its last digit a check digit for even keys."""
    body = F.concat(F.lit("2"), F.lpad(F.col(key).cast("string"), 10, "0"))
    return F.when(F.col(key) % 2 == 0, F.concat(body, numbers.verhoeff_digit(body))).otherwise(F.concat(body, F.lit("0")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name beside another part's."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


PAIRS_SQL = "p AS (SELECT a.p_partkey, a.p_name, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
QUERIES: dict = {"dob_consensus": dob_consensus}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


ORACLES["dob_consensus"] = f"""
    WITH {DOCUMENTS_SQL},
    per AS (SELECT application_id, iso AS key, sum(weight) AS w, max(weight) AS top, count(*) AS n, count(DISTINCT ord) AS corroboration FROM docs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY CASE WHEN top >= 0.9 THEN 0 ELSE 1 END, round(w, 6) DESC, n DESC, key) AS r, sum(w) OVER (PARTITION BY application_id) AS all_w, sum(n) OVER (PARTITION BY application_id) AS all_n FROM per)
    SELECT application_id, key AS value, CAST(n AS BIGINT) AS n_agree, CAST(all_n - n AS BIGINT) AS n_dissent, CAST(corroboration AS BIGINT) AS corroboration, round(CAST(w / all_w AS DOUBLE), 6) AS confidence,
        CASE WHEN all_n > n THEN 'disagreement' WHEN corroboration >= 2 THEN 'agreement' ELSE 'single_source' END AS status
    FROM r WHERE r = 1"""


# --- scans, windows, set operators


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter_project(spark, d):
    return t(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    return rel.best(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def priority_latest(spark, d):
    return rel.latest(t(spark, d, "orders"), ["o_custkey"], (F.col("o_orderstatus") == "F").asc(), F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'fresh' ELSE 'duplicate_in_upload' END AS route FROM documents")
def first_in_batch(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rel.first_in_batch(docs, "hash", F.asc("doc_id")).select("doc_id", "route")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS next FROM c) SELECT user_id, event_type, CAST(n - coalesce(next, 0) AS BIGINT) AS margin FROM r WHERE r = 1")
def top2_margin(spark, d):
    return rel.margin(t(spark, d, "events").groupBy("user_id", "event_type").count(), "user_id", "event_type", "count")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark, d):
    return rel.latest(t(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"), k=3).select("o_custkey", "o_orderkey")


@query("SELECT lang, arg_max(doc_id, (length(text), -doc_id)) AS doc_id FROM documents GROUP BY lang")
def argmax(spark, d):
    return rel.best(t(spark, d, "documents"), ["lang"], "doc_id", F.length("text"), -F.col("doc_id"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, length(event_type) * 3 + CAST(floor(value) AS BIGINT) % 7 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (
        SELECT user_id, event_id, k, size, size <= 300 AS fits, CASE WHEN size <= 300 THEN size ELSE 0 END AS total, CASE WHEN size <= 300 THEN 1 ELSE 0 END AS n FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, e.size, r.total + e.size <= 300 AND r.n < 20, CASE WHEN r.total + e.size <= 300 AND r.n < 20 THEN r.total + e.size ELSE r.total END, CASE WHEN r.total + e.size <= 300 AND r.n < 20 THEN r.n + 1 ELSE r.n END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1
    )
    SELECT user_id, event_id, fits FROM r""")
def running_budget(spark, d):
    size = F.length("event_type") * 3 + F.floor("value") % 7
    e = t(spark, d, "events").select("user_id", "event_id", size.cast("long").alias("size"))
    return rel.within_budget(e, ["user_id"], "size", 300, 20, "event_id").select("user_id", "event_id", "fits")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def set_difference(spark, d):
    e = t(spark, d, "events")
    return rel.foreign(e.where("event_type = 'click'").select("user_id").distinct(), e.where("event_type = 'purchase' AND value > 50"), ["user_id"])


# --- joins

OWNERS = "(SELECT c_custkey FROM customer WHERE c_nationkey < 5)"


def _owners(spark, d):
    return t(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN {OWNERS}")
def ownership_semi(spark, d):
    return rel.owned(t(spark, d, "orders").select("o_orderkey", "o_custkey"), _owners(spark, d), ["o_custkey"])


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN {OWNERS}")
def ownership_anti(spark, d):
    return rel.foreign(t(spark, d, "orders").select("o_orderkey", "o_custkey"), _owners(spark, d), ["o_custkey"])


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, d):
    return rel.with_default(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", "quality", F.lit(-1))


@query("SELECT l.l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F' GROUP BY 1")
def live_record_join(spark, d):
    live = t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").select("l_orderkey").join(live, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
    WITH a AS (SELECT event_id, event_type AS raw, event_id % 5 = 0 AS ev FROM events WHERE event_type <> 'purchase'), b AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE upper(event_type) END AS raw, event_id % 3 = 1 AS ev FROM events WHERE event_type = 'purchase' OR value > 20),
    m AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, a.raw AS ra, b.raw AS rb, coalesce(a.ev, false) AS ea, coalesce(b.ev, false) AS eb FROM a FULL OUTER JOIN b ON a.event_id = b.event_id)
    SELECT event_id, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL AND upper(ra) <> upper(rb) AND eb AND NOT ea THEN rb ELSE coalesce(ra, rb) END AS value,
        CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN CASE WHEN upper(ra) = upper(rb) OR ea <> eb THEN 'present_verified' ELSE 'present_uncertain' END WHEN ra IS NOT NULL AND ea OR rb IS NOT NULL AND eb THEN 'present_verified' ELSE 'present_uncertain' END AS status,
        CAST(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN CASE WHEN upper(ra) = upper(rb) THEN 0.95 WHEN ea <> eb THEN 0.6 ELSE 0.3 END WHEN ra IS NOT NULL AND ea OR rb IS NOT NULL AND eb THEN 0.8 ELSE 0.3 END AS DOUBLE) AS confidence
    FROM m""")
def full_outer_merge(spark, d):
    e, i = t(spark, d, "events"), F.col("event_id")
    a = e.where("event_type <> 'purchase'").select(i, F.col("event_type").alias("raw"), (i % 5 == 0).alias("evidenced"))
    b = e.where("event_type = 'purchase' OR value > 20").select(i, F.when(i % 7 == 0, F.lit("other")).otherwise(F.upper("event_type")).alias("raw"), (i % 3 == 1).alias("evidenced"))
    return rel.merge_readings(a, b, ["event_id"])


@query("WITH " + DOCUMENTS_SQL + ", c AS (SELECT * FROM (VALUES ('pan', 0), ('aadhaar', 1), ('passport', 1), ('voter', 1), ('birth_certificate', 1)) AS x(doc_type, g)) SELECT doc_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS may_print_gender FROM docs JOIN c USING (doc_type) GROUP BY 1")
def capability_gate(spark, d):
    r = F.broadcast(evidence.registry(spark).where("field = 'gender' AND page_role = 'front'").select("doc_type", (F.col("carries") != "no").cast("int").alias("g")))
    return documents(spark, d).select("doc_type").join(r, "doc_type").groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("g").alias("may_print_gender"))


# --- store semantics


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'purchase' THEN round(round(value, 6) + 1, 6) ELSE round(value, 6) END AS value FROM events")
def insert_if_absent(spark, d):
    return rel.insert_if_absent(*_event_table(spark, d), ["event_id", "event_type"])


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type IN ('purchase', 'view') THEN round(round(value, 6) + 1, 6) ELSE round(value, 6) END AS value FROM events")
def upsert_latest(spark, d):
    return rel.upsert(*_event_table(spark, d), ["event_id"], ["user_id"], F.desc("value"))


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type IN ('purchase', 'view') THEN round(round(value, 6) + 1, 6) ELSE round(value, 6) END AS value FROM events WHERE event_type NOT IN ('purchase', 'view') OR round(value, 6) >= 20")
def delete_insert(spark, d):
    table, rows = _event_table(spark, d)
    return rel.delete_insert(table, rows.withColumn("event_type", F.when(F.col("value") < 21, F.lit(" ")).otherwise(F.col("event_type"))), ["event_id"], "event_type")


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'view' AND round(value, 6) < 20 THEN NULL WHEN event_type = 'view' THEN round(round(value, 6) + 1, 6) ELSE round(value, 6) END AS value FROM events WHERE event_type <> 'purchase'")
def patch_update(spark, d):
    table, rows = _event_table(spark, d)
    clear = F.col("value") < 21
    return rel.patch(table, rows.withColumn("clear", clear).withColumn("value", F.when(~clear, F.col("value"))), ["event_id"], ["value"], "clear")


@query("SELECT CAST(count(*) AS BIGINT) AS active, user_id FROM events WHERE value >= 25 GROUP BY user_id")
def soft_delete_filter(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "value").withColumn("status", F.lit("ready")).withColumn("removed_at", F.lit(None).cast("timestamp"))
    out = rel.soft_delete(e, e.where("value < 25"), ["event_id"], F.lit("2026-01-01").cast("timestamp"))
    return out.where("status <> 'removed_by_user'").groupBy("user_id").agg(F.count("*").alias("active"))


@query("SELECT DISTINCT event_type, left(sha256(event_type), 12) AS id FROM events")
def get_or_create(spark, d):
    e = t(spark, d, "events")
    make = F.left(F.sha2("event_type", 256), F.lit(12))
    have = e.where("event_type < 'm' AND value > 10").select(make.alias("id"), "event_type").distinct()
    return rel.get_or_create(have, e, "event_type", make, "id")


# --- aggregates


@query("WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS w FROM events GROUP BY 1, 2) SELECT user_id, event_type AS spelling FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS r FROM s) WHERE r = 1")
def weighted_mode(spark, d):
    return rel.weighted_mode(t(spark, d, "events").withColumnRenamed("event_type", "spelling"), ["user_id"], "spelling", "value")


@query("SELECT l_orderkey, CAST(count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_suppkey END) AS BIGINT) AS corroboration FROM lineitem GROUP BY 1")
def corroboration(spark, d):
    source = F.when(F.col("l_returnflag") == "N", F.lit("user_correction")).otherwise(F.lit("vision"))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(reconcile.corroboration(source, F.col("l_suppkey")).alias("corroboration"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / sum(l_quantity), 4) AS ratio FROM lineitem GROUP BY 1")
def confidence_ratio(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(reconcile.share(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("ratio"))


@query("SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 1 END) WHEN 4 THEN 'reject' WHEN 3 THEN 'needs_confirmation' ELSE 'info' END AS severity FROM lineitem GROUP BY 1")
def worst_severity(spark, d):
    severity = F.when(F.col("l_returnflag") == "R", F.lit("reject")).when(F.col("l_returnflag") == "A", F.lit("needs_confirmation")).otherwise(F.lit("none"))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(reconcile.severity_rank(severity)).alias("rank")).select("l_orderkey", reconcile.worst(F.col("rank")).alias("severity"))


# --- text


@query(f"WITH {PAIRS_SQL} SELECT p_partkey, CAST(levenshtein(p_name, other) AS INTEGER) AS d, CAST(least(levenshtein(p_name, other), 9) AS INTEGER) AS capped, round(1 - levenshtein(p_name, other) / CAST(greatest(length(p_name), length(other)) AS DOUBLE), 6) AS s FROM p")
def edit_distance(spark, d):
    a, b = F.col("p_name"), F.col("other")
    return _pairs(spark, d).select("p_partkey", text.levenshtein(a, b).alias("d"), text.levenshtein(a, b, 8).alias("capped"), F.round(text.similarity(a, b), 6).alias("s"))


GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"WITH {PAIRS_SQL}, u AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS a, upper(replace(other, ' ', '')) AS b FROM p), g AS (SELECT p_partkey, {GRAMS.format('a')} AS a, {GRAMS.format('b')} AS b FROM u) SELECT p_partkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM g")
def ngram_dice(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(text.bigram_dice(F.col("p_name"), F.col("other")), 6).alias("dice"))


def _phonetic_sql(x: str) -> str:
    folded = reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", text.PHONETIC, f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')")
    return f"WITH k AS (SELECT *, {folded} AS f FROM part), v AS (SELECT *, left(f, 1) || regexp_replace(substr(f, 2), '[AEIOU]', '', 'g') AS g FROM k)"


@query(_phonetic_sql("p_name") + " SELECT p_partkey, " + reduce(lambda s, c: f"regexp_replace({s}, '{c}+', '{c}', 'g')", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "g") + " AS sound FROM v")
def phonetic_key(spark, d):
    return t(spark, d, "part").select("p_partkey", text.phonetic_key(F.col("p_name")).alias("sound"))


@query(f"WITH {PAIRS_SQL}, w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(other, ' ')) AS b FROM p) SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE), 6) AS shared FROM w")
def token_overlap(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(text.overlap(F.split("p_name", " "), F.split("other", " ")), 6).alias("shared"))


@query("SELECT doc_id, sha256(text) AS hash, sha256(sha256(text) || '|3.2.0|3.0.0|3.0.0|m1,m2') AS extraction_key FROM documents")
def content_hash(spark, d):
    h = F.sha2("text", 256)
    return t(spark, d, "documents").select("doc_id", h.alias("hash"), text.extraction_key(h, "3.2.0", "3.0.0", "3.0.0", ["m1", "m2"]).alias("extraction_key"))


@query("SELECT sha256(text) AS hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_bytes(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS squashed, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def squash(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.squash(F.col("c_name")).alias("squashed"), text.digits(F.col("c_name")).alias("digits"))


@query("SELECT c_custkey, repeat('*', CAST(least(length(c_name) - 4, 8) AS INTEGER)) || right(c_name, 4) AS masked, replace('id ' || c_name || '.', c_name, repeat('*', CAST(least(length(c_name) - 4, 8) AS INTEGER)) || right(c_name, 4)) AS told FROM customer")
def mask_and_redact(spark, d):
    n = F.col("c_name")
    return t(spark, d, "customer").select("c_custkey", text.mask(n).alias("masked"), text.redact(F.concat(F.lit("id "), n, F.lit(".")), F.array(n, F.lit(""))).alias("told"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_unwrap(spark, d):
    m = F.from_json("props", "map<string,string>")
    first = F.json_object_keys("props")
    return t(spark, d, "events").select("event_id", F.element_at(m, F.get(first, F.lit(0))).alias("first_value"))


# --- numbers

_D, _P = ("[" + ",".join(map(str, v)) + "]" for v in (numbers.dihedral(), numbers.permutations()))


def _verhoeff_steps(n: int, shift: int) -> str:
    """One CTE for each digit, so that no expression nests."""
    out = []
    for i in range(n):
        out.append(f"v{shift}{i + 1} AS (SELECT *, {_D}[CAST(1 + 10 * c{shift}{i} + {_P}[CAST(1 + {10 * ((i + shift) % 8)} + CAST(substr(body, {n - i}, 1) AS INTEGER) AS BIGINT)] AS BIGINT)] AS c{shift}{i + 1} FROM v{shift}{i})")
    return ", ".join(out)


@query("WITH v10 AS (SELECT c_custkey, '2' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS body, 0 AS c10 FROM customer), " + _verhoeff_steps(11, 1) + " SELECT c_custkey, CAST([0,4,3,2,1,5,6,7,8,9][CAST(1 + c111 AS BIGINT)] AS VARCHAR) AS digit, c_custkey % 2 = 0 OR c111 = 0 AS valid FROM v111")
def verhoeff(spark, d):
    body = F.concat(F.lit("2"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return t(spark, d, "customer").select("c_custkey", numbers.verhoeff_digit(body).alias("digit"), numbers.verhoeff_valid(_card("c_custkey")).alias("valid"))


@query("WITH s AS (SELECT c_custkey, upper(replace(c_name, '#', '<')) AS x FROM customer), e AS (SELECT c_custkey, x, unnest(range(1, length(x) + 1)) AS i FROM s) SELECT c_custkey, CAST(sum(greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(x, i, 1)) - 1, 0) * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END) % 10 AS INTEGER) AS digit FROM e GROUP BY 1")
def mrz_check(spark, d):
    return t(spark, d, "customer").select("c_custkey", numbers.mrz_check(F.upper(F.replace("c_name", F.lit("#"), F.lit("<")))).cast("int").alias("digit"))


@query("WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ABCDE' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || 'F' WHEN 1 THEN 'k ' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') WHEN 2 THEN 'abc-' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') WHEN 3 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS x FROM orders), c AS (SELECT *, regexp_replace(upper(x), '[\\s/-]', '', 'g') AS v FROM n) SELECT o_orderkey, CASE WHEN v = '' THEN 'empty' WHEN length(v) <> 10 THEN 'wrong_length' WHEN NOT regexp_full_match(v, '[A-Z]{5}[0-9]{4}[A-Z]') THEN 'pattern_mismatch' ELSE '' END AS reason, CASE WHEN regexp_full_match(v, '[A-Z]{5}[0-9]{4}[A-Z]') THEN 'pan' WHEN regexp_full_match(v, '[A-Z][0-9]{7}') THEN 'passport' WHEN regexp_full_match(v, '[A-Z]{3}[0-9]{7}') THEN 'voter' ELSE '' END AS kind FROM c".replace("\\\\s", "\\s"))
def number_format(spark, d):
    k = F.col("o_orderkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    x = F.when(k % 5 == 0, F.concat(F.lit("ABCDE"), pad(4), F.lit("F"))).when(k % 5 == 1, F.concat(F.lit("k "), pad(7))).when(k % 5 == 2, F.concat(F.lit("abc-"), pad(7))).when(k % 5 == 3, k.cast("string")).otherwise(F.lit(""))
    return t(spark, d, "orders").select("o_orderkey", numbers.number_reason(F.lit("pan"), x).alias("reason"), numbers.infer_type(x).alias("kind"))


@query("WITH n AS (SELECT p_partkey, lpad(CAST(p_partkey % 10000000 AS VARCHAR), 7, '0') AS z FROM part) SELECT p_partkey, 'BIS' || z AS repaired FROM n")
def repair_positional(spark, d):
    z = F.lpad((F.col("p_partkey") % 10**7).cast("string"), 7, "0")
    return t(spark, d, "part").select("p_partkey", numbers.repair_positional("voter", F.concat(F.lit("81"), F.lit("5"), F.translate(z, "015", "OIS"))).alias("repaired"))


@query("""
    WITH v10 AS (SELECT c_custkey, '2' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS body, 0 AS c10 FROM customer), """ + _verhoeff_steps(11, 1) + """,
    card AS (SELECT c_custkey, body || translate(CAST([0,4,3,2,1,5,6,7,8,9][CAST(1 + c111 AS BIGINT)] AS VARCHAR), '0681', '8067') AS x FROM v111),
    swaps AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, many in C.CONFUSIONS.items() for b in many) + """) AS s(a, b)),
    made AS (SELECT DISTINCT c_custkey, left(x, i - 1) || s.b || substr(x, i + 1) AS y FROM (SELECT c_custkey, x, unnest(range(1, 13)) AS i FROM card) JOIN swaps s ON s.a = substr(x, i, 1)),
    v00 AS (SELECT c_custkey, y AS body, 0 AS c00 FROM made), """ + _verhoeff_steps(12, 0) + """,
    good AS (SELECT c_custkey, min(body) AS y, count(*) AS n FROM v012 WHERE c012 = 0 GROUP BY 1)
    SELECT c_custkey, CASE WHEN n = 1 THEN y END AS repaired FROM customer LEFT JOIN good USING (c_custkey)""")
def repair_checksum(spark, d):
    body = F.concat(F.lit("2"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    card = F.concat(body, numbers.verhoeff_digit(body))
    return spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", numbers.repair_checksum(F.concat(F.left(card, F.lit(11)), F.translate(F.right(card, F.lit(1)), "0681", "8067"))).alias("repaired"))


# --- fields


@query("WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT o_orderkey, day, CASE o_orderkey % 4 WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%Y.%m.%d') WHEN 2 THEN strftime(day, '%Y') ELSE 'x' END AS s FROM d) SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN strftime(day, '%Y-%m-%d') END AS iso, o_orderkey % 4 = 0 AND day(day) <= 12 AND day(day) <> month(day) AS ambiguous, CASE o_orderkey % 4 WHEN 2 THEN 'year-only' WHEN 3 THEN 'unparsed' ELSE '' END AS reason FROM p")
def normalize_date(spark, d):
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    s = F.when(k == 0, F.date_format(day, "dd / MM/yyyy")).when(k == 1, F.date_format(day, "yyyy.MM.dd")).when(k == 2, F.date_format(day, "yyyy")).otherwise(F.lit("x"))
    return t(spark, d, "orders").select("o_orderkey", fields.date(s, PIVOT).alias("d")).select("o_orderkey", "d.*")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'O' WHEN 3 THEN '' WHEN 4 THEN 'F' ELSE 'O' END AS g FROM customer")
def normalize_gender(spark, d):
    s = pick(["Male.", " f ", "Transgender", "  ", "महिला / FEMALE", "unclear"], F.col("c_custkey") % 6)
    return t(spark, d, "customer").select("c_custkey", fields.gender(s).alias("g"))


@query("WITH w AS (SELECT p_partkey, string_split(upper(p_name), ' ') AS a FROM part) SELECT p_partkey, 'MD ' || array_to_string(a, ' ') AS ordered, array_to_string(list_sort(list_append(a, 'MD')), ' ') AS sorted, CAST(4 AS INTEGER) AS n_alternates FROM w")
def normalize_name(spark, d):
    n = fields.name(F.concat(F.lit("Mr. md  "), F.col("p_name")))
    return t(spark, d, "part").select("p_partkey", n["ordered"].alias("ordered"), n["sorted"].alias("sorted"), F.size(n["alternates"]).alias("n_alternates"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' MG ROAD, BENGALURU, KARNATAKA 560001' AS text, '560001' AS postal_code, 'KARNATAKA' AS state, CAST(c_custkey AS VARCHAR) || ' MG ROAD' AS house, 'same' AS relation FROM customer")
def normalize_address(spark, d):
    a = fields.address(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" mg  rd ,, Bengaluru, karnataka 560001 .")))
    b = fields.address(F.concat(F.col("c_custkey").cast("string"), F.lit(" mg road, bengaluru 560001")))
    return t(spark, d, "customer").select("c_custkey", a["text"].alias("text"), a["postal_code"].alias("postal_code"), a["state"].alias("state"), a["house"].alias("house"), fields.address_relation(a, b)["relation"].alias("relation"))


@query("WITH w AS (SELECT o_orderkey, array_to_string(list_sort(string_split(upper(p_name), ' ')), ' ') AS n, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d FROM orders JOIN part ON p_partkey = 1 + o_orderkey % (SELECT max(p_partkey) FROM part)) SELECT o_orderkey, sha256(n || '|' || d || '|' || 'F') AS hash FROM w")
def identity_fingerprint(spark, d):
    return with_part(spark, d, "o_orderkey").select("o_orderkey", records.fingerprint(fields.name(F.col("p_name"))["sorted"], fields.date(F.date_format("o_orderdate", "dd MMM yyyy"), PIVOT)["iso"], fields.gender(F.lit("female"))).alias("hash"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'voter' ELSE 'passport' END AS document_type, CASE WHEN o_orderkey % 4 = 1 THEN 'Asha Devi' ELSE p_name END AS holder_name, 'Ram of ' || p_brand AS father_name,
        strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS dob, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'male' END AS gender,
        CASE o_orderkey % 4 WHEN 0 THEN 'ABCDE' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || 'F' WHEN 1 THEN '2345 6789 ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN 'XYZ ' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') ELSE 'K' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') END AS number,
        o_orderkey % 2 = 0 AS gender_label FROM orders JOIN part ON p_partkey = 1 + o_custkey % (SELECT max(p_partkey) FROM part)""")
def page_text_fields(spark, d):
    k = F.col("o_orderkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    number = F.when(k % 4 == 0, F.concat(F.lit("ABCDE"), pad(4), F.lit("F"))).when(k % 4 == 1, F.concat(F.lit("2345 6789 "), pad(4))).when(k % 4 == 2, F.concat(F.lit("XYZ "), pad(7))).otherwise(F.concat(F.lit("K"), pad(7)))
    head = F.when(k % 4 == 0, F.lit("Income Tax Department")).when(k % 4 == 1, F.lit("Government of India\nAadhaar\nAsha Devi")).when(k % 4 == 2, F.lit("Election Commission")).otherwise(F.lit("Republic"))
    name = F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("\nName: "), "p_name"))
    sex = F.when(k % 2 == 0, F.lit("Sex: F")).otherwise(F.lit("male"))
    page = F.concat(head, name, F.lit("\nDOB: "), F.date_format("o_orderdate", "dd / MM/yyyy"), F.lit("\nFather's Name\nRam of "), "p_brand", F.lit("\n"), sex, F.lit("\n"), number)
    r = spread(with_part(spark, d, "o_custkey"), "o_orderkey").withColumn("page", page).withColumn("r", page_text.page_reading(F.col("page"), PIVOT))
    return r.select("o_orderkey", "r.document_type", "r.holder_name", "r.father_name", "r.dob", "r.gender", F.col("r.document_number").alias("number"), F.col("page").rlike(r"(?i)sex\s*[:=-]").alias("gender_label"))


@query()
def page_fields(spark, d):
    """All that a page's text says, its machine-readable zone, and whether the text beside each field shows its value."""
    x = F.col("text")
    rows = spread(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "text", page_text.page_fields(x).alias("f"), page_text.mrz(x, PIVOT).alias("mrz"))
    names = rows.schema["f"].dataType.names
    shown = [fields.evidence_contains(n, F.col(f"f.{n}"), x, PIVOT).alias(f"{n}_seen") for n in names]
    return rows.select("doc_id", "f.*", *shown, fields.evidence_contains("mrz", F.lit("the"), x, PIVOT).alias("the_seen"), *[F.col(f"mrz.{n}").alias(f"mrz_{n}") for n in rows.schema["mrz"].dataType.names])


# --- gates and classification


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, CASE WHEN l_quantity < 22 OR l_discount > 0.09 THEN 'unusable' WHEN l_quantity < 55 THEN 'marginal' ELSE 'good' END AS tier FROM lineitem GROUP BY 1, 2, 4")
def quality_tier(spark, d):
    made = evidence.tier(F.col("l_quantity"), F.lit(20), F.when(F.col("l_discount") > 0.09, 0.5).otherwise(0.05), F.lit(0.3), F.lit(800), F.lit(500))
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", made.alias("tier")).agg(F.count("*").alias("n"))


_FLAGS = "WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS g, o_orderkey % 3 = 0 AS a, o_orderkey % 5 = 0 AS m, o_orderkey % 7 = 0 AS e, CASE o_orderkey % 4 WHEN 0 THEN 'pan' WHEN 1 THEN 'voter' WHEN 2 THEN 'aadhaar' ELSE 'unknown' END AS claimed FROM orders), "


@query(_FLAGS + "s AS (SELECT o_orderkey, claimed, [CASE WHEN g THEN -2 ELSE 0 END + CASE WHEN a THEN -2 ELSE 0 END + CASE WHEN claimed = 'pan' THEN 2 ELSE 0 END, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN claimed = 'aadhaar' THEN 2 ELSE 0 END, CASE WHEN e THEN 2 ELSE 0 END, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN m THEN -1 ELSE 0 END + CASE WHEN claimed = 'voter' THEN 2 ELSE 0 END, CASE WHEN m THEN 2 ELSE 0 END, CASE WHEN e THEN 1 ELSE 0 END] AS x FROM f), r AS (SELECT *, list_max(x) AS best, list_position(x, list_max(x)) AS i FROM s) SELECT o_orderkey, CASE WHEN best <= 0 THEN claimed ELSE ['pan', 'aadhaar', 'passport', 'voter', 'birth_certificate', 'driving_licence'][i] END AS type FROM r")
def classify_scores(spark, d):
    k = F.col("o_orderkey")
    on = lambda n: F.when(k % n == 0, F.lit("x"))
    claimed = F.when(k % 4 == 0, "pan").when(k % 4 == 1, "voter").when(k % 4 == 2, "aadhaar").otherwise("unknown")
    df = t(spark, d, "orders").select("o_orderkey", on(2).alias("gender"), on(3).alias("address"), on(5).alias("mother_name"), on(7).alias("expiry_date"), claimed.alias("claimed"), F.lit(None).cast("string").alias("document_number"), F.lit(False).alias("qr"), F.lit(False).alias("mrz_valid"))
    return evidence.classify(df).select("o_orderkey", "class.type")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not_present' WHEN event_id % 7 = 0 THEN 'present_verified' WHEN event_id % 5 = 0 THEN 'present_verified' WHEN event_id % 2 = 0 THEN 'present_verified' ELSE 'not_present' END AS status FROM events")
def evidence_ladder(spark, d):
    k = F.col("event_id")
    source = F.when(k % 7 == 0, "mrz").when(k % 5 == 0, "user").otherwise("vision")
    no, yes = F.lit(False), F.lit(True)
    return t(spark, d, "events").select("event_id", evidence.field_status(F.when(k % 11 != 0, F.lit("v")), source, no, no, k % 2 == 0, k % 2 == 0, yes, yes, no)["status"].alias("status"))


# --- reconciliation, decisions, records


# Where words are swapped, a word of three letters with one wrong is another word: ROD and ROX.
_CLUSTERS = """
    l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS ord FROM lineitem),
    d AS (
        SELECT l_orderkey AS app, ord, CASE l_linenumber % 5 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'passport' WHEN 3 THEN 'voter' ELSE 'birth_certificate' END AS doc, CASE WHEN l_linestatus = 'F' THEN 'barcode' ELSE 'vision' END AS source, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.6 END::DOUBLE AS w,
            first_value(upper(p_name)) OVER (PARTITION BY l_orderkey ORDER BY ord) AS base, l_suppkey % 7 AS spelt, strftime(CAST(o_orderdate AS DATE) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') AS iso, CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'M' ELSE '' END AS gender, CAST(o_custkey AS VARCHAR) AS house
        FROM l JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 7
    ),
    f AS (
        SELECT app, ord, doc, source, w, 'holder_name' AS field, 'yes' AS carries, CASE spelt WHEN 0 THEN array_to_string(list_reverse(string_split(base, ' ')), ' ') WHEN 1 THEN left(base, length(base) - 1) || 'X' ELSE base END AS display FROM d
        UNION ALL SELECT app, ord, doc, source, w, 'dob', CASE doc WHEN 'voter' THEN 'partial' ELSE 'yes' END, iso FROM d
        UNION ALL SELECT app, ord, doc, source, w, 'gender', CASE doc WHEN 'pan' THEN 'no' WHEN 'birth_certificate' THEN 'partial' ELSE 'yes' END, gender FROM d
        UNION ALL SELECT app, ord, doc, source, w, 'address', CASE doc WHEN 'birth_certificate' THEN 'yes' WHEN 'aadhaar' THEN 'partial' ELSE 'no' END, CASE spelt WHEN 0 THEN house || ' MG ROAD, INDIRANAGAR, BENGALURU 560038' WHEN 1 THEN 'FLAT 9, KORAMANGALA 560038' WHEN 2 THEN '17 HILL LANE, KOCHI, KERALA 682001' ELSE house || ' MG ROAD, INDIRANAGAR, BENGALURU, KARNATAKA 560038' END FROM d
    ),
    g AS (SELECT *, CASE WHEN carries = 'no' THEN 'abstained' WHEN display <> '' THEN 'present' WHEN carries = 'yes' THEN 'unreadable' ELSE 'abstained' END AS bucket, CASE field WHEN 'holder_name' THEN array_to_string(list_sort(string_split(display, ' ')), ' ') ELSE display END AS key FROM f),
    p AS (SELECT *, CASE WHEN field = 'address' AND contains(display, 'MG ROAD') THEN 'mg' ELSE key END AS grp FROM g WHERE bucket = 'present'),
    k AS (SELECT app, field, grp, key, sum(w) AS kw, min(ord) AS k_ord, arg_min(display, ord) AS k_face FROM p GROUP BY 1, 2, 3, 4),
    ks AS (SELECT *, row_number() OVER (PARTITION BY app, field, grp ORDER BY round(kw, 6) DESC, k_ord) AS place FROM k),
    q AS (SELECT app, field, grp, sum(w) AS gw, max(w) AS top, count(*) AS n FROM p GROUP BY 1, 2, 3),
    r AS (SELECT q.*, row_number() OVER (PARTITION BY q.app, q.field ORDER BY CASE WHEN top >= 0.9 THEN 0 ELSE 1 END, round(gw, 6) DESC, n DESC, k_face) AS rank, sum(gw) OVER (PARTITION BY q.app, q.field) AS all_w FROM q JOIN ks ON ks.app = q.app AND ks.field = q.field AND ks.grp = q.grp AND ks.place = 1),
    sp AS (SELECT p.app, p.field, p.display, row_number() OVER (PARTITION BY p.app, p.field ORDER BY round(sum(p.w), 6) DESC, p.display) AS best FROM p JOIN r ON r.app = p.app AND r.field = p.field AND r.grp = p.grp AND r.rank = 1 GROUP BY 1, 2, 3),
    m AS (
        SELECT p.*, r.rank, ks.place, sp.display AS value, CASE p.field WHEN 'holder_name' THEN NOT (p.display LIKE 'ROD %' AND sp.display LIKE '% ROX' OR sp.display LIKE 'ROD %' AND p.display LIKE '% ROX') WHEN 'address' THEN NOT contains(p.display, 'HILL') AND NOT contains(sp.display, 'HILL') ELSE levenshtein(p.display, sp.display) <= 2 END AS ask
        FROM p JOIN r ON r.app = p.app AND r.field = p.field AND r.grp = p.grp JOIN ks ON ks.app = p.app AND ks.field = p.field AND ks.key = p.key JOIN sp ON sp.app = p.app AND sp.field = p.field AND sp.best = 1
    ),
    u AS (
        SELECT app, field, any_value(value) AS value, string_agg(doc, ',' ORDER BY place, ord) FILTER (WHERE rank = 1) AS agreeing, coalesce(string_agg(doc || '=' || display, ',' ORDER BY rank, place, ord) FILTER (WHERE rank > 1), '') AS dissenting, count(*) FILTER (WHERE rank = 1) AS n_agree, count(*) FILTER (WHERE rank > 1 AND NOT ask) AS n_dissent, count(*) FILTER (WHERE rank > 1 AND ask) AS confirmable, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE rank = 1) AS sources FROM m GROUP BY 1, 2
    ),
    b AS (SELECT app, field, coalesce(string_agg(doc, ',' ORDER BY doc) FILTER (WHERE bucket = 'unreadable'), '') AS unreadable, coalesce(string_agg(doc, ',' ORDER BY doc) FILTER (WHERE bucket = 'abstained'), '') AS abstained FROM g GROUP BY 1, 2),
    c AS (
        SELECT b.app AS application_id, b.field, coalesce(value, '') AS value, coalesce(agreeing, '') AS agreeing, coalesce(dissenting, '') AS dissenting, CAST(coalesce(n_agree, 0) AS INTEGER) AS n_agree, CAST(coalesce(n_dissent, 0) AS INTEGER) AS n_dissent, CAST(coalesce(confirmable, 0) AS INTEGER) AS confirmable, CAST(coalesce(n_agree, 0) AS INTEGER) AS corroboration, CAST(coalesce(n_agree + confirmable, 0) AS INTEGER) AS support,
            coalesce(round(round(gw / all_w, 6), 2), 0.0) AS confidence, coalesce(top >= 0.9, false) AS strong, coalesce(sources, '') AS sources, CASE WHEN value IS NULL AND unreadable <> '' THEN 'not_extracted' WHEN value IS NULL THEN 'not_applicable' WHEN dissenting <> '' THEN 'disagreement' WHEN n_agree >= 2 THEN 'agreement' ELSE 'single_source' END AS status,
            CASE WHEN value IS NULL AND unreadable <> '' THEN 'info' WHEN value IS NULL OR dissenting = '' THEN 'none' WHEN b.field = 'address' THEN 'info' WHEN n_dissent = 0 THEN 'needs_confirmation' ELSE 'reject' END AS severity, false AS holder, unreadable, abstained, '' AS asserted, CAST(0 AS INTEGER) AS confirmed
        FROM b LEFT JOIN u ON u.app = b.app AND u.field = b.field LEFT JOIN r ON r.app = b.app AND r.field = b.field AND r.rank = 1
    )"""


@query(f"WITH {_CLUSTERS} SELECT * FROM c")
def field_clusters(spark, d):
    return clusters(spark, d)


#: Decisions (x) over the clusters c.
_DECIDED = """
    s AS (SELECT l_orderkey AS application_id, bool_or(l_quantity > 7) AS ready, bool_or(l_quantity <= 3) AS retake, bool_or(l_quantity > 3 AND l_quantity <= 5) AS rejected FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    e AS (
        SELECT application_id, count(*) FILTER (WHERE field <> 'address' AND corroboration >= 1 AND n_dissent > 0) AS conflicts, count(*) FILTER (WHERE field <> 'address' AND corroboration >= 1 AND n_dissent = 0 AND confirmable > 0) AS asks, count(*) FILTER (WHERE field IN ('holder_name', 'dob') AND status = 'not_extracted') AS lacking,
            max(support) FILTER (WHERE field = 'holder_name') AS name_support, count(*) FILTER (WHERE value <> '' AND corroboration >= 2) AS multi, count(*) FILTER (WHERE value <> '' AND corroboration <= 1) AS single, max(CASE severity WHEN 'reject' THEN 4 WHEN 'needs_confirmation' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst FROM c GROUP BY 1
    ),
    x AS (
        SELECT s.application_id, worst, CASE WHEN NOT ready AND retake THEN 'retake_required' WHEN NOT ready AND rejected THEN 'rejected_invalid_document' WHEN NOT ready THEN 'extraction_failed' WHEN conflicts >= 2 THEN 'suspected_cross_identity' WHEN conflicts = 1 THEN 'document_conflict'
            WHEN lacking > 0 OR coalesce(name_support, 0) < 2 THEN 'insufficient_evidence' WHEN asks > 0 THEN 'likely_match_needs_confirmation' WHEN single = 0 THEN 'verified_match' WHEN multi >= 2 THEN 'verified_with_partial_overlap' ELSE 'verified_no_conflict' END AS decision FROM s LEFT JOIN e USING (application_id)
    )"""


@query(f"""
    WITH {_CLUSTERS}, {_DECIDED}
    SELECT application_id, decision, decision LIKE 'verified%' AS issuable, decision IN ('suspected_cross_identity', 'document_conflict') AS needs_review, ['info', 'warn', 'needs_confirmation', 'reject'][greatest(coalesce(worst, 1), 1)] AS severity FROM x""")
def decisions(spark, d):
    return reconcile.decide(clusters(spark, d), documents=documents(spark, d).select("application_id", F.col("doc_status").alias("status")))


@query(f"""
    WITH {_CLUSTERS}, v AS (SELECT * FROM c WHERE status <> 'not_applicable' OR unreadable <> '')
    SELECT application_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE severity = 'reject'), '') AS blocking, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE severity = 'needs_confirmation'), '') AS confirmations, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE severity = 'info'), '') AS notes,
        coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE value <> '' AND corroboration >= 2), '') AS multi_sourced, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE value <> '' AND corroboration <= 1), '') AS single_sourced FROM v GROUP BY 1""")
def verdicts(spark, d):
    return reconcile.verdict(clusters(spark, d)).select("application_id", "blocking", "confirmations", "notes", "multi_sourced", "single_sourced")


@query("WITH " + DOCUMENTS_SQL + ", c AS (SELECT application_id, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS pending FROM docs WHERE l_returnflag <> 'R' GROUP BY 1) SELECT application_id, pending, CASE WHEN pending = 0 THEN 'ready' ELSE 'documents_still_processing' END AS state FROM c")
def barrier(spark, d):
    gender, source = F.col("gender"), F.col("source")
    status = F.when(gender == "MALE", F.lit("removed_by_user")).when(source == "barcode", F.lit("ready")).otherwise(F.lit("extracting"))
    return intake.barrier(documents(spark, d).select("application_id", status.alias("status")))


@query("SELECT event_id, CASE WHEN event_type <> 'click' AND date_trunc('second', ts) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTE THEN 'unreadable' WHEN event_type = 'click' THEN 'ready' ELSE 'pending' END AS status FROM events")
def stale_heal(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.lit("ready")).otherwise(F.lit("pending")).alias("status"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.col("ts").alias("updated_at"))
    return intake.heal(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'dob,name' ELSE 'name' END AS released, CASE WHEN c_custkey % 7 = 0 THEN 'expired' WHEN c_custkey % 5 = 0 THEN 'used' WHEN c_custkey % 11 = 0 THEN 'revoked' ELSE 'valid' END AS token FROM customer")
def scope_projection(spark, d):
    k = F.col("c_custkey")
    record = F.create_map(F.lit("name"), F.col("c_name"), F.lit("dob"), F.lit("1990-01-01"), F.lit("face"), F.lit("x"))
    scope = F.when(k % 3 == 0, F.array(F.lit("name"), F.lit("dob"))).otherwise(F.array(F.lit("name")))
    token = records.token_state(F.lit(10), F.when(k % 7 == 0, 5).otherwise(20), F.lit(True), F.when(k % 5 == 0, F.lit(1)), F.when(k % 11 == 0, 1).otherwise(0))
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(records.project(record, scope))), ",").alias("released"), token.alias("token"))


@query("WITH r AS (SELECT c_custkey AS gid, sha256(CAST(c_custkey % 100 AS VARCHAR)) AS h, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS revoked FROM customer), live AS (SELECT h, min(gid) AS gid FROM r WHERE revoked = 0 GROUP BY 1), nums AS (SELECT gid AS number, gid FROM r WHERE revoked = 0) SELECT o_orderkey, coalesce(live.gid, nums.gid) AS existing FROM (SELECT o_orderkey, sha256(CAST(o_orderkey % 150 AS VARCHAR)) AS h, o_custkey FROM orders) o LEFT JOIN live USING (h) LEFT JOIN nums ON nums.number = o.o_custkey")
def dedup_probe(spark, d):
    h = lambda c, n: F.sha2((F.col(c) % n).cast("string"), 256).alias("dedup_hash")
    live = t(spark, d, "customer").select(F.col("c_custkey").alias("gid"), h("c_custkey", 100), (F.col("c_custkey") % 4 == 0).cast("int").alias("revoked"))
    new = t(spark, d, "orders").select("o_orderkey", h("o_orderkey", 150), F.col("o_custkey").alias("number"))
    return records.probe(new, live, live.select(F.col("gid").alias("number"), "gid")).select("o_orderkey", "existing")


# --- faces


def _faces(spark, d):
    return t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("app"), "vec_id", "embedding", "label")


FACES_SQL = "f AS (SELECT vec_id // 5 AS app, vec_id, embedding AS v, label FROM embeddings), q AS (SELECT a.app, a.vec_id AS a_id, b.vec_id AS b_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS s, a.label = b.label AS same FROM f a JOIN f b ON a.app = b.app AND a.vec_id < b.vec_id)"


@query(f"WITH {FACES_SQL} SELECT app, a_id, b_id, round(s, 4) AS similarity FROM q")
def cosine_pairs(spark, d):
    return face_ops.pairs(_faces(spark, d), "app", "vec_id", "embedding")


@query(f"WITH {FACES_SQL} SELECT app, CAST(count(*) AS BIGINT) AS compared, round(avg(CASE WHEN round(s, 4) >= 0.5 THEN 1.0 ELSE 0.0 END), 2) AS confidence FROM q GROUP BY 1")
def face_match_summary(spark, d):
    return face_ops.summary(face_ops.pairs(_faces(spark, d), "app", "vec_id", "embedding"), "app")


@query(f"WITH {FACES_SQL}, w AS (SELECT unnest(range(0, 16)) AS i), x AS (SELECT round(0.2 + i * 0.05, 2) AS threshold, same, CASE WHEN round(s, 4) >= round(0.2 + i * 0.05, 2) THEN 1.0 ELSE 0.0 END AS hit FROM q, w) SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN NOT same THEN hit END), 6) AS far, round(avg(CASE WHEN same THEN 1 - hit END), 6) AS frr FROM x GROUP BY 1")
def far_frr_sweep(spark, d):
    f = _faces(spark, d)
    p = face_ops.pairs(f, "app", "vec_id", "embedding")
    label = lambda s: f.select(F.col("vec_id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"))
    return face_ops.sweep(p.join(label("a"), "a_id").join(label("b"), "b_id").withColumn("same", F.col("a_label") == F.col("b_label")), "same")


# --- what SQL cannot say


@query()
def name_comparisons(spark, d):
    a, b = F.col("p_name"), F.col("other")
    return spread(_pairs(spark, d), "p_partkey").select("p_partkey", alignment.name_comparison(a, b).alias("c"), alignment.osa_distance(a, b).alias("osa"), F.round(alignment.jaro_winkler_similarity(a, b), 6).alias("jaro_winkler"), alignment.name_difference(a, b).alias("diff")).select("p_partkey", "c.*", "osa", "jaro_winkler", "diff")


@query("""
    WITH RECURSIVE e AS (SELECT user_id AS key, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT), event_id) AS k FROM events),
    r AS (
        SELECT key, event_id, moment, k, moment AS start, 1 AS used FROM e WHERE k = 1
        UNION ALL SELECT e.key, e.event_id, e.moment, e.k, CASE WHEN e.moment >= r.start + 21600 THEN e.moment ELSE r.start END, CASE WHEN e.moment >= r.start + 21600 THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1
    )
    SELECT key, event_id, moment, used <= 5 AS allowed, CAST(greatest(0, 5 - used) AS INTEGER) AS remaining FROM r""")
def fixed_window_limiter(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_timestamp("ts").alias("at"))
    return limits.limited(e, 5, 6 * 3600).withColumnRenamed("at", "moment")


from corrobora import document_queries, service_queries, workflow_queries  # noqa: E402, F401  (add their queries)
