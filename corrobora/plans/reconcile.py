"""Reconciliation: readings of one field across documents become a value with support, dissent and abstention; fields become a decision.

Readings are rows (application_id, field, document_id, logical_id, ord, doc_type, page_role, value, source, status,
raw_value). Pools, gates and keys are columns; comparing the few different values of one field is a vectorised function.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import alignment, fields
from corrobora.functions.text import blank, let, struct_of

CLUSTERS = "application_id long, field string, value string, agreeing string, dissenting string, n_agree int, n_dissent int, confirmable int, corroboration int, support int, confidence double, strong boolean, sources string, status string, severity string, holder boolean, unreadable string, abstained string, asserted string, confirmed int"
#: What a cluster's own columns are, without its application.
CLUSTER = CLUSTERS.partition(", ")[2]
NAMES = [c.split()[0] for c in CLUSTER.split(", ")]


def weight(source: Column) -> Column:
    table = F.create_map(*[F.lit(v) for p in C.SOURCE_WEIGHTS.items() for v in p])
    return F.coalesce(table[F.coalesce(source, F.lit("vision"))], F.lit(C.DEFAULT_WEIGHT))


def keyed(readings: DataFrame, pivot: int) -> DataFrame:
    """Adds key and display: equal keys are one value. Each value is normalised once, by the rule of its field."""
    f = F.col("field")
    # Names, genders and addresses in normal form, as a column of its own: what follows uses it several times.
    readings = readings.withColumn("__v", F.when(f.endswith("name") | f.isin("gender", "address"), fields.nfkc(F.col("value"))).otherwise(F.col("value")))
    v = F.col("__v")
    both = lambda key, display: F.struct(key.alias("key"), display.alias("display"))
    other = F.upper(F.regexp_replace(F.trim(blank(v)), r"\s+", " "))
    is_date = (f == "dob") | f.endswith("date")
    readings = readings.withColumn("__parts", F.when(is_date, fields.date_parts(fields.tidy_date(v)))).withColumn("__iso", fields.iso_of(F.col("__parts"), pivot))
    told = (
        F.when(f.endswith("name"), let(fields.name_tokens(v), lambda w: both(F.array_join(F.array_sort(w), " "), F.array_join(w, " "))))
        .when(is_date, both(F.coalesce("__iso", F.lit("")), F.coalesce("__iso", F.trim(blank(v)))))
        .when(f == "gender", let(fields.gender(v), lambda g: both(g, g)))
        .when(f == "address", let(fields.spelt_out(fields.tidy_address(v)), lambda a: both(a, a)))
        .otherwise(both(other, F.trim(blank(v))))
    )
    return readings.withColumn("__k", told).withColumn("key", F.col("__k.key")).withColumn("display", F.col("__k.display")).drop("__k", "__parts", "__iso", "__v")


def anew(df: DataFrame) -> DataFrame:
    """``df`` with its application_id named anew: a union of parts that lie by application then does so too, also where they are read
    from a table of the catalog, whose name Spark takes for a part of the column's."""
    return df.withColumn("application_id", F.col("application_id").alias("application_id"))


def pooled(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """Readings of the fields that are compared, each row once and where it lies, with its group's field and with
    __first: for fields of a pool alone, where a reading stands among those of its document.

    Facts of a single card are not compared. Fields of a pool (a father's or a spouse's name) become one: the first member,
    in the pool's order, that the page can carry and that is verified; else the first that was read but not verified; else
    none, so that the document abstains. chosen() picks it, where the readings of a field have met.
    """
    pool = {m: g for g, members in C.GROUPS.items() for m in members}
    group = F.coalesce(*[F.when(F.col("field") == m, F.lit(g)) for m, g in pool.items()], F.col("field"))
    own = F.broadcast(registry.where(F.col("field").isin(*pool)).select("doc_type", "page_role", "field", F.col("carries").alias("__own")))
    rows = readings.where(F.col("field").isin(*C.COMPARED)).join(own, ["doc_type", "page_role", "field"], "left")
    carried, verified = F.coalesce("__own", F.lit("yes")) != "no", F.coalesce("status", F.lit("present_verified")) == "present_verified"
    full, member = F.trim(blank(F.col("value"))) != "", F.array_position(F.array(*[F.lit(m) for m in pool]), F.col("field"))
    rank = F.when(carried & verified & full, 0).when(carried & ~verified & (full | F.col("raw_value").isNotNull()), 1).when(carried, 2).otherwise(3)
    rest = [c for c in readings.columns if c not in ("application_id", "document_id", "field", "value", "source", "status", "raw_value")]
    rows = rows.withColumn("__first", F.when(F.col("field").isin(*pool), F.struct(rank.alias("rank"), member.alias("member"), "value", "source", "status", "raw_value", *rest)))
    shown = F.col("__first").isNull() | (F.col("__first.rank") < 2)
    return rows.withColumns({c: F.when(shown, F.col(c)) for c in ("value", "status", "raw_value")} | {"field": group}).drop("__own")


def chosen(readings: Column) -> Column:
    """Of each document the first of its readings of one pool."""
    ranked = F.sort_array(F.transform(readings, lambda r: F.struct(r["r"]["document_id"].alias("document_id"), r["first"].alias("first"), r.alias("x"))))
    return let(ranked, lambda a: F.transform(F.filter(a, lambda x, i: (i == 0) | ~x["document_id"].eqNullSafe(F.get(a, i - 1)["document_id"])), lambda x: x["x"]))


def gated(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds bucket: abstained (not carried, or not evidenced), unreadable (expected, no usable value) or present.

    A page that the registry does not describe may carry anything.
    """
    own = F.broadcast(registry.select("doc_type", "page_role", "field", "carries"))
    carries, status = F.coalesce("carries", F.lit("yes")), F.coalesce("status", F.lit("present_verified"))
    expected = carries == "yes"
    bucket = (
        F.when(carries == "no", F.lit("abstained"))
        .when((status == "unreadable") | (status == "present_uncertain") & F.col("raw_value").isNotNull() & expected, F.lit("unreadable"))
        .when(status != "present_verified", F.lit("abstained"))
        .when((F.col("key") == "") & expected, F.lit("unreadable"))
        .when(F.col("key") == "", F.lit("abstained"))
        .otherwise(F.lit("present"))
    )
    return readings.join(own, ["doc_type", "page_role", "field"], "left").withColumn("bucket", bucket)


@lru_cache(maxsize=200_000)
def alike(field: str, a: str, b: str) -> tuple[bool, bool]:
    """(same value seen twice, close enough to ask)."""
    if field.endswith("name"):
        verdict = alignment.compare_names(a, b)[0]
        return verdict in ("identical", "safe_variant"), verdict == "needs_confirmation"
    if field == "address":
        relation = alignment.address_relation(a, b)
        return relation == "same", relation == "same_area"
    d = alignment.plain_distance(a, b)
    return d == 0, 0 < d <= 2


@lru_cache(maxsize=65_536)
def two_places(x: float) -> float:
    """Rounded to two places; what is between goes up, whatever a sum of weights like 0.6 lacks in its last bits."""
    return float(Decimal(str(round(x, 6))).quantize(Decimal("0.01"), ROUND_HALF_UP))


def cluster(field: str, present: list[dict], settled: list[list[str]]) -> tuple:
    """The columns of MERGED, for the present readings of a field, in their order, of which two differ at least."""
    severity = C.SEVERITY.get(field, "warn")
    of_key: dict[str, list[dict]] = {}
    for r in present:
        of_key.setdefault(r["key"], []).append(r)
    groups = list(of_key.values())
    heavy = lambda g: sum([r["weight"] for r in g])
    while len(groups) > 1:
        pair = next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if alike(field, groups[i][0]["display"], groups[j][0]["display"])[0]), None)
        if pair is None:
            break
        i, j = pair if heavy(groups[pair[0]]) >= heavy(groups[pair[1]]) else pair[::-1]
        groups[i] += groups[j]  # the heavier group keeps its face
        del groups[j]
    if len(groups) > 1:
        groups.sort(key=lambda g: (-(max([r["weight"] for r in g]) >= C.STRONG), -round(heavy(g), 6), -len(g), g[0]["display"]))
    spelt: dict[str, float] = {}
    for r in groups[0]:
        spelt[r["display"]] = spelt.get(r["display"], 0) + r["weight"]
    value = min(spelt, key=lambda s: (-round(spelt[s], 6), s))
    face = next(r["key"] for r in groups[0] if r["display"] == value)
    agree, dissent, confirmed = [], [], 0
    for n, g in enumerate(groups):
        for r in g:
            same, ask = (True, False) if r["display"] == value else alike(field, value, r["display"])
            held = bool(settled) and not (n == 0 and same) and (n == 0 or ask) and any(face in keys and r["key"] in keys for keys in settled)
            confirmed += held
            r["ask"] = ask or n == 0
            (agree if n == 0 and same or held else dissent).append(r)
    own = lambda r: r["source"] in C.HOLDER_SOURCES
    backed = {r["logical_id"] for r in agree if not own(r)}
    ask = [r for r in dissent if r["ask"]]
    kinds = {r["doc_type"] for r in agree}
    share = sum(r["weight"] for r in groups[0] if r["doc_type"] in kinds) / heavy(present)
    level = "none" if not dissent else severity if severity in ("info", "warn") else "needs_confirmation" if len(ask) == len(dissent) else "reject"
    hard = sum(not r["ask"] and not own(r) for r in dissent)
    return (value, ",".join(r["doc_type"] for r in agree), ",".join(f"{r['doc_type']}={r['display']}" for r in dissent), len(agree), hard, len(dissent) - hard, len(backed), len(backed | {r["logical_id"] for r in ask if not own(r)}), two_places(share), any(r["weight"] >= C.STRONG for r in groups[0]), ",".join(sorted({r["source"] for r in groups[0]})), "disagreement" if dissent else "agreement" if len(backed) >= 2 else "single_source", level, confirmed)


MERGED = "value string, agreeing string, dissenting string, n_agree int, n_dissent int, confirmable int, corroboration int, support int, confidence double, strong boolean, sources string, status string, severity string, confirmed int"


#: What cluster() asks of a reading.
SEEN = ["logical_id", "doc_type", "source", "key", "display", "weight"]


@F.arrow_udf(struct_of(MERGED))
def merged(field: pa.Array, rows: pa.Array, settled: pa.Array) -> pa.Array:
    """cluster() of the groups that are given; empty ones are passed over.

    No list is null: before each row Spark asks how large its batch is, and Arrow then walks over all nulls since the last list.
    """
    each = ({"logical_id": i, "doc_type": d, "source": s, "key": k, "display": v, "weight": w} for i, d, s, k, v, w in zip(*[c.to_pylist() for c in rows.flatten().flatten()], strict=True))
    sizes, told = pc.list_value_length(rows).to_pylist(), settled.to_pylist()
    out = [cluster(f, list(islice(each, n)), k) if n else None for f, n, k in zip(field.to_pylist(), sizes, told, strict=True)]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = [x.split() for x in MERGED.split(", ")]
    return pa.StructArray.from_arrays([pa.array([x and x[i] for x in out], kinds[kind]) for i, (_, kind) in enumerate(columns)], [c for c, _ in columns])


#: A filter on what it returns would be moved before it, and compare everything once more.
merged = merged.asNondeterministic()


def compare(readings: DataFrame, registry: DataFrame, pivot: int, confirmations: DataFrame | None = None) -> DataFrame:
    """One row of CLUSTERS for each compared field of each application; an application has MAX_FILES documents at most.

    ``confirmations`` (application_id, field, values): values that the holder said to be one; they settle differences that
    may be asked about, never others. Readings of a field meet in one exchange, or in none if they lie by application_id
    already: those that do, in partitions of some 100,000 documents, are sorted in memory. Where all that was read is one value,
    built-in functions say the rest; only fields with two spellings at least go to Python, which compares them.
    """
    rows = gated(keyed(pooled(readings, registry), pivot), registry).withColumn("weight", weight(F.col("source")))
    shape = F.struct(F.struct("ord", "document_id", "logical_id", "doc_type", "source", "key", "display", "weight").alias("r"), "bucket", "status", "raw_value", F.col("__first").alias("first"))
    # One list for each field: what is asked of its few readings is asked of the list.
    per = rows.groupBy("application_id", "field").agg(F.collect_list(shape).alias("__all"))
    per = per.withColumn("__all", F.when(F.col("field").isin(*C.GROUPS), chosen(F.col("__all"))).otherwise(F.col("__all")))
    per = per.withColumn("rows", F.sort_array(F.transform(F.filter("__all", lambda x: x["bucket"] == "present"), lambda x: x["r"])))
    each = lambda c: F.transform("rows", lambda r: r[c])
    types = lambda b: F.array_join(F.sort_array(F.transform(F.filter("__all", lambda x: x["bucket"] == b), lambda x: x["r"]["doc_type"])), ",")
    said = F.filter("__all", lambda x: (x["bucket"] == "abstained") & (x["status"] == "holder_asserted") & x["raw_value"].isNotNull())
    per = per.select(
        "application_id", "field", "rows", F.size("rows").alias("n"), F.array_min(each("display")).alias("display"), F.array_max(each("display")).alias("__other"), F.array_max(each("weight")).alias("top"),
        F.size(F.array_distinct(F.transform(F.filter("rows", lambda r: ~r["source"].isin(*C.HOLDER_SOURCES) & r["logical_id"].isNotNull()), lambda r: r["logical_id"]))).alias("backed"), F.array_join(F.sort_array(F.array_distinct(each("source"))), ",").alias("sources"),
        types("unreadable").alias("unreadable"), types("abstained").alias("abstained"), F.exists("__all", lambda x: F.coalesce(x["status"] == "holder_asserted", F.lit(False))).alias("holder"),
        F.coalesce(F.array_min(F.transform(said, lambda x: F.struct(x["r"]["ord"], x["r"]["document_id"], x["raw_value"].alias("raw_value"))))["raw_value"], F.lit("")).alias("asserted"),
    ).withColumn("mixed", F.coalesce(F.col("display") != F.col("__other"), F.lit(False)))
    if confirmations is not None:
        told = keyed(confirmations.withColumn("__id", F.monotonically_increasing_id()).select("application_id", "field", "__id", F.explode("values").alias("value")), pivot)
        keys = told.groupBy("application_id", "field", "__id").agg(F.collect_set("key").alias("keys")).groupBy("application_id", "field").agg(F.collect_list("keys").alias("keys"))
        # Joined by application alone, as readings lie by it.
        told = keys.groupBy("application_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "keys"))).alias("__told"))
        per = per.join(told, "application_id", "left").withColumn("settled", F.try_element_at("__told", F.col("field"))).drop("__told")
    else:
        per = per.withColumn("settled", F.lit(None))
    none_said = F.array().cast("array<array<string>>")
    per = per.withColumn("m", merged("field", F.transform(F.when(F.col("mixed"), F.col("rows")).otherwise(F.slice("rows", 1, 0)), lambda r: F.struct(*[r[c].alias(c) for c in SEEN])), F.coalesce(F.col("settled").cast("array<array<string>>"), none_said)))
    none, zero, no = F.col("n") == 0, F.lit(0), F.lit("")
    unread = none & (F.col("holder") | (F.col("unreadable") != ""))
    one = {
        "value": F.coalesce("display", no), "agreeing": F.array_join(each("doc_type"), ","), "dissenting": no, "n_agree": F.col("n"), "n_dissent": zero, "confirmable": zero,
        "corroboration": F.col("backed"), "support": F.col("backed"), "confidence": F.when(none, 0.0).otherwise(1.0), "strong": F.coalesce(F.col("top") >= C.STRONG, F.lit(False)), "sources": F.col("sources"),
        "status": F.when(unread, "not_extracted").when(none, "not_applicable").when(F.col("backed") >= 2, "agreement").otherwise("single_source"), "severity": F.when(unread, "info").otherwise("none"), "confirmed": zero,
    }
    made = {c: F.when(F.col("mixed"), F.col(f"m.{c}")).otherwise(v) for c, v in one.items()} | {c: F.col(c) for c in ("holder", "unreadable", "abstained", "asserted")}
    kinds = dict(x.split() for x in CLUSTER.split(", "))
    return per.select("application_id", "field", *[made[c].cast(kinds[c]).alias(c) for c in NAMES if c != "field"])


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(v) for i, s in enumerate(C.SEVERITIES) for v in (s, i)])[severity]


def worst(rank: Column) -> Column:
    """The severity of a rank, info at least; the greatest rank of a group says how bad it is."""
    return F.element_at(F.array(*map(F.lit, C.SEVERITIES)), F.greatest(rank, F.lit(1)) + 1)


def corroboration(source: Column, logical_id: Column) -> Column:
    """An aggregate: documents that back a value, each card once, and nothing that its holder typed."""
    return F.count_distinct(F.when(~source.isin(*C.HOLDER_SOURCES), logical_id))


def share(agrees: Column, weight_: Column) -> Column:
    """An aggregate: the weight of the readings that agree, of all."""
    return F.round(F.sum(F.when(agrees, weight_).otherwise(0.0)) / F.sum(weight_), 4)


#: What verdict() lists of an application's fields.
LISTS = ["blocking", "confirmations", "warnings", "notes", "confirmable", "multi_sourced", "single_sourced"]


def listed() -> Column:
    """An aggregate: the fields of an application that are shown, with what LISTS ask of them; empty if there are none."""
    shown = (F.col("status") != "not_applicable") | (F.col("unreadable") != "")
    return F.collect_list(F.when(shown, F.struct("field", "severity", (F.col("value") != "").alias("valued"), "corroboration"))).alias("shown")


def decide(clusters: DataFrame, integrity: DataFrame | None = None, documents: DataFrame | None = None, *more: Column) -> DataFrame:
    """One decision for each application, by the first rule that applies.

    ``integrity`` (application_id): applications that failed a check. ``documents`` (application_id, status): all
    documents; an application has a decision if any of the three tables names it. ``more``: aggregates of an application's
    clusters, which stay beside its decision, null where it has none.
    """
    is_ = lambda c, *v: F.col(c).isin(*v)
    conflict = is_("field", *C.IDENTITY_FIELDS) & (F.col("corroboration") >= 1) & (F.col("n_dissent") > 0)
    ask = is_("field", *C.IDENTITY_FIELDS) & (F.col("corroboration") >= 1) & (F.col("n_dissent") == 0) & (F.col("confirmable") > 0)
    lacking = is_("field", *C.REQUIRED_FIELDS) & (F.col("status") == "not_extracted") & ~F.col("holder")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    valued = F.col("value") != ""
    per = clusters.groupBy("application_id").agg(n(conflict).alias("conflicts"), n(ask).alias("asks"), n(lacking).alias("lacking"), F.coalesce(F.max(F.when(is_("field", "holder_name"), F.col("support"))), F.lit(0)).alias("name_support"), n(valued & (F.col("corroboration") >= 2)).alias("multi"), n(valued & (F.col("corroboration") <= 1)).alias("single"), n(F.col("holder")).alias("holders"), F.max(severity_rank(F.col("severity"))).alias("severity_rank"), *more)
    beside = per.columns[9:]
    per = anew(per).select("*", *[F.lit(None).cast("boolean").alias(c) for c in ("failed", "ready", "retake", "rejected")])
    if integrity is not None:
        per = per.unionByName(integrity.select("application_id", F.lit(True).alias("failed")).distinct(), allowMissingColumns=True)
    if documents is not None:
        any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
        per = per.unionByName(documents.groupBy("application_id").agg(any_("ready").alias("ready"), any_("retake_required").alias("retake"), any_("rejected_file").alias("rejected")), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)) if c in ("conflicts", "asks", "lacking", "name_support", "multi", "single", "holders") else F.max(c)
    if integrity is not None or documents is not None:
        per = per.groupBy("application_id").agg(*[zero(c).alias(c) for c in per.columns[1:]])
    decision = (
        F.when(F.col("failed"), F.lit("blocked_security_integrity"))
        .when(~F.col("ready") & F.col("retake"), F.lit("retake_required"))
        .when(~F.col("ready") & F.col("rejected"), F.lit("rejected_invalid_document"))
        .when(~F.col("ready"), F.lit("extraction_failed"))
        .when(F.col("conflicts") >= 2, F.lit("suspected_cross_identity"))
        .when(F.col("conflicts") == 1, F.lit("document_conflict"))
        .when((F.col("lacking") > 0) | (F.col("name_support") < C.MINIMUM_DOCUMENTS), F.lit("insufficient_evidence"))
        .when(F.col("asks") > 0, F.lit("likely_match_needs_confirmation"))
        .when((F.col("single") == 0) & (F.col("holders") == 0), F.lit("verified_match"))
        .when(F.col("multi") >= 2, F.lit("verified_with_partial_overlap"))
        .otherwise(F.lit("verified_no_conflict"))
    )
    severity = worst(F.col("severity_rank"))
    return per.select("application_id", decision.alias("decision"), decision.isin(*C.ISSUABLE).alias("issuable"), decision.isin("blocked_security_integrity", "suspected_cross_identity", "document_conflict").alias("needs_review"), severity.alias("severity"), *beside)


def verdict(clusters: DataFrame, integrity: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Decisions, by decide(), with a status and the fields by severity: blocking, confirmations, warnings, notes; confirmable, multi
    and single sourced. Clusters are read once for both."""
    severe, valued = lambda s: lambda x: x["severity"] == s, lambda x: x["valued"]
    tests = [severe("reject"), severe("needs_confirmation"), severe("warn"), severe("info"), lambda x: (x["severity"] == "needs_confirmation") & x["field"].isin(*C.IDENTITY_FIELDS), lambda x: valued(x) & (x["corroboration"] >= 2), lambda x: valued(x) & (x["corroboration"] <= 1)]
    lists = {c: F.coalesce(F.array_join(F.sort_array(F.transform(F.filter("shown", test), lambda x: x["field"])), ","), F.lit("")) for c, test in zip(LISTS, tests, strict=True)}
    status = F.when(F.col("issuable"), F.lit("match")).when(F.col("decision") == "likely_match_needs_confirmation", F.lit("needs_confirmation")).otherwise(F.lit("rejected"))
    return decide(clusters, integrity, documents, listed()).withColumn("status", status).withColumns(lists).drop("shown")


def confirmation_errors(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """``requests`` (request_id, application_id, comparison_id, field, decision) with error, '' where the holder may say that two spellings
    are one person's. ``latest`` (application_id, comparison_id, verdict, confirmable, severities map): each application's last comparison."""
    last = latest.select("application_id", F.col("comparison_id").alias("__last"), F.col("verdict").alias("__verdict"), F.col("confirmable").alias("__ask"), F.col("severities").alias("__severities"))
    soft = (F.col("__verdict") == "likely_match_needs_confirmation") & F.array_contains("__ask", F.col("field")) & (F.try_element_at("__severities", F.col("field")) == "needs_confirmation")
    error = (
        F.when(F.coalesce("decision", F.lit("")) != "same_person", F.lit("unsupported_confirmation_decision"))
        .when(F.coalesce("field", F.lit("")) == "", F.lit("field_required"))
        .when(F.col("__last").isNull(), F.lit("no_comparison"))
        .when(~F.coalesce(F.col("comparison_id") == F.col("__last"), F.lit(False)), F.lit("comparison_superseded"))
        .when(~F.coalesce(soft, F.lit(False)), F.lit("field_not_confirmable"))
        .otherwise(F.lit(""))
    )
    return requests.join(last, "application_id", "left").withColumn("error", error).select(*requests.columns, "error")


def face_field(pairs: DataFrame, group: str) -> DataFrame:
    """The face as a field of each group of ``pairs`` (group, a_id, b_id, similarity): advisory, so a mismatch warns and never rejects."""
    hit = F.col("similarity") >= 0.5
    name = F.concat_ws(" ↔ ", F.col("a_id").cast("string"), F.col("b_id").cast("string"))
    per = pairs.where("similarity IS NOT NULL").groupBy(group).agg(F.count("*").alias("compared"), F.array_join(F.array_sort(F.collect_list(F.when(hit, name))), ",").alias("agreeing"), F.count_if(~hit).alias("n_dissent"), F.round(F.avg(hit.cast("double")), 2).alias("confidence"))
    return per.select(group, F.lit("face").alias("field"), F.concat(F.col("compared").cast("string"), F.lit(" photo pair(s) compared")).alias("value"), "agreeing", "n_dissent", "confidence", F.when(F.col("n_dissent") > 0, F.lit("disagreement")).otherwise(F.lit("agreement")).alias("status"), F.when(F.col("n_dissent") > 0, F.lit("warn")).otherwise(F.lit("none")).alias("severity"))


def consensus_by_key(readings: DataFrame) -> DataFrame:
    """Fields whose values merge only when equal (dates, genders, numbers): consensus in built-in aggregates alone.

    ``readings``: (application_id, logical_id, ord, key, weight, source) of present values; those without a key are left out.
    """
    per = readings.groupBy("application_id", "key").agg(F.sum("weight").alias("w"), F.max("weight").alias("top"), F.count("*").alias("n"), corroboration(F.col("source"), F.col("logical_id")).alias("corroboration"), F.count("key").alias("known"))
    per = per.where("known > 0")  # not a condition on the key, which Spark would compute once more below
    every = Window.partitionBy("application_id")
    order = every.orderBy((F.col("top") >= C.STRONG).desc(), F.round("w", 6).desc(), F.desc("n"), "key")
    ranked = per.select("*", F.row_number().over(order).alias("r"), F.sum("w").over(every).alias("all_w"), F.sum("n").over(every).alias("all_n"))
    status = F.when(F.col("all_n") > F.col("n"), F.lit("disagreement")).when(F.col("corroboration") >= 2, F.lit("agreement")).otherwise(F.lit("single_source"))
    return ranked.where("r = 1").select("application_id", F.col("key").alias("value"), F.col("n").alias("n_agree"), (F.col("all_n") - F.col("n")).alias("n_dissent"), "corroboration", F.round(F.col("w") / F.col("all_w"), 6).alias("confidence"), status.alias("status"))
