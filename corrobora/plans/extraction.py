"""Readings of one document: what a model says, gated by what the page can carry and what its text shows, merged and repaired.

Rows are (doc_id, field, ...): one for each field of a document, so every rule is a CASE ladder over columns and the only
joins are with the small registry and with other readings of the same field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import numbers, responses
from corrobora.functions.text import blank
from corrobora.plans import evidence

#: Fields that a second, single look may settle, and how many of a document.
REREAD, REREAD_MOST = ["holder_name", "dob", "gender", "document_number"], 3
#: Ways to enhance a marginal image, each with the metrics that call for it; how many of them are made.
VARIANTS_MOST = 3


def has(x: Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


# --- what a model answered


def readings(answers: DataFrame, text: str = "response") -> DataFrame:
    """``answers`` exploded to one row for each known field: field, value, evidence, claimed type, error.

    Of several keys that mean one field the first with a value counts. An answer that cannot be read gives one row, with
    its error and no field; one without any known field says no_expected_field.
    """
    names = [*C.FIELDS, "document_type"]
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(responses.canonical_key(e["key"]).alias("k"), e["value"].alias("v")))
    proof = F.coalesce(*[F.try_variant_get(F.try_element_at("a.fields", F.lit(k)), "$", "map<string,variant>") for k in ("evidence", "_evidence", "evidence_text")], F.lit(None).cast("map<string,variant>"))
    sound = lambda e: e["v"].isNotNull() & (F.schema_of_variant(e["v"]) != "VOID")
    df = answers.withColumn("a", responses.answer(F.col(text)))
    df = df.withColumn("pairs", F.filter(pairs(F.col("a.fields")), lambda e: e["k"].isin(*names))).withColumn("proof", F.transform(pairs(proof), lambda e: F.struct(e["k"], responses.plain(e["v"]).alias("t"))))
    error = F.when(F.col("a.error") != "", F.col("a.error")).when(F.size("pairs") == 0, F.lit("no_expected_field")).otherwise(F.lit(""))
    value = lambda f: responses.plain(F.get(F.filter("pairs", lambda e: (e["k"] == f) & sound(e)), F.lit(0))["v"])
    told = lambda f: F.element_at(F.filter("proof", lambda e: (e["k"] == f) & e["t"].isNotNull()), -1)["t"]
    shown = lambda f: F.when(F.exists("proof", lambda e: (e["k"] == f) & e["t"].isNotNull()), told(f))
    rows = F.when(error == "", F.transform(F.array(*map(F.lit, C.FIELDS)), lambda f: F.struct(f.alias("field"), value(f).alias("value"), shown(f).alias("evidence"))))
    kind = responses.document_type(value(F.lit("document_type")))
    keep = [c for c in answers.columns if c != text]
    return df.select(*keep, error.alias("error"), F.when(error == "", kind).alias("claimed"), F.explode_outer(rows).alias("r")).select(*keep, "error", "claimed", "r.field", "r.value", "r.evidence")


def meets(text: Column, condition: Column) -> Column:
    """Whether ``text`` meets a condition of the registry; the few that there are stand as literals, so that each is compiled once."""
    out = F.when(F.lit(False), False)
    for pattern in sorted({p for *_, conditions in C.CAPABILITIES.values() for p in conditions.values()}):
        out = out.when(condition == F.lit(pattern), text.rlike(pattern))
    return out.otherwise(F.regexp_like(text, F.coalesce(condition, F.lit(""))))


def gate(rows: DataFrame, registry: DataFrame, pivot: int, trusted: Column | None = None) -> DataFrame:
    """``rows`` (doc_type, page_role, field, value, evidence, page_text, mrz, source[, confirmed]) with status, reason, verified,
    confidence, normalized_value.

    First what the page can carry: an impossible field, or one whose condition no text meets, is invalid. Then the
    evidence: only what the page is shown to print becomes present_verified. ``trusted`` rows skip the second gate.
    """
    own = F.broadcast(registry.select("doc_type", "page_role", "field", "capability", "condition"))
    rows = rows.join(own, ["doc_type", "page_role", "field"], "left")
    hay = F.concat_ws(" ", blank(F.col("evidence")), blank(F.col("page_text")), blank(F.col("mrz")))
    value, field, page = F.col("value"), F.col("field"), F.col("page_text")
    label = evidence.label_present(field, F.col("evidence")) | evidence.label_present(field, page)
    number = (field == "document_number") & (F.col("doc_type") != "unknown") & (numbers.number_reason(F.col("doc_type"), value) == "")
    assessed = evidence.field_status(
        value, F.col("source"), number, evidence.shows(field, value, page, pivot), evidence.shows(field, value, F.col("evidence"), pivot), label, evidence.witnesses(page), field.isin(*C.SELF_IDENTIFYING),
        F.coalesce(F.col("capability") == "required", F.lit(False)), F.coalesce(F.col("confirmed"), F.lit(False)) if "confirmed" in rows.columns else None,
    )
    told = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    status = (
        F.when(~has(value), told("not_present", "no_value_returned"))
        .when(F.col("capability") == "impossible", told("invalid", "field_impossible_for_document"))
        .when(F.col("condition").isNotNull() & ~meets(hay, F.col("condition")), told("invalid", "conditional_evidence_missing"))
    )
    status = status.when(trusted, told("present_verified", "trusted_input")) if trusted is not None else status
    rows = rows.withColumn("__s", status.otherwise(assessed)).drop("capability", "condition")
    return enveloped(rows.withColumn("status", F.col("__s.status")).withColumn("reason", F.col("__s.reason")).drop("__s"))


def enveloped(rows: DataFrame) -> DataFrame:
    """Adds verified, confidence and normalized_value from value and status."""
    ok = F.col("status") == "present_verified"
    level = F.when(~has(F.col("value")) | (F.col("status") == "invalid"), F.lit(0.0)).when(ok, F.lit(0.8)).otherwise(F.lit(0.3))
    return rows.withColumn("verified", ok).withColumn("confidence", level).withColumn("normalized_value", F.when(ok, F.col("value")))


def refusals(gated: DataFrame, *by: str) -> DataFrame:
    """(``by``, rejected, unsupported): of each document the values that the gates did not let through, by field.

    rejected: what its page cannot carry, array of (field, value, reason, doc_type, page_role); unsupported: what it does not
    verifiably show, array of (field, value, status, reason). Fields without a value are in neither; documents without
    either have empty lists.
    """
    refused, read = F.col("status") == "invalid", has(F.col("value"))
    listed = lambda which, *c: F.array_sort(F.collect_list(F.when(which, F.struct(*c))))
    return gated.groupBy(*by).agg(listed(read & refused, "field", "value", "reason", "doc_type", "page_role").alias("rejected"), listed(read & ~refused & (F.col("status") != "present_verified"), "field", "value", "status", "reason").alias("unsupported"))


def reassess(rows: DataFrame, registry: DataFrame, pivot: int) -> DataFrame:
    """The gates again, once the type is known. What is verified stays so, unless the page cannot carry it; nothing else gets worse
    than the rules say, and an unknown type changes nothing."""
    before = rows.withColumnsRenamed({c: f"__{c}" for c in ("status", "reason", "verified", "confidence", "normalized_value")})
    again = gate(before, registry.withColumn("condition", F.lit(None).cast("string")), pivot)
    stays = ~has(F.col("value")) | (F.col("doc_type") == "unknown") | (F.col("status") != "invalid") & (F.col("__status") == "present_verified")
    out = again
    for c in ("status", "reason", "verified", "normalized_value"):
        out = out.withColumn(c, F.when(stays, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.withColumn("confidence", F.col("__confidence")).drop(*[f"__{c}" for c in ("status", "reason", "verified", "confidence", "normalized_value")])


# --- several readings of one field


def merge(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Two models' rows (value, status, reason) of each field as one: (keys, value, status, reason, confidence, level, candidates).

    What either side found invalid stays so. Equal readings verify each other; of different ones the evidenced side wins,
    and if neither or both are, the field is uncertain.
    """
    side = lambda df, s: df.select(*keys, F.struct("value", "status", "reason").alias(s))
    rows = side(primary, "a").join(side(secondary, "b"), keys, "full_outer")
    a, b = F.col("a"), F.col("b")
    is_ = lambda x, s: F.coalesce(x["status"] == s, F.lit(False))
    fold = lambda c: F.upper(F.trim(c))
    ok_a, ok_b, both = is_(a, "present_verified"), is_(b, "present_verified"), has(a["value"]) & has(b["value"])
    same = fold(a["value"]) == fold(b["value"])
    row = lambda value, status, reason, confidence, level: F.struct(value.alias("value"), status.alias("status"), reason.alias("reason"), F.lit(confidence).alias("confidence") if not isinstance(confidence, Column) else confidence.alias("confidence"), (F.lit(level) if isinstance(level, str) else level).alias("level"))
    text = F.lit
    kept = lambda x, confidence, level: row(x["value"], x["status"], x["reason"], confidence, level)
    alone = lambda x: kept(x, F.when(is_(x, "present_verified"), 0.8).otherwise(0.3), F.when(is_(x, "present_verified"), text("medium")).otherwise(text("low")))
    made = (
        F.when(is_(a, "invalid"), kept(a, 0.0, "none"))
        .when(is_(b, "invalid"), kept(b, 0.0, "none"))
        .when(both & same, row(a["value"], text("present_verified"), F.when(ok_a, a["reason"]).when(ok_b, b["reason"]).otherwise(text("confirmed_by_second_model")), 0.95, "high"))
        .when(both & ok_a & ~ok_b, kept(a, 0.6, "medium"))
        .when(both & ok_b & ~ok_a, kept(b, 0.6, "medium"))
        .when(both, row(a["value"], text("present_uncertain"), text("models_disagree"), 0.3, "low"))
        .when(has(a["value"]), alone(a))
        .when(has(b["value"]), alone(b))
        .otherwise(row(F.lit(None).cast("string"), F.coalesce(a["status"], b["status"], text("not_present")), F.coalesce(a["reason"], b["reason"]), 0.0, "none"))
    )
    candidates = F.when(both & ~same & ~is_(a, "invalid") & ~is_(b, "invalid"), F.array(a["value"], b["value"]))
    return rows.select(*keys, made.alias("m"), candidates.alias("candidates")).select(*keys, "m.*", "candidates")


def overwrite(fields: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Readings of machine-readable sources (keys, value, source) take the place of ``fields`` (value, status, reason, confidence, source);
    of several of one key, the machine-readable zone comes last and so wins. Blank ones change nothing."""
    best = exact.where(has(F.col("value"))).groupBy(*keys).agg(F.max_by(F.struct("value", "source"), F.struct(F.col("source") == "mrz", F.col("source"), F.col("value"))).alias("x"))
    hit, out = F.col("x").isNotNull(), fields.join(best, keys, "full_outer")
    new = {"value": F.col("x.value"), "status": F.lit("present_verified"), "reason": F.concat(F.lit("self_evident_source:"), F.col("x.source")), "confidence": F.lit(0.99), "source": F.col("x.source")}
    return out.select(*keys, *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) for c in new])


def ocr_consensus(fields: DataFrame, texts: DataFrame, pivot: int) -> DataFrame:
    """Fields (doc_id, field, value, status, reason, confidence) that are not verified become so where two texts of the page at least
    (doc_id, variant, text) show value and label each. Adds ``variants``, the texts that do."""
    open_ = has(F.col("value")) & F.col("status").isin("present_uncertain", "not_present", "unreadable")
    pairs = fields.where(open_).select("doc_id", "field", "value").join(texts, "doc_id")
    seen = pairs.where(evidence.shows(F.col("field"), F.col("value"), F.col("text"), pivot) & evidence.label_present(F.col("field"), F.col("text")))
    found = seen.groupBy("doc_id", "field").agg(F.array_sort(F.collect_set("variant")).alias("variants"), F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    out, hit = fields.join(found, ["doc_id", "field"], "left"), F.col("variants").isNotNull()
    return out.withColumns({"status": F.when(hit, F.lit("present_verified")).otherwise(F.col("status")), "reason": F.when(hit, F.lit("verified_by_ocr_consensus")).otherwise(F.col("reason")), "confidence": F.when(hit, F.greatest("confidence", F.lit(0.75))).otherwise(F.col("confidence"))})


def reread(fields: DataFrame, again: DataFrame, page_texts: DataFrame, pivot: int) -> DataFrame:
    """Up to REREAD_MOST uncertain fields of a document are settled by a second look (doc_id, field, answer): agreement verifies; where it
    fails though the label stands on the page (doc_id, page_text), the reason says so."""
    order = F.array_position(F.array(*map(F.lit, C.FIELDS)), F.col("field"))
    wanted = fields.where(has(F.col("value")) & (F.col("status") == "present_uncertain") & F.col("field").isin(*REREAD))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    targets = wanted.withColumn("__r", rank).where(F.col("__r") <= REREAD_MOST).select("doc_id", "field", F.lit(True).alias("__target"))
    out = fields.join(targets, ["doc_id", "field"], "left").join(again.select("doc_id", "field", F.col("answer").alias("__answer")), ["doc_id", "field"], "left").join(page_texts.select("doc_id", F.col("page_text").alias("__page")), "doc_id", "left")
    asked = F.coalesce("__target", F.lit(False))
    agrees = asked & has(F.col("__answer")) & evidence.shows(F.col("field"), F.col("value"), F.col("__answer"), pivot)
    lost = asked & ~agrees & evidence.label_present(F.col("field"), F.col("__page"))
    out = out.withColumns({"status": F.when(agrees, F.lit("present_verified")).otherwise(F.col("status")), "reason": F.when(agrees, F.lit("verified_by_field_reread")).when(lost, F.lit("field_area_found_but_unreadable")).otherwise(F.col("reason")), "confidence": F.when(agrees, F.greatest("confidence", F.lit(0.8))).otherwise(F.col("confidence"))})
    return out.drop("__target", "__answer", "__page")


def content_score(fields: DataFrame) -> DataFrame:
    """(doc_id, score): fields that came back with content."""
    return fields.groupBy("doc_id").agg(F.count_if(F.col("value").isNotNull() & (F.col("status") != "invalid")).alias("score"))


def keep_focused(first: DataFrame, focused: DataFrame) -> DataFrame:
    """(doc_id, read): which of two reads of a document goes on; the focused one unless it found less. A read that is missing scores -1."""
    score = lambda df, c: content_score(df).select("doc_id", F.col("score").alias(c))
    both = score(first, "a").join(score(focused, "b"), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.coalesce("b", F.lit(-1)) >= F.coalesce("a", F.lit(-1)), F.lit("focused")).otherwise(F.lit("identify")).alias("read"))


def needs_second_model(mode: Column, name_status: Column, dob_status: Column, confident: Column) -> Column:
    """Whether a second model reads the document too."""
    missing = lambda s: F.coalesce(s != "present_verified", F.lit(True))
    return (mode == "always") | missing(name_status) | missing(dob_status) | ~F.coalesce(confident, F.lit(False))


def quality_gate(fields: DataFrame, quality: DataFrame) -> DataFrame:
    """Fields of documents whose image was assessed (doc_id, assessed, usable) and found unusable are unreadable, whatever was read."""
    out = fields.join(quality.select("doc_id", (F.col("assessed") & ~F.col("usable")).alias("__bad")), "doc_id", "left")
    bad = F.coalesce("__bad", F.lit(False))
    return out.withColumns({"value": F.when(~bad, F.col("value")), "status": F.when(bad, F.lit("unreadable")).otherwise(F.col("status")), "reason": F.when(bad, F.lit("document_not_read")).otherwise(F.col("reason"))}).drop("__bad")


def enhancements(sharpness: Column, contrast: Column, glare: Column, dark: Column, width: Column) -> Column:
    """The enhanced views to make of a marginal image, VARIANTS_MOST at most: those whose metric failed. Missing metrics fail none."""
    q = C.QUALITY
    soft = F.coalesce(sharpness, F.lit(99)) < q["sharpness"][1]
    uneven = (F.coalesce(contrast, F.lit(99)) < q["contrast"][1]) | (F.coalesce(glare, F.lit(0)) > q["glare"][1]) | (F.coalesce(dark, F.lit(0)) > q["dark"][1])
    small = (F.coalesce(width, F.lit(0)) > 0) & (width < 1100)
    ways = [("gray-normalize", F.lit(True)), ("clahe", uneven), ("sharpen", soft), ("upscale2x", small & soft)]
    return F.slice(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in ways]), lambda n: n.isNotNull()), 1, VARIANTS_MOST)


def requests(spark: SparkSession) -> DataFrame:
    """(doc_type, page_role, prompt): what to ask a model about a page, from the registry."""
    rows = evidence.registry(spark).where(F.col("field").isin(*C.FIELDS))
    of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("capability").isin(*kinds), F.col("field"))))
    lists = rows.groupBy("doc_type", "page_role").agg(of("allowed", "required", "conditional").alias("may"), of("required").alias("must"), of("impossible").alias("never"))
    line = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", "), F.lit(". "))).otherwise(F.lit(""))
    ask = F.concat(F.lit("Read the "), "page_role", F.lit(" page of this "), F.translate("doc_type", "_", " "), F.lit(" and answer with one JSON object. "), line("Fields: ", "may"), line("Expected on every such page: ", "must"), line("Never printed there: ", "never"), F.lit("Give null for what is not printed; do not guess."))
    return lists.select("doc_type", "page_role", ask.alias("prompt"))


# --- views of an envelope


def comparable(status: Column, normalized: Column, raw: Column) -> Column:
    """What may be compared: the value of a verified field, nothing of any other."""
    return F.when(status == "present_verified", F.coalesce(normalized, raw))


def as_read(status: Column, raw: Column) -> Column:
    """What tells documents apart: any reading that the page could hold."""
    return F.when(F.coalesce(status, F.lit("")) != "invalid", raw)


def state(status: Column, verified: Column, reason: Column, raw: Column, source: Column, shown: Column) -> Column:
    return F.struct(F.coalesce(status, F.lit("not_present")).alias("status"), F.coalesce(verified, F.lit(False)).alias("verified"), reason.alias("reason"), raw.alias("raw_value"), source.alias("source"), shown.alias("evidence"))


def document_status(failed: Column, retake: Column, kind: Column) -> Column:
    """The status of a document after extraction."""
    return F.when(F.coalesce(failed, F.lit(False)), F.lit("unreadable")).when(F.coalesce(retake, F.lit(False)), F.lit("retake_required")).when(F.coalesce(kind, F.lit("unknown")) == "unknown", F.lit("unreadable")).otherwise(F.lit("ready"))


# --- numbers


def validated_number(kind: Column, x: Column) -> Column:
    """struct(value, valid, reason, repaired, changes, needs_manual_entry) of a document number.

    As it stands; else with the look-alikes that its slots allow; else, where a checksum guards it, with the one digit that
    makes it sound. What none of these mends is to be typed in.
    """
    own = numbers.canonical(x)
    shaped = F.when(F.lit(False), own)
    for name in C.SLOTS:
        shaped = shaped.when(kind == name, numbers.repair_positional(name, x))
    shaped = F.coalesce(shaped, own)
    summed = F.when(kind == "aadhaar", numbers.repair_checksum(shaped))
    sound = lambda v: v.isNotNull() & (numbers.number_reason(kind, v) == "")
    moved = lambda v: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(own), F.lit(1))), lambda i: F.substr(own, i, F.lit(1)) != F.substr(v, i, F.lit(1))))
    row = lambda v, ok, reason, fixed, n: F.struct(v.alias("value"), F.lit(ok).alias("valid"), reason.alias("reason"), F.lit(fixed).alias("repaired"), n.cast("int").alias("changes"), F.lit(not ok).alias("needs_manual_entry"))
    empty = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("valid"), F.lit("empty").alias("reason"), F.lit(False).alias("repaired"), F.lit(0).alias("changes"), F.lit(False).alias("needs_manual_entry"))
    return (
        F.when(~has(x), empty)
        .when(sound(own), row(own, True, F.lit(""), False, F.lit(0)))
        .when((shaped != own) & sound(shaped), row(shaped, True, F.lit(""), True, moved(shaped)))
        .when(sound(summed), row(summed, True, F.lit(""), True, moved(summed)))
        .otherwise(row(own, False, numbers.number_reason(kind, own), False, F.lit(0)))
    )
