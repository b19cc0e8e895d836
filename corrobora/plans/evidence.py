"""Evidence gates and classification as CASE ladders over one row per reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import fields, numbers


def sheet(kind: str, page: str) -> tuple[str, str, str, dict[str, str]]:
    """allowed, required, impossible and conditional fields of a page; a page that nobody describes may hold anything."""
    return C.CAPABILITIES.get((kind, page), C.CAPABILITIES["unknown", "front"])


def registry(spark: SparkSession) -> DataFrame:
    """(doc_type, page_role, field, capability, carries, condition): a fixed table of some 400 rows; broadcast it.

    A pool of fields (GROUPS) carries what the strongest of its members does; what only some layouts print is looked up
    by the field's own name, so it does not weaken a pool.
    """
    rows = []
    for kind, page in sorted({(k, p) for k in {k for k, _ in C.CAPABILITIES} for p in ("front", "back")}):
        allowed, required, impossible, conditional = sheet(kind, page)
        level = {}
        for f in C.FIELDS:
            c = "impossible" if f in impossible.split() else "required" if f in required.split() else "allowed" if f in allowed.split() else "conditional" if f in conditional else "none"
            level[f] = {"required": "yes", "allowed": "yes", "conditional": "partial"}.get(c, "no")
            partial = level[f] == "yes" and c != "required" and kind in C.PARTIAL.get(f, [])
            rows.append((kind, page, f, c, "partial" if partial else level[f], conditional.get(f)))
        for group, members in C.GROUPS.items():
            rows.append((kind, page, group, "none", max((level[m] for m in members), key=["no", "partial", "yes"].index), None))
    return spark.createDataFrame(rows, "doc_type string, page_role string, field string, capability string, carries string, condition string")


def field_status(value: Column, source: Column, number_valid: Column, in_page: Column, in_evidence: Column, label: Column, witness: Column, self_identifying: Column, required: Column, confirmed: Column | None = None) -> Column:
    """struct(status, reason): the first rule that decides how a reading is trusted. ``confirmed``: a second model read the same."""
    told = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    verified = lambda r: told("present_verified", r)
    return (
        F.when(F.trim(F.coalesce(value, F.lit(""))) == "", told("not_present", "no_value_returned"))
        .when(source.isin(*C.SELF_EVIDENT), F.struct(F.lit("present_verified").alias("status"), F.concat(F.lit("self_evident_source:"), source).alias("reason")))
        .when(source == "user", verified("user_confirmed"))
        .when(number_valid, verified("format_and_checksum_valid"))
        .when(in_page & label, verified("corroborated_by_page_text"))
        .when((F.lit(False) if confirmed is None else confirmed) & label, verified("confirmed_by_second_model"))
        .when(in_evidence & label & witness & ~in_page & ~self_identifying, told("present_uncertain", "evidence_not_found_in_page_text"))
        .when(in_evidence & label, verified("evidence_supports_value"))
        .when(required & self_identifying, F.struct(F.lit("present_verified").alias("status"), F.when(in_page, F.lit("corroborated_by_page_text")).otherwise(F.lit("required_field_read_from_document")).alias("reason")))
        .when(~label & ~witness, told("present_uncertain", "no_local_corroboration_available"))
        .when(~label, told("not_present", "no_label_for_field_on_page"))
        .otherwise(told("present_uncertain", "value_without_supporting_evidence"))
    )


def labelled_by(pattern: str, text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])")


def label_present(field: Column, text: Column) -> Column:
    """Whether a label of the field stands in the text; fields that identify themselves, or have no label, need none."""
    out = F.when(field.isin(*C.SELF_IDENTIFYING), F.lit(True))
    for name, pattern in C.LABELS.items():
        if name not in C.SELF_IDENTIFYING:
            out = out.when(field == name, labelled_by(pattern, text))
    return out.otherwise(F.lit(True))


def shows(field: Column, value: Column, text: Column, pivot: int) -> Column:
    """Whether the text shows the value of the field, by the field's own rule."""
    is_date, is_name = (field == "dob") | field.endswith("date"), field.endswith("name")
    return F.when(is_date, fields.evidence_contains("dob", value, text, pivot)).when(is_name, fields.evidence_contains("holder_name", value, text, pivot)).otherwise(fields.evidence_contains("", value, text, pivot))


def witnesses(text: Column) -> Column:
    """Whether a page's text is rich enough that an absent label means an absent field."""
    return (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) >= 30) & labelled_by("|".join([*C.LABELS.values(), r"name|holder|surname|given\s*name"]), text)


def tier(sharpness: Column, contrast: Column, glare: Column, dark: Column, width: Column, height: Column) -> Column:
    q = C.QUALITY
    bad = (sharpness < q["sharpness"][0]) | (contrast < q["contrast"][0]) | (glare > q["glare"][0]) | (dark > q["dark"][0]) | (width < q["width"]) | (height < q["height"])
    poor = (sharpness < q["sharpness"][1]) | (contrast < q["contrast"][1]) | (glare > q["glare"][1]) | (dark > q["dark"][1])
    return F.when(bad, F.lit("unusable")).when(poor, F.lit("marginal")).otherwise(F.lit("good"))


#: What each present field adds to each type.
FIELD_SCORES = {"gender": {"pan": -2}, "address": {"pan": -2, "aadhaar": 1, "voter": 1}, "father_name": {"aadhaar": -2, "pan": 1, "voter": 1}, "expiry_date": {"passport": 2, "driving_licence": 1}, "mother_name": {"birth_certificate": 2, "voter": -1}, "spouse_name": {"voter": 2}, "place_of_birth": {"passport": 1, "birth_certificate": 1}}


def classify(df: DataFrame) -> DataFrame:
    """Adds ``class`` = struct(type, runner_up, margin, confident, confidence, corrected) from the columns of fields, claimed, qr and mrz_valid."""
    has = lambda c: (F.coalesce(F.trim(F.col(c)), F.lit("")) != "") if c in df.columns else F.lit(False)
    kind = numbers.infer_type(F.col("document_number"))
    wrong = numbers.number_reason(F.col("claimed"), F.col("document_number"))

    def score(t: str) -> Column:
        parts = [F.when(has(f), F.lit(s[t])).otherwise(0) for f, s in FIELD_SCORES.items() if t in s]
        parts += [F.when(has("document_number") & (kind == t), F.lit(5)).otherwise(0), F.when(F.col("claimed") == t, F.lit(2)).otherwise(0)]
        if C.FORMATS.get(t, (None,))[0]:
            parts.append(F.when((F.col("claimed") == t) & has("document_number") & (wrong != ""), F.lit(-4)).otherwise(0))
        parts += [F.when(F.col("qr"), F.lit(10)).otherwise(0)] if t == "aadhaar" else [F.when(F.col("mrz_valid"), F.lit(10)).otherwise(0)] if t == "passport" else []
        return reduce(lambda a, b: a + b, parts)

    ranked = F.array_sort(F.array(*[F.struct((-score(t)).alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(C.TYPES)]))
    out = df.withColumn("__r", ranked)
    best, second = F.col("__r")[0], F.col("__r")[1]
    margin, known = second["s"] - best["s"], F.col("claimed").isin(*C.TYPES)
    none = best["s"] >= 0
    made = F.struct(
        F.when(none, F.when(known, F.col("claimed")).otherwise(F.lit("unknown"))).otherwise(best["t"]).alias("type"), second["t"].alias("runner_up"), margin.alias("margin"), (~none & (margin >= 3)).alias("confident"),
        F.when(none, F.when(known, F.lit(0.3)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.round(margin / 7, 2))).alias("confidence"), (~none & known & (best["t"] != F.col("claimed"))).alias("corrected"),
    )
    return out.withColumn("class", made).drop("__r")
