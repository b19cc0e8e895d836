"""Uploads and selections of an application: where a file goes, what a selection lacks, when work is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora import constants as C


def stale(status: Column, touched: Column, now: Column) -> Column:
    """Whether work on a document has stopped: no final status, and nothing happened for STALE_SECONDS."""
    return ~status.isin(*C.FINAL_STATUSES) & (F.unix_timestamp(now) - F.unix_timestamp(touched) > C.STALE_SECONDS)


def routes(files: DataFrame, documents: DataFrame, version: Column, now: Column) -> DataFrame:
    """``files`` (application_id, ord, name, hash) with route and document_id, by the documents that the application has.

    Of equal files in one upload the first counts. A removed document comes back; one whose work is stale, or that an
    older extractor read (extraction_key differs from ``version``, an expression over the file's row), is read again;
    others are duplicates. Of several documents with a hash, live ones come first, then the newest.
    """
    newest = F.row_number().over(Window.partitionBy("application_id", "hash").orderBy((F.col("status") == "removed_by_user").asc(), F.desc("created_at"), "document_id"))
    have = documents.withColumn("__r", newest).where("__r = 1").select("application_id", "hash", "document_id", "status", F.coalesce("updated_at", "created_at").alias("touched"), "extraction_key")
    first = F.row_number().over(Window.partitionBy("application_id", "hash").orderBy("ord"))
    rows = files.withColumn("__n", first).join(have, ["application_id", "hash"], "left")
    route = (
        F.when(F.col("__n") > 1, F.lit("duplicate_in_upload"))
        .when(F.col("document_id").isNull(), F.lit("fresh"))
        .when(F.col("status") == "removed_by_user", F.lit("reactivate"))
        .when(stale(F.col("status"), F.col("touched"), now), F.lit("retry"))
        .when(~F.col("status").isin(*C.FINAL_STATUSES), F.lit("duplicate_still_processing"))
        .when((F.coalesce("extraction_key", F.lit("")) != "") & (F.col("extraction_key") != version), F.lit("retry"))
        .otherwise(F.lit("duplicate_of_active_document"))
    )
    return rows.withColumn("route", route).withColumn("document_id", F.when(F.col("__n") == 1, F.col("document_id"))).select(*files.columns, "route", "document_id")


def within_room(fresh: DataFrame, documents: DataFrame, most: int = C.MAX_FILES) -> DataFrame:
    """Fresh files (application_id, ord) with ``accepted``: as many, in order, as live documents leave room for."""
    used = documents.where(F.col("status") != "removed_by_user").groupBy("application_id").agg(F.count("*").alias("__used"))
    rank = F.row_number().over(Window.partitionBy("application_id").orderBy("ord"))
    return fresh.withColumn("__n", rank).join(used, "application_id", "left").withColumn("accepted", F.col("__n") <= F.greatest(F.lit(most) - F.coalesce("__used", F.lit(0)), F.lit(0))).drop("__n", "__used")


def selection_errors(selections: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, error, ids, foreign): why a selection (request_id, application_id, document_ids) cannot be compared; '' if it can.

    First an empty list, then ids named twice, then removed documents; ids of other applications are no error of the
    caller but a breach (``foreign``), which blocks the verdict and so passes over removed ones.
    """
    ids = selections.select("request_id", "application_id", F.explode_outer("document_ids").alias("document_id"))
    per = ids.groupBy("request_id", "application_id", "document_id").agg(F.count("*").alias("n"))
    own = documents.select("application_id", "document_id", F.lit(True).alias("own"), (F.col("status") == "removed_by_user").alias("removed"))
    rows = per.join(own, ["application_id", "document_id"], "left")
    named = F.col("document_id").isNotNull()
    listed = lambda c: F.array_sort(F.collect_list(F.when(named & c, F.col("document_id"))))
    out = rows.groupBy("request_id").agg(F.count_if(named).alias("n"), listed(F.col("n") > 1).alias("twice"), listed(F.coalesce("removed", F.lit(False))).alias("removed"), listed(F.col("own").isNull()).alias("foreign"))
    error = (
        F.when(F.col("n") == 0, F.lit("document_ids_required"))
        .when(F.size("twice") > 0, F.lit("duplicate_document_ids"))
        .when((F.size("foreign") == 0) & (F.size("removed") > 0), F.lit("removed_document_selected"))
        .otherwise(F.lit(""))
    )
    which = F.when(error == "duplicate_document_ids", F.col("twice")).when(error == "removed_document_selected", F.col("removed")).otherwise(F.array().cast("array<string>"))
    return out.select("request_id", error.alias("error"), which.alias("ids"), "foreign")


def resolve(selections: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owned, rejected) references of selections (application_id, document_id), each id once."""
    once = selections.select("application_id", "document_id").distinct()
    keys = ["application_id", "document_id"]
    return once.join(documents.select(*keys), keys, "left_semi"), once.join(documents.select(*keys), keys, "left_anti")


def barrier(documents: DataFrame) -> DataFrame:
    """(application_id, pending, state): documents_still_processing while any live document has no final status."""
    pending = F.count_if(~F.col("status").isin(*C.FINAL_STATUSES))
    return documents.where(F.col("status") != "removed_by_user").groupBy("application_id").agg(pending.alias("pending"), F.when(pending > 0, F.lit("documents_still_processing")).otherwise(F.lit("ready")).alias("state"))


def heal(documents: DataFrame, now: Column) -> DataFrame:
    """Documents on which work has stopped are unreadable."""
    return documents.withColumn("status", F.when(stale(F.col("status"), F.coalesce("updated_at", "created_at"), now), F.lit("unreadable")).otherwise(F.col("status")))


def expired(at: Column, now: Column, seconds: int) -> Column:
    """Whether something that began at ``at`` and lives for ``seconds`` is over."""
    return F.unix_timestamp(now) > F.unix_timestamp(at) + seconds


def challenge_state(begun: Column, now: Column, attempts: Column, matches: Column) -> Column:
    """What becomes of an answer to a one-time code: expired, too_many_attempts, wrong_code or signed_in."""
    return F.when(expired(begun, now, C.CODE_SECONDS), F.lit("expired")).when(attempts >= C.CODE_ATTEMPTS, F.lit("too_many_attempts")).when(matches, F.lit("signed_in")).otherwise(F.lit("wrong_code"))


def identifier_kind(x: Column) -> Column:
    """phone, email or '' for what a person signs in with."""
    t = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(F.regexp_replace(t, r"[\s-]", "").rlike(r"^\+?[1-9][0-9]{9,14}$"), F.lit("phone")).when(t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit("email")).otherwise(F.lit(""))


def hydrated(states: DataFrame, corrections: DataFrame) -> DataFrame:
    """States of fields (document_id, field, status, value, source, reason) overlaid with what the holder typed (document_id, field, value).

    A correction of a value that the document verifiably printed stays comparable, as the holder's; a value that it never
    showed is holder_asserted. document_status and document_value keep what the document showed.
    """
    fixed = corrections.select("document_id", "field", F.col("value").alias("__v"))
    rows = states.join(fixed, ["document_id", "field"], "full_outer")
    typed, printed = F.col("__v").isNotNull(), F.coalesce(F.col("status") == "present_verified", F.lit(False))
    told = lambda yes, no, other: F.when(typed & printed, F.lit(yes)).when(typed, F.lit(no)).otherwise(other)
    return rows.select(
        "document_id", "field", told("present_verified", "holder_asserted", F.col("status")).alias("status"), F.coalesce("__v", "value").alias("value"), told("user_correction", "user", F.col("source")).alias("source"),
        told("user_corrected_printed_value", "user_supplied_value_not_printed_on_document", F.col("reason")).alias("reason"), F.when(typed, F.coalesce("status", F.lit("not_present"))).alias("document_status"), F.when(typed, F.col("value")).alias("document_value"),
    )


def typed(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """``documents`` (document_id, doc_type, ...) with the type that counts, and ``type_source``: what the holder says of a document's type
    outranks what was read. What is corrected last as document_type in ``corrections`` (document_id, field, value[, at]) is that; a
    blank correction is none."""
    said = corrections.where((F.col("field") == "document_type") & (F.trim("value") != ""))
    order = [F.col("at")] if "at" in corrections.columns else []
    own = said.groupBy("document_id").agg(F.max_by("value", F.struct(*order, F.col("value"))).alias("__type"))
    rows = documents.join(own, "document_id", "left")
    return rows.withColumn("type_source", F.when(F.col("__type").isNotNull(), F.lit("holder")).otherwise(F.lit("reading"))).withColumn("doc_type", F.coalesce("__type", "doc_type")).drop("__type")


def corrections_map(corrections: DataFrame) -> DataFrame:
    """(document_id, corrections map): the few corrections of each document; one for each field."""
    return corrections.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("corrections"))


def status_label(status: Column) -> Column:
    """What a person is shown for a document's status; anything that is not final is at work."""
    names = {"ready": "Ready", "unreadable": "Could not be read", "retake_required": "Needs a new photo", "rejected_file": "Rejected", "removed_by_user": "Removed"}
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in names.items()], F.lit("Working"))
