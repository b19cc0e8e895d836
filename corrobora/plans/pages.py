"""Pages of one physical document: which side a page is, and which pages belong together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions import alignment, numbers
from corrobora.functions.text import blank

GROUPED = "application_id long, document_id string, logical_id string, page_role string, signal string"
PAGE = ["application_id", "document_id", "ord", "doc_type", "role", "number", "holder_name", "source_file"]


def page_role(values: Column) -> Column:
    """front or back, by the fields in a map of values: back where its marks outnumber those of a front. The number marks neither."""
    marks = lambda names: F.size(F.filter(F.array(*[F.trim(blank(F.try_element_at(values, F.lit(n)))) for n in names]), lambda v: v != ""))
    return F.when(marks(C.BACK_MARKERS) > marks(C.FRONT_MARKERS), F.lit("back")).otherwise(F.lit("front"))


def link(a: dict, b: dict) -> str:
    """What shows that two pages are one document, or ''. Contradiction beats any hint, and no hint is not enough."""
    if a["doc_type"] != b["doc_type"]:
        return ""
    if a["number"] and b["number"]:
        return "same_document_number" if a["number"] == b["number"] else ""
    if a["holder_name"] and b["holder_name"]:
        return "same_holder_name" if alignment.compare_names(a["holder_name"], b["holder_name"])[0] in ("identical", "safe_variant") else ""
    return "same_source_file" if a["source_file"] and a["source_file"] == b["source_file"] else ""


def pair(pages: list[dict]) -> list[tuple]:
    """Pages of one application in order: each that is still free takes the later ones that it links with, one for each side."""
    out, free = [], list(pages)
    while free:
        head, rest, sides, group, signal = free[0], [], {free[0]["role"]}, [free[0]], "single_page"
        for p in free[1:]:
            why = link(head, p) if p["role"] not in sides else ""
            if why:
                sides.add(p["role"])
                group.append(p)
                signal = why
            else:
                rest.append(p)
        out += [(p["application_id"], p["document_id"], head["document_id"], p["role"], signal) for p in group]
        free = rest
    return out


def grouped(pages: DataFrame) -> DataFrame:
    """(application_id, document_id, logical_id, page_role, signal) of ``pages`` (application_id, document_id, ord, doc_type, page_role,
    document_number, holder_name, relative_path, fields).

    logical_id is the first page's document. A missing page_role is told from the fields. Applications are streamed in order;
    the pages of one, MAX_FILES at most, are held at a time.
    """
    rows = pages.select(
        "application_id", "document_id", "ord", "doc_type", F.coalesce("page_role", page_role(F.col("fields"))).alias("role"), numbers.canonical(F.col("document_number")).alias("number"),
        F.trim(blank(F.col("holder_name"))).alias("holder_name"), F.split(blank(F.col("relative_path")), "#page=")[0].alias("source_file"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for pdf in batches:
            done = []
            for r in pdf.to_dict("records"):
                if held and held[0]["application_id"] != r["application_id"]:
                    done += pair(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(done, columns=[c.split()[0] for c in GROUPED.split(", ")])
        if held:
            yield pd.DataFrame(pair(held), columns=[c.split()[0] for c in GROUPED.split(", ")])

    return rows.repartition("application_id").sortWithinPartitions("application_id", "ord", "document_id").mapInPandas(run, GROUPED)
