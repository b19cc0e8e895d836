"""What readers outside this repository hand over: tables of texts, answers, codes and faces, with their columns checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions import responses

#: Columns that each kind of reader has to give; more may follow.
CONTRACTS = {
    "ocr_texts": "doc_id long, variant string, text string",
    "model_replies": "doc_id long, model string, payload string, error string",
    "codes": "doc_id long, symbol int, format string, payload string",
    "faces": "doc_id long, face int, score double, width double, height double, page_width double, page_height double, embedding array<double>",
}
#: Symbols of a page that are looked at.
SYMBOLS = 4


def handed_over(table: DataFrame, kind: str) -> DataFrame:
    """``table`` with the columns of its contract, in order and cast; a missing one is an error that names all that are missing."""
    wanted = dict(x.split(" ", 1) for x in CONTRACTS[kind].split(", "))
    missing = sorted(set(wanted) - set(table.columns))
    if missing:
        raise ValueError(f"{kind} lacks {', '.join(missing)}")
    return table.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()], *[c for c in table.columns if c not in wanted])


def answers(replies: DataFrame) -> DataFrame:
    """(doc_id, model, response, error) of model_replies: the text of a reply wherever its service puts it. A failed call stays a row."""
    rows = handed_over(replies, "model_replies")
    said = F.when(F.coalesce("error", F.lit("")) == "", responses.reply_text(F.col("payload"), F.col("model")))
    return rows.select("doc_id", "model", said.alias("response"), F.coalesce("error", F.lit("")).alias("error"))


def card_code(codes: DataFrame) -> DataFrame:
    """(doc_id, symbol, QR columns): the first of a page's SYMBOLS symbols that is a QR code and can be read; pages without one are left out."""
    rows = handed_over(codes, "codes")
    order = Window.partitionBy("doc_id").orderBy("symbol")
    seen = rows.withColumn("__n", F.row_number().over(order)).where((F.col("__n") <= SYMBOLS) & (F.col("format") == "QRCode"))
    read = seen.withColumn("q", responses.code_payload(F.col("payload"))).where("q IS NOT NULL")
    best = read.groupBy("doc_id").agg(F.min_by(F.struct("symbol", "q"), "symbol").alias("x"))
    return best.select("doc_id", "x.symbol", "x.q.*")


def richest(texts: DataFrame) -> DataFrame:
    """(doc_id, variant, text): the text of each page with most characters other than white space (ties: the first variant)."""
    rows = handed_over(texts, "ocr_texts")
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("variant", "text"), F.struct((-size).alias("n"), "variant")).alias("x")).select("doc_id", "x.*")


def trusted_text(text: Column, pivot: int) -> Column:
    """What an uploaded text file says: its own words, so that no second gate is asked."""
    from corrobora.sources import page_text

    return page_text.page_reading(text, pivot)
