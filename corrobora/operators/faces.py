"""Face vectors: pairs within a group, match summaries, error rates over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as C
from corrobora.functions.text import cosine


def pairs(faces: DataFrame, group: str, ident: str, vector: str) -> DataFrame:
    """Each unordered pair of one group once, with its cosine to 4 places. Groups are the few documents of one application."""
    a, b = (faces.select(group, F.col(ident).alias(f"{s}_id"), F.col(vector).alias(f"{s}_v")) for s in "ab")
    return a.join(b, group).where(F.col("a_id") < F.col("b_id")).select(group, "a_id", "b_id", F.round(cosine(F.col("a_v"), F.col("b_v")), 4).alias("similarity"))


def summary(found: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """Pairs compared and the share at or above the threshold. Advisory: a face never rejects."""
    return found.where("similarity IS NOT NULL").groupBy(group).agg(F.count("*").alias("compared"), F.round(F.avg((F.col("similarity") >= threshold).cast("double")), 2).alias("confidence"))


def sweep(found: DataFrame, same: str, low: float = 0.20, high: float = 0.95, step: float = 0.05) -> DataFrame:
    """False accept and reject rates at each threshold. Pairs are counted once for each similarity (to 4 places), so only counts meet
    the thresholds."""
    n = round((high - low) / step) + 1
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + i * step, 2))).alias("threshold")
    counts = found.groupBy("similarity", F.col(same).alias("same")).agg(F.count("*").alias("n"))
    hit, of = F.col("similarity") >= F.col("threshold"), lambda c: F.sum(F.when(c, F.col("n")))
    rate = lambda c, all_: F.round(F.coalesce(of(c & all_), F.lit(0)) / of(all_), 6)
    return counts.select("similarity", "same", "n", at).groupBy("threshold").agg(rate(hit, ~F.col("same")).alias("far"), rate(~hit, F.col("same")).alias("frr"))


def equal_error(rates: DataFrame) -> DataFrame:
    return rates.agg(F.min_by("threshold", F.struct(F.abs(F.col("far") - F.col("frr")), "threshold")).alias("threshold"))


def face_reasons(width: Column, height: Column, page_width: Column, page_height: Column, score: Column) -> Column:
    """Why a detected face is too poor to compare, an empty array if it is not."""
    area, page = width * height, page_width * page_height
    told = lambda c, r: F.when(c, F.lit(r))
    found = F.array(told(F.least(width, height) < C.FACE["side"], "face_too_small"), told((page > 0) & (area / F.nullif(page, F.lit(0)) < C.FACE["share"]), "face_too_small_relative"), told(F.coalesce(score, F.lit(0.0)) < C.FACE["score"], "low_detection_confidence"))
    return F.filter(found, lambda r: r.isNotNull())


def strongest(faces: DataFrame, key: str) -> DataFrame:
    """The face with the highest score of each ``key`` (ties: the larger, then the first)."""
    best = F.max_by(F.struct(*[c for c in faces.columns if c != key]), F.struct("score", F.col("width") * F.col("height"), -F.col("face")))
    return faces.groupBy(key).agg(best.alias("x")).select(key, "x.*")


def embedded(documents: DataFrame, cache: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Documents with their vector: the cached one if there is one, else the one computed now; ``cached`` tells which."""
    out = documents.join(cache.select(key, F.col("embedding").alias("__old")), key, "left").join(computed.select(key, F.col("embedding").alias("__new")), key, "left")
    return out.withColumn("embedding", F.coalesce("__old", "__new")).withColumn("cached", F.col("__old").isNotNull()).drop("__old", "__new")


def labelled(files: DataFrame, path: str = "path") -> DataFrame:
    """(person, image, path): images of folders that are named by person; files outside such a folder are left out."""
    part = lambda i: F.regexp_extract(F.col(path), r"([^/]+)/([^/]+\.(?:jpe?g|png))$", i)
    return files.select(part(1).alias("person"), part(2).alias("image"), F.col(path).alias("path")).where("person <> ''")
