"""Hashed features of texts, and bounded samples of them for classifiers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns ASCII bytes other than letters into spaces.
LETTERS_ONLY = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))


def gram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed byte 2- to 4-grams of the lower-cased letters of the whole text, as relative frequencies."""
    b = np.frombuffer(b" %b " % b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()), np.uint8).astype(np.uint32)
    size, out = 1 << bits, np.zeros(1 << bits)
    code = b
    for n in range(2, min(4, len(b)) + 1):
        code = (b[:-1] if n == 2 else code[:-1]) * np.uint32(257) + b[n - 1 :]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=size)
    total = out.sum()
    return np.sqrt(out / total) if total else out


def word_ids(text: str, bits: int, stem: int = 5) -> np.ndarray:
    """Distinct hashed features of the whole text: its words, and stems of ``stem`` letters that one, two, three or more distinct words share."""
    words = set(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).decode("utf-8", "replace").split())
    mask, digest = (1 << bits) - 1, xxhash.xxh3_64_intdigest
    found = [digest(w) for w in words]
    for s, n in Counter([w[:stem] for w in words]).items():
        h = digest(s, 7)
        found += [h + i for i in range(min(n, 4))]
    return np.unique(np.array([h & mask for h in found], np.int64))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def bounded_sample(rows: DataFrame, by: Column, most: int, values: int = 200) -> DataFrame:
    """About ``most`` rows (a tenth more at most is usual) for each value of ``by``, all of them where there are fewer.

    Only the ``values`` most frequent values take part (ties: the smaller); rows where ``by`` is null are left out.
    Whether a row is in it depends on its doc_id alone, so the sample is the same at every run, and rows of one id are in
    or out together.
    """
    counted = rows.where(by.isNotNull()).groupBy(by.cast("string").alias("by")).count().orderBy(F.desc("count"), "by").limit(values).collect()
    if not counted:
        return rows.limit(0)
    share = F.create_map(*[F.lit(v) for r in counted for v in (r["by"], most / r["count"])])
    place = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)) / F.lit(2.0**64)) + 0.5
    return rows.where(place < share[by.cast("string")])
