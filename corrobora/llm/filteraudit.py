"""Audit of how quality filters interact: what each takes away at every place of every order of the filters.

Texts are read as Arrow buffers. Classes of bytes are looked up for a whole run of texts at once, and prefix sums of them
count words, capitals, symbols and code points between the texts' offsets. Words are hashed by prefix sums too; sorted
hashes of a text give its distinct words, and words of equal hash are compared byte by byte. What fails where is a mask
of five bits a document; all that leaves the scan is that mask with a digest of the text, and masks are counted a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm._shared import SPACE, materialize
from corrobora.llm.neardup import mix
from corrobora.ship import ship

#: The filters by letter; bit i of a mask is that of the i-th.
FILTERS = "ABCDE"
#: A document fails A under so many words, B under so many distinct ones in 100 words, C over so many capitals in 100 code points, D with any of these characters.
FEWEST, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Bytes that are counted at once.
RUN = 1 << 20
#: An odd factor of the words' hash, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def is_one_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


IS_SPACE = is_one_of(SPACE)


@cache
def powers(base: int) -> np.ndarray:
    """base ** i modulo 2**64 for every place of a run."""
    with np.errstate(over="ignore"):
        steps = np.full(RUN, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set between bounds, by prefix sums."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[bounds[1:]] - before[bounds[:-1]]


def word_bounds(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts between ``bounds`` start and end in ``b``; no word goes on in the next text."""
    word = ~IS_SPACE[b]
    first, last = np.ones(len(b), bool), np.ones(len(b), bool)
    first[1:], last[:-1] = ~word[:-1], ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(b))]
    first[inner], last[inner - 1] = True, True
    return np.flatnonzero(word & first), np.flatnonzero(word & last) + 1


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a run (RUN bytes at most), by prefix sums of its bytes times powers."""
    with np.errstate(over="ignore"):
        before = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(FACTOR)[: len(b)], out=before[1:])
        return mix((before[end] - before[start]) * powers(INVERSE)[start] + (end - start).astype(np.uint64))


def equal_words(b: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of ``size`` bytes (each at least 1) from ``one`` and from ``other`` on are the same bytes."""
    out, ends = np.zeros(len(one), bool), np.cumsum(size)
    lo = 0
    while lo < len(one):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN, "right")))
        n = size[lo:hi]
        at = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(at, n)
        out[lo:hi] = np.logical_and.reduceat(b[np.repeat(one[lo:hi], n) + step] == b[np.repeat(other[lo:hi], n) + step], at)
        lo = hi
    return out


def first_of_each(b: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of one word of each kind in each text, texts in which different words share a hash).

    Hashes are sorted; neighbours of one hash are compared byte by byte. The words of the texts in the second result are
    not told apart here.
    """
    with np.errstate(over="ignore"):
        key = mix(hashes + text.astype(np.uint64) * np.uint64(FACTOR))
    order = np.argsort(key, kind="stable")
    a, z = order[:-1], order[1:]
    like = key[a] == key[z]
    a, z = a[like], z[like]
    size = end - start
    same = (text[a] == text[z]) & (size[a] == size[z])
    same[same] = equal_words(b, start[a[same]], start[z[same]], size[a[same]])
    again = np.zeros(len(start), bool)
    again[z] = True
    clash = np.unique(np.concatenate([text[a[~same]], text[z[~same]]]))
    return np.flatnonzero(~again), clash


def long_distinct(b: np.ndarray) -> int:
    """Distinct words of one text of any length, run by run; words longer than a run are told apart by digest and bytes."""
    starts, ends, hashes, long_words = [], [], [], {}
    lo = 0
    while lo < len(b):
        hi = min(lo + RUN, len(b))
        gaps = np.flatnonzero(IS_SPACE[b[lo:hi]])
        if hi - lo == RUN and not len(gaps):  # one word fills the run
            while hi < len(b) and not IS_SPACE[b[hi : hi + RUN]].any():
                hi += RUN
            hi = hi + int(np.argmax(IS_SPACE[b[hi : hi + RUN]])) if hi < len(b) else len(b)
            word = b[lo:hi]
            kin = long_words.setdefault(hashlib.sha256(word).digest(), [])
            if not any(np.array_equal(word, x) for x in kin):
                kin.append(word)
            lo = hi
            continue
        if hi < len(b):
            hi = lo + int(gaps[-1]) + 1
        run = b[lo:hi]
        s, e = word_bounds(run, np.array([0, len(run)]))
        h = word_hashes(run, s, e)
        one, clash = first_of_each(run, s, e, h, np.zeros(len(s), np.int64))
        if len(clash):
            return len(set(b.tobytes().split()))
        starts.append(s[one] + lo)
        ends.append(e[one] + lo)
        hashes.append(h[one])
        lo = hi
    if not starts:
        return sum(map(len, long_words.values()))
    s, e, h = map(np.concatenate, (starts, ends, hashes))
    one, clash = first_of_each(b, s, e, h, np.zeros(len(s), np.int64))
    return len(set(b.tobytes().split())) if len(clash) else len(one) + sum(map(len, long_words.values()))


def counts(b: np.ndarray, bounds: np.ndarray, symbols: str = SYMBOLS) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and chars of each text: text i is ``b[bounds[i]:bounds[i + 1]]``, UTF-8."""
    n = len(bounds) - 1
    out = {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "symbols", "chars")}
    marks, lo = is_one_of(symbols), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + RUN, "right")) - 1)
        edges = bounds[lo : hi + 1]
        for at in range(int(edges[0]), max(int(edges[-1]), int(edges[0]) + 1), RUN):  # more than one run only for one long text
            part = b[at : min(at + RUN, int(edges[-1]))]
            own = np.clip(edges - at, 0, len(part))
            out["capitals"][lo:hi] += sums((part >= 65) & (part <= 90), own)
            out["symbols"][lo:hi] += sums(marks[part], own)
            out["chars"][lo:hi] += sums((part & 0xC0) != 0x80, own)
            first = ~IS_SPACE[part]
            first[1:] &= IS_SPACE[part[:-1]]
            if len(part) and at > edges[0]:
                first[0] &= IS_SPACE[b[at - 1]]
            for x in own[(own > 0) & (own < len(part))]:
                first[x] = not IS_SPACE[part[x]]
            out["words"][lo:hi] += sums(first, own)
        if edges[-1] - edges[0] > RUN:
            out["distinct"][lo] = long_distinct(b[edges[0] : edges[-1]])
        else:
            run, own = b[edges[0] : edges[-1]], edges - edges[0]
            s, e = word_bounds(run, own)
            text = np.repeat(np.arange(hi - lo), out["words"][lo:hi])
            one, clash = first_of_each(run, s, e, word_hashes(run, s, e), text)
            out["distinct"][lo:hi] = np.bincount(text[one], minlength=hi - lo)
            for i in clash:
                out["distinct"][lo + i] = len(set(run[own[i] : own[i + 1]].tobytes().split()))
        lo = hi
    return out


def masks(documents: DataFrame, fewest: int = FEWEST, distinct: int = DISTINCT, capitals: int = CAPITALS, symbols: str = SYMBOLS) -> DataFrame:
    """(doc_id, part, mask, digest) of every row of ``documents``: bits A to D of the mask, and the SHA-256 of the text."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
            bounds = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            b = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            c = counts(b, bounds, symbols)
            mask = (c["words"] < fewest) | ((100 * c["distinct"] < distinct * c["words"]) << 1) | ((100 * c["capitals"] > capitals * c["chars"]) << 2) | ((c["symbols"] > 0) << 3)
            digest = [hashlib.sha256(b[lo:hi]).digest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def audit(documents: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part (a lang; null and empty lang are one part), each order of the five filters and each step of it.
    ``removed`` fail the step's filter and no earlier one, ``redundant`` fail it and an earlier one, ``unique_fails`` fail
    it alone, ``kept`` fail none so far; ``good_lost`` and ``toxic_lost`` are removed rows with a label quality or toxic
    of 1; ``shapley`` sums ``removed`` of the filter over all orders. A null text counts as empty: it fails A only, or E
    too. E: a row fails if a row of a smaller doc_id has the same text; rows repeated with one id stand or fall together;
    a row without an id fails no E, makes none fail and has no label. Of several labels of one id any 1 counts. Texts are
    read whole, at any length. Columns of other names are not read. Empty input: no rows. ``limits`` are those of masks().

    Plan: one scan of the texts; then rows of some 60 bytes a document meet by (digest, doc_id) and by doc_id, so that no
    group of copies comes together in one task, and the least id of a digest is found by partial aggregates.
    """
    rows = materialize(masks(documents, **limits), "masks")
    known = rows.where("doc_id IS NOT NULL")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("bad"))
    no = F.lit(False)
    flagged = known.join(least, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    flagged = flagged.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("bad"))
    cells = flagged.unionByName(rows.where("doc_id IS NULL").select("part", "mask", no.alias("good"), no.alias("bad"))).groupBy("part", "mask", "good", "bad").agg(F.count("*").alias("n"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "bad", "n")).alias("cells"))  # 128 cells at most

    orders = parts.select("part", "cells", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.pow(F.lit(2), F.ascii(F.substr("filter_order", i, F.lit(1))) - ord("A")).cast("int"))
    steps = orders.withColumn("bits", bits).select("*", F.posexplode("bits").alias("place", "bit"))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda a, x: a + x))
    total = lambda which: F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    out = steps.select(
        "part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), F.substr("filter_order", F.col("place") + 1, F.lit(1)).alias("filter"),
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(lambda x: fails(x) & ~gone(x)).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"), total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda x: fails(x) & ~gone(x) & x["good"]).alias("good_lost"), total(lambda x: fails(x) & ~gone(x) & x["bad"]).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
