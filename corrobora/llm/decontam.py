"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is WINDOW consecutive words of an item (all of a shorter item). Containment is exact, so every shingle of a
window has to occur in a document that contains it, and one shingle is a sufficient prefix: its rarest by count over
the whole corpus. Documents are searched for those prefix shingles only; each find fixes where the window would have to
start and end (position and length bounds), and the words in between are compared in full.

The benchmark goes out in blocks of a bounded number of words, each broadcast to one scan; with several blocks the scans
are chained row by row, and the hit words of a document are united. No document is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm._shared import discard, materialize
from corrobora.ship import ship

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Benchmark words in a block (about 20 MB when broadcast, measured with words of seven letters), and in a piece of a text.
BLOCK_WORDS, PIECE = 200_000, 2_000

#: Order of item ids; None is the id of all items without one.
BY_ID = lambda i: (i is not None, i or "")

#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Block:
    """Distinct windows of some pieces of items, as rows of word numbers, and their shingles."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.items = sorted({i for i, w in pieces if w}, key=BY_ID)
        number = {v: k for k, v in enumerate(self.items)}
        for item, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                windows[tuple(ids[at : at + window])].add(number[item])
        self.words = np.array([i for w in windows for i in w], np.int32)
        self.starts = np.cumsum([0, *map(len, windows)])
        self.owned = np.array([o for owners in windows.values() for o in sorted(owners)], np.int32)
        self.owners = np.cumsum([0, *map(len, windows.values())])
        self.sizes = sorted({min(shingle, len(w)) for w in windows})
        #: By shingle size: sorted codes of all shingles that any window holds.
        self.codes = {}
        for s in self.sizes:
            own = [self.shingles(w, s)[1] for w in map(self.window, range(len(windows))) if min(shingle, len(w)) == s]
            self.codes[s] = np.unique(np.concatenate(own))
        self.shingle = shingle

    def window(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k + 1]]

    def shingles(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the shingles all of whose words the benchmark knows (number 0 and up; others are -1).

        A code is a 64-bit hash of word numbers. Two shingles of one code are searched for together: what is found is
        compared word by word, so that costs time and changes no result.
        """
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = ids >= 0
        fits = known[:n].copy()
        for i in range(1, size):
            fits &= known[i : n + i]
        at = np.flatnonzero(fits)
        code = np.zeros(len(at), np.uint64)
        for i in range(size):
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + i].astype(np.uint64) + np.uint64(1)
        return at, code

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, index into codes) of the benchmark's shingles in a document."""
        if not len(ids) or ids.max() < 0:
            return
        for s in self.sizes:
            at, code = self.shingles(ids, s)
            if len(at):
                place = np.minimum(np.searchsorted(self.codes[s], code), len(self.codes[s]) - 1)
                hit = self.codes[s][place] == code
                if hit.any():
                    yield s, at[hit], place[hit]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Give every window the rarest of its shingles as its prefix (ties: the first in the window)."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {s: defaultdict(list) for s in self.sizes}
        for k in range(len(self.starts) - 1):
            w = self.window(k)
            s = min(self.shingle, len(w))
            place = np.searchsorted(self.codes[s], self.shingles(w, s)[1])
            offset = int(counts[s][place].argmin())
            self.prefix[s][int(place[offset])].append((k, offset))
        self.is_prefix = {s: np.isin(np.arange(len(self.codes[s])), list(self.prefix[s])) for s in self.sizes}

    def search(self, ids: np.ndarray, hit: np.ndarray) -> set[int]:
        """Mark the words inside occurrences in ``hit``; return the numbers of the items that occur."""
        items: set[int] = set()
        for s, at, place in self.found(ids):
            use = self.is_prefix[s][place]
            for a, p in zip(at[use].tolist(), place[use].tolist(), strict=True):
                for k, offset in self.prefix[s][p]:
                    w, start = self.window(k), a - offset
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        hit[start : start + len(w)] = True
                        items.update(self.owned[self.owners[k] : self.owners[k + 1]].tolist())
        return items


def blocks_of(benchmark: DataFrame, window: int, shingle: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words.

    Texts are cut into pieces of PIECE words on the executors, each with the window's overlap, so that a window is in one
    piece whole and no text is too large for a block. Pieces are dealt to blocks by a hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                lows = range(0, max(1, len(words) - window + 1), PIECE) if words else ()
                parts = [words[lo : lo + PIECE + window - 1] for lo in lows]
                yield pa.record_batch({"item": pa.array([item] * len(parts), pa.string()), "words": pa.array([b" ".join(w) for w in parts], pa.binary()), "n": pa.array(map(len, parts), pa.int64())})

    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    pieces = materialize(rows.mapInArrow(cut, "item string, words binary, n long"), "pieces")
    n = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    for b in range(n):
        got = (pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) if n > 1 else pieces).collect()
        block = Block(sorted(((r["item"], bytes(r["words"]).split()) for r in got), key=lambda x: (BY_ID(x[0]), x[1])), window, shingle)
        if len(block.words):
            yield block
    discard(pieces)


def counts_over(documents: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents, by shingle size."""
    sent = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        total = {s: np.zeros(len(c), np.int64) for s, c in block.codes.items()}
        for pdf in batches:
            for text in pdf["text"]:
                for s, _, place in block.found(block.numbers(words_of(text))):
                    np.add.at(total[s], place, 1)
        for s, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"size": np.full(len(at), s), "place": at, "n": c[at]})

    got = documents.where(F.col("text").isNotNull()).select("text").mapInPandas(run, "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {s: np.zeros(len(c), np.int64) for s, c in block.codes.items()}
    for s in out:
        part = got[got["size"] == s]
        out[s][part["place"].to_numpy()] = part["n"].to_numpy()
    return out


SEARCHED = "n_words long, hit binary, items array<string>"


def search_column(spark, block: Block, text: Column, before: Column | None) -> Column:
    """struct(n_words, hit, items) of a text: hit is a packed bit a word, united with that of the blocks before."""
    sent = spark.sparkContext.broadcast(block)

    def look(text: str | None, earlier: dict | None) -> tuple:
        words = words_of(text)
        hit = np.zeros(len(words), bool)
        items = {sent.value.items[i] for i in sent.value.search(sent.value.numbers(words), hit)} if words else set()
        if earlier is not None:
            if earlier["hit"]:
                hit |= np.unpackbits(np.frombuffer(zlib.decompress(earlier["hit"]), np.uint8), count=len(words)).astype(bool)
            items |= set(earlier["items"])
        return len(words), zlib.compress(np.packbits(hit).tobytes(), 1) if hit.any() else b"", sorted(items, key=BY_ID)

    frame = lambda rows: pd.DataFrame(rows, columns=["n_words", "hit", "items"])
    if before is None:

        @F.pandas_udf(SEARCHED)
        def first(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield frame([look(t, None) for t in part])

        return first(text)

    @F.pandas_udf(SEARCHED)
    def further(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for part, done in parts:
            yield frame([look(t, e) for t, e in zip(part, done.to_dict("records"), strict=True)])

    return further(text, before)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, into: str = "contamination") -> DataFrame:
    """``documents`` with a column ``into``: struct(n_words, n_hit, n_items, items_sha256, contaminated).

    Words are ASCII-lower-cased runs of digits, letters and non-ASCII characters. A document word inside any occurrence
    of a window counts once. items_sha256 digests the ids of the occurring items, sorted as strings, comma-joined.
    Null texts and items without words have no words and match nothing; items of one id are windows of one item. Items
    without an id hit and contaminate like others, count as one item together and are left out of items_sha256. All
    columns of ``documents`` are kept (a column named as ``into`` is replaced); repeated rows have one result each. Texts
    of any length are searched whole. Empty documents: no rows; empty benchmark: nothing is hit.
    """
    ship(documents.sparkSession)
    spark, text = documents.sparkSession, F.col("text")
    state = None
    out = documents
    for block in blocks_of(benchmark, window, shingle, block_words):
        block.choose(counts_over(documents, block))
        out = out.withColumn(into, search_column(spark, block, text, state))
        state = F.col(into)
    if state is None:
        empty = Block([], window, shingle)
        empty.choose({})
        out = out.withColumn(into, search_column(spark, empty, text, None))

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = [int(np.unpackbits(np.frombuffer(zlib.decompress(h), np.uint8)).sum()) if h else 0 for h in part["hit"]]
            yield pd.DataFrame({"n_words": part["n_words"], "n_hit": n, "n_items": part["items"].map(len), "items_sha256": [hashlib.sha256(",".join(x for x in i if x is not None).encode()).hexdigest() for i in part["items"]], "contaminated": [x > 0 for x in n]})

    return out.withColumn(into, finish(F.col(into)))
