"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped.

Format of a data set: shards in ascending doc_id order, each a pair ``NAME.bin`` (token ids, little-endian, 2 bytes each
if every id fits, else 4) and ``NAME.idx`` (64-bit little-endian: for each document its id and the place in the shard
where its tokens end). A manifest row a shard holds its number of tokens; the global base of a shard is the prefix sum
of the tokens before it, so no task needs to know another's output while writing.

Texts are encoded where they are read. Their ids, which are smaller, are dealt by ranges of doc_id; each task writes its
range in one go. Files are written under a name of their own and renamed when whole, so a task that runs twice leaves
one result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora.llm._shared import fresh_path, materialize
from corrobora.ship import ship

#: Distinct units whose ids a worker remembers (about 100 MB); others are encoded anew in each batch.
REMEMBERED = 700_000
#: Stands for a missing id, before all others; ids sampled for each shard.
NO_ID, SAMPLED = -(2**63), 200
#: Bytes of text encoded together.
BYTES_AT_ONCE = 16_000_000

#: How byte-level vocabularies write the byte of a space.
SPACE_BYTE = "\u0120"
#: White space, as the pre-tokenizer knows it.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """The ids of texts under a tokenizer whose byte-level pieces never span a single space before a word.

    A text cut at its spaces falls into units, each with the space before it. A unit that neither starts (after that
    space) nor ends with white space is encoded alike in any text, so a batch is cut, its distinct units are numbered
    and encoded once, and the ids are gathered by number. Units are encoded in rows of many; in a row a unit begins
    where a token begins with a space. Texts in which two kinds of white space meet, or that begin or end with it, or
    that hold a special token are encoded whole.
    """

    def __init__(self, path: str, encode_special_tokens: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 2**16 else "<u4")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE_BYTE)]] = True
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"^[{SPACES}]", f"[{SPACES}]$", f" [{SPACES}]", f"[{SPACES}] ", *special])
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another, and how many each has."""
        rows = [units[i : i + 500] for i in range(0, len(units), 500)]
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([f" {' '.join(r)}" for r in rows], add_special_tokens=False), strict=True):
            own = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.opens[own])
            if len(at) == len(row) and at[0] == 0:
                ids.append(own)
                sizes.append(np.diff(np.append(at, len(own))))
            else:  # a unit with a space of its own in its ids
                for u in self.tokenizer.encode_batch_fast([f" {u}" for u in row], add_special_tokens=False):
                    ids.append(np.array(u.ids, self.dtype))
                    sizes.append(np.array([len(u.ids)], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def numbered(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each unit, ids, ends): a unit at place p has ids[ends[p]:ends[p + 1]]. New units are remembered, up to REMEMBERED."""
        get, n = self.known.get, len(self.ends) - 1
        place = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place, self.ids, self.ends
        missing = [units[i] for i in new]
        place[new] = n + np.arange(len(new))
        more, sizes = self.fresh(missing)
        ids, ends = np.concatenate([self.ids, more]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        room = max(REMEMBERED - n, 0)
        if room:
            self.known.update(zip(missing[:room], range(n, n + room), strict=False))
            keep = min(n + len(new), REMEMBERED) if n < REMEMBERED else n
            self.ids, self.ends = ids[: ends[keep]], ends[: keep + 1]
        return place, ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text ends)."""
        n = len(texts)
        whole = np.asarray(pc.match_substring_regex(texts, self.whole)) if n else np.zeros(0, bool)
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0)) if n else whole
        plain = np.flatnonzero(~whole & ~empty)
        cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
        words = cut.flatten().dictionary_encode()
        begins = np.asarray(cut.offsets, np.int64)[:-1] - (cut.offsets[0].as_py() if len(cut.offsets) else 0)
        number = np.asarray(words.indices, np.int64)
        place, ids, ends = self.numbered(words.dictionary.to_pylist())
        at = place[number]
        lengths = (ends[1:] - ends[:-1])[at] if len(at) else np.zeros(0, np.int64)
        # The first word of a text has no space before it.
        first = {i: e for i, e in zip(plain.tolist(), self.single([words.dictionary[int(number[b])].as_py() for b in begins]), strict=True)}
        for i, e in zip(np.flatnonzero(whole).tolist(), self.single(texts.take(pa.array(np.flatnonzero(whole))).to_pylist()), strict=True):
            first[i] = e
        lengths[begins] = 0
        total = np.concatenate([[0], np.cumsum(lengths)])
        rest = np.zeros(n, np.int64)
        rest[plain] = total[np.append(begins[1:], len(number))] - total[begins] if len(plain) else 0
        lead = np.array([len(first[i]) if i in first else 0 for i in range(n)], np.int64)
        text_ends = np.cumsum(lead + rest)
        out = np.empty(int(text_ends[-1]) if n else 0, self.dtype)
        gather = np.repeat(ends[at] - total[:-1], lengths) + np.arange(total[-1]) if len(at) else np.zeros(0, np.int64)
        body = ids[gather]
        starts = text_ends - lead - rest
        done = 0
        for i in range(n):
            s, k, r = starts[i], lead[i], rest[i]
            if k:
                out[s : s + k] = first[i]
            if r:
                out[s + k : s + k + r] = body[done : done + r]
                done += r
        return out, text_ends

    def single(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str, encode_special_tokens: bool) -> Encoder:
    """One for each worker process and tokenizer."""
    key = (path, encode_special_tokens)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def local(uri: str) -> str:
    """The path of a shared folder that is mounted on every machine."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped shards need a shared folder that is mounted, not a {at.scheme} store")
    return at.path


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about BYTES_AT_ONCE together, one text at least."""
    size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) if len(texts) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(texts):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + BYTES_AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def bounds_of(documents: DataFrame, parts: int) -> np.ndarray:
    """At most ``parts`` - 1 ids that cut the documents into ranges of like size, ascending, by a sample of ids."""
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    seen = ids.sample(min(1.0, SAMPLED * parts / max(ids.count(), 1)), seed=3).toArrow()["id"]
    ordered = np.sort(np.asarray(seen, np.int64))
    return ordered[(np.arange(1, parts) * len(ordered)) // parts] if len(ordered) else ordered


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int, encode_special_tokens: bool, bounds: np.ndarray) -> DataFrame:
    """(part, doc_id, ids): the ids of every text and ``end_id``, as little-endian integers of the tokenizer's width.

    Parts are ranges of doc_id. An id so frequent that it fills several ranges is spread over them by row number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, encode_special_tokens)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts, key = batch.column("text"), np.asarray(batch.column("doc_id").fill_null(NO_ID), np.int64)
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            part = pa.array(np.where(high > low, low + np.asarray(batch.column("row"), np.int64) % (high - low + 1), low), pa.int32())
            for lo, hi in slices(texts):
                ids, ends = enc.encode(texts.slice(lo, hi - lo))
                data, at = ids.tobytes(), np.append(0, ends) * enc.dtype.itemsize
                yield pa.record_batch({"part": part.slice(lo, hi - lo), "doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": pa.array([data[a:b] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "part int, doc_id long, ids binary")


def write_shards(documents: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None, encode_special_tokens: bool = False) -> DataFrame:
    """Encode every text, append ``end_id``, write the shards; returns the manifest (shard, dir, name, width, n_docs, n_tokens, base).

    Null texts are empty. Documents stand in ascending doc_id order, null ids first; rows of one doc_id stand in an order of
    their own, by their tokens within a shard; repeated rows are documents of their own. Empty input: no shards. Extra
    columns are not carried along. There are as many shards as ``spark.sql.shuffle.partitions`` at most.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    target = local(out_dir or fresh_path(spark, "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer_path, encode_special_tokens).dtype.itemsize
        name, at, n, part = f"shard-{uuid.uuid4().hex}", 0, 0, None
        os.makedirs(target, exist_ok=True)
        with open(f"{target}/{name}.bin.part", "wb") as ids, open(f"{target}/{name}.idx.part", "wb") as index:
            for batch in batches:
                docs, own = batch.column("doc_id"), batch.column("ids")
                if len(own):
                    part, n = batch.column("part")[0].as_py(), n + len(own)
                    ends = at + np.cumsum(np.asarray(pc.binary_length(own), np.int64)) // width
                    for x in own:
                        ids.write(x.as_buffer())
                    index.write(np.stack([np.asarray(docs.is_null()).astype("<i8"), np.asarray(docs.fill_null(0), "<i8"), ends.astype("<i8")], axis=1).tobytes())
                    at = int(ends[-1])
        for kind in ("bin", "idx"):
            if n:
                os.replace(f"{target}/{name}.{kind}.part", f"{target}/{name}.{kind}")
            else:
                os.remove(f"{target}/{name}.{kind}.part")
        if n:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([width], pa.int32()), "n_docs": [n], "n_tokens": [at]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = encoded(documents, tokenizer_path, end_id, encode_special_tokens, bounds_of(documents, parts))
    dealt = tokens.repartitionById(parts, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    shards = materialize(dealt.mapInArrow(run, "part int, name string, width int, n_docs long, n_tokens long"), "shards")
    order = Window.orderBy("part")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a shard: the prefix sums run over the number of tasks, not over documents.
    return shards.select((F.row_number().over(order) - 1).alias("shard"), F.lit(target).alias("dir"), "name", "width", "n_docs", "n_tokens", before.alias("base"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the memory-mapped shards, as many tasks as shards."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.memmap(f"{r.dir}/{r.name}.bin", dtype=f"<u{r.width}", mode="r")
                index = np.fromfile(f"{r.dir}/{r.name}.idx", "<i8").reshape(-1, 3)
                starts = np.r_[0, index[:-1, 2]]
                for lo in range(0, len(index), 20_000):
                    part, begin = index[lo : lo + 20_000], starts[lo : lo + 20_000]
                    crc = [zlib.crc32(np.asarray(ids[a:b], "<u4")) for a, b in zip(begin, part[:, 2], strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array(np.where(part[:, 0] == 1, None, part[:, 1]).tolist(), "Int64"), "start": r.base + begin, "n_tokens": part[:, 2] - begin, "ids_crc32": crc})

    manifest = materialize(manifest, "manifest")
    # The manifest is small, so without a number of its own its rows would all go to one task.
    return manifest.repartition(max(manifest.count(), 1), "name").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(shard, ids): the ids of each shard, for callers that want them as arrays rather than files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"shard": [r.shard], "ids": [np.memmap(f"{r.dir}/{r.name}.bin", dtype=f"<u{r.width}", mode="r").astype(np.int64)]})

    return manifest.mapInPandas(run, "shard long, ids array<long>")
