"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(word | context) = p(class of word | context) * p(word | its class)

* A word falls into a slot by a hash of its last letters; slots are clustered into classes by the words before them.
* p(class | context) is a softmax over hashed features of the context: the previous word's slot, the slot before it (a
  skip feature), and both together. Weights start from log-odds of counts and are improved by gradient updates; each
  update sums the gradients of all training tokens, computed by the executors in numpy, once per distinct context.
* p(word | class) is the smoothed relative frequency within the class.

The corpus is tokenised once, into chunks of texts with a vocabulary of their own. The vocabularies of chunks, not the
tokens, are dealt by ranges of a word's hash, as packed arrays; each range sums its counts and sends them back to the
chunks. No vocabulary of the corpus is ever held in one place. What reaches the driver has a fixed size: the matrices of
slots, features and classes.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm._shared import materialize
from corrobora.ship import ship

#: Slots of words, rows of the joint feature, classes, tokens in a chunk, gradient updates.
SLOTS, JOINT, CLASSES, CHUNK_TOKENS, UPDATES = 4_096, 8_192, 64, 1_000_000, 2
#: Last bytes of a word that choose its slot; add-alpha smoothing; feature rows in a block of a partial matrix.
TAIL, ALPHA, BLOCK = 3, 0.1, 64
#: Step of an update, by the count of a feature.
RATE = 3.0
#: The end of a document as a word; white space, so no word equals it.
END = "\n"
END_SLOT = 0
ROWS = 2 * SLOTS + JOINT + 1

#: Words of all vocabularies that are summed up together.
RANGE_WORDS = 250_000
#: Chunks whose sums one task adds up, where there are enough of them.
CHUNKS_PER_TASK = 32

CHUNK = "chunk long, doc_ids array<long>, held binary, sizes binary, ids binary, keys binary, counts binary, n_words long"


class Vocabulary(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def key(word: bytes) -> int:
    """64 bits that stand for a word: its slot in the low bits, a hash of all of it in the others."""
    if word == END.encode():
        return END_SLOT
    slot = 1 + xxhash.xxh3_64_intdigest(word[-TAIL:]) % (SLOTS - 1)
    return xxhash.xxh3_64_intdigest(word) & ~(SLOTS - 1) | slot


def slots_of(keys: bytes) -> np.ndarray:
    return (np.frombuffer(keys, np.uint64) & np.uint64(SLOTS - 1)).astype(np.uint16)


def chunks(documents: DataFrame, held_out: Column) -> DataFrame:
    """The corpus as rows of CHUNK: token numbers of whole documents, each ended by END, and the chunk's vocabulary."""

    def row(docs: list, held: list[bool], tokens: list[list[int]], vocabulary: Vocabulary) -> pd.DataFrame:
        ids = np.concatenate([np.array(t, np.uint32) for t in tokens])
        sizes = np.array([len(t) for t in tokens], np.uint32)
        train = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(ids[train], minlength=len(vocabulary)).astype(np.uint32)
        keys = np.fromiter(map(key, vocabulary), np.uint64, len(vocabulary))
        name = int.from_bytes(os.urandom(8), "little", signed=True)
        return pd.DataFrame({"chunk": [name], "doc_ids": [docs], "held": [np.packbits(held).tobytes()], "sizes": [sizes.tobytes()], "ids": [ids.tobytes()], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "n_words": [len(keys)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = lambda: ([], [], [], Vocabulary({END.encode(): 0}), 0)
        docs, held, tokens, vocabulary, n = fresh()
        for pdf in batches:
            missing = pdf["doc_id"].isna()
            for doc, none, out, text in zip(pdf["doc_id"], missing, pdf["held"], pdf["text"], strict=True):
                own = list(map(vocabulary.__getitem__, text.encode("utf-8", "replace").lower().split()))
                own.append(0)
                docs.append(None if none else int(doc))
                held.append(bool(out))
                tokens.append(own)
                n += len(own)
                if n >= CHUNK_TOKENS:
                    yield row(docs, held, tokens, vocabulary)
                    docs, held, tokens, vocabulary, n = fresh()
        if docs:
            yield row(docs, held, tokens, vocabulary)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, CHUNK)


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` ranges of the hash each word falls in."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def corpus_counts(encoded: DataFrame, n: int) -> DataFrame:
    """(chunk, part, counts, slots): for each chunk and range, the corpus's counts of the words that the chunk has there, in
    the order of its vocabulary; and for each range, with no chunk, its tokens and its distinct words by slot.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                keys, counts = np.frombuffer(r.keys, np.uint64), np.frombuffer(r.counts, np.uint32)
                part = ranges_of(keys, n)
                order = np.argsort(part, kind="stable")
                keys, counts, part = keys[order], counts[order], part[order]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
                yield pd.DataFrame({"part": part[first].astype(np.int64), "chunk": r.chunk, "keys": [keys[a:b].tobytes() for a, b in bounds], "counts": [counts[a:b].tobytes() for a, b in bounds]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        words, at = np.unique(keys, return_inverse=True)
        c = np.bincount(at, np.frombuffer(b"".join(pdf["counts"]), np.uint32), len(words))
        slots = (words & np.uint64(SLOTS - 1)).astype(np.int64)
        by_slot = np.stack([np.bincount(slots, c, SLOTS), np.bincount(slots, c > 0, SLOTS)])
        kind = np.dtype(np.uint32 if c.max() < 2**32 else np.uint64)
        back = c.astype(kind)[at].tobytes()
        ends = np.cumsum(pdf["keys"].map(len).to_numpy()) // 8 * kind.itemsize
        out = pd.DataFrame({"chunk": pdf["chunk"].to_numpy(np.int64), "part": pdf["part"], "width": kind.itemsize, "counts": [back[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], "slots": None})
        sums = pd.DataFrame({"chunk": pd.array([None], "Int64"), "part": [pdf["part"].iloc[0]], "width": [8], "counts": [None], "slots": [by_slot.tobytes()]})
        return pd.concat([out.astype({"chunk": "Int64"}), sums])

    dealt = encoded.select("chunk", "keys", "counts").mapInPandas(deal, "part long, chunk long, keys binary, counts binary")
    return dealt.groupBy("part").applyInPandas(add, "chunk long, part long, width int, counts binary, slots binary")


def slot_sums(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each slot, summed over the ranges in two levels."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((np.frombuffer(x, np.float64) for pdf in batches for x in pdf["slots"]), np.zeros(2 * SLOTS))
        yield pd.DataFrame({"slots": [total.tobytes()]})

    got = counted.where("chunk IS NULL").select("slots").mapInPandas(add, "slots binary").repartition(math.isqrt(n) + 1).mapInPandas(add, "slots binary").collect()
    c, v = sum((np.frombuffer(r["slots"], np.float64) for r in got), np.zeros(2 * SLOTS)).reshape(2, SLOTS)
    return c, v


def contexts(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots before each token; documents follow each other, and none looks past the end before it."""
    one = np.r_[np.array([END_SLOT], slots.dtype), slots[:-1]]
    two = np.r_[np.array([END_SLOT], slots.dtype), one[:-1]]
    return one.astype(np.int64), np.where(one == END_SLOT, END_SLOT, two).astype(np.int64)


def feature_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Rows of the weights that are active in each context: previous, skip, joint, bias."""
    joint = ((one * 2654435761 + two * 40503) >> 7) % JOINT
    return np.stack([one, SLOTS + two, 2 * SLOTS + joint, np.full(len(one), ROWS - 1)], axis=1)


def probabilities(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = w[rows[:, 0]] + w[rows[:, 1]] + w[rows[:, 2]] + w[ROWS - 1]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def token_slots(r) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the tokens of a chunk, and which tokens are for training."""
    sizes = np.frombuffer(r.sizes, np.uint32)
    held = np.unpackbits(np.frombuffer(r.held, np.uint8), count=len(sizes)).astype(bool)
    return slots_of(r.keys)[np.frombuffer(r.ids, np.uint32)], np.repeat(~held, sizes)


def summed(encoded: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all chunks of what ``add(total, slots, train)`` adds to a matrix of ``shape``.

    A task sends the non-zero blocks of rows of its sum, compressed. They are added up in two levels, so that no task
    meets more than the square root of what all tasks send of a block. The driver receives one matrix.
    """
    n = encoded.select("chunk").count()
    tasks = max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-n // CHUNKS_PER_TASK))
    salt = math.isqrt(tasks)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for r in pdf.itertuples():
                total = np.zeros(shape, np.float32) if total is None else total
                add(total, *token_slots(r))
        if total is not None:
            yield blocks({(b, int.from_bytes(os.urandom(4), "little") % salt): total[b * BLOCK : (b + 1) * BLOCK] for b in range(-(-shape[0] // BLOCK)) if total[b * BLOCK : (b + 1) * BLOCK].any()})

    def blocks(own: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"block": [b for b, _ in own], "salt": [s for _, s in own], "data": [zlib.compress(x.astype(np.float64).tobytes(), 1) for x in own.values()]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sum(np.frombuffer(zlib.decompress(data), np.float64) for data in pdf["data"])
        return blocks({(pdf["block"].iloc[0], 0): x})

    row = "block int, salt int, data binary"
    sent = encoded.select("held", "sizes", "ids", "keys").coalesce(tasks).mapInPandas(part, row)
    got = sent.groupBy("block", "salt").applyInPandas(unite, row).groupBy("block").applyInPandas(unite, row).collect()
    out = np.zeros(shape)
    for r in got:
        x = np.frombuffer(zlib.decompress(r["data"]), np.float64).reshape(-1, shape[1])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out


def cluster(before: np.ndarray, classes: int) -> np.ndarray:
    """A class for each slot, by k-means over the square roots of what stands before it; the end is class 0."""
    n = before.sum(axis=1)
    x = np.sqrt((before + 0.05) / (n + 0.05 * before.shape[1])[:, None])
    rest = np.flatnonzero(np.arange(len(n)) != END_SLOT)
    order = rest[np.argsort(-n[rest], kind="stable")]
    singles = order[: classes // 4]
    many = order[classes // 4 :]
    k = classes - 1 - len(singles)
    centres = x[many[:: max(1, len(many) // (8 * k))][:k]] if len(many) >= k else x[np.resize(many, k)]
    label = np.zeros(len(many), int)
    for _ in range(12):
        label = (x[many] @ centres.T).argmax(axis=1)
        for c in range(k):
            own = many[label == c]
            if len(own) and n[own].sum():
                centres[c] = np.average(x[own], axis=0, weights=n[own] + 1e-9)
                centres[c] /= np.linalg.norm(centres[c]) or 1
    out = np.zeros(len(n), np.int64)
    out[singles] = 1 + np.arange(len(singles))
    out[many] = 1 + len(singles) + label
    return out


class Model:
    """Classes of slots, weights of features, and each class's log10 mass and size."""

    def __init__(self, class_of: np.ndarray, weights: np.ndarray, mass: np.ndarray):
        self.class_of, self.weights, self.mass = class_of, weights, mass

    def class_log10(self, slots: np.ndarray) -> np.ndarray:
        """log10 p(class | context) - log10 of the class's smoothed mass, for each token, once per distinct context."""
        one, two = contexts(slots)
        distinct, at = np.unique(one * SLOTS + two, return_inverse=True)
        out, cls = np.empty(len(slots)), self.class_of[slots]
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(0, len(distinct) + 16_384, 16_384))
        for lo, a, b in zip(range(0, len(distinct), 16_384), starts[:-1], starts[1:], strict=False):
            part = distinct[lo : lo + 16_384]
            p = probabilities(self.weights, feature_rows(part // SLOTS, part % SLOTS))
            own = order[a:b]
            out[own] = np.log10(np.maximum(p[at[own] - lo, cls[own]], 1e-30))
        return out - self.mass[cls]


def train(encoded: DataFrame, slot_counts: np.ndarray, slot_words: np.ndarray, updates: int = UPDATES) -> Model:
    """Fit on the training tokens of all chunks."""
    sc = encoded.sparkSession.sparkContext

    def co(total: np.ndarray, slots: np.ndarray, train: np.ndarray) -> None:
        one, _ = contexts(slots)
        key = slots[train].astype(np.int64) * 64 + one[train] % 64
        total += np.bincount(key, minlength=total.size).reshape(total.shape).astype(np.float32)

    class_of = cluster(summed(encoded, (SLOTS, 64), co), CLASSES)

    def counts(total: np.ndarray, slots: np.ndarray, train: np.ndarray) -> None:
        one, two = contexts(slots)
        rows, cls = feature_rows(one[train], two[train]), class_of[slots[train]]
        for i in range(rows.shape[1]):
            total += np.bincount(rows[:, i] * CLASSES + cls, minlength=total.size).reshape(total.shape).astype(np.float32)

    seen = summed(encoded, (ROWS, CLASSES), counts)
    n = seen.sum(axis=1, keepdims=True)
    prior = (seen[-1] + 0.5) / (n[-1] + 0.5 * CLASSES)
    odds = np.log((seen + 8 * prior) / (n + 8)) - np.log(prior)
    weights = np.concatenate([0.45 * odds[:SLOTS], 0.2 * odds[SLOTS : 2 * SLOTS], 0.35 * odds[2 * SLOTS : -1], np.log(prior)[None]])
    for _ in range(updates):
        sent = sc.broadcast(weights.astype(np.float32))

        def gradient(total: np.ndarray, slots: np.ndarray, train: np.ndarray, sent=sent) -> None:
            one, two = contexts(slots)
            distinct, many = np.unique((one * SLOTS + two)[train], return_counts=True)
            for lo in range(0, len(distinct), 16_384):
                part = distinct[lo : lo + 16_384]
                rows = feature_rows(part // SLOTS, part % SLOTS)
                p = probabilities(sent.value, rows) * many[lo : lo + 16_384, None].astype(np.float32)
                for i in range(3):
                    order = np.argsort(rows[:, i], kind="stable")
                    own = rows[order, i]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    total[own[first]] += np.add.reduceat(p[order], first, axis=0)
                total[-1] += p.sum(axis=0)

        expected = summed(encoded, (ROWS, CLASSES), gradient)
        weights += RATE * (seen - expected) / (n + 8)
        sent.unpersist()
    mass = np.zeros(CLASSES)
    words = np.zeros(CLASSES)
    np.add.at(mass, class_of, slot_counts)
    np.add.at(words, class_of, slot_words)
    return Model(class_of, weights.astype(np.float32), np.log10(mass + ALPHA * (words + 1)))


def score(documents: DataFrame, held_out: Column, updates: int = UPDATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``documents``.

    The model learns from the rows where ``held_out`` is false; all rows are scored, as whole texts. Tokens are the
    ASCII-lower-cased words of a text and one end. base_score is the log10 probability under add-0.1 unigrams, score
    that under the model after ``updates`` gradient updates. Null texts are empty: their end is scored. Repeated rows have one result each. With nothing to
    learn from, base_score is 0 and the model is uniform. Empty input: no rows. Extra columns are not carried along.
    """
    ship(documents.sparkSession)
    encoded = materialize(chunks(documents, held_out), "chunks")
    n = max(1, -(-(encoded.agg(F.sum("n_words")).first()[0] or 0) // RANGE_WORDS))
    counted = materialize(corpus_counts(encoded, n), "counts")
    c, v = slot_sums(counted, n)
    n_all, v_all = int(c.sum()), int(v.sum())
    model = train(encoded, c, v, updates)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    floor = np.log10(n_all + ALPHA * (v_all + 1))

    def run(chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        r = next(chunk.itertuples())
        sizes, ids, keys = np.frombuffer(r.sizes, np.uint32), np.frombuffer(r.ids, np.uint32), np.frombuffer(r.keys, np.uint64)
        known = known.sort_values("part")
        count = np.empty(len(keys), np.int64)
        count[np.argsort(ranges_of(keys, n), kind="stable")] = np.concatenate([np.frombuffer(x, f"<u{w}") for x, w in zip(known["counts"], known["width"], strict=True)])
        ends = np.cumsum(sizes, dtype=np.int64)
        per_doc = lambda x: np.add.reduceat(x, np.r_[0, ends[:-1]])
        logs = per_doc(np.log10(count + ALPHA)[ids])
        of_class = per_doc(sent.value.class_log10(slots_of(r.keys)[ids]))
        held = np.unpackbits(np.frombuffer(r.held, np.uint8), count=len(sizes)).astype(bool)
        docs = pd.array([None if pd.isna(d) else int(d) for d in r.doc_ids], "Int64")
        return pd.DataFrame({"doc_id": docs, "held_out": held, "n_tokens": sizes.astype(np.int64), "n_known": per_doc((count > 0)[ids].astype(np.int64)), "train_tokens": n_all, "base_score": logs - sizes * floor, "score": logs + of_class})

    back = counted.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "part", "width", "counts")
    text = encoded.select("chunk", "doc_ids", "held", "sizes", "ids", "keys")
    return text.groupBy("chunk").cogroup(back.groupBy("of")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
