"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples have a label that counts; all other text is unlabelled and may hold toxic text too. With
class prior p, a linear classifier over hashed word features minimises

    p * E+[loss(g)] + max(0, Eu[loss(-g)] - p * E+[loss(-g)])

where E+ is over confirmed examples and Eu over unlabelled text; where the second term falls below zero, its gradient
is reversed (Kiryo et al., 2017). Trained in numpy on bounded samples; scoring runs over whole texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm.features import bounded_sample, word_ids
from corrobora.ship import ship

#: log2 of the number of features; rows of the samples of confirmed and of unlabelled text (about 1 kB each, so that the
#: driver gathers some 24 MB; very long texts have at most one feature for each of their distinct words and stems).
BITS, CONFIRMED, UNLABELLED = 20, 6_000, 18_000


def packed(ids: np.ndarray) -> bytes:
    """Ascending ids as compressed differences, byte plane by byte plane: about 1.5 bytes each."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4"), dtype=np.int32)


class Model:
    """Weights of the features that occur often enough in the samples, and a bias."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float):
        self.at, self.w, self.bias = at, w, bias

    def score(self, ids: np.ndarray) -> float:
        if not len(self.at):
            return 1 / (1 + np.exp(-self.bias))
        near = np.minimum(np.searchsorted(self.at, ids), len(self.at) - 1)
        g = self.w[near[self.at[near] == ids]].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def nonnegative_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fit by full-batch Adam. A feature takes part if it marks several confirmed examples, and more of them than of the unlabelled."""
    width = 1 + max([0, *(int(p[-1]) for p in positive + unlabelled if len(p))])
    blocks = lambda rows: (rows[lo : lo + 1000] for lo in range(0, len(rows), 1000))
    count = lambda rows: sum((np.bincount(np.concatenate(b), minlength=width) for b in blocks(rows)), np.zeros(width, np.int64))
    # Copies of one example would vouch for all of its words: of those that have the same features, one counts.
    apart = lambda rows: list({x.tobytes(): x for x in rows}.values())
    distinct, others = apart(positive), apart(unlabelled)
    cp, cu = count(distinct), count(others)
    rp, ru = (cp + 0.5) / (len(distinct) + 1), (cu + 0.5) / (len(others) + 1)
    # Standard errors, were it as frequent among the confirmed as in the unlabelled.
    z = (rp - ru) / np.sqrt(ru * (1 - ru) / (len(distinct) + 1))
    at = np.flatnonzero((cp >= max(3, 0.004 * len(distinct))) & (z > 6) & (rp > 3 * ru))
    place = np.full(width, -1)
    place[at] = np.arange(len(at))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, found, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b in blocks(docs):
            flat = place[np.concatenate(b)]
            owner.append(before + np.repeat(np.arange(len(b)), [len(d) for d in b])[flat >= 0])
            found.append(flat[flat >= 0])
            before += len(b)
        return np.concatenate(owner), np.concatenate(found)

    op, fp = rows(positive)
    ou, fu = rows(unlabelled)
    np_, nu = len(positive), max(len(unlabelled), 1)
    w, bias = np.zeros(len(at)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, steps + 1):
        gp = np.bincount(op, w[fp], np_) + bias
        gu = np.bincount(ou, w[fu], nu) + bias if len(unlabelled) else np.full(1, bias)
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp, du = prior * (sp - 1) / np_, np.zeros(nu)
        sign = 1.0 if negative >= 0 else -1.0
        if sign < 0:
            dp[:] = 0
        dp, du = dp - sign * prior * sp / np_, sign * su / nu
        grad = np.append(np.bincount(fp, dp[op], len(at)) + np.bincount(fu, du[ou], len(at)) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(at, w, bias)


def fit(documents: DataFrame, labels: DataFrame, learn: Column, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED, bits: int = BITS) -> Model:
    """Train on the rows of ``documents`` where ``learn`` holds.

    Confirmed examples are those with labels.toxic = 1; the class prior is their share among the labelled rows. A doc_id
    with several labels counts as toxic if any of them is. Without confirmed examples every score is the prior's floor.
    The samples hold about ``confirmed`` and ``unlabelled`` whole texts, chosen by doc_id: rows of one doc_id are in or out
    together, and each counts. Examples with the same features count once where features are chosen. Null and empty
    texts are examples without features. Rows without an id, and labels without an id or a mark, are not learned from.
    """
    ship(documents.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = documents.where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ids alone meet the labels; the texts of the chosen few are read afterwards, so no text is shuffled.
    known = texts.select("doc_id").join(marks, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic"), F.lit(-1)).alias("toxic"))
    seen = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, labelled = seen.get(1, 0), sum(n for k, n in seen.items() if k >= 0)
    if not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), -5.0)
    prior = min(max(toxic / labelled, 1e-4), 0.5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield pd.DataFrame({"doc": part["doc_id"], "kind": part["kind"], "at": [packed(word_ids(t, bits)) for t in part["text"]]})

    # Unlabelled text is all text that is not confirmed; of the labelled, the confirmed are both.
    total = sum(seen.values())
    place = (F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64)) + 0.5
    kind = F.when((F.col("toxic") == 1) & (place < confirmed / toxic), F.lit(1)).otherwise(0) + F.when(place >= 1 - unlabelled / total, F.lit(2)).otherwise(0)
    chosen = known.select("doc_id", kind.alias("kind")).where("kind > 0").distinct()  # ids and marks of the bounded samples
    got = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(run, "doc long, kind int, at binary").toArrow().to_pandas().sort_values(["doc", "at"])
    ids = [unpacked(x) for x in got["at"]]
    flags = got["kind"].to_numpy()
    return nonnegative_pu([x for x, k in zip(ids, flags, strict=True) if k & 1], [x for x, k in zip(ids, flags, strict=True) if k & 2], prior)


def toxicity_of(model: Model, text: Column, bits: int = BITS) -> Column:
    """The score of a text column, 0 to 1. Null and empty texts have no features and get the bias alone."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.score(word_ids(t or "", bits)) for t in part], dtype="float64")

    return score(text)
