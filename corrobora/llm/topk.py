"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; each segment of length L is summed up by its mean m and deviation s. With
a = sqrt(L) m and b = sqrt(L) s per segment, the squared distance of two vectors is at least the squared distance of
their (a, b) rows, and the squares of a row sum to the squared length of its vector. So the lower bound on the
distance is an upper bound on the inner product: the product of the two rows. Bounds are taken coarse to fine (2, 4, 8
16 and 32 segments), pair by pair: a candidate that one query of a batch still needs is not scored for the others. What no
level rules out gets its exact score.

Plan: queries go out in passes of a bounded size, each broadcast to one scan of the candidates. Every pass starts from
thresholds found on a bounded sample of candidates (any subset gives a valid threshold), so a task emits only what can
still be among the best k. Nothing but those few rows is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm._shared import materialize
from corrobora.ship import ship

#: Segments of a vector at each level, coarse to fine.
LEVELS = (2, 4, 8, 16, 32)
#: Queries broadcast in one pass (fewer, if their components take more than QUERY_BYTES), and scored together inside a task.
QUERIES_PER_PASS, QUERY_BYTES, QUERIES_AT_ONCE = 65_536, 64_000_000, 256
#: Share of surviving pairs under which they are scored one by one rather than as a block; pairs at once.
SPARSE, PAIRS_AT_ONCE = 0.05, 200_000
#: Candidates of the sample that sets the first thresholds.
SEEDS = 4_096
#: Sums of products stay whole numbers in a double up to here.
EXACT = 2.0**53


def segment_rows(x: np.ndarray, segments: int) -> np.ndarray:
    """The (a, b) row of every vector in ``x`` at one level."""
    n, d = x.shape
    edges = np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, lo:hi]
        mean = part.mean(axis=1) if hi > lo else np.zeros(n)
        out += [mean * np.sqrt(hi - lo), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; in Python integers where doubles would round, held within 64 bits."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def pairwise(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, one by one."""
    if not q.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q * x).sum(axis=1).astype(np.int64)
    return np.array([int(np.clip(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), -(2**63), 2**63 - 1)) for u, v in zip(q, x, strict=True)], np.int64)


class Best:
    """The best k candidates so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        order = np.argsort(segment_rows(q, 2)[:, 0], kind="stable") if len(q) else np.arange(0)
        self.ids, self.q, self.k = ids[order], q[order], k
        self.floor = np.full(len(q), -np.inf) if floor is None else floor[order]
        self.levels = [segment_rows(self.q, s) for s in LEVELS]
        self.at, self.ref, self.score = (np.zeros(0, np.int64) for _ in range(3))
        #: Pairs of query and candidate offered, and left after each level.
        self.offered, self.left = 0, np.zeros(len(LEVELS), np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows = [segment_rows(x, s) for s in LEVELS]
        for lo in range(0, len(self.ids), QUERIES_AT_ONCE):
            part = slice(lo, lo + QUERIES_AT_ONCE)
            least = self.floor[part, None]
            alive, fits = np.arange(len(ids)), self.ids[part, None] != ids[None, :]
            self.offered += int(fits.sum())
            for level, (mine, theirs) in enumerate(zip(self.levels, rows, strict=True)):
                if fits.mean() < SPARSE:
                    at, col = np.nonzero(fits)
                    stays = np.concatenate([np.zeros(0, bool), *[(bound := (mine[part][at[i : i + PAIRS_AT_ONCE]] * theirs[alive[col[i : i + PAIRS_AT_ONCE]]]).sum(axis=1)) + np.abs(bound) * 1e-9 + 1e-3 >= least[at[i : i + PAIRS_AT_ONCE], 0] for i in range(0, len(at), PAIRS_AT_ONCE)]])
                    fits[at[~stays], col[~stays]] = False
                else:
                    bound = mine[part] @ theirs[alive].T
                    fits &= bound + np.abs(bound) * 1e-9 + 1e-3 >= least
                stay = fits.any(axis=0)
                alive, fits = alive[stay], fits[:, stay]
                self.left[level] += int(fits.sum())
                if not len(alive):
                    break
            if not len(alive):
                continue
            at, col = np.nonzero(fits)
            if fits.mean() < SPARSE:
                score = np.concatenate([pairwise(self.q[part][at[i : i + PAIRS_AT_ONCE]], x[alive[col[i : i + PAIRS_AT_ONCE]]]) for i in range(0, len(at), PAIRS_AT_ONCE)])
            else:
                score = inner(self.q[part], x[alive])[at, col]
            good = score >= least[at, 0]
            self.merge(at[good] + lo, ids[alive[col[good]]], score[good])

    def merge(self, at: np.ndarray, ref: np.ndarray, score: np.ndarray) -> None:
        """Take in rows; of an id offered twice, its best score stays."""
        if not len(at):
            return
        touched = np.isin(self.at, at)
        a, r, s = (np.concatenate([old[touched], new]) for old, new in ((self.at, at), (self.ref, ref), (self.score, score)))
        order = np.lexsort((~s, r, a))
        a, r, s = a[order], r[order], s[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]
        a, r, s = a[first], r[first], s[first]
        order = np.lexsort((r, ~s, a))
        a, r, s = a[order], r[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        full = rank == self.k - 1
        self.floor[a[full]] = np.maximum(self.floor[a[full]], s[full])
        keep = rank < self.k
        self.at, self.ref, self.score = (np.concatenate([old[~touched], new[keep]]) for old, new in ((self.at, a), (self.ref, r), (self.score, s)))


def matrices(ids: pd.Series, vectors: pd.Series, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors of whole numbers), a group for each dimension."""
    sizes = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, int)
    for d in np.unique(sizes):
        pick = sizes == d
        x = np.stack([np.asarray(v, np.float64) for v in vectors[pick]])
        yield int(d), ids[pick].to_numpy(np.int64), np.floor(x * scale)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query by inner product of floor(scale * x).

    Every row is a candidate; rows where ``is_query`` holds are queries too, and never their own candidates. Ties go
    to the smaller id. Vectors (or ids) that are null, and vectors holding null, NaN or infinite components, take no
    part. Only vectors of one dimension are compared. An id that occurs twice counts once, with its best score; as a
    query, one of its vectors with most components, then the greatest, stands for it. Empty input: no rows.
    """
    ship(vectors.sparkSession)
    value = F.col(vector_col)
    sound = value.isNotNull() & F.col(id_col).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), value.cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    spark = vectors.sparkSession
    queries = rows.where("asks").groupBy("id").agg(F.max(F.struct(F.size("x").alias("d"), "x")).alias("v")).select("id", "v.x")
    asked = queries.agg(F.count("*").alias("n"), F.sum(8 * F.size("x")).alias("bytes")).first()
    passes = max(1, -(-asked["n"] // queries_per_pass), -(-(asked["bytes"] or 0) // QUERY_BYTES))
    if passes > 1:
        queries = materialize(queries, "queries")
    seeds = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SEEDS).toPandas()
    seeds = {d: (ids, x) for d, ids, x in matrices(seeds["id"], seeds["x"], scale)}

    found: list[DataFrame] = []
    for p in range(passes):
        own = (queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else queries).toPandas()
        of_size = {}
        for d, ids, q in matrices(own["id"], own["x"], scale):
            start = Best(ids, q, k)
            if d in seeds:
                start.offer(*seeds[d])
            of_size[d] = (start.ids, start.q, start.floor)
        sent = spark.sparkContext.broadcast(of_size)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best = {d: Best(ids, q, k, floor) for d, (ids, q, floor) in sent.value.items()}
            for pdf in batches:
                for d, ids, x in matrices(pdf["id"], pdf["x"], scale):
                    if d in best:
                        best[d].offer(ids, x)
            for b in best.values():
                yield pd.DataFrame({"query_id": b.ids[b.at], "vec_id": b.ref, "score": b.score})

        found.append(rows.select("id", "x").mapInPandas(scan, "query_id long, vec_id long, score long"))
        if passes > 1:
            found[-1] = materialize(found[-1], "topk")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
