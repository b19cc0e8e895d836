"""Near-duplicate vectors by an epsilon grid order join over cosine.

* Vectors scaled to length 1 with a cosine of at least c are no farther apart than eps = sqrt(2 - 2c). Exact copies are
  one class from the start; everything after works on classes.
* Classes are sorted by the cells of a grid of side eps on their leading principal dimensions. The sequence is cut into
  intervals of a bounded number of bytes, each with the box that its projections fill; the length of what the projection
  leaves over is one more side of the box.
* The sequence joins itself recursively: a pair of intervals whose boxes are farther apart than eps is dropped, any other
  is cut into pairs of its parts. Down to the stored intervals these are joins of boxes; below, inside a task, halves of
  intervals, until blocks of a few hundred vectors are compared in full.
* A pair of intervals yields for each vector how many others it links with, and a forest of the links, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm._shared import broadcast_below, discard, facts, materialize, small
from corrobora.llm.neardup import BROADCAST_ROWS, components
from corrobora.ship import ship

#: Principal dimensions of the grid and of the boxes; vectors of the sample that they are fitted on, and its bytes at most.
LEAD, SAMPLE_ROWS, SAMPLE_BYTES = 8, 4_096, 64_000_000
#: Bytes of an interval (as stored), and of the part of the sequence that one task sorts.
INTERVAL_BYTES, SORTED_BYTES = 1_000_000, 64_000_000
#: Log2 of the parts of an interval at each level of the recursion; rows of a block that is compared in full.
FAN_BITS, BLOCK = 4, 256
#: Nodes of the boxes get this much closer, for what doubles round.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; none is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(u: np.ndarray, lead: int) -> np.ndarray:
    """The leading principal directions of the rows of ``u``, as columns."""
    return np.linalg.svd(u - u.mean(axis=0), full_matrices=False)[2][:lead].T.copy()


class Basis:
    """Directions by dimension; where the sample has none of a dimension, its first axes."""

    def __init__(self, found: dict[int, np.ndarray], lead: int):
        self.found, self.lead = found, lead

    def place(self, u: np.ndarray) -> np.ndarray:
        """Coordinates that are no farther apart than the unit vectors themselves: projections, and the length of the rest."""
        own = self.found.get(u.shape[1])
        on = u[:, : self.lead] if own is None else u @ own
        on = np.pad(on, ((0, 0), (0, self.lead - on.shape[1])))
        return np.hstack([on, np.sqrt(np.maximum(0.0, 1.0 - (on * on).sum(axis=1, keepdims=True)))])


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def merge_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, when links (a, b) come to components ``root``."""
    while len(a):
        ra, rb = root[a], root[b]
        new = ra != rb
        a, b = a[new], b[new]
        np.minimum.at(root, np.maximum(ra, rb)[new], np.minimum(ra, rb)[new])
        while True:
            ahead = root[root]
            if np.array_equal(ahead, root):
                break
            root = ahead
    return root


def links_exactly(x: np.ndarray, y: np.ndarray, percent: Fraction) -> bool:
    """Whether the cosine is ``percent`` or more, in whole-number arithmetic; for what doubles can't tell."""
    p, q = [Fraction(v) for v in x.tolist()], [Fraction(v) for v in y.tolist()]
    dot = sum(a * b for a, b in zip(p, q, strict=True))
    return (dot >= 0) == (percent >= 0) and (dot * dot - percent**2 * sum(a * a for a in p) * sum(b * b for b in q)) * (1 if percent >= 0 else -1) >= 0 or dot >= 0 > percent


class Interval:
    """The vectors of one interval, ready to be compared."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, basis: Basis):
        self.x, self.copies = x.astype(np.float64), copies
        self.u = unit(self.x)
        self.short = self.u.astype(np.float32)
        self.at = basis.place(self.u)
        self.links = np.zeros(len(x), np.int64)


def join_intervals(one: Interval, other: Interval, cosine: float, exact: Fraction) -> tuple[np.ndarray, int]:
    """(roots over the rows of both, blocks compared); links are counted in the intervals. ``other`` may be ``one`` itself."""
    same, reach = one is other, 2 - 2 * cosine + SLACK
    shift = 0 if same else len(one.u)
    root, done = np.arange(len(one.u) + (0 if same else len(other.u))), 0
    slack = 1e-6 + one.u.shape[1] * 2.4e-7
    todo = [(0, len(one.u), 0, len(other.u))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        p, q = one.at[alo:ahi], other.at[blo:bhi]
        if ahi <= alo or bhi <= blo or apart(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > reach:
            continue
        if max(ahi - alo, bhi - blo) > BLOCK:
            if same and (alo, ahi) == (blo, bhi):
                mid = (alo + ahi) // 2
                todo += [(alo, mid, alo, mid), (alo, mid, mid, ahi), (mid, ahi, mid, ahi)]
            elif ahi - alo >= bhi - blo:
                mid = (alo + ahi) // 2
                todo += [(alo, mid, blo, bhi), (mid, ahi, blo, bhi)]
            else:
                mid = (blo + bhi) // 2
                todo += [(alo, ahi, blo, mid), (alo, ahi, mid, bhi)]
            continue
        done += 1
        likely = one.short[alo:ahi] @ other.short[blo:bhi].T >= cosine - slack
        if same and alo == blo:
            likely = np.triu(likely, 1)
        i, j = np.nonzero(likely)
        if not len(i):
            continue
        if len(i) * 8 > likely.size:
            got = (one.u[alo:ahi] @ other.u[blo:bhi].T)[i, j]
        else:
            got = np.einsum("ij,ij->i", one.u[alo + i], other.u[blo + j])
        holds = got >= cosine
        for k in np.flatnonzero(np.abs(got - cosine) <= 1e-12 * len(one.u[0])):
            holds[k] = links_exactly(one.x[alo + i[k]], other.x[blo + j[k]], exact)
        i, j = i[holds] + alo, j[holds] + blo
        np.add.at(one.links, i, other.copies[j])
        np.add.at(other.links, j, one.copies[i])
        root = merge_roots(root, i, j + shift)
    return root, done


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, digest, d, x): the components as little-endian bytes and a digest of them; null for vectors that take no part."""
    value = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    wide, arrow = (("<f4", pa.float32()) if kind == "float" else ("<f8", pa.float64()))
    sound = value.isNotNull() & F.col(id_col).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, data = [], [], []
            for v in batch.column(1):
                x = None if not v.is_valid else (v.values.cast(arrow).to_numpy(zero_copy_only=False) + 0).astype(wide).tobytes()
                digest.append(x and sha256(x).digest())
                size.append(x and len(x) // int(wide[2]))
                data.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "digest", "d", "x"])

    simple = "array<float>" if kind == "float" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), value.cast(simple)).alias("x"))
    return rows.mapInArrow(run, "vec_id long, digest binary, d int, x binary")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", interval_bytes: int = INTERVAL_BYTES, lead: int = LEAD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Two vectors of one dimension are linked if their cosine is ``cosine`` or more, in doubles; where the double is within
    rounding of it, exact arithmetic decides. n_links counts the other rows linked directly, exact copies among them.
    component_id is the smallest id reachable over links, itself included; kept says that the row is it. Vectors that are
    null, empty, zero or hold null, NaN or infinite components link with nothing and are kept. A row without an id takes
    no part: no links, no component, kept. Rows of one id with different vectors are vectors of their own. Vectors of
    different dimensions are not compared. Extra columns are not carried along. Empty input: no rows.

    The basis is fitted on a bounded sample (SAMPLE_ROWS vectors by hash, SAMPLE_BYTES at most); it decides what is
    compared early or skipped, never what is linked. Nothing else reaches the driver but counts by task.
    """
    spark = vectors.sparkSession
    ship(spark)
    wide = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    matrix = lambda parts, d: np.frombuffer(b"".join(parts), wide).reshape(-1, int(d)).astype(np.float64)
    rows = prepared(vectors, id_col, vector_col)
    classes = materialize(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("d").alias("d"), F.first("x").alias("x")), "classes", widest=F.max("d"), bytes=F.sum(F.length("x")))
    seen = facts(classes)
    widest = seen["widest"] or 1
    sample = classes.select("d", "x").orderBy(F.xxhash64("digest"), "digest").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))).toPandas()
    basis = Basis({int(d): principal(unit(matrix(own["x"], d)), lead) for d, own in sample.groupby("d") if len(own) > lead}, lead)
    eps, exact = sqrt(max(2 - 2 * cosine, 1e-12)), Fraction(str(cosine))

    def with_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in pdf.groupby("d"):
                cells = np.clip(np.floor(basis.place(unit(matrix(own["x"], d)))[:, :-1] / eps) + 128, 0, 255).astype(np.uint8)
                yield own.assign(cell=[c.tobytes() for c in cells])

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, past = TaskContext.get().partitionId(), {}
        for pdf in batches:
            place = pdf.groupby("d").cumcount() + pdf["d"].map(past).fillna(0).astype(np.int64)
            for d, n in pdf["d"].value_counts().items():
                past[d] = past.get(d, 0) + int(n)
            yield pdf.drop(columns="cell").assign(part=part, place=place.astype(np.int64))

    shape = "digest binary, least long, copies long, d int, x binary"
    keyed = classes.mapInPandas(with_keys, f"{shape}, cell binary")
    tasks = max(1, -(-(seen["bytes"] or 0) // SORTED_BYTES))
    dealt = keyed.repartitionByRange(tasks, "d", "cell", "digest").sortWithinPartitions("d", "cell", "digest")
    ordered = materialize(dealt.mapInPandas(numbered, f"{shape}, part int, place long"), "ordered")
    discard(classes)

    # Places in the whole sequence: those in a task after all that stand in earlier tasks, dimension by dimension.
    held = ordered.groupBy("d", "part").agg(F.count("*").alias("n")).collect()
    before, past, start = [], 0, {}
    for r in sorted(held):
        before.append((r["d"], r["part"], past, start.setdefault(r["d"], past)))
        past += r["n"]
    bases = small(materialize(spark.createDataFrame(before, "d int, part int, base long, start long"), "bases"), BROADCAST_ROWS)
    per = F.greatest(F.lit(2), (F.lit(interval_bytes) / (int(wide[2]) * F.col("d"))).cast("long"))
    placed = ordered.join(bases, ["d", "part"]).withColumn("id", F.col("place") + F.col("base")).withColumn("no", F.floor((F.col("id") - F.col("start")) / per).cast("long"))

    def gathered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        at = basis.place(unit(matrix(pdf["x"], key[0])))
        return pd.DataFrame({"d": [key[0]], "no": [key[1]], "first": [pdf["id"].iloc[0]], "copies": [pdf["copies"].to_numpy("<i8").tobytes()], "x": [b"".join(pdf["x"])], "lo": [at.min(axis=0).tolist()], "hi": [at.max(axis=0).tolist()]})

    intervals = materialize(placed.select("d", "no", "id", "copies", "x").groupBy("d", "no").applyInPandas(gathered, "d int, no long, first long, copies binary, x binary, lo array<double>, hi array<double>"), "intervals", most=F.max("no"))

    # From one pair of everything with itself down to pairs of stored intervals, level by level.
    height = -(-int(facts(intervals)["most"] or 0).bit_length() // FAN_BITS)
    side = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(lead + 1)]).alias(c)
    levels = [intervals.select("d", "no", "lo", "hi")]
    for _ in range(height):
        levels.append(levels[-1].groupBy("d", F.shiftright("no", FAN_BITS).alias("no")).agg(side(F.min, "lo"), side(F.max, "hi")))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(lead)), F.lit(0.0), lambda a, i: a + F.pow(F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]), F.lit(2)))
    pairs = levels[-1].select("d", F.col("no").alias("a"), F.col("no").alias("b"))
    for level in reversed(levels[:-1]):
        child = lambda c, level=level: level.select("d", F.shiftright("no", FAN_BITS).alias(c), F.col("no").alias(f"no_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
        near = pairs.join(child("a"), ["d", "a"]).join(child("b"), ["d", "b"]).where((F.col("no_a") <= F.col("no_b")) & (gap <= 2 - 2 * cosine + SLACK))
        pairs = near.select("d", F.col("no_a").alias("a"), F.col("no_b").alias("b"))
    pairs = materialize(pairs, "pairs")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, a, b = key
        of = {r.no: r for r in pdf.itertuples()}
        sides = {no: Interval(np.frombuffer(r.x, wide).reshape(-1, int(d)), np.frombuffer(r.copies, "<i8"), basis) for no, r in of.items()}
        root, _ = join_intervals(sides[a], sides[b], cosine, exact)
        order = [a] if a == b else [a, b]
        ids = np.concatenate([of[no].first + np.arange(len(sides[no].u)) for no in order])
        links = np.concatenate([sides[no].links for no in order])
        got = links > 0
        return pd.DataFrame({"id": ids[got], "links": links[got], "root": ids[root][got]})

    sides = pairs.select("d", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("no"))
    parts = intervals.select("d", "no", "first", "copies", "x").join(broadcast_below(sides, 2 * facts(pairs)["rows"], BROADCAST_ROWS), ["d", "no"])
    found = materialize(parts.groupBy("d", "a", "b").applyInPandas(compared, "id long, links long, root long"), "found")
    discard(pairs, intervals)

    summed = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = placed.select("id", "digest", "least", "copies")
    group = labels.join(known.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("lowest"))
    grouped = labels.join(group, "component").select("id", "lowest")
    named = materialize(known.join(summed, "id", "left").join(grouped, "id", "left").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("lowest")), "named")
    discard(ordered, bases, found, labels)
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
