"""Near-duplicate documents by MinHash, with links confirmed on full shingle sets.

* One-permutation hashing: the sorted 64-bit shingle hashes fall into bins by their top bits; the least of a bin is its
  value. Empty bins are filled by optimal densification: each draws bins in an order of its own until one is filled.
* Documents with equal sets form a class at once (by a 128-bit digest); everything after works on classes, which are
  numbered by a 64-bit hash of it. A class stands for its least doc_id only at the end.
* Bands of bins make buckets. Each bucket yields a star: edges from its class of the smallest doc_id to the others, so a bucket of n
  yields n - 1 candidates. Candidates are confirmed on full sets.
* A star can miss a link between two of its tips. Star edges make groups; groups whose classes are not all in one
  component after the first round are cut into blocks of a bounded size, and within a block all pairs are compared on
  full sets. A block yields a forest of links, fewer than it has classes.
* Components come from label propagation with pointer jumping over the links; nothing of it reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm._shared import discard, facts, materialize, small
from corrobora.ship import ship

#: Bins of a signature, and how many make a band. A pair at similarity 0.8 misses all bands with odds of 5e-8.
BINS, BAND = 128, 4
#: Classes in a block of the second round; bytes of the sketch that sort a group larger than that; orders in which one search cuts it.
WINDOW, KEY_BYTES, SEARCHES = 512, 16, 3
#: Ids that may be broadcast (24 MB of keys); beyond that the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: With the doc_id, tells texts apart where a doc_id repeats.
LOOK = "xxhash64(coalesce(text, ''))"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all of its input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; of fewer words, the one of them all; of none, empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        code = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i])
    return np.unique(code)


@cache
def draws(bins: int) -> np.ndarray:
    """For each bin, the order in which it tries others when it is empty."""
    with np.errstate(over="ignore"):
        seed = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(bins * 4) + np.arange(bins * 4, dtype=np.uint64)[None, :]
        return (mix(seed + np.uint64(0x51ED27)) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of a sorted non-empty set, empty bins densified."""
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[filled], full[filled] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = draws(bins)[empty]
        hit = full[tries]
        source = np.where(hit.any(axis=1), tries[np.arange(len(empty)), hit.argmax(axis=1)], filled[0])
        out[empty] = out[source]
    return out


def bands(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band; which band it is, is part of the key."""
    rows = sig.reshape(-1, band)
    with np.errstate(over="ignore"):
        key = np.arange(len(rows), dtype=np.uint64)
        for i in range(band):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> bytes:
    return (mix(sig) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, look, n_shingles, digest, bands, sketch) of every row: look is a hash of the text; digest, bands and sketch are null for an empty set."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part, out = pdf.iloc[lo : lo + 1000], []
                for text in part["text"]:
                    s = shingle_set(text, size)
                    if len(s):
                        sig = signature(s)
                        out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(sig), sketch(sig)))
                    else:
                        out.append((0, None, None, None))
                yield pd.DataFrame(out, columns=["n_shingles", "digest", "bands", "sketch"]).assign(doc_id=part["doc_id"].astype("Int64").to_numpy(), look=part["look"].to_numpy())[["doc_id", "look", "n_shingles", "digest", "bands", "sketch"]]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.expr(LOOK).alias("look"))
    return rows.mapInPandas(run, "doc_id long, look long, n_shingles long, digest binary, bands array<long>, sketch binary")


def sets_of(documents: DataFrame, classes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the classes in ``ids`` (a written table of distinct ids), each from the text of its least document.

    Texts stay where they are as long as the wanted ids can be broadcast; they were counted when they were written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                part = part[~part["id"].isin(done)].drop_duplicates("id")
                done.update(part["id"].tolist())
                yield pd.DataFrame({"id": part["id"].to_numpy(np.int64), "hashes": [shingle_set(t, size).tobytes() for t in part["text"]]})

    wanted = materialize(classes.select("id", "doc_id", "look").join(small(ids, BROADCAST_ROWS), "id"), "wanted")
    text = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(LOOK).alias("look"), F.coalesce("text", F.lit("")).alias("text"))
    texts = text.join(small(wanted, BROADCAST_ROWS), ["doc_id", "look"]).select("id", "text")
    out = materialize(texts.mapInPandas(run, "id long, hashes binary").dropDuplicates(["id"]), "sets")
    discard(wanted)
    return out


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets overlap by ``percent`` of their union; written to the shared folder.

    The sets of one side are dealt by its id, as is the star's hub, where Spark splits what is too large.
    """

    @F.pandas_udf("boolean")
    def linked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, other in parts:
            yield pd.Series([100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - both) for x, y in ((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(one, other, strict=True))], dtype=bool)

    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}"))
    return materialize(pairs.join(side("b"), "b").join(side("a"), "a").where(linked("ha", "hb")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id can reach. ``links``: (a, b); written to the shared folder.

    Every node points to its smallest neighbour, if that is smaller; pointers are followed twice, and edges drawn between
    what they point to. Edges inside one node go, so each round has far fewer of them, until none is left. While the
    pointers can be broadcast, a round has two exchanges; beyond that its joins are shuffled.
    """
    way = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(links.where("a <> b").select(*way("a", "b")).distinct(), "edges")
    found: DataFrame | None = None
    while facts(edges)["rows"] or found is None:
        point = materialize(edges.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "at"), "pointers")
        on = lambda c, v, point=point: small(point, BROADCAST_ROWS).select(F.col("at").alias(c), F.col("to").alias(v))
        for _ in range(2):
            ahead = materialize(point.join(on("to", "next"), "to", "left").select("at", F.coalesce("next", "to").alias("to")), "pointers")
            discard(point)
            point = ahead
            on = lambda c, v, point=point: small(point, BROADCAST_ROWS).select(F.col("at").alias(c), F.col("to").alias(v))
        new = point.select(F.col("at").alias("id"), F.col("to").alias("component"))
        all_ = new if found is None else found.join(on("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")).unionByName(new)
        labels = materialize(all_, "labels")
        moved = edges.join(on("b", "to_b"), "b").join(on("a", "to_a"), "a", "left").select(*way(F.coalesce("to_a", "a"), F.col("to_b"))).where("a <> b").distinct()
        fewer = materialize(moved, "edges")
        discard(*[x for x in (edges, point, found) if x is not None])
        edges, found = fewer, labels
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    out = materialize(found.unionByName(roots), "components")
    discard(edges, found)
    return out


def blocks_of(sorted_rows: DataFrame) -> DataFrame:
    """(id, group, component, block) of rows (id, group, component, n, order) that are sorted within partitions: cut into blocks of at
    most WINDOW rows, each named by its first row. Groups of up to WINDOW rows (n) are in one block each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, last = 0, 0, None
        for pdf in batches:
            out = np.empty(len(pdf), np.int64)
            for i, (id_, group, order, n) in enumerate(zip(pdf["id"].tolist(), pdf["group"].tolist(), pdf["order"].tolist(), pdf["n"].tolist(), strict=True)):
                if last is None or held >= WINDOW or ((order, group) != last and held + n > WINDOW):
                    block, held = int(mix(np.array([id_ ^ order], np.int64).view(np.uint64)).view(np.int64)[0]), 0
                out[i], held, last = block, held + 1, (order, group)
            yield pdf[["id", "group", "component"]].assign(block=out)

    return sorted_rows.mapInPandas(run, "id long, group long, component long, block long")


def cut_blocks(members: DataFrame, orders: range) -> DataFrame:
    """blocks_of() members (id, group, component, n, sketch). Groups above WINDOW rows are sorted by bytes of the sketch, once for each
    of ``orders``, so that like rows stand together."""
    first, large = F.lit(orders[0]), F.col("n") > WINDOW
    rows = members.withColumn("order", F.explode(F.when(large, F.array(*map(F.lit, orders))).otherwise(F.array(first))))
    key = F.when(large, F.expr(f"substring(sketch, 1 + `order` * {KEY_BYTES} % {BINS}, {KEY_BYTES})")).otherwise(F.lit(b""))
    return blocks_of(rows.withColumn("key", key).drop("sketch").repartitionByRange("order", "group", "key").sortWithinPartitions("order", "group", "key", "id"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of 0/1 rows over the elements that several sets hold."""
    element, many = np.unique(np.concatenate(sets), return_counts=True)
    element = element[many > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    place = [np.searchsorted(element, s) for s in sets]
    place = [p[(p < len(element)) & (element[np.minimum(p, len(element) - 1)] == s)] if len(element) else p[:0] for p, s in zip(place, sets, strict=True)]
    for lo in range(0, len(element), 8192):
        rows = np.zeros((len(sets), min(8192, len(element) - lo)), np.float32)
        for row, p in zip(rows, place, strict=True):
            row[p[slice(*np.searchsorted(p, (lo, lo + rows.shape[1])))] - lo] = 1
        out += rows @ rows.T
    return out


def links_in(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between different components of a group, as many as it takes to join what any pair of its rows joins."""
    root = {c: c for c in pdf["component"].tolist()}
    if len(root) < 2:
        return []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    ids, comp = pdf["id"].tolist(), pdf["component"].to_numpy()
    sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
    n = np.array([len(x) for x in sets], np.float64)
    both = overlaps(sets)
    fits = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] < comp[None, :])
    out = []
    for i, j in zip(*np.nonzero(fits), strict=True):
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[b] = a
            out.append((ids[i], ids[j]))
    return out


def tips(star: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, exact: bool = True) -> DataFrame:
    """Labels of all classes in the star (id, component), with the links that the stars miss: those between two tips.

    The star edges, confirmed or not, make groups; only groups that hold several components are searched. A group of up
    to WINDOW classes is one block, in which all pairs are compared on full sets. A larger group is cut into blocks in
    several orders; it is searched again, in other orders, as long as a search finds something new. A block emits fewer
    links than it has rows, and a search deals a class to as many blocks as it has orders. Whatever large group still has
    several components then is searched by all pairs of its blocks, unless ``exact`` is off.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, own in pdf.groupby("group", sort=True) for x in links_in(own.drop_duplicates("id").sort_values("id"), percent)]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    groups = components(star)
    state = materialize(groups.select("id", F.col("component").alias("group")).join(small(labels, BROADCAST_ROWS).select("id", "component"), "id", "left").select("id", "group", F.coalesce("component", "id").alias("component")), "state")
    discard(groups, labels)
    for search in range(0, BINS // KEY_BYTES, SEARCHES):
        per = state.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
        mixed = materialize((per.where(F.col("n") > WINDOW) if search else per).select("group", "n"), "mixed")
        if not facts(mixed)["rows"]:
            break
        members = materialize(state.join(small(mixed, BROADCAST_ROWS), "group"), "members")
        sketched = classes.select("id", "sketch").join(small(members, BROADCAST_ROWS), "id")
        blocks = materialize(cut_blocks(sketched, range(search, min(search + SEARCHES, BINS // KEY_BYTES))), "blocks")
        found = materialize(sets.join(small(blocks, BROADCAST_ROWS), "id").groupBy("block").applyInPandas(run, "a long, b long"), "tips")
        discard(mixed, members, blocks)
        if not facts(found)["rows"]:
            break
        state = merged(state, found)
    if exact:
        state = all_blocks(state, classes, sets, percent)
    return state


def merged(state: DataFrame, found: DataFrame) -> DataFrame:
    """``state`` (id, group, component) with the components joined that the links in ``found`` (a, b) join; both go."""
    # The links join components, which are fewer than classes.
    own = lambda c: state.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    joined = components(small(found, BROADCAST_ROWS).join(own("a"), "a").join(own("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    now = small(joined, BROADCAST_ROWS).select(F.col("id").alias("component"), F.col("component").alias("now"))
    after = materialize(state.join(now, "component", "left").select("id", "group", F.coalesce("now", "component").alias("component")), "state")
    discard(state, found, joined)
    return after


def all_blocks(state: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``state`` after a search that misses nothing: in a group above WINDOW that still has several components every block is
    compared with every other one, but for blocks of one and the same component and for those whose sets differ too much in size.

    Blocks have some WINDOW classes, however many partitions there are: a component above WINDOW has blocks of its own, the
    rest of the group shares blocks, both by the size of the sets. A group of n classes has (n / WINDOW)**2 / 2 pairs of
    blocks at most, which are rows of their own, dealt evenly; each holds some 2 * WINDOW sets and yields a forest of links.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(np.array(links_in(pdf.drop_duplicates("id").sort_values("id"), percent), np.int64).reshape(-1, 2), columns=["a", "b"])

    per = state.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where((F.col("low") < F.col("high")) & (F.col("n") > WINDOW))
    mixed = materialize(per.select("group", "n"), "mixed")
    if not facts(mixed)["rows"]:
        discard(mixed)
        return state
    inside = materialize(state.join(small(mixed, BROADCAST_ROWS), "group").drop("n"), "inside")
    rows = materialize(classes.select("id", "n_shingles").join(small(inside, BROADCAST_ROWS), "id"), "sized")
    whole = materialize(rows.groupBy("group", "component").agg(F.count("*").alias("n")).where(F.col("n") >= WINDOW).select("group", "component", F.col("component").alias("part")), "parts")
    # Sets of sizes two steps apart have no link.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent))) if percent < 100 else F.col("n_shingles")
    parted = rows.join(small(whole, BROADCAST_ROWS), ["group", "component"], "left").withColumn("step", step)
    many = materialize(parted.groupBy("group", "part", "step").agg(F.ceil(F.count("*") / WINDOW).alias("many")), "many")
    same = [F.col("group") == F.col("g"), F.col("part").eqNullSafe(F.col("p")), F.col("step") == F.col("s")]
    cuts = small(many, BROADCAST_ROWS).select(F.col("group").alias("g"), F.col("part").alias("p"), F.col("step").alias("s"), "many")
    members = materialize(parted.join(cuts, same).select("id", "group", "component", "n_shingles", F.xxhash64("group", "part", "step", F.pmod("id", "many")).alias("block")), "members")
    cut = materialize(members.groupBy("group", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")), "blocks")
    side = lambda c: cut.select("group", F.col("block").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("low", "high", "least", "most")])
    pairs = side("x").join(side("y"), "group").where("x <= y AND NOT (low_x = high_y AND high_x = low_y)").where(f"100 * most_x >= {percent} * least_y AND 100 * most_y >= {percent} * least_x")
    sides = pairs.select("group", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    found = materialize(members.join(sides, ["group", "block"]).select("id", "component", "group", "x", "y").join(sets, "id").groupBy("group", "x", "y").applyInPandas(run, "a long, b long"), "tips")
    discard(mixed, inside, rows, whole, many, members, cut)
    if not facts(found)["rows"]:
        discard(found)
        return state
    return merged(state, found)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, exact: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``documents``.

    Two documents are linked if their sets of ``size``-word shingles (ASCII lower case, words split at ASCII white
    space) share at least ``percent`` of their union. component_id is the smallest doc_id reachable over links; kept
    says that the row is it. Fewer words than ``size`` make one shingle of them all. Null and wordless texts have no
    shingles, link with nothing and are kept. A null doc_id takes no part in links: its component_id is null, it is
    kept. Repeated rows have one result each; rows of one doc_id with different texts are
    documents of their own that carry the same id. Empty input: no rows. Extra columns are not carried along.

    In groups of more than WINDOW classes links are looked for in a bounded number of orders first. Those that still have
    several components are searched by all pairs of blocks then, but for blocks of one component, so that no link is missed:
    at worst at a cost that grows with the square of the group. Without ``exact`` that search is left out.
    """
    return grouped(documents, size, percent, exact).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(documents: DataFrame, size: int, percent: int, exact: bool = True) -> DataFrame:
    """near_duplicates() with look and group: rows of one doc_id may be in several groups; rows without id or words are in none."""
    rows = materialize(signatures(documents, size), "signatures")
    known = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("digest").agg(F.min(F.struct("doc_id", "look")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("*", F.xxhash64("digest").alias("id"), "least.doc_id", "least.look").drop("least"), "classes")
    banded = classes.select("id", "doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("doc_id", "id", "n_shingles")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n_shingles").alias("n_hub"))
    fits = 100 * F.least("n_shingles", "n_hub") >= percent * F.greatest("n_shingles", "n_hub")
    edges = banded.drop("doc_id").join(hubs, "bucket").where(F.col("id") != F.col("hub"))
    star = materialize(edges.groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.first(fits).alias("fits")), "star")
    ids = materialize(star.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    sets = sets_of(documents, classes, ids, size)
    links = confirm(star.where("fits").select("a", "b"), sets, percent)
    labels = tips(star.select("a", "b"), classes, sets, components(links), percent, exact)
    discard(links, sets, ids)
    least = labels.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = materialize(classes.select("digest", "id", "doc_id").join(labels.join(least, "component").select("id", "component", "least"), "id", "left").select("digest", F.coalesce("component", "id").alias("group"), F.coalesce("least", "doc_id").alias("found")), "named")
    discard(classes, star, labels)
    out = rows.select("doc_id", "look", "n_shingles", "digest").join(named, "digest", "left")
    component, known = F.coalesce("found", "doc_id"), F.col("doc_id").isNotNull()
    return out.select("doc_id", "look", F.when(known, F.col("group")).alias("group"), "n_shingles", F.when(known, component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
