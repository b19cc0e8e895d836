"""Packing into length buckets whose boundaries minimise padding, and token-budget batches inside each bucket.

A bucket pads its rows to its longest length. Over the global histogram of lengths, dynamic programming finds the
boundaries with the least padding for a number of buckets; the recurrence is a minimum of lines, so each layer takes
one sweep along a lower hull. The histogram holds every distinct length exactly. It is bounded by the corpus itself: D
distinct lengths take D * D / 2 tokens at least, so 10^13 tokens have under 4.5 million of them, and usual texts far fewer.

Batches hold as many rows as the budget allows at the bucket's length. A row's place in its bucket is exact and needs no
task to see the bucket: rows are dealt to shards evenly, shard sizes are summed up in order in two levels, and a row adds
its number inside its shard. So all batches but the last of a bucket are full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm._shared import materialize

#: Rows that a shard of a bucket holds on average, and shards summed up together.
SHARD_ROWS, SPAN = 512, 4_096
#: Production parameters: buckets, and padded tokens in a batch.
BUCKETS, TOKEN_BUDGET = 16, 65_536


def n_words(text: Column) -> Column:
    """Words of a text, split at ASCII white space, and one end token; 1 for null and empty texts."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, ascending, that minimise the sum of padded lengths with at most ``buckets`` buckets."""
    order = np.argsort(lengths)
    size, many = [int(v) for v in lengths[order]], [0, *np.cumsum(counts[order]).tolist()]
    n = len(size)
    if n <= buckets:
        return size
    cost = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(buckets):
        # cost[i] - many[i] * x, at x = size[j - 1]: slopes fall and queries rise along i, so a deque of lines does.
        hull: list[tuple[int, int, int]] = []
        head, new, came = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                m, b = -many[j - 1], cost[j - 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            x = size[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, came[j] = hull[head]
                new[j] = m * x + b + x * many[j]
        cost = [None, *new[1:]]
        back.append(came)
    out, j = [], n
    for came in reversed(back):
        out.append(size[j - 1])
        j = came[j]
        if not j:
            break
    return out[::-1]


def pack(documents: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, padding, batch, place): one row for each row of ``documents``.

    ``length`` is a column of token counts (words and an end token if not given; null and less than 1 count as 1).
    bucket_tokens is the length to which the bucket pads, its largest n_tokens; batch numbers the batches of a bucket from
    0, place the rows of a batch. A row longer than ``budget`` is a batch of its own. Repeated rows are rows of their
    own; null doc_ids are packed like others. Which shard a row falls in depends on where it stands in the written table,
    so no id or length, however frequent, makes a large shard. Empty input: no rows. Extra columns are not carried along.
    """
    n = F.greatest(F.coalesce((n_words(F.col("text")) if length is None else length).cast("long"), F.lit(1)), F.lit(1))
    rows = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    seen = rows.groupBy("n_tokens").count().toArrow()
    if not len(seen):
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_tokens", "padding", "batch", "place")])
    lengths, counts = (np.asarray(seen[c], np.int64) for c in ("n_tokens", "count"))
    tops = boundaries(lengths, counts, buckets)
    many = np.bincount(np.searchsorted(tops, lengths), counts, len(tops)).astype(int)
    bucket = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t < F.col("n_tokens")))
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    dealt = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("row"), pick(np.maximum(-(-many // SHARD_ROWS), 1))))
    span = F.floor(F.col("shard") / SPAN).alias("span")
    sum_before = lambda what, by, order: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = materialize(dealt.groupBy("bucket", "shard").count().select("bucket", "shard", span, "count"), "shards")
    spans = shards.groupBy("bucket", "span").agg(F.sum("count").alias("n")).select("bucket", "span", sum_before("n", ["bucket"], "span").alias("base"))
    sizes = shards.join(spans, ["bucket", "span"]).select("bucket", "shard", (F.col("base") + sum_before("count", ["bucket", "span"], "shard")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "row")) - 1
    at = F.col("before") + F.col("within")
    per_batch = pick([max(1, budget // t) for t in tops])
    placed = dealt.withColumn("within", within).join(sizes, ["bucket", "shard"]).withColumn("bucket_tokens", pick(tops))
    return placed.select("doc_id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bucket_tokens", (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"), F.floor(at / per_batch).cast("long").alias("batch"), (at % per_batch).cast("long").alias("place"))
