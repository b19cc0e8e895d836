"""Joins, windows, set operators and store semantics over DataFrames. All are lazy and leave strategy to the optimiser."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in ``order``; give a total order for a fixed result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def best(df: DataFrame, keys: list[str], column: str, *by: Column) -> DataFrame:
    """``column`` of the row of each key that is greatest by ``by``: an aggregate, so nothing is sorted and partial results are small."""
    return df.groupBy(*keys).agg(F.max_by(column, F.struct(*by)).alias(column))


def margin(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(key, label, margin): the label with the highest score of each key (ties: the smaller) and what it is ahead of the next, or of nothing."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l")))), 1, 2)
    top = df.groupBy(key).agg(ranked.alias("r"))
    return top.select(key, F.col("r")[0]["l"].alias(label), (F.coalesce(F.get("r", F.lit(1))["s"], F.lit(0)) - F.col("r")[0]["s"]).cast("long").alias("margin"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the greatest sum of weights of each key (ties, to six places: the smaller)."""
    sums = df.groupBy(*keys, value).agg(F.round(F.sum(weight), 6).alias("__w"))
    return sums.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__w"), F.col(value))).alias(value))


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """``left`` with a column of ``right``, and ``default`` where ``right`` has no row or no value."""
    return left.join(right.select(key, F.col(column).alias("__v")), key, "left").withColumn(column, F.coalesce("__v", default)).drop("__v")


def first_in_batch(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Every row with ``route``: fresh for the first of its key, duplicate_in_upload for the rest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("route", F.when(rank == 1, F.lit("fresh")).otherwise(F.lit("duplicate_in_upload")))


def owned(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(owners.select(*keys), keys, "left_semi")


def foreign(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(owners.select(*keys), keys, "left_anti")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What an immutable store holds after ``rows`` came in: its own rows win, then the first of each new key (smallest row)."""
    new = rows.join(table.select(*keys), keys, "left_anti").select(*table.columns)
    return table.unionByName(latest(new, keys, *[F.col(c).asc_nulls_last() for c in table.columns]))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str], *order: Column) -> DataFrame:
    """Latest-wins by key; the columns in ``keep`` stay as they were in the table."""
    new = latest(rows, keys, *order)
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
    changed = new.join(old, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns])
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(changed)


def delete_insert(table: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows replace those of their key; a blank value only deletes."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.where(F.trim(F.coalesce(value, F.lit(""))) != "").select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], clear: str | None = None) -> DataFrame:
    """Non-null changes win; where the flag ``clear`` of a change is set, nulls win too."""
    new = changes.select(*keys, F.lit(True).alias("__hit"), *([F.col(clear).alias("__clear")] if clear else []), *[F.col(c).alias(f"__{c}") for c in columns])
    wipe = F.coalesce(F.col("__clear"), F.lit(False)) if clear else F.lit(False)
    return table.join(new, keys, "left").select(*[F.when(wipe, F.col(f"__{c}")).otherwise(F.coalesce(f"__{c}", c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def get_or_create(table: DataFrame, rows: DataFrame, key: str, make: Column, id_col: str) -> DataFrame:
    """The table with a row for every key in ``rows``; new ids are ``make``, a function of the key."""
    new = rows.select(key).distinct().join(table.select(key), key, "left_anti").withColumn(id_col, make)
    return table.select(id_col, key).unionByName(new.select(id_col, key))


def soft_delete(table: DataFrame, removed: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Marks rows as removed_by_user; nothing goes away, and reactivate() can bring a row back."""
    hit = removed.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return table.join(hit, keys, "left").withColumn("status", F.when(F.col("__hit"), F.lit("removed_by_user")).otherwise(F.col("status"))).withColumn("removed_at", F.when(F.col("__hit"), at).otherwise(F.col("removed_at"))).drop("__hit").select(*table.columns)


def reactivate(table: DataFrame, back: DataFrame, keys: list[str], status: Column) -> DataFrame:
    """Rows that were removed and are uploaded again live on as the same rows, with ``status``."""
    hit = back.select(*keys).distinct().withColumn("__hit", F.lit(True))
    gone = F.coalesce("__hit", F.lit(False)) & (F.col("status") == "removed_by_user")
    rows = table.join(hit, keys, "left").withColumn("removed_at", F.when(~gone, F.col("removed_at"))).withColumn("status", F.when(gone, status).otherwise(F.col("status")))
    return rows.select(*table.columns)


def revoke(records: DataFrame, requests: DataFrame, key: str, at: Column) -> DataFrame:
    """Records named in ``requests`` (key, reason) are revoked; one that is revoked already keeps its time and reason."""
    asked = requests.groupBy(key).agg(F.min("reason").alias("__reason")).withColumn("__hit", F.lit(True))
    now = F.coalesce("__hit", F.lit(False)) & (F.col("revoked") == 0)
    out = records.join(asked, key, "left")
    return out.withColumns({"revoked_at": F.when(now, at).otherwise(F.col("revoked_at")), "revoke_reason": F.when(now, F.col("__reason")).otherwise(F.col("revoke_reason")), "revoked": F.when(now, F.lit(1)).otherwise(F.col("revoked"))}).select(*records.columns)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """An append-only table with more rows; columns that the new rows lack are null."""
    missing = [c for c in table.columns if c not in rows.columns]
    return table.unionByName(rows.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in missing}).select(*table.columns) if missing else rows.select(*table.columns))


def blobs(store: DataFrame, rows: DataFrame, content: str = "content") -> DataFrame:
    """A store of contents by their SHA-256: putting one twice changes nothing."""
    new = rows.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), content).dropDuplicates(["hash"])
    return store.select("hash", content).unionByName(new.join(store.select("hash"), "hash", "left_anti").select("hash", content))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def audit(table: DataFrame, events: DataFrame, *order: str) -> DataFrame:
    """Appends events, numbered on from the last in the order of columns, which has to be total.

    Days are numbered apart and summed up, so no task sorts more than a day's events: ``order`` begins with a time.
    """
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    rows = events.withColumn("__day", F.to_date(order[0]))
    days = rows.groupBy("__day").agg(F.count("*").alias("__n")).select("__day", F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__day").orderBy(*order))
    days = days.withColumnRenamed("__day", "__of")
    numbered = rows.withColumn("__place", place).join(F.broadcast(days), F.col("__day").eqNullSafe(F.col("__of"))).crossJoin(F.broadcast(last)).withColumn("id", F.col("__place") + F.col("__base") + F.col("__last"))
    return table.unionByName(numbered.select(*table.columns))


def within_budget(df: DataFrame, keys: list[str], size: str, most: float, files: int, *order: str) -> DataFrame:
    """``df`` with ``fits``: items of each key in order, each taken if it and all taken before it stay within both limits.

    An item that does not fit takes no room, so smaller ones after it may. Rows are sorted by the columns in ``order`` and
    streamed, with two numbers held for the key at hand.
    """
    names = [*df.columns, "fits"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, n = None, 0, 0
        for pdf in batches:
            fits = []
            for k, v in zip(pdf[keys].itertuples(index=False, name=None), pdf[size].tolist(), strict=True):
                if k != key:
                    key, total, n = k, 0, 0
                ok = n < files and total + v <= most
                total, n = (total + v, n + 1) if ok else (total, n)
                fits.append(ok)
            yield pdf.assign(fits=fits)[names]

    schema = T.StructType([*df.schema.fields, T.StructField("fits", T.BooleanType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def merge_readings(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two readings (raw, evidenced): agreement verifies, the evidenced side wins a difference, else both stay uncertain."""
    a = primary.select(*keys, F.col("raw").alias("a"), F.col("evidenced").alias("ea"))
    b = secondary.select(*keys, F.col("raw").alias("b"), F.col("evidenced").alias("eb"))
    fold = lambda c: F.upper(F.trim(c))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    rows = a.join(b, keys, "full_outer")
    both, same = has(F.col("a")) & has(F.col("b")), fold(F.col("a")) == fold(F.col("b"))
    ea, eb = (F.coalesce(c, F.lit(False)) for c in ("ea", "eb"))
    status = F.when(both & same, F.lit("present_verified")).when(both & (ea != eb), F.lit("present_verified")).when(both, F.lit("present_uncertain")).when(has(F.col("a")) & ea | has(F.col("b")) & eb, F.lit("present_verified")).when(has(F.col("a")) | has(F.col("b")), F.lit("present_uncertain")).otherwise(F.lit("not_present"))
    confidence = F.when(both & same, F.lit(0.95)).when(both & (ea != eb), F.lit(0.6)).when(both, F.lit(0.3)).when(status == "present_verified", F.lit(0.8)).otherwise(F.lit(0.3))
    value = F.when(both & ~same & eb & ~ea, F.col("b")).otherwise(F.coalesce(F.when(has(F.col("a")), F.col("a")), F.col("b")))
    return rows.select(*keys, value.alias("value"), status.alias("status"), confidence.alias("confidence"))
