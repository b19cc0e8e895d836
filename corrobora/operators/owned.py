"""Tables that are read by their owner only: bucketed by owner, so that one owner's rows are one bucket and owners meet without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.shared import shared_path

#: Buckets of a table. Tables of as many buckets are joined by owner where they lie.
BUCKETS = 64


class Owned:
    """A stored table every row of which has an owner. There is no way to its rows that does not name one, or bring a table of them.

    Rows of one owner are one bucket, so an owner's share bounds a task; tables where that is too much are better bucketed by
    another key and joined. The session is told that tables dealt by a part of a join's keys need not be dealt again.
    """

    def __init__(self, spark: SparkSession, name: str, owner: str):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.spark, self.name, self.owner = spark, name, owner

    @classmethod
    def store(cls, rows: DataFrame, owner: str, label: str, buckets: int = BUCKETS) -> Owned:
        """Writes ``rows`` in buckets by ``owner``, each sorted by it; rows that nobody owns are refused, as nobody could read them."""
        spark, name = rows.sparkSession, f"{label}_{uuid.uuid4().hex}"
        checked = rows.withColumn(owner, F.when(F.col(owner).isNull(), F.raise_error(F.lit(f"a row of {label} has no {owner}"))).otherwise(F.col(owner)))
        checked.repartition(buckets, owner).write.bucketBy(buckets, owner).sortBy(owner).option("path", shared_path(spark, label)).saveAsTable(name)
        return cls(spark, name, owner)

    def of(self, owner, *where: Column) -> DataFrame:
        """The rows of one owner: one bucket is read."""
        if owner is None:
            raise ValueError(f"{self.name} is read by {self.owner}")
        out = self.spark.table(self.name).where(F.col(self.owner) == F.lit(owner))
        for c in where:
            out = out.where(c)
        return out

    def newest(self, owner, at: str, ident: str) -> DataFrame:
        """The rows of one owner, the newest first; ties by id."""
        return self.of(owner).orderBy(F.desc(at), F.asc(ident))

    def named(self, requests: DataFrame, *keys: str) -> DataFrame:
        """The rows that ``requests`` (owner and ``keys``) name, each once: a key under another owner's name finds nothing."""
        return self.spark.table(self.name).join(requests.select(self.owner, *keys), [self.owner, *keys], "left_semi")

    def beside(self, other: Owned, *keys: str, how: str = "inner") -> DataFrame:
        """Rows of two tables of one owner (and equal ``keys``), joined bucket by bucket."""
        if self.owner != other.owner:
            raise ValueError(f"{self.name} and {other.name} have different owners")
        return self.spark.table(self.name).join(self.spark.table(other.name), [self.owner, *keys], how)

    def per_owner(self, *made: Column) -> DataFrame:
        """Aggregates of each owner's rows, without an exchange."""
        return self.spark.table(self.name).groupBy(self.owner).agg(*made)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
