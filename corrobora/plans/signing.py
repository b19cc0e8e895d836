"""Signed records: canonical JSON and Ed25519 in the tasks, and a sink that takes a batch once."""

from __future__ import annotations

import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corrobora.functions import ed25519
from corrobora.functions.canonical import canonical
from corrobora.shared import spread
from corrobora.ship import ship
from corrobora.sources import committed


def signed(records: DataFrame, seed: bytes, record: str = "record") -> DataFrame:
    """``records`` with payload (``record``, a JSON text or a struct, in canonical form) and signature (base64url, no padding).

    The seed of 32 bytes goes to the tasks as a broadcast, so it is in no plan and no log. A record that is null or no JSON has
    neither payload nor signature.
    """
    spark = records.sparkSession
    ship(spark)
    key = spark.sparkContext.broadcast(seed)
    text = F.col(record) if dict(records.dtypes)[record] == "string" else F.to_json(record)

    @F.pandas_udf("payload string, signature string")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x: str | None) -> tuple:
            try:
                body = canonical(json.loads(x))
            except (TypeError, ValueError):
                return None, None
            return body, urlsafe_b64encode(ed25519.sign(key.value, body.encode("utf-8", "surrogatepass"))).decode().rstrip("=")

        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["payload", "signature"])

    return records.withColumn("__signed", sign(text)).select(*records.columns, "__signed.payload", "__signed.signature")


def verified(records: DataFrame, public: bytes, payload: str = "payload", signature: str = "signature") -> DataFrame:
    """``records`` with valid: whether the signature is one of the payload, whatever order its keys are in; false where either is missing."""
    ship(records.sparkSession)

    @F.pandas_udf("boolean")
    def check(payloads: pd.Series, signatures: pd.Series) -> pd.Series:
        def one(body: str | None, mark: str | None) -> bool:
            try:
                return ed25519.verify(public, canonical(json.loads(body)).encode("utf-8", "surrogatepass"), urlsafe_b64decode(mark + "=" * (-len(mark) % 4)))
            except (TypeError, ValueError):
                return False

        return pd.Series([one(b, m) for b, m in zip(payloads, signatures, strict=True)], dtype=bool)

    return spread(records).withColumn("valid", check(payload, signature))


def issue_once(batch: DataFrame, seed: bytes, path: str, name: str) -> None:
    """Signs the records of a batch into the log at ``path``, as one commit: a batch of this name that is there stays as it is."""
    committed.register(batch.sparkSession)
    if any(m["name"] == name for m in committed.manifests(path)):
        return
    signed(spread(batch), seed).write.format("committed_log").option("commit", name).mode("append").save(path)


def signed_sink(stream: DataFrame, seed: bytes, path: str, label: str) -> DataStreamWriter:
    """A writer that signs every batch of ``stream`` (with a column record) once, under ``label`` and its number.

    A batch that runs again after a failure finds its commit and adds nothing. Give it a checkpoint and start it.
    """
    committed.register(stream.sparkSession)
    return stream.writeStream.foreachBatch(lambda batch, n: issue_once(batch, seed, path, f"{label}-{n:012d}"))
