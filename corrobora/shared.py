"""Files that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset in a local session, as in tests, in a temporary folder; on a cluster that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='corrobora-')}"
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/engine/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt evenly over all cores by ``by``, for rows that cost much: a small file is one task else, however long its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


#: Rows of a partition, where a row becomes several wide ones that are sorted in memory.
PARTITION_ROWS = 100_000


def parts_of(df: DataFrame) -> int:
    """Partitions for the rows of ``df``, a table as it lies in files: as many as there are rows for, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PARTITION_ROWS))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
