"""What the operators share: table access, hand-over files, deterministic row splits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corrobora.ship import ship

#: ASCII white space; the words of a text are what it leaves when split there.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset in a local session, as in tests, a temporary folder takes its place for the life of the process.
    On a cluster that is an error: executors would write where nobody else can read.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='corrobora-')}"
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corrobora/{label}-{uuid.uuid4().hex}"


#: Folders of materialize() that still stand, and the folder of each table.
_standing: dict[str, SparkSession] = {}
_folder: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_facts: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def materialize(df: DataFrame, label: str, **seen: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing.

    The rows are counted on the way, and the aggregates in ``seen`` computed: facts() has them without another job.
    """
    path, counted = fresh_path(df.sparkSession, label), Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in seen.items()]).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folder[out], _standing[path], _facts[out] = path, df.sparkSession, counted.get
    return out


def facts(table: DataFrame) -> dict:
    """``rows`` of a table of materialize(), and what else was asked for."""
    return _facts[table]


def small(table: DataFrame, limit: int) -> DataFrame:
    """A table of materialize() marked for broadcast if it has ``limit`` rows at most; else as it is, for a shuffled join."""
    return broadcast_below(table, facts(table)["rows"], limit)


def remove(path: str) -> None:
    if spark := _standing.pop(path, None):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := _folder.pop(table, None):
            remove(path)


@contextmanager
def intermediates() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what materialize() writes inside, but for the tables handed to the function that it gives."""
    before, kept = set(_standing), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_folder.get(table))
        return table

    yield keep
    for path in set(_standing) - before - kept:
        remove(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def broadcast_below(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
