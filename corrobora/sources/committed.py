"""Tables that grow by commits: a data source whose writers commit in two phases, and a store of contents upon it.

A task writes one segment, which nobody reads until a manifest names it. The driver writes the manifest when all tasks are
done: that one file is the commit. What a failed task wrote it deletes, and the driver what else its job wrote and did not
commit; a task that is done only after its job was given up finds that marked and deletes its segment. What a task leaves
that is killed half-way, or a machine that is lost, stays unread until vacuum(). A commit that has a name happens once.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a segment that are written at once.
GROUP_ROWS = 10_000


def store_of(path: str):
    """(file system, path in it) of a path or an address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def names_in(path: str, folder: str) -> list[str]:
    from pyarrow import fs

    store, root = store_of(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File)


def manifests(path: str) -> list[dict]:
    """All commits of a table, in order."""
    store, root = store_of(path)
    out = []
    for name in names_in(path, "manifests"):
        if name.endswith(".json"):
            with store.open_input_file(f"{root}/manifests/{name}") as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: (m["at"], m["name"]))


@dataclass
class Segment(WriterCommitMessage):
    """What a task wrote: its file (none without rows), rows, and the least and greatest value of the key column."""

    file: str = ""
    rows: int = 0
    low: str | None = None
    high: str | None = None


class Commit:
    """What writers of batches and of streams share. ``key`` is a string column by whose range readers pass over segments."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key, self.name, self.schema = options["path"], options.get("key"), options.get("commit"), schema
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Segment:
        """One segment of what a task has; nothing of it stays if the task fails."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, root = store_of(self.path)
        store.create_dir(f"{root}/segments", recursive=True)
        self.refuse_late()
        out, file, into = Segment(), f"{self.job}-{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if into is None:
                    into = pq.ParquetWriter(f"{root}/segments/{file}", batch.schema, filesystem=store, compression="zstd")
                    out.file = file
                into.write_table(pa.Table.from_batches([batch]), row_group_size=GROUP_ROWS)
                out.rows += batch.num_rows
                if self.key:
                    ends = pc.min_max(batch.column(self.key)).as_py()
                    out.low = min((x for x in (out.low, ends["min"]) if x is not None), default=None)
                    out.high = max((x for x in (out.high, ends["max"]) if x is not None), default=None)
            if into is not None:
                into.close()
            self.refuse_late()
        except BaseException:
            if into is not None:
                into.close()
                if file in names_in(self.path, "segments"):
                    store.delete_file(f"{root}/segments/{file}")
            raise
        return out

    def refuse_late(self) -> None:
        """Ends a task whose job was given up. The mark is set before segments are listed and deleted, and looked for after a segment is
        closed, so one of the two sees it."""
        if self.job in names_in(self.path, "aborted"):
            raise RuntimeError("the job was aborted")

    def give_up(self) -> None:
        store, root = store_of(self.path)
        store.create_dir(f"{root}/aborted", recursive=True)
        with store.open_output_stream(f"{root}/aborted/{self.job}"):
            pass
        self.undo()

    def publish(self, messages: list[Segment | None], name: str | None) -> bool:
        """Writes the manifest; False, and what was written goes, if a commit of this name is there."""
        store, root = store_of(self.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        if name is not None and f"{name}.json" in names_in(self.path, "manifests"):
            self.undo()
            return False
        name = name or f"{time.time_ns():020d}-{self.job}"
        body = {"name": name, "at": time.time_ns(), "schema": self.schema.json(), "key": self.key, "segments": [asdict(m) for m in messages if m is not None and m.file]}
        with store.open_output_stream(f"{root}/manifests/{name}.{self.job}.part") as f:
            f.write(json.dumps(body).encode())
        store.move(f"{root}/manifests/{name}.{self.job}.part", f"{root}/manifests/{name}.json")
        self.undo()
        return True

    def undo(self) -> None:
        """Deletes what tasks of this job wrote and no manifest names: of attempts that were lost, or of all if nothing was committed."""
        store, root = store_of(self.path)
        named = {s["file"] for m in manifests(self.path) for s in m["segments"]}
        for file in names_in(self.path, "segments"):
            if file.startswith(f"{self.job}-") and file not in named:
                store.delete_file(f"{root}/segments/{file}")


class BatchWriter(Commit, DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        Commit.__init__(self, options, schema)

    def commit(self, messages: list[Segment | None]) -> None:
        self.publish(messages, self.name)

    def abort(self, messages: list[Segment | None]) -> None:
        self.give_up()


class StreamWriter(Commit, DataSourceStreamArrowWriter):
    """A commit for each batch, named by the stream and the batch: one that is done again adds nothing."""

    def __init__(self, options: dict[str, str], schema: StructType):
        Commit.__init__(self, options, schema)

    def commit(self, messages: list[Segment | None], batchId: int) -> None:
        self.publish(messages, f"{self.name or 'stream'}-{batchId:012d}")

    def abort(self, messages: list[Segment | None], batchId: int) -> None:
        self.undo()  # the next batch is of the same job


@dataclass
class Files(InputPartition):
    at: int
    name: str
    segments: list[str]


class LogReader(DataSourceReader):
    """A partition for each segment; those whose range of the key holds no value that is asked for are not read."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns, self.asked = options["path"], [f.name for f in schema.fields], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        keys = {m["key"] for m in manifests(self.path)}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and keys == {".".join(f.attribute)}:
                self.asked = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            yield f  # rows are still to be compared

    def partitions(self) -> list[Files]:
        wanted = lambda s: self.asked is None or any(s["low"] is not None and s["low"] <= v <= s["high"] for v in self.asked)
        return [Files(m["at"], m["name"], [s["file"]]) for m in manifests(self.path) for s in m["segments"] if wanted(s)] or [Files(0, "", [])]

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, root = store_of(self.path)
        for file in partition.segments:
            with pq.ParquetFile(f"{root}/segments/{file}", filesystem=store) as source:
                for batch in source.iter_batches(GROUP_ROWS):
                    extra = {"commit_at": pa.array([partition.at] * batch.num_rows, pa.int64()), "commit_name": pa.array([partition.name] * batch.num_rows, pa.string())}
                    names = batch.schema.names
                    yield pa.RecordBatch.from_arrays([extra[c] if c in extra else batch.column(names.index(c)) for c in self.columns], names=self.columns)


class CommittedLog(DataSource):
    """``df.write.format("committed_log").mode("append").save(path)``, ``spark.read.format("committed_log").load(path)``.

    Reading gives the columns written (those of the last commit) with commit_at (nanoseconds) and commit_name. Options of
    writers: ``commit``, the name of a commit that happens once (of a stream: what its batches are called), and ``key``, a string
    column by which segments are passed over when it is compared for equality.
    """

    @classmethod
    def name(cls) -> str:
        return "committed_log"

    def schema(self) -> StructType:
        found = manifests(self.options["path"])
        if not found:
            raise ValueError(f"nothing was committed to {self.options['path']}")
        return StructType.fromJson(json.loads(found[-1]["schema"])).add("commit_at", "long").add("commit_name", "string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a committed log is only appended to")
        return BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes ``committed_log`` known to a session, which may push filters to it; what plans it need not find this package."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CommittedLog)


def vacuum(path: str, older_than: float = 86_400) -> int:
    """Deletes segments that no manifest names, and marks of jobs that were given up, if they are older than so many seconds; returns
    how many segments."""
    store, root = store_of(path)
    named, gone = {s["file"] for m in manifests(path) for s in m["segments"]}, 0
    for folder in ("segments", "aborted"):
        for name in names_in(path, folder):
            if name not in named and time.time() - store.get_file_info(f"{root}/{folder}/{name}").mtime.timestamp() >= older_than:
                store.delete_file(f"{root}/{folder}/{name}")
                gone += folder == "segments"
    return gone


# --- contents by their hash


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(hash, content) of what the store at ``path`` holds now."""
    register(spark)
    if not manifests(path):
        return spark.createDataFrame([], "hash string, content binary")
    rows = spark.read.format("committed_log").load(path)
    return rows.groupBy("hash").agg(F.max_by("content", F.struct("commit_at", "commit_name")).alias("content")).where("content IS NOT NULL")


def put(rows: DataFrame, path: str, content: str = "content") -> None:
    """Adds contents that the store does not hold, each once, under their SHA-256; null contents are passed over."""
    spark = rows.sparkSession
    data = F.col(content).cast("binary")
    new = rows.where(F.col(content).isNotNull()).select(F.sha2(data, 256).alias("hash"), data.alias("content")).dropDuplicates(["hash"])
    new = new.join(blobs(spark, path).select("hash"), "hash", "left_anti")
    new.sortWithinPartitions("hash").write.format("committed_log").option("key", "hash").mode("append").save(path)


def remove(hashes: DataFrame, path: str) -> None:
    """Takes contents out; hashes that are not there change nothing. A content may be put again."""
    have = blobs(hashes.sparkSession, path).select("hash")
    gone = hashes.select("hash").distinct().join(have, "hash", "left_semi").select("hash", F.lit(None).cast("binary").alias("content"))
    gone.write.format("committed_log").option("key", "hash").mode("append").save(path)


def find(spark: SparkSession, path: str, hashes: list[str]) -> DataFrame:
    """(hash, content) of a few hashes; segments that cannot hold them are not read."""
    return blobs(spark, path).where(F.col("hash").isin(*hashes))
