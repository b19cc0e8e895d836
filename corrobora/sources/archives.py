"""Archives and folders of uploads: members as rows of a lateral join, and as the partitions of a data source.

An archive is read by its directory first: what would make it a bomb is refused before anything is unpacked. Then its
members come out one at a time, each read in pieces up to the limit, whatever size it claims.
"""

from __future__ import annotations

import io
import stat
import sys
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corrobora.sources.uploads import LIMITS, PDF_PAGES, ignorable, kind_of, unsafe_path

#: A member is read in pieces of so many bytes. What one partition of a folder takes, in bytes as stored.
PIECE, PARTITION_BYTES = 1 << 16, 32_000_000


class Refused(Exception):
    """An archive that is not opened, and why."""


def opened(file: Any, limits: dict) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    """The archive in a seekable file, and its members; Refused if its directory says that it is no archive, too large or a bomb."""
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        raise Refused("bad_archive") from None
    infos = archive.infolist()
    if len(infos) > 4 * limits["files"]:
        raise Refused("too_many_entries")
    total = 0
    for e in (e for e in infos if not ignorable(e.filename) and not checked(e, limits)):
        if e.file_size > limits["ratio_from"] and e.file_size > limits["ratio"] * max(e.compress_size, 1):
            raise Refused("compression_bomb")
        total += e.file_size
        if total > limits["total"]:
            raise Refused("archive_too_large")
    return archive, infos


def checked(e: zipfile.ZipInfo, limits: dict) -> str:
    """Why a member is passed over by what the directory says of it; '' if it is not."""
    if why := unsafe_path(e.orig_filename):
        return why
    if stat.S_IFMT(e.external_attr >> 16) == stat.S_IFLNK:
        return "symlink"
    return "file_too_large" if e.file_size > limits["file"] else ""


def unpacked(archive: zipfile.ZipFile, e: zipfile.ZipInfo, limits: dict) -> tuple[bytes | None, str]:
    """(bytes, '') of a member, or (None, why not)."""
    out, size = [], 0
    try:
        with archive.open(e) as f:
            while piece := f.read(PIECE):
                size += len(piece)
                if size > limits["file"]:
                    return None, "file_too_large"
                out.append(piece)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, ValueError):
        return None, "unreadable_entry"
    except Exception as fault:  # zlib.error is no subclass of those
        if type(fault).__module__ != "zlib":
            raise
        return None, "unreadable_entry"
    data = b"".join(out)
    mime, why = kind_of(data)
    if why or not data:
        return None, why or "empty_file"
    return (None, "nested_archive") if mime == "application/zip" else (data, "")


def members(file: Any, limits: dict = LIMITS, first: int = 0, last: int | None = None) -> Iterator[tuple[int, str, bytes | None, str]]:
    """(number, path, bytes, reason) of the members ``first`` to ``last`` (not included) of an archive, one at a time.

    reason is '' for what is accepted. An archive that is refused as a whole has one row, number -1. Numbers are places in
    the directory; folders and the like have none.
    """
    try:
        archive, infos = opened(file, limits)
    except Refused as why:
        if first == 0:
            yield -1, "", None, str(why)
        return
    for n, e in enumerate(infos[first:last], first):
        if ignorable(e.filename) and not unsafe_path(e.orig_filename):
            continue
        why = checked(e, limits)
        data, why = (None, why) if why else unpacked(archive, e, limits)
        yield n, e.orig_filename.replace("\0", "\\0"), data, why


MEMBERS = "number int, entry string, content binary, reason string"


def archive_members(limits: dict = LIMITS):
    """A table function of an archive's bytes: MEMBERS, a row for each member as it is unpacked.

    Use it beside a table: ``files.lateralJoin(archive_members()(F.col("content").outer()))``. Null content has no rows.
    """

    class ArchiveMembers:
        def eval(self, content: bytes):
            if content is not None:
                yield from members(io.BytesIO(content), limits)

    return F.udtf(ArchiveMembers, returnType=MEMBERS)


PAGES = "page_number int, image binary, reason string"


def pdf_pages(render: Callable[[bytes], Iterator[bytes]], most: int = PDF_PAGES):
    """A table function of a PDF's bytes: (page_number, image, reason), a row for each page as ``render`` gives it.

    A PDF of more than ``most`` pages has one row instead, page_number 0 and pdf_too_many_pages, as one has that can't be
    rendered, pdf_failed: pages that came before are not given. Null content has no rows.
    """

    class PdfPages:
        def eval(self, content: bytes):
            if content is None:
                return
            pages = []
            try:
                for image in render(content):
                    if len(pages) == most:
                        yield 0, None, "pdf_too_many_pages"
                        return
                    pages.append(image)
            except Exception:  # whatever a renderer raises about a file that someone sent
                yield 0, None, "pdf_failed"
                return
            for n, image in enumerate(pages, 1):
                yield n, image, ""

    return F.udtf(PdfPages, returnType=PAGES)


# --- folders as a data source


@dataclass
class Slice(InputPartition):
    """Files, each whole (first and last are None) or some members of an archive."""

    files: list[tuple[str, int, int | None, int | None]]


FOUND = "upload string, path string, number int, entry string, mime string, bytes long, content binary, reason string"


class UploadFolder(DataSource):
    """``spark.read.format("upload_folder").load(path)``: FOUND, what lies in a folder, archives opened.

    A folder right below ``path`` is an upload; files right in it belong to the upload ''. number is the place of a member in
    its archive, 0 for a file of its own and -1 for an archive that is refused. bytes and content are null where there is a
    reason. ``path`` may be in any store that Arrow opens (file, s3, hdfs). Options: ``partitionBytes``, and the limits ``files``,
    ``file``, ``total``, ``ratio`` of uploads.LIMITS.
    """

    @classmethod
    def name(cls) -> str:
        return "upload_folder"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema: StructType) -> DataSourceReader:
        return UploadReader(self.options)


class UploadReader(DataSourceReader):
    """Plans partitions by bytes: small files together, the members of a large archive apart."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.limits = {k: int(options.get(k, v)) for k, v in LIMITS.items()}

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:/") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Slice]:
        """Sizes come from the listing, and from the directory of an archive that is larger than a partition; no content is read."""
        from pyarrow import fs

        store, root = self.store()
        held, size, out = [], 0, []
        for f in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if f.type != fs.FileType.File:
                continue
            for part, n in self.parts(store, f):
                if held and size + n > self.most:
                    out.append(Slice(held))
                    held, size = [], 0
                held.append((f.path, *part, f.size))
                size += n
        return [*out, Slice(held)] if held or not out else out

    def parts(self, store, f) -> Iterator[tuple[tuple[int | None, int | None], int]]:
        if f.size > self.most:
            with store.open_input_file(f.path) as file:
                if file.read(4) == b"PK\x03\x04":
                    file.seek(0)
                    try:
                        infos = opened(file, self.limits)[1]
                    except Refused:
                        infos = []
                    first, size = 0, 0
                    for n, e in enumerate(infos):
                        if size and size + e.compress_size > self.most:
                            yield (first, n), size
                            first, size = n, 0
                        size += e.compress_size
                    if infos:
                        yield (first, len(infos)), size
                        return
        yield (None, None), f.size

    def read(self, partition: Slice) -> Iterator[tuple]:
        store, root = self.store()
        for path, first, last, size in partition.files:
            name = path[len(root) :].lstrip("/") if path.startswith(root) else path
            upload = name.split("/")[0] if "/" in name else ""
            row = lambda n, entry, data, why, upload=upload, name=name: (upload, name, n, entry, kind_of(data)[0] if data else None, len(data) if data else None, data, why)
            with store.open_input_file(path) as file:
                head = file.read(4)
                file.seek(0)
                if head == b"PK\x03\x04":
                    for n, entry, data, why in members(file, self.limits, first or 0, last):
                        yield row(n, entry, data, why)
                elif size > self.limits["file"]:
                    yield row(0, "", None, "file_too_large")
                else:
                    data = file.read()
                    why = kind_of(data)[1] if data else "empty_file"
                    yield row(0, "", None if why else data, why)


def register(spark: SparkSession) -> None:
    """Makes ``upload_folder`` known to a session; what plans it need not find this package."""
    for name in ("corrobora.sources.archives", "corrobora.sources.uploads"):
        cloudpickle.register_pickle_by_value(sys.modules[name])
    spark.dataSource.register(UploadFolder)


def room(found: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """``found`` (FOUND) with the limits of each upload: accepted files count in the order of path and number.

    One that comes when so many files, or so many bytes, have been accepted has the reason max_files or max_total_bytes; what
    is refused takes no room, so a smaller one after it may fit.
    """
    from corrobora.operators import relational as rel

    ok = found.where("reason = ''")
    fits = rel.within_budget(ok.select("upload", "path", "number", "bytes"), ["upload"], "bytes", limits["total"], limits["files"], "path", "number")
    before = Window.partitionBy("upload").orderBy("path", "number").rowsBetween(Window.unboundedPreceding, -1)
    told = fits.withColumn("full", F.coalesce(F.count_if("fits").over(before), F.lit(0)) >= limits["files"]).select("upload", "path", "number", "fits", "full")
    why = F.when(F.col("fits").isNull() | F.col("fits"), F.col("reason")).when(F.col("full"), F.lit("max_files")).otherwise(F.lit("max_total_bytes"))
    kept = lambda c: F.when(why == "", F.col(c))
    return found.join(told, ["upload", "path", "number"], "left").select("upload", "path", "number", "entry", "mime", kept("bytes").alias("bytes"), kept("content").alias("content"), why.alias("reason"))


def zipped(names: Column, bodies: Column) -> Column:
    """The bytes of an archive of arrays of names and contents, for tests and for sending. Rows go to Python a hundred at a time,
    not as Arrow frames, which hold 10,000 of them whatever their size."""

    @F.udf("binary", useArrow=False)
    def pack(paths: list[str], contents: list[bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, data in zip(paths, contents, strict=True):
                info = zipfile.ZipInfo(path.removeprefix("link:"))
                info.compress_type = zipfile.ZIP_DEFLATED
                info.external_attr = (0o120777 if path.startswith("link:") else 0o100644) << 16
                z.writestr(info, bytes(data))
        return out.getvalue()

    return pack(names, bodies)


def saved(files: DataFrame, root: str) -> None:
    """Writes the rows of ``files`` (path, content) as files below ``root``, from the tasks; a task that runs again writes the same.

    Rows go to Python a hundred at a time, as in zipped().
    """

    @F.udf("boolean", useArrow=False)
    def write(path: str, content: bytes) -> bool:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (fs.LocalFileSystem(), root)
        store.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{at}/{path}") as f:
            f.write(bytes(content))
        return True

    files.select(write("path", "content").alias("written")).write.format("noop").mode("overwrite").save()
